"""Terms as numbers.

A term's id is its 64-bit hash, so triples are encoded where they lie and a rerun gives the same ids. The
dictionary is one aggregation over the graph. Terms that share a hash are found in it; all of them but the
least get an id of their own, and only these few are looked up when triples are encoded.

The dictionary says how often a term is subject, predicate and object. Decoding broadcasts the frequent ones; the
rows they answer are spread evenly through the shuffled joins that look up the others. Predicates come last, so
that their text is not shuffled; all those in use are broadcast unless they are very many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions.terms import TRIPLE, is_bnode, is_literal
from kgweave.plans.skew import HEAVY_SHARE
from kgweave.plans.workspace import BROADCAST_ROWS, Stored, store, union_all


def _counted(rows: DataFrame, name: str) -> DataFrame:
    """``(name, n_s, n_p, n_o)``: how often each term or id is subject, predicate and object."""
    places = rows.select(F.explode(F.array(*[
        F.struct(F.col(c).alias(name), F.lit(c).alias("place")) for c in TRIPLE
    ])).alias("e")).select("e.*")
    return places.groupBy(name).agg(*[
        F.count(F.when(F.col("place") == c, 1)).alias(f"n_{c}") for c in TRIPLE
    ])


def _own_ids(named: Stored, hashed: Callable[..., Column]) -> Stored:
    """``(term, own)``: new ids for all terms of a shared id but the least, none of them taken."""
    shared = store(named.df.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("id"))
    if shared.empty:
        return Stored(named.df.select("term", F.col("id").alias("own")).where("false"), 0)
    least = named.df.join(shared.side(), "id", "left_semi").groupBy("id").agg(F.min("term").alias("least"))
    waiting = store(named.df.join(shared.side(least), "id").where(F.col("term") != F.col("least")).select("term"))
    settled, tries = [waiting.df.select("term", F.lit(0).cast("long").alias("own")).where("false")], 0
    while not waiting.empty:
        tries += 1
        tried = waiting.df.select("term", hashed(F.lit(tries), F.col("term")).alias("own"))
        free = tried.join(named.df.select(F.col("id").alias("own")), "own", "left_anti")
        free = free.join(union_all(settled).select("own"), "own", "left_anti")
        found = store(free.groupBy("own").agg(F.min("term").alias("term")).select("term", "own"))
        settled.append(found.df)
        waiting = store(waiting.df.join(found.side(), "term", "left_anti"))
    return store(union_all(settled))


def encode_terms(graph: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """``(s, p, o)`` of ids, and the dictionary ``(id, term, kind, n_s, n_p, n_o)``.

    ``kind`` is 0 for IRIs, 1 for blank nodes and 2 for literals, so a literal test on encoded
    triples joins kinds, not texts. Ids are unique, neither consecutive nor in order. ``hashed`` makes
    a BIGINT of columns. Triples with a null are passed over, repeated ones are kept.
    """
    graph = graph.select(*TRIPLE).dropna()
    kind = F.when(is_literal(F.col("term")), 2).when(is_bnode(F.col("term")), 1).otherwise(0)
    named = store(_counted(graph, "term").select(
        hashed(F.col("term")).alias("id"), "term", kind.cast("tinyint").alias("kind"), *[f"n_{c}" for c in TRIPLE]))
    moved = _own_ids(named, hashed)
    if moved.empty:
        return graph.select(*[hashed(F.col(c)).alias(c) for c in TRIPLE]), named.df
    dictionary = store(
        named.df.join(moved.side(), "term", "left")
        .withColumn("id", F.coalesce("own", "id")).select(*named.df.columns))
    encoded = graph
    for c in TRIPLE:
        encoded = (
            encoded.join(moved.side(moved.df.select(F.col("term").alias(c), "own")), c, "left")
            .withColumn(f"{c}_", F.coalesce("own", hashed(F.col(c)))).drop("own"))
    return encoded.select(*[F.col(f"{c}_").alias(c) for c in TRIPLE]), dictionary.df


def decode_terms(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Triples of terms; rows with an id that the dictionary does not have are left out."""
    result, known = encoded.select(*TRIPLE), Stored(dictionary, dictionary.count())
    small = known.rows <= BROADCAST_ROWS
    limits = {} if small else dictionary.agg(*[F.greatest(F.lit(1), F.floor(F.sum(f"n_{c}") / HEAVY_SHARE)).alias(c) for c in TRIPLE]).first()
    # As the dictionary may be of another graph, its counts do not tell which predicates there are.
    used = None if small else store(encoded.select(F.col("p").alias("id")).distinct())
    for c in ("s", "o", "p"):
        frequent = dictionary if small else dictionary.where(F.col(f"n_{c}") > limits[c])  # at most HEAVY_SHARE ids
        whole = small or (c == "p" and used.rows <= BROADCAST_ROWS)
        if whole and not small:
            frequent = dictionary.join(F.broadcast(used.df), "id", "left_semi")
        names = frequent.select(F.col("id").alias(c), F.col("term").alias(f"{c}_"))
        result = result.join(F.broadcast(names), c, "left")
        if not whole:
            result = _look_up_rest(result, c, dictionary.where(F.col(f"n_{c}") <= limits[c]))
    return result.dropna(subset=[f"{c}_" for c in TRIPLE]).select(*[F.col(f"{c}_").alias(c) for c in TRIPLE])


def _look_up_rest(rows: DataFrame, c: str, lookup: DataFrame) -> DataFrame:
    """Fills ``c_`` where it is null; rows that have it get a key that matches nothing and spreads them evenly.

    The ids of ``c`` are the key and are not shuffled beside it; nothing asks for them afterwards.
    """
    done = F.col(f"{c}_").isNotNull()
    keyed = rows.withColumn("_done", done).withColumn("_key", F.when(done, F.xxhash64(*rows.columns)).otherwise(F.col(c))).drop(c)
    terms = lookup.select(F.lit(False).alias("_done"), F.col("id").alias("_key"), F.col("term").alias("_term"))
    return (
        keyed.join(terms, ["_done", "_key"], "left")
        .withColumn(f"{c}_", F.coalesce(f"{c}_", "_term")).drop("_done", "_key", "_term"))
