"""The operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm import (
    decontaminate, language, licences, linededup, merkle, mixing, negatives, phrases, quality, simhash, sitestyle, tokens,
    toxicity,
)
from kgweave.llm.tables import Scratch, documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sitestyle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sitestyle.extract(documents(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", "n_chars")


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = language.identify(documents(spark, sf_dir))
    return judged.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.curriculum(documents(spark, sf_dir))
    return plan.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("takes", F.lit(0).cast("long"), lambda n, t: n + t["words"]).alias("taken"),
        F.round(F.element_at(F.transform("takes", lambda t: t["position"]), F.when(F.size("takes") > 0, F.lit(1))),
                6).alias("first_position"),
    ).orderBy("first_position", "doc_id")


ORACLE["op3_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mixed,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE k WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 3.0::DOUBLE END AS w0,
         CASE k WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w1,
         CASE k WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2 * source_size AS cap
  FROM (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM sources)),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (
              ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
           / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, w0, w1,
         least(coalesce((SELECT max(level) FROM levels WHERE level * weight <= cap) * weight, cap::DOUBLE),
               cap::DOUBLE) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.w0, t.w1,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mixed, s.doc_id NULLS FIRST, s.size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS BIGINT) AS start,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS passes
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, least(size, greatest(0, CAST(floor(target) AS BIGINT) - passes * source_size - start)) AS rest FROM placed),
first AS (
  SELECT *, CASE WHEN passes > 0 AND size > 0 THEN size WHEN rest > 0 THEN rest END AS amount FROM taken),
due AS (
  SELECT *, CASE WHEN passes > 0 OR rest > 0 THEN (start + amount / 2.0::DOUBLE) / nullif(target, 0) * (w0 + w1) / 2 END
            AS demand FROM first)
SELECT doc_id, size, source_size, target, CAST(passes * size + rest AS BIGINT) AS taken,
       round(2 * demand / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * demand)), 6) AS first_position
FROM due
"""


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.covered(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE["op4_decontaminate"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, list_slice(w, s, s + 9) AS words
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(words) AS n FROM windows),
starts AS (
  SELECT r, s, n, list_slice(w, s, s + n - 1) AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT DISTINCT h.r, h.s, h.n, i.item FROM starts h JOIN windows i ON h.words = i.words),
spots AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN spots USING (r) LEFT JOIN named USING (r)
"""


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "posterior")


@query
def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = phrases.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op7_phrases"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, doc_id, s, list_slice(w, s, s + 19) AS words
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs WHERE len(w) >= 20)),
later AS (
  SELECT r, s FROM (
    SELECT r, s, row_number() OVER (PARTITION BY words ORDER BY doc_id NULLS LAST, r, s) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT r, list(DISTINCT p) AS spots FROM (SELECT r, unnest(range(s, s + 20)) AS p FROM later) GROUP BY r),
cut AS (
  SELECT d.r, d.doc_id, w, CASE WHEN g.r IS NULL THEN w ELSE list_select(w, list_sort(list_filter(
           range(1, len(w) + 1), lambda p: NOT list_contains(g.spots, p)))) END AS kept
  FROM docs d LEFT JOIN gone g USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM cut
"""


@query
def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_removed", "lost", "text")


ORACLE["op8_linededup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, doc_id, spot, line FROM (
    SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS spot FROM docs WHERE text IS NOT NULL)),
filled AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY spot) AS pos FROM lines WHERE trim(line, ' ') <> ''),
runs AS (
  SELECT *, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3 FROM filled
  WINDOW w AS (PARTITION BY r ORDER BY pos)),
later AS (
  SELECT r, pos FROM (
    SELECT r, pos, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id NULLS LAST, r, pos) AS nth
    FROM runs WHERE line3 IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT r, unnest(range(pos, pos + 3)) AS pos FROM later),
marked AS (SELECT f.*, g.r IS NOT NULL AS out FROM filled f LEFT JOIN gone g USING (r, pos)),
counted AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_removed,
         coalesce(sum(length(line)) FILTER (WHERE out), 0)::DOUBLE / sum(length(line))::DOUBLE AS lost
  FROM marked GROUP BY r),
kept AS (
  SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.spot) AS text
  FROM lines l LEFT JOIN marked m ON l.r = m.r AND l.spot = m.spot WHERE m.out IS NULL OR NOT m.out GROUP BY l.r)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(lost, 0.0)::DOUBLE AS lost, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM docs d LEFT JOIN counted USING (r) LEFT JOIN kept k USING (r)
"""


@query
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licences"),
        F.array_join("rules", " ").alias("rules"))


def _licence_sql() -> str:
    known = ", ".join(f"('{name}', '{plain}')" for name, plain in licences.SENTENCES.items())
    rules = ", ".join(f"('{licence}', '{rule}', ' {' '.join(ids)} ')" for licence, rule, ids in licences.RULES)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
known(sentence_id, plain) AS (VALUES {known}),
rules(licence, rule, ids) AS (VALUES {rules}),
pieces AS (
  SELECT r, unnest(p) AS piece, unnest(range(len(p))) AS spot
  FROM (SELECT r, regexp_split_to_array(text, '
|[.!?]+(?:[ 	-
]+|\z)') AS p FROM docs WHERE text IS NOT NULL)),
ids AS (
  SELECT r, count(*) AS n, string_agg(sentence_id, ' ' ORDER BY spot) AS ids
  FROM (SELECT r, spot, trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')) AS plain FROM pieces)
  JOIN known USING (plain) GROUP BY r),
matched AS (
  SELECT r, string_agg(DISTINCT licence, ' ' ORDER BY licence) AS licences, string_agg(DISTINCT rule, ' ' ORDER BY rule) AS rules
  FROM ids i JOIN rules u ON contains(' ' || i.ids || ' ', u.ids) GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids,
       coalesce(licences, '') AS licences, coalesce(rules, '') AS rules
FROM docs d LEFT JOIN ids USING (r) LEFT JOIN matched USING (r)
"""


ORACLE["op9_licences"] = _licence_sql()


@query
def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Scratch(spark).keep(tokens.token_files(documents(spark, sf_dir)))
    return tokens.scan(files, keep=("ids",)).select(F.col("ids").alias("doc_id"), "n_tokens", "closed")


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mine(
        rows.select("vec_id", label.alias("label"), negatives.scaled(F.col("embedding"), 256).alias("vector")),
        F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE["op12_negatives"] = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor, anchor_id, r AS positive, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scores s ON s.anchor = p.anchor AND NOT s.same
   AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, proved = merkle.manifest_of(documents(spark, sf_dir))
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _enc(value: str) -> str:
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    columns = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return f"sha256({' || '.join(_enc(c) for c in columns)})"


def _climb(tree: str, table: str, state: str) -> str:
    return f"""
  SELECT p.id, p.g, p.level + 1, p.pos // 2, (p.size + 1) // 2, p.proof || coalesce(s.h, ''),
         sha256(CASE WHEN p.pos % 2 = 1 THEN coalesce(s.h, '') || p.folded ELSE p.folded || coalesce(s.h, '') END)
  FROM {state} p LEFT JOIN {table} s ON {tree} s.level = p.level AND s.pos = xor(p.pos, 1) WHERE p.size > 1"""


ORACLE["op13_merkle"] = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
docs AS (
  SELECT row_number() OVER () AS id, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {_leaf("n_chars")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND xor(4294967295, list_reduce(
                list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) for x in string_split(CAST(doc_id AS VARCHAR), '')]),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0
              THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS shown
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size
  FROM docs),
nodes(g, level, pos, size, h) AS (
  SELECT g, 0, pos, size, leaf FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE size > 1
  GROUP BY g, level, pos // 2, size),
subroots AS (SELECT g, h FROM nodes WHERE size = 1),
tops(level, pos, size, h) AS (
  SELECT 0, g, (SELECT count(*) FROM subroots), h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE size > 1
  GROUP BY level, pos // 2, size),
lower_paths(id, g, level, pos, size, proof, folded) AS (
  SELECT id, g, 0, pos, size, '', shown FROM placed
  UNION ALL {_climb("s.g = p.g AND", "nodes", "lower_paths")}),
upper_paths(id, g, level, pos, size, proof, folded) AS (
  SELECT id, g, 0, g, (SELECT count(*) FROM subroots), proof, folded FROM lower_paths WHERE size = 1
  UNION ALL {_climb("", "tops", "upper_paths")})
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root,
       u.folded = r.h AS verified
FROM placed p JOIN subroots s USING (g) JOIN upper_paths u ON u.id = p.id AND u.size = 1 JOIN tops r ON r.size = 1
"""
