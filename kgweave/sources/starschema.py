"""The star-schema tables as a knowledge graph with an ontology.

``instances`` turns rows into triples, ``ontology`` describes their classes and properties, and
``catalog`` is a terminology that grows with the part and supplier tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.functions import terms as t
from kgweave.plans.workspace import Workspace, store, union_all
from kgweave.sources.inline import triples

EX = "ex:"


def ex(name: str) -> str:
    return EX + name


def _node(prefix: str, *keys: str | Column) -> Column:
    return F.concat(F.lit(EX + prefix), F.concat_ws("-", *[
        F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def _rows(df: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ingested: dict[tuple, DataFrame] = {}


def ingested(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """The triples of ``build(spark, sf_dir)`` as a table, written once per session.

    Files hold one predicate each, as every branch of the union writes its own, so a filter on the
    predicate skips files by their statistics.
    """
    key = (Workspace.of(spark).database, sf_dir, build.__name__)
    if key not in _ingested:
        _ingested[key] = store(build(spark, sf_dir)).df
    return _ingested[key]


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One triple per row; duplicate input rows give duplicate triples."""
    def read(name):
        return table(spark, sf_dir, name)

    customer, supplier, orders, line = read("customer"), read("supplier"), read("orders"), read("lineitem")
    nation, region, part, events = read("nation"), read("region"), read("part"), read("events")
    documents, turns = read("documents"), read("conversations")
    c, s, n = _node("c/", "c_custkey"), _node("s/", "s_suppkey"), _node("n/", "n_nationkey")
    o, e, u = _node("o/", "o_orderkey"), _node("e/", "event_id"), _node("u/", "user_id")
    item = _node("l/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return union_all([
        _rows(customer, c, t.TYPE, _node("Customer_", "c_mktsegment")),
        _rows(customer, c, ex("inNation"), _node("n/", "c_nationkey")),
        _rows(customer.where("c_custkey > 0"), c, ex("referredBy"), _node("c/", F.shiftright("c_custkey", 1))),
        _rows(supplier, s, t.TYPE, F.lit(ex("Supplier"))),
        _rows(supplier, s, ex("basedIn"), _node("n/", "s_nationkey")),
        _rows(nation, n, ex("partOf"), _node("r/", "n_regionkey")),
        _rows(nation.where("n_nationkey > 0"), n, ex("neighbourOf"), _node("n/", F.col("n_nationkey") - 1)),
        _rows(region, _node("r/", "r_regionkey"), t.TYPE, F.lit(ex("Region"))),
        _rows(orders, o, t.TYPE, _node("Order_", "o_orderstatus")),
        _rows(orders, o, ex("placedBy"), _node("c/", "o_custkey")),
        _rows(line, item, ex("ofOrder"), _node("o/", "l_orderkey")),
        _rows(line, item, ex("itemPart"), _node("p/", "l_partkey")),
        _rows(line, item, ex("itemSupplier"), _node("s/", "l_suppkey")),
        _rows(line, item, ex("returnFlag"), t.as_literal(F.col("l_returnflag"))),
        _rows(part, _node("p/", "p_partkey"), t.TYPE, _node("Part_", "p_type")),
        _rows(part, _node("p/", "p_partkey"), ex("brand"), _node("b/", "p_brand")),
        _rows(events, e, t.TYPE, _node("Event_", "event_type")),
        _rows(events, e, ex("byUser"), u),
        _rows(events, u, t.TYPE, _node("User_", "event_type")),
        _rows(documents, _node("d/", "doc_id"), ex("contentHash"), _node("h/", F.md5("text"))),
        _rows(documents, _node("d/", "doc_id"), ex("source"), _node("src/", "source")),
        _rows(turns.where("turn > 0"), _node("t/", "conv_id", "turn"), ex("previousTurn"),
              _node("t/", F.col("conv_id"), F.col("turn") - 1)),
    ])


# The constant part of the ontology.
ONTOLOGY = [
    ("Customer", t.SUB_CLASS, "Party"),
    ("Supplier", t.SUB_CLASS, "Party"),
    ("Party", t.SUB_CLASS, "Agent"),
    ("Customer", t.EQUIVALENT_CLASS, "Client"),
    ("Order_P", t.SUB_CLASS, "AllReturnedOrder"),
    ("inNation", t.SUB_PROPERTY, "locatedIn"),
    ("basedIn", t.SUB_PROPERTY, "locatedIn"),
    ("partOf", t.SUB_PROPERTY, "locatedIn"),
    ("locatedIn", t.TYPE, t.TRANSITIVE),
    ("referredBy", t.TYPE, t.TRANSITIVE),
    ("placedBy", t.DOMAIN, "Order"),
    ("placedBy", t.RANGE, "Customer"),
    ("placedBy", t.INVERSE_OF, "placed"),
    ("itemPart", t.DOMAIN, "LineItem"),
    ("itemPart", t.DOMAIN, "SalesRecord"),
    ("itemPart", t.RANGE, "Part"),
    ("ofOrder", t.RANGE, "Order"),
    ("ofOrder", t.INVERSE_OF, "hasItem"),
    ("returnFlag", t.RANGE, "Flag"),
    ("byUser", t.RANGE, "User"),
    ("contentHash", t.TYPE, t.INVERSE_FUNCTIONAL),
    ("neighbourOf", t.TYPE, t.SYMMETRIC),
    ("ReturnedItem", t.ON_PROPERTY, "returnFlag"),
    ("ReturnedItem", t.HAS_VALUE, '"R"'),
    ("OrderWithReturn", t.ON_PROPERTY, "hasItem"),
    ("OrderWithReturn", t.SOME_VALUES, "ReturnedItem"),
    ("AllReturnedOrder", t.ON_PROPERTY, "hasItem"),
    ("AllReturnedOrder", t.ALL_VALUES, "ReturnedItem"),
    ("Order", t.TYPE, t.RDFS_CLASS),
    ("Part", t.TYPE, t.RDFS_CLASS),
    ("brand", t.TYPE, t.PROPERTY),
    ("itemSupplier", t.TYPE, t.CONTAINER_PROPERTY),
]


def _constant(rows: list[tuple]) -> list[tuple]:
    def full(term: str) -> str:
        return term if "://" in term or term.startswith('"') else EX + term

    return [(full(s), p, full(o)) for s, p, o in rows]


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant ontology and one subclass per segment, status, type of part and of event."""
    def below(name: str, prefix: str, column: str, parent: str) -> DataFrame:
        return _rows(table(spark, sf_dir, name).select(column).distinct(),
                     _node(prefix, column), t.SUB_CLASS, F.lit(ex(parent)))

    return union_all([
        triples(spark, _constant(ONTOLOGY)),
        below("customer", "Customer_", "c_mktsegment", "Customer"),
        below("orders", "Order_", "o_orderstatus", "Order"),
        below("part", "Part_", "p_type", "Part"),
        below("events", "Event_", "event_type", "Event"),
        below("events", "User_", "event_type", "User"),
    ])


_described: dict[tuple, DataFrame] = {}


def kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances and ontology, made from the tables wherever they are read.

    Every branch of the union has its predicate as a literal, so a filter on the predicate drops the branches of
    all others. The ontology, which is small and needs distinct values of whole tables, is written once per session.
    """
    key = (Workspace.of(spark).database, sf_dir)
    if key not in _described:
        _described[key] = instances(spark, sf_dir).union(ingested(spark, sf_dir, ontology))
    return _described[key]


# The constant part of the catalog's terminology.
CATALOG = [
    ("madeBy", t.SUB_PROPERTY, "sourcedFrom"),
    ("Ware", t.SUB_CLASS, "Thing"),
    ("some-region", t.ON_PROPERTY, "suppliedIn"),
    ("some-region", t.SOME_VALUES, "Region"),
    ("some-region", t.SUB_CLASS, "Located"),
    ("some-source", t.ON_PROPERTY, "sourcedFrom"),
    ("some-source", t.SOME_VALUES, "Maker"),
    ("some-source", t.SUB_CLASS, "Traceable"),
    ("suppliedIn", t.PROPERTY_CHAIN, "chain-1"),
    ("chain-1", t.FIRST, "madeBy"),
    ("chain-1", t.REST, "chain-2"),
    ("chain-2", t.FIRST, "seatedIn"),
    ("chain-2", t.REST, t.NIL),
    ("Traceable", t.SUB_CLASS, "Checked"),
]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, brands, suppliers and nations as classes.

    Each part is below its brand-and-type line and made by some supplier class; a supplier class is
    below Maker and seated in some nation class, a nation class below its region class. Brand and
    type together make a line, large parts of a brand form an intersection class, and suppliers
    in debt have no possible instance.
    """
    def read(name):
        return table(spark, sf_dir, name)

    part, supplier, nation, line = read("part"), read("supplier"), read("nation"), read("lineitem")
    model, brand = _node("M/", "p_partkey"), _node("B/", "p_brand")
    kind, size = _node("K/", "p_type"), _node("Z/", "p_size")
    maker, seat = _node("S/", "s_suppkey"), _node("N/", "s_nationkey")
    both = part.select("p_brand", "p_type").distinct()
    sizes = part.select("p_brand", "p_size", "p_type").distinct()
    made = line.select("l_partkey", "l_suppkey").distinct()
    made_node = _node("made/", "l_suppkey")
    makers = line.select("l_suppkey").distinct()
    seat_node = _node("seat/", "s_nationkey")
    seats = supplier.select("s_nationkey").distinct()
    bundle = [_node(f"bundle{i}/", "p_brand", "p_size", "p_type") for i in range(4)]
    pair = [_node(f"pair{i}/", "p_brand", "p_type") for i in range(3)]

    def members(df, nodes, classes):
        parts = [_rows(df, nodes[0], t.INTERSECTION, nodes[1])]
        for i, cls in enumerate(classes):
            last = i + 1 == len(classes)
            parts.append(_rows(df, nodes[i + 1], t.FIRST, cls))
            parts.append(_rows(df, nodes[i + 1], t.REST, F.lit(t.NIL) if last else nodes[i + 2]))
        return parts

    return union_all([
        triples(spark, _constant(CATALOG)),
        _rows(part, model, t.SUB_CLASS, brand),
        _rows(part, model, t.SUB_CLASS, kind),
        _rows(part, model, t.SUB_CLASS, size),
        _rows(part.select("p_brand").distinct(), brand, t.SUB_CLASS, F.lit(ex("Ware"))),
        *members(both, pair, [brand, kind]),
        _rows(both, pair[0], t.SUB_CLASS, _node("Line/", "p_brand", "p_type")),
        *members(sizes, bundle, [brand, size, kind]),
        _rows(sizes, bundle[0], t.SUB_CLASS, _node("Shelf/", "p_brand", "p_size", "p_type")),
        _rows(made, _node("M/", "l_partkey"), t.SUB_CLASS, made_node),
        _rows(makers, made_node, t.ON_PROPERTY, F.lit(ex("madeBy"))),
        _rows(makers, made_node, t.SOME_VALUES, _node("S/", "l_suppkey")),
        _rows(supplier, maker, t.SUB_CLASS, F.lit(ex("Maker"))),
        _rows(supplier, maker, t.SUB_CLASS, seat_node),
        _rows(supplier.where("s_acctbal < 0"), maker, t.SUB_CLASS, F.lit(t.NOTHING)),
        _rows(seats, seat_node, t.ON_PROPERTY, F.lit(ex("seatedIn"))),
        _rows(seats, seat_node, t.SOME_VALUES, seat),
        _rows(part.select("p_size").distinct(), size, t.SUB_CLASS, _node("stored/", "p_size")),
        _rows(part.select("p_size").distinct(), _node("stored/", "p_size"), t.ON_PROPERTY, F.lit(ex("storedIn"))),
        _rows(part.select("p_size").distinct(), _node("stored/", "p_size"), t.SOME_VALUES, _node("Hall/", "p_size")),
        _rows(nation, _node("N/", "n_nationkey"), t.SUB_CLASS, _node("R/", "n_regionkey")),
        _rows(nation.select("n_regionkey").distinct(), _node("R/", "n_regionkey"), t.SUB_CLASS, F.lit(ex("Region"))),
        _rows(supplier, _node("from/", "s_suppkey"), t.SUB_PROPERTY, _node("fromNation/", "s_nationkey")),
        _rows(nation, _node("fromNation/", "n_nationkey"), t.SUB_PROPERTY, _node("fromRegion/", "n_regionkey")),
        _rows(nation.select("n_regionkey").distinct(), _node("fromRegion/", "n_regionkey"), t.SUB_PROPERTY,
              F.lit(ex("madeBy"))),
    ])
