"""The registered queries once more, as DuckDB SQL over the source tables.

``triple_sql`` and the ontology below restate the projection of the tables to triples; the rule
queries then apply the rule texts literally, round by round, and share no code with the operators.
"""

from __future__ import annotations

from kgweave.functions import terms as t
from kgweave.operators import graph as G
from kgweave.operators.rdfs import axiom_rows
from kgweave.sources.starschema import CATALOG, ONTOLOGY

EX = "ex:"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ex(name: str) -> str:
    return q(EX + name)


def node(prefix: str, *keys: str) -> str:
    return f"{ex(prefix)} || " + " || '-' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)


def rows(table: str, s: str, p: str, o: str, where: str = "", distinct: bool = False) -> str:
    head = "SELECT DISTINCT" if distinct else "SELECT"
    tail = f" WHERE {where}" if where else ""
    return f"{head} {s} AS s, {q(p)} AS p, {o} AS o FROM {table}{tail}"


def values(triples: list[tuple]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join(q(x) for x in row) + ")" for row in triples) + ") v(s, p, o)"


def full(rows_: list[tuple]) -> list[tuple]:
    def term(x):
        return x if "://" in x or x.startswith('"') else EX + x
    return [(term(s), p, term(o)) for s, p, o in rows_]


C, S, N = node("c/", "c_custkey"), node("s/", "s_suppkey"), node("n/", "n_nationkey")
O, E, U = node("o/", "o_orderkey"), node("e/", "event_id"), node("u/", "user_id")
L = node("l/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
P, D = node("p/", "p_partkey"), node("d/", "doc_id")
TYPE = t.TYPE

INSTANCES = " UNION ALL ".join([
    rows("customer", C, TYPE, node("Customer_", "c_mktsegment")),
    rows("customer", C, EX + "inNation", node("n/", "c_nationkey")),
    rows("customer", C, EX + "referredBy", node("c/", "c_custkey // 2"), "c_custkey > 0"),
    rows("supplier", S, TYPE, ex("Supplier")),
    rows("supplier", S, EX + "basedIn", node("n/", "s_nationkey")),
    rows("nation", N, EX + "partOf", node("r/", "n_regionkey")),
    rows("nation", N, EX + "neighbourOf", node("n/", "n_nationkey - 1"), "n_nationkey > 0"),
    rows("region", node("r/", "r_regionkey"), TYPE, ex("Region")),
    rows("orders", O, TYPE, node("Order_", "o_orderstatus")),
    rows("orders", O, EX + "placedBy", node("c/", "o_custkey")),
    rows("lineitem", L, EX + "ofOrder", node("o/", "l_orderkey")),
    rows("lineitem", L, EX + "itemPart", node("p/", "l_partkey")),
    rows("lineitem", L, EX + "itemSupplier", node("s/", "l_suppkey")),
    rows("lineitem", L, EX + "returnFlag", "'\"' || l_returnflag || '\"'"),
    rows("part", P, TYPE, node("Part_", "p_type")),
    rows("part", P, EX + "brand", node("b/", "p_brand")),
    rows("events", E, TYPE, node("Event_", "event_type")),
    rows("events", E, EX + "byUser", U),
    rows("events", U, TYPE, node("User_", "event_type")),
    rows("documents", D, EX + "contentHash", node("h/", "md5(text)")),
    rows("documents", D, EX + "source", node("src/", "source")),
    rows("conversations", node("t/", "conv_id", "turn"), EX + "previousTurn",
         node("t/", "conv_id", "turn - 1"), "turn > 0"),
])

SCHEMA = " UNION ALL ".join([
    values(full(ONTOLOGY)),
    rows("customer", node("Customer_", "c_mktsegment"), t.SUB_CLASS, ex("Customer"), distinct=True),
    rows("orders", node("Order_", "o_orderstatus"), t.SUB_CLASS, ex("Order"), distinct=True),
    rows("part", node("Part_", "p_type"), t.SUB_CLASS, ex("Part"), distinct=True),
    rows("events", node("Event_", "event_type"), t.SUB_CLASS, ex("Event"), distinct=True),
    rows("events", node("User_", "event_type"), t.SUB_CLASS, ex("User"), distinct=True),
])


def members(table: str, prefix: str, keys: list[str], classes: list[str]) -> list[str]:
    cells = [node(f"{prefix}{i}/", *keys) for i in range(len(classes) + 1)]
    out = [rows(table, cells[0], t.INTERSECTION, cells[1], distinct=True)]
    for i, cls in enumerate(classes):
        rest = q(t.NIL) if i + 1 == len(classes) else cells[i + 2]
        out.append(rows(table, cells[i + 1], t.FIRST, cls, distinct=True))
        out.append(rows(table, cells[i + 1], t.REST, rest, distinct=True))
    return out


_B, _K, _Z = node("B/", "p_brand"), node("K/", "p_type"), node("Z/", "p_size")
CATALOG_SQL = " UNION ALL ".join([
    values(full(CATALOG)),
    rows("part", node("M/", "p_partkey"), t.SUB_CLASS, _B),
    rows("part", node("M/", "p_partkey"), t.SUB_CLASS, _K),
    rows("part", node("M/", "p_partkey"), t.SUB_CLASS, _Z),
    rows("part", _B, t.SUB_CLASS, ex("Ware"), distinct=True),
    *members("part", "pair", ["p_brand", "p_type"], [_B, _K]),
    rows("part", node("pair0/", "p_brand", "p_type"), t.SUB_CLASS, node("Line/", "p_brand", "p_type"), distinct=True),
    *members("part", "bundle", ["p_brand", "p_size", "p_type"], [_B, _Z, _K]),
    rows("part", node("bundle0/", "p_brand", "p_size", "p_type"), t.SUB_CLASS,
         node("Shelf/", "p_brand", "p_size", "p_type"), distinct=True),
    rows("lineitem", node("M/", "l_partkey"), t.SUB_CLASS, node("made/", "l_suppkey"), distinct=True),
    rows("lineitem", node("made/", "l_suppkey"), t.ON_PROPERTY, ex("madeBy"), distinct=True),
    rows("lineitem", node("made/", "l_suppkey"), t.SOME_VALUES, node("S/", "l_suppkey"), distinct=True),
    rows("supplier", node("S/", "s_suppkey"), t.SUB_CLASS, ex("Maker")),
    rows("supplier", node("S/", "s_suppkey"), t.SUB_CLASS, node("seat/", "s_nationkey")),
    rows("supplier", node("S/", "s_suppkey"), t.SUB_CLASS, q(t.NOTHING), "s_acctbal < 0"),
    rows("supplier", node("seat/", "s_nationkey"), t.ON_PROPERTY, ex("seatedIn"), distinct=True),
    rows("supplier", node("seat/", "s_nationkey"), t.SOME_VALUES, node("N/", "s_nationkey"), distinct=True),
    rows("part", _Z, t.SUB_CLASS, node("stored/", "p_size"), distinct=True),
    rows("part", node("stored/", "p_size"), t.ON_PROPERTY, ex("storedIn"), distinct=True),
    rows("part", node("stored/", "p_size"), t.SOME_VALUES, node("Hall/", "p_size"), distinct=True),
    rows("nation", node("N/", "n_nationkey"), t.SUB_CLASS, node("R/", "n_regionkey")),
    rows("nation", node("R/", "n_regionkey"), t.SUB_CLASS, ex("Region"), distinct=True),
    rows("supplier", node("from/", "s_suppkey"), t.SUB_PROPERTY, node("fromNation/", "s_nationkey")),
    rows("nation", node("fromNation/", "n_nationkey"), t.SUB_PROPERTY, node("fromRegion/", "n_regionkey")),
    rows("nation", node("fromRegion/", "n_regionkey"), t.SUB_PROPERTY, ex("madeBy"), distinct=True),
])


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes) + " " + final


INST = ("inst", INSTANCES)
KG = [INST, ("kg", f"SELECT * FROM inst UNION ALL {SCHEMA}")]
CAT = [("cat", CATALOG_SQL)]


def kg(final: str, *ctes: tuple[str, str]) -> str:
    return with_([*KG, *ctes], final)


def cat(final: str, *ctes: tuple[str, str]) -> str:
    return with_([*CAT, *ctes], final)


def closure_cte(name: str, source: str) -> tuple[str, str]:
    """Linear recursion over ``source(s, o)``."""
    return (name, f"SELECT DISTINCT s, o FROM {source} UNION "
                  f"SELECT c.s, e.o FROM {name} c JOIN {source} e ON c.o = e.s")


def pred(name: str, predicate: str, source: str = "kg") -> tuple[str, str]:
    return (name, f"SELECT DISTINCT s, o FROM {source} WHERE p = {q(predicate)}")


LIT = "o NOT LIKE '\"%'"


# --- rules as SQL over a triple table {g} -----------------------------------------------------------

def schema_of(g: str, predicate: str) -> str:
    return f"(SELECT DISTINCT s, o FROM {g} WHERE p = {q(predicate)})"


def typed(g: str, cls: str) -> str:
    return f"(SELECT DISTINCT s FROM {g} WHERE p = {q(TYPE)} AND o = {q(cls)})"


def restriction(g: str, filler: str) -> str:
    return (f"(SELECT DISTINCT f.s AS r, n.o AS pr, f.o AS d FROM {g} f JOIN {g} n ON f.s = n.s "
            f"WHERE f.p = {q(filler)} AND n.p = {q(t.ON_PROPERTY)})")


def r_domain(g):
    return f"SELECT x.s, {q(TYPE)} AS p, d.o FROM {g} x JOIN {schema_of(g, t.DOMAIN)} d ON x.p = d.s"


def r_range(g):
    return (f"SELECT x.o AS s, {q(TYPE)} AS p, d.o FROM {g} x JOIN {schema_of(g, t.RANGE)} d "
            f"ON x.p = d.s WHERE x.{LIT}")


def r_compose(g, predicate):
    e = schema_of(g, predicate)
    return f"SELECT a.s, {q(predicate)} AS p, b.o FROM {e} a JOIN {e} b ON a.o = b.s"


def r_sub_property(g):
    return f"SELECT x.s, d.o AS p, x.o FROM {g} x JOIN {schema_of(g, t.SUB_PROPERTY)} d ON x.p = d.s WHERE d.s <> d.o"


def r_sub_class(g):
    return (f"SELECT x.s, x.p, d.o FROM {g} x JOIN {schema_of(g, t.SUB_CLASS)} d ON x.o = d.s "
            f"WHERE x.p = {q(TYPE)}")


def r_resource(g):
    return (f"SELECT s, {q(TYPE)} AS p, {q(t.RESOURCE)} AS o FROM {g} UNION "
            f"SELECT o, {q(TYPE)}, {q(t.RESOURCE)} FROM {g} WHERE {LIT}")


def r_property(g):
    return f"SELECT DISTINCT p AS s, {q(TYPE)} AS p, {q(t.PROPERTY)} AS o FROM {g}"


def r_instances(g, cls, p, o):
    return f"SELECT s, {q(p)} AS p, {o} AS o FROM {typed(g, cls)}"


def r6(g):
    return r_instances(g, t.PROPERTY, t.SUB_PROPERTY, "s")


def r8(g):
    return r_instances(g, t.RDFS_CLASS, t.SUB_CLASS, q(t.RESOURCE))


def r10(g):
    return r_instances(g, t.RDFS_CLASS, t.SUB_CLASS, "s")


def r12(g):
    return r_instances(g, t.CONTAINER_PROPERTY, t.SUB_PROPERTY, q(t.MEMBER))


def r_symmetric(g):
    return f"SELECT x.o AS s, x.p, x.s AS o FROM {g} x JOIN {typed(g, t.SYMMETRIC)} y ON x.p = y.s WHERE x.{LIT}"


def r_transitive(g):
    return (f"SELECT x.s, x.p, z.o FROM {g} x JOIN {typed(g, t.TRANSITIVE)} y ON x.p = y.s "
            f"JOIN {g} z ON z.p = x.p AND z.s = x.o")


def r_inverse(g):
    i = schema_of(g, t.INVERSE_OF)
    return (f"SELECT x.o AS s, i.o AS p, x.s AS o FROM {g} x JOIN {i} i ON x.p = i.s WHERE x.{LIT} UNION "
            f"SELECT x.o, i.s, x.s FROM {g} x JOIN {i} i ON x.p = i.o WHERE x.{LIT}")


def r_equivalent(g, equal, below):
    e = schema_of(g, equal)
    return f"SELECT s, {q(below)} AS p, o FROM {e} UNION SELECT o, {q(below)}, s FROM {e}"


def r_mutual(g, below, equal):
    e = schema_of(g, below)
    return f"SELECT a.s, {q(equal)} AS p, a.o FROM {e} a JOIN {e} b ON a.s = b.o AND a.o = b.s WHERE a.s <> a.o"


def r_has_value_in(g):
    return (f"SELECT x.s, {q(TYPE)} AS p, h.r AS o FROM {g} x JOIN {restriction(g, t.HAS_VALUE)} h "
            f"ON x.p = h.pr AND x.o = h.d")


def r_has_value_out(g):
    return (f"SELECT x.s, h.pr AS p, h.d AS o FROM {g} x JOIN {restriction(g, t.HAS_VALUE)} h "
            f"ON x.o = h.r WHERE x.p = {q(TYPE)}")


def r_some(g):
    return (f"SELECT x.s, {q(TYPE)} AS p, h.r AS o FROM {g} x JOIN {restriction(g, t.SOME_VALUES)} h "
            f"ON x.p = h.pr JOIN {g} y ON y.s = x.o AND y.o = h.d WHERE y.p = {q(TYPE)}")


def r_all(g):
    return (f"SELECT x.o AS s, {q(TYPE)} AS p, h.d AS o FROM {g} x JOIN {restriction(g, t.ALL_VALUES)} h "
            f"ON x.p = h.pr JOIN {g} y ON y.s = x.s AND y.o = h.r WHERE y.p = {q(TYPE)} AND x.{LIT}")


def rounds(start: str, rules: list, number: int, prefix: str = "g") -> list[tuple[str, str]]:
    """``number`` applications of all rules; the last table is ``<prefix><number>``."""
    out = [(f"{prefix}0", f"SELECT DISTINCT s, p, o FROM ({start})")]
    for i in range(number):
        g = f"{prefix}{i}"
        found = " UNION ".join(rule(g) for rule in rules)
        out.append((f"{prefix}{i + 1}", f"SELECT s, p, o FROM {g} UNION {found}"))
    return out


SIMPLE_RULES = [
    r_domain, r_range, lambda g: r_compose(g, t.SUB_PROPERTY), r_sub_property, r_sub_class,
    lambda g: r_compose(g, t.SUB_CLASS),
]
FULL_RULES = SIMPLE_RULES + [r_resource, r_property, r6, r8, r10, r12]
HORST_RULES = SIMPLE_RULES + [
    r_symmetric, r_transitive, r_inverse,
    lambda g: r_equivalent(g, t.EQUIVALENT_CLASS, t.SUB_CLASS),
    lambda g: r_equivalent(g, t.EQUIVALENT_PROPERTY, t.SUB_PROPERTY),
    lambda g: r_mutual(g, t.SUB_CLASS, t.EQUIVALENT_CLASS),
    lambda g: r_mutual(g, t.SUB_PROPERTY, t.EQUIVALENT_PROPERTY),
    r_has_value_in, r_has_value_out, r_some, r_all,
]
RL_RULES = [
    r_domain, r_range, r_sub_property, r_sub_class, r_symmetric, r_transitive, r_inverse,
    r_has_value_in, r_has_value_out, r_all,
    lambda g: (f"SELECT x.s, x.p, d.o FROM {g} x JOIN {schema_of(g, t.EQUIVALENT_CLASS)} d ON x.o = d.s "
               f"WHERE x.p = {q(TYPE)} UNION SELECT x.s, x.p, d.s FROM {g} x "
               f"JOIN {schema_of(g, t.EQUIVALENT_CLASS)} d ON x.o = d.o WHERE x.p = {q(TYPE)}"),
    lambda g: (f"SELECT x.s, {q(TYPE)} AS p, h.r AS o FROM {g} x JOIN {restriction(g, t.SOME_VALUES)} h "
               f"ON x.p = h.pr JOIN {typed(g, t.OBJECT_PROPERTY)} op ON op.s = x.p "
               f"JOIN {g} y ON y.s = x.o AND y.o = h.d WHERE y.p = {q(TYPE)}"),
]

SIMPLE = rounds("SELECT * FROM kg", SIMPLE_RULES, 5)
SIMPLE_END = "g5"
AXIOM_VALUES = values(axiom_rows())
HORST_ROUNDS = 11
HORST = rounds("SELECT * FROM kg", HORST_RULES, HORST_ROUNDS)
HORST_END = f"g{HORST_ROUNDS}"
NO_LOOPS = f"NOT (s = o AND p IN ({q(t.SUB_CLASS)}, {q(t.SUB_PROPERTY)}))"


def stars(pairs: str) -> str:
    """Both directions between a member and the least of its group, from ``pairs(k, v)``."""
    least = f"SELECT v AS s, min(v) OVER (PARTITION BY k) AS o FROM (SELECT DISTINCT k, v FROM {pairs})"
    return (f"SELECT s, {q(t.SAME_AS)} AS p, o FROM ({least}) WHERE s <> o UNION "
            f"SELECT o, {q(t.SAME_AS)}, s FROM ({least}) WHERE s <> o")


HASH_PAIRS = f"(SELECT o AS k, s AS v FROM kg WHERE p = {ex('contentHash')})"
CANON = ("canon", f"SELECT DISTINCT s AS node, min(s) OVER (PARTITION BY o) AS canonical FROM kg "
                  f"WHERE p = {ex('contentHash')}")


def isin(column: str, items: list[str]) -> str:
    return f"{column} IN ({', '.join(q(i) for i in items)})"


TERMINOLOGICAL = (f"({isin('p', G.TERMINOLOGICAL_PREDICATES)} OR "
                  f"(p = {q(TYPE)} AND {isin('o', G.TERMINOLOGICAL_TYPES)}))")
