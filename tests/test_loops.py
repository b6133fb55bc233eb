"""Closures, components and lists against straightforward Python."""

import random

import pytest

from kgweave.functions import terms as t
from kgweave.operators import closure as tc
from kgweave.operators import components as cc
from kgweave.operators.lists import CyclicList, unfold_list
from kgweave.plans import workspace
from kgweave.plans.skew import join_counted
from kgweave.sources.inline import inline
from tests.conftest import rows


def pairs_df(spark, pairs):
    return inline(spark, [tuple(p) for p in pairs], ["s", "o"])


def brute_closure(pairs):
    known = set(pairs)
    while True:
        more = known | {(a, d) for a, b in known for c, d in known if b == c}
        if more == known:
            return known
        known = more


def brute_components(pairs):
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return {(x, min(y for y in root if root[y] == r)) for x, r in root.items()}


@pytest.mark.parametrize("strategy", ["doubling", "linear"])
def test_closure_of_cycle_and_path(spark, strategy):
    cycle = [("1", "2"), ("2", "3"), ("3", "1")]
    path = [(f"x{i}", f"x{i + 1}") for i in range(9)]
    assert rows(tc.closure(pairs_df(spark, cycle + path), strategy)) == brute_closure(cycle + path)


def test_closure_switches_to_the_large_form(spark, monkeypatch):
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 12)
    path = [(f"x{i}", f"x{i + 1}") for i in range(12)]
    assert rows(tc.closure(pairs_df(spark, path))) == brute_closure(path)


def test_groups_do_not_mix_and_limits_raise(spark):
    df = inline(spark, [("p", "a", "b"), ("p", "b", "c"), ("q", "c", "d"), ("q", "d", "e")], ["g", "s", "o"])
    assert rows(tc.closure_by_group(df, "g")) == {
        ("p", "a", "b"), ("p", "b", "c"), ("p", "a", "c"), ("q", "c", "d"), ("q", "d", "e"), ("q", "c", "e")}
    path = pairs_df(spark, [(f"x{i}", f"x{i + 1}") for i in range(6)])
    with pytest.raises(workspace.FixpointNotReached):
        tc.closure(path, "linear", max_rounds=1)
    with pytest.raises(tc.EmptyPropertyList):
        tc.transitive_reasoner(path, [])


@pytest.mark.parametrize("limit", [None, 0])
def test_components(spark, monkeypatch, limit):
    if limit is not None:  # every join takes the path for data too large to broadcast
        monkeypatch.setattr(cc, "BROADCAST_ROWS", limit)
    rng = random.Random(7)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    star = [("hub", f"leaf{i}") for i in range(30)]
    loose = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    edges = chain + star + loose
    assert rows(cc.connected_components(pairs_df(spark, edges))) == brute_components(edges)


def test_partners_and_stars(spark):
    groups = inline(spark, [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")], ["node", "canonical"])
    asked = inline(spark, [("b",), ("x",)], ["node"])
    assert rows(cc.same_as_partners(groups, asked)) == {("b", "a"), ("b", "c"), ("x", "y")}
    assert rows(cc.star_triples(groups)) == {
        (s, t.SAME_AS, o) for a, b in [("a", "b"), ("a", "c"), ("x", "y")] for s, o in [(a, b), (b, a)]}


def test_one_key_with_most_rows(spark):
    left = [("hot", str(i)) for i in range(3000)] + [(f"k{i}", "v") for i in range(50)]
    counts = {}
    for key, _ in left:
        counts[key] = counts.get(key, 0) + 1
    df = inline(spark, left, ["k", "v"])
    summary = inline(spark, [(k, k.upper(), str(n)) for k, n in counts.items()], ["k", "name", "n"]).selectExpr(
        "k", "name", "cast(n as long) n")
    joined = join_counted(df, summary, ["k"], len(left))
    assert rows(joined.select("k", "v", "name")) == {(k, v, k.upper()) for k, v in left}


def cells(name, members):
    out = []
    for i, m in enumerate(members):
        out += [(f"{name}{i}", t.FIRST, m), (f"{name}{i}", t.REST, f"{name}{i + 1}" if i + 1 < len(members) else t.NIL)]
    return out


def test_lists(graph):
    data = {"a": ["x"], "b": ["x", "y", "x"], "c": [f"m{i}" for i in range(21)]}
    df = graph([c for name, members in data.items() for c in cells(name, members)])
    assert rows(unfold_list(df)) == {(f"{n}0", i + 1, m) for n, ms in data.items() for i, m in enumerate(ms)}
    with pytest.raises(CyclicList):
        unfold_list(graph([("l1", t.FIRST, "a"), ("l1", t.REST, "l2"), ("l2", t.FIRST, "b"), ("l2", t.REST, "l1")])).collect()
