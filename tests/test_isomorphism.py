"""Graph equality up to blank node names, against all renamings of small graphs."""

import itertools
import random

import pytest

from kgweave.operators.isomorphism import Undecided, same_graph


def renamed(rows, seed):
    rng = random.Random(seed)
    names = sorted({x for r in rows for x in (r[0], r[2]) if x.startswith("_:")})
    new = [f"_:n{i}" for i in range(len(names))]
    rng.shuffle(new)
    to = dict(zip(names, new))
    out = [(to.get(s, s), p, to.get(o, o)) for s, p, o in rows]
    rng.shuffle(out)
    return out


def brute(a, b):
    a, b = set(a), set(b)
    names = [sorted({x for r in g for x in (r[0], r[2]) if x.startswith("_:")}) for g in (a, b)]
    if len(names[0]) != len(names[1]):
        return False
    return any({(to.get(s, s), p, to.get(o, o)) for s, p, o in a} == b
               for order in itertools.permutations(names[1]) for to in [dict(zip(names[0], order))])


def cycle(n, start=0, p="p"):
    return [(f"_:c{start + i}", p, f"_:c{start + (i + 1) % n}") for i in range(n)]


SAME = {
    "ground": [("a", "p", "b"), ("a", "p", '"_:x"')],
    "chain": [("a", "p", "_:1"), ("_:1", "p", "_:2"), ("_:2", "p", "_:3"), ("_:3", "q", "b")],
    "twins": [("h", "p", f"_:{i}") for i in range(5)] + [(f"_:{i}", "q", "x") for i in range(3)],
    "hub": [("_:h", "p", f"_:{i}") for i in range(6)] + [("_:h", "q", "a")],
    "cycle": cycle(5),
    "two cycles": cycle(3) + cycle(3, 10) + [("_:c0", "q", "a")],
    "loop": [("_:1", "p", "_:1"), ("_:2", "p", "_:1"), ("_:3", "p", "_:2")],
    "repeated": [("_:1", "p", "b")] * 3 + [("_:2", "p", "b")],
}
DIFFERENT = {
    "one more": (SAME["chain"], SAME["chain"] + [("a", "p", "c")]),
    "one edge": (SAME["chain"], SAME["chain"][:-1] + [("_:2", "q", "b")]),
    "twins": (SAME["twins"], SAME["twins"][:-1] + [("_:0", "q", "y")]),
    "hexagon": (cycle(3) + cycle(3, 10), cycle(6)),
    "turned": ([("_:1", "p", "_:2"), ("_:1", "p", "_:3")], [("_:2", "p", "_:1"), ("_:3", "p", "_:1")]),
    "literal": ([("a", "p", "_:1")], [("a", "p", '"_:1"')]),
}


@pytest.mark.parametrize("name", SAME)
def test_same(graph, name):
    rows = SAME[name]
    assert brute(rows, renamed(rows, 3)) and same_graph(graph(rows), graph(renamed(rows, 3)))


@pytest.mark.parametrize("name", DIFFERENT)
def test_different(graph, name):
    a, b = DIFFERENT[name]
    assert not brute(a, b) and not same_graph(graph(a), graph(renamed(b, 5)))


def test_random_graphs(graph):
    rng = random.Random(8)
    for _ in range(6):
        def made():
            ends = ["a"] + [f"_:{i}" for i in range(5)]
            return list({(rng.choice(ends), rng.choice("pq"), rng.choice(ends)) for _ in range(6)})

        a = made()
        b = renamed(a, 1) if rng.random() < 0.5 else made()
        try:
            assert same_graph(graph(a), graph(b)) == brute(a, b)
        except Undecided:
            pass


def test_limits(graph):
    assert same_graph(graph([]), graph([]))
    with pytest.raises(Undecided):
        same_graph(graph(cycle(4)), graph(cycle(4)), max_picks=0)
