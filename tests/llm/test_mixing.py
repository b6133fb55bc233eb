import pytest
from pyspark.sql import functions as F

from kgweave.llm import mixing


def slow_targets(sizes, share=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(repeats * sizes[s] for s in capped)
        targets = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s, t in targets.items() if t > repeats * sizes[s] + 1e-9}
        if not over:
            return targets | {s: repeats * sizes[s] for s in capped}
        capped |= over


def test_targets_takes_and_positions(docs, rows):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want, taken = slow_targets(sizes), {}
    for r in mixing.curriculum(docs).collect():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        words = sum(t["words"] for t in r.takes)
        assert words <= 2 * r.size and all(0 < t["position"] < 1 for t in r.takes)
        taken[r.source] = taken.get(r.source, 0) + words
    assert all(taken[s] == int(want[s] + 1e-6) for s in want)


def test_order_follows_the_schedules(spark):
    rows = [(i, "w " * 10, ("a", "b", "c")[i % 3]) for i in range(3000)]
    plan = mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=1.0)
    order = mixing.training_order(plan).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    share = lambda part, s: sum(r.taken for r in part if r.source == s) / sum(r.taken for r in part)
    tenth = len(order) // 10
    for source, (first, last) in zip("abc", mixing.SCHEDULES):
        begin = first / sum(w for w, _ in mixing.SCHEDULES)
        end = last / sum(w for _, w in mixing.SCHEDULES)
        slope = (end - begin) * 0.05
        assert share(order[:tenth], source) == pytest.approx(begin + slope, abs=0.03)
        assert share(order[-tenth:], source) == pytest.approx(end - slope, abs=0.03)


def test_reruns_partitions_and_columns(docs, nothing):
    read = lambda d: sorted(str(tuple(r)) for r in mixing.curriculum(d).collect())
    assert read(docs) == read(docs.repartition(5))
    given = docs.withColumn("size", F.lit("old")).withColumn("bucket", F.lit("b")).withColumn("kept", F.lit(1)).withColumn(
        "own", F.lit(2))
    plan = mixing.curriculum(given, keep=given.columns)
    assert dict(plan.dtypes)["size"] == "bigint" and {"bucket", "kept", "own", "text"} <= set(plan.columns)
    assert plan.count() == docs.count() and {(r.bucket, r.kept, r.own) for r in plan.collect()} == {("b", 1, 2)}
    assert mixing.training_order(mixing.curriculum(nothing)).collect() == []
