from pyspark.sql import functions as F

from kgweave.llm import linededup


def slow_lines(rows, k):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        text = rows[i][1]
        lines = [] if text is None else text.split("\n")
        full = [n for n, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for s in range(len(full) - k + 1):
            run = tuple(lines[n] for n in full[s:s + k])
            gone.update(full[s:s + k]) if run in seen else seen.add(run)
        left = None if text is None else "\n".join(x for n, x in enumerate(lines) if n not in gone)
        out[i] = (left, len(full), len(gone))
    return out


def test_runs_of_several_lengths(docs, rows):
    """The SQL comparison covers runs of three lines; one, two and five double the prefix differently."""
    for k in (1, 2, 5):
        want = slow_lines(rows, k)
        got = linededup.dedup_lines(docs, k).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *want[i])) for i, r in enumerate(rows))


def test_columns_and_copies(docs, nothing):
    given = docs.withColumn("lost", F.lit("mine")).withColumn("row", F.lit(7)).withColumn("doc", F.lit("d"))
    cleaned = linededup.dedup_lines(given)
    assert set(cleaned.columns) == {*docs.columns, "row", "doc", "n_lines", "n_removed", "lost"}
    assert {(r.row, r.doc) for r in cleaned.collect()} == {(7, "d")}
    assert linededup.drop_copied(docs).columns == docs.columns
    assert linededup.dedup_lines(nothing).collect() == []


def test_mostly_copied_documents_go(spark):
    shared = "\n".join(f"shared line number {i}" for i in range(10))
    rows = [(1, shared), (2, shared + "\nx"), (3, "own text that is long enough to stay\n" * 2 + "and more of it " * 40 + "\n" + shared)]
    kept = {r.doc_id: r.text for r in linededup.drop_copied(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(kept) == {1, 3} and "shared" not in kept[3] and kept[3].startswith("own text")
