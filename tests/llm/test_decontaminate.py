from pyspark.sql import functions as F

from kgweave.llm import decontaminate
from kgweave.llm.tables import documents


def test_blocks_give_the_same(spark, saved, docs, monkeypatch):
    """A benchmark too large for one broadcast goes in blocks; SQL covers one block."""
    items = documents(spark, saved, "benchmark")
    read = lambda: sorted(str(tuple(r)) for r in decontaminate.contamination(docs, items).withColumn(
        "spans", F.array_sort("spans")).collect())
    whole = read()
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 4)
    assert read() == whole


def test_only_contaminated_documents_go(spark, saved, docs, nothing):
    items = documents(spark, saved, "benchmark")
    given = docs.withColumn("_row", F.lit(1)).withColumn("items", F.lit("mine")).withColumn("token", F.lit(2))
    kept = decontaminate.remove_contaminated(given, items)
    assert kept.columns == given.columns
    hit = decontaminate.contamination(docs, items).where(F.size("spans") > 0).count()
    assert 3 <= hit < docs.count() and kept.count() == docs.count() - hit
    assert decontaminate.remove_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.remove_contaminated(nothing, items).collect() == []
