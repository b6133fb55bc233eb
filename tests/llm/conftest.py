import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "So", "é", "zü") for b in ("na", "rit", "pos", "del", "um", "x9")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages and lines, ties, repeated rows, nulls, an empty and a long text."""
    rng = random.Random(5)
    passage, lines = prose(rng, 30), "\n".join(prose(rng, 6) for _ in range(4))
    texts = [prose(rng, rng.randint(1, 90)) for _ in range(20)]
    texts += [texts[3]] * 3 + [texts[4] + " extra", "", " \n\t ", None, None, "x", "X"]
    texts += [prose(rng, 10) + " " + passage + "  " + prose(rng, 12), passage + "\n" + passage, "\n" + lines + "\n\n" + prose(rng, 9)]
    texts += [lines + "\n" + prose(rng, 8) + "\n" + lines, prose(rng, 6000), "ab " * 300, "same line\n" * 9]
    rows = [(i, t, ("en", "de", None)[i % 3], ("web", "web", "web", "books", None)[i % 5], None if t is None else len(t))
            for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[5], "en", "wiki", 1), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def saved(spark, docs, tmp_path_factory):
    """A folder with the tables that the queries read."""
    folder = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    long = next(r[1] for r in corpus() if r[1] and len(r[1].split()) == 6000).split()
    items = [("a", " ".join(long[50:75])), ("b", "x"), ("c", None), ("d", ""), ("b", "x"), ("e", "none of this, at all"),
             ("f", " ".join(long[60:70]).upper()), (None, "ab ab ab")]
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)
