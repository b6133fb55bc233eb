import random
import zlib

import pytest
from pyspark.sql import functions as F

from kgweave.llm import language


def english(rng, alphabet):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(60))


def test_held_out_accuracy_and_split(spark):
    rng = random.Random(1)
    made = [("aab", "aeioukmn"), ("bbc", "rstlaeou"), ("ccd", "абвгдежз")]
    rows = [(i, english(rng, made[i % 3][1]), made[i % 3][0]) for i in range(150)]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = found.select("*", language.held_out(F.col("doc_id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    out = [r for r in found if r.out]
    assert len(out) > 20 and sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in found)


def test_label_of_held_out_rows_is_not_used(spark):
    rng = random.Random(2)
    rows = [(i, english(rng, "aeiouk" if i % 2 else "rstlmn"), "xx" if i % 2 else "yy") for i in range(60)]
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    read = lambda data: {r.doc_id: (r.lang_pred, r.score) for r in language.identify(
        spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert read(rows) == read(swapped)


def test_defined_results(docs, nothing):
    found = language.identify(docs.withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit(3))).collect()
    assert len(found) == docs.count()
    for r in found:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de")
    unlearned = language.predict(docs, []).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}
    assert language.identify(nothing).collect() == []


def test_pieces_count_as_the_whole():
    rng = random.Random(3)
    text = "".join(rng.choice("abc dé 1") for _ in range(5000))
    whole = language.Trigrams(64).bundles([text])
    before = language.PIECE
    try:
        language.PIECE = 1 << 20
        assert (language.Trigrams(64).bundles([text]) == whole).all()
    finally:
        language.PIECE = before


@pytest.mark.parametrize("piece", [1, 2, 7, 100, 4999])
def test_small_pieces_count_as_the_whole(monkeypatch, piece):
    rng = random.Random(4)
    text = "".join(rng.choice("abc dé 1 ... ΣΟΣ") for _ in range(3000)) + "  \n 1 " * 200 + "end"
    whole = [language.Trigrams(64).bundles([t]) for t in (text, " " * 50, "ab")]
    monkeypatch.setattr(language, "PIECE", piece)
    for t, want in zip((text, " " * 50, "ab"), whole):
        assert (language.Trigrams(64).bundles([t]) == want).all()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "abc def", "en", 1, 2) for i in range(9)],
                                 "doc_id long, text string, lang string, judged int, _judged int")
    got = language.identify(docs)
    assert got.columns == [*docs.columns, "lang_pred", "score"] and got.where("judged = 1 AND _judged = 2").count() == 9
