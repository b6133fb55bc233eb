from kgweave.llm import licences


def test_sentences_in_order_make_a_licence(spark, docs, nothing):
    header = [licences.SENTENCES[i].capitalize() for i in licences.RULES[1][2]]
    rows = [(1, "Intro. " + "! ".join(header) + "."), (2, ". ".join(reversed(header))), (3, None), (4, ""),
            (5, "Released under the MIT License.\nother text\nAll rights reserved"), (5, "Nothing of the kind."),
            (6, "Text. " * 20_000 + "Licensed under CC-BY 4.0.")]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.licences, r.rules, len(r.sentence_ids)) for r in found.collect())
    assert got == [
        (1, ["Apache-2.0"], ["apache-header", "apache-short"], 4), (2, ["Apache-2.0"], ["apache-short"], 4),
        (3, [], [], 0), (4, [], [], 0), (5, [], [], 0),
        (5, ["LicenseRef-all-rights-reserved", "MIT"], ["all-rights", "mit-short"], 2), (6, ["CC-BY-4.0"], ["cc-by"], 1)]
    assert licences.scan(docs).count() == docs.count()
    assert licences.scan(nothing).collect() == []
