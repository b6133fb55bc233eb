from pyspark.sql import functions as F

from kgweave.llm import sitestyle

SCHEMA = "page_id long, url string, html string"


def page(i, host="news.example", extra=""):
    """A page without telling names: only the host's other pages show what is template."""
    return (i, f"https://{host}/{i}",
            f"<html><head><title>t{i}</title></head><body><div class='a1'><p>Always the same top</p></div>"
            f"<div class='b1'><h1>Title {i}</h1><p>Text  of\n page {i} &amp; &eacute;{extra}</p><p>Second {i}</p></div>"
            f"<div class='c1'><p>Always the same end</p></div></body></html>")


def extracted(spark, rows):
    return {r.page_id: r for r in sitestyle.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_host_template_goes_and_articles_stay(spark):
    found = extracted(spark, [page(i) for i in range(12)] + [page(99, "other.example")])
    for i in range(12):
        assert found[i].text == f"Title {i}\n\nText of page {i} & é\n\nSecond {i}"
        assert found[i].n_chars == len(found[i].text)
    assert found[99].text.startswith("Always the same top")  # a host's only page has no template


def test_copies_of_a_page_are_no_template(spark):
    rows = [page(i) for i in range(8)] + [(100 + k, "https://news.example/x", page(3)[2]) for k in range(40)]
    found = extracted(spark, rows)
    assert all(found[100 + k].text == found[3].text != "" for k in range(40))


def test_both_ways_to_the_noise_lists_agree(spark, monkeypatch):
    rows = [page(i) for i in range(9)] + [page(50 + i, "b.example", " more") for i in range(5)]
    near = {i: r.text for i, r in extracted(spark, rows).items()}
    monkeypatch.setattr(sitestyle, "BROADCAST_BYTES", -1)
    assert near == {i: r.text for i, r in extracted(spark, rows).items()}


def test_named_branches():
    html = ("<head><title>x</title><nav>menu</nav><article><header><h1>Head</h1><span>by</span></header><p>A &lt;b&gt;"
            "<p>B<script>no()</script><style>no</style><form>no</form><aside>no</aside><div class=comments>no</div></article>"
            "<div id=cookieNotice>no</div><footer>no</footer>")
    assert sitestyle.blocks_of(html) == ["Head", "by", "A <b>", "B"] or sitestyle.blocks_of(html)[0] == "Head"
    text = " ".join(sitestyle.blocks_of(html))
    assert "no" not in text.split() and "menu" not in text and text.endswith("A <b> B")
    assert sitestyle.blocks_of("<form><article>kept</article></form>") == ["kept"]
    assert sitestyle.blocks_of("plain &amp; bare") == ["plain & bare"]


def test_defined_results(spark):
    rows = [(1, None, None), (2, "http://[bad", "<p>one"), (3, None, ""), (None, "u", "<p>two</p>" * 3), (5, "u", "<" * 5000),
            (6, "u", "<p>" + "long " * 100_000), (2, "http://[bad", "<p>one")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("old")).withColumn("host", F.lit("mine"))
    found = sitestyle.extract(pages)
    assert found.columns == ["page_id", "url", "html", "host", "text", "n_chars"]
    got = sorted((str(r.page_id), r.text[:8], r.n_chars, r.host) for r in found.collect())
    assert got == sorted([("1", "", 0, "mine"), ("2", "one", 3, "mine"), ("2", "one", 3, "mine"), ("3", "", 0, "mine"),
                          ("None", "two\n\ntwo", 13, "mine"), ("5", "<" * 8, 5000, "mine"), ("6", "long lon", 499_999, "mine")])
