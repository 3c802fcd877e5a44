"""Pages by tag depth, and the payloads of profiles, on pages written out; time in proportion to the page."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from exposark.sources import pages as P

ONE = """<html><head><title> A &amp; B </title><meta property="og:title" content="Ann Lee (@ann) on X"><meta content='Likes &quot;rivers&quot;' name=og:description>
<script type="application/ld+json">{"@graph": [{"@type": "WebSite", "url": "https://linkedin.com/x"}, {"@type": "Person", "name": "Ann Lee", "description": "Writes", "url": "https://ann.example", "address": {"addressLocality": "Pune", "addressCountry": "IN"}}]}</script>
<script type="application/ld+json">not json</script><script type="application/ld+json">[{"name": "A list"}]</script><script type="application/ld+json">{"author": {"name": "Other", "url": "https://other.example"}, "logo": "l.png"}</script></head>
<body><nav>menu<nav>inner</nav>still menu</nav><p>Visible text<div><aside>unclosed aside</div>after the div<form><select><option>a<option>b</select></form><footer>foot</body></html>"""


def rows_of(spark, pages):
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, html string").withColumn("page", P.page(F.col("html")))
    return frame.select("i", P.title(F.col("page")).alias("title"), P.lines(F.col("page.text")).alias("text"), P.profile_fields(F.col("page")).alias("own")).orderBy("i").collect()


def test_nested_and_unclosed_tags_and_payloads(spark):
    one, og, nothing, null = rows_of(spark, [ONE, '<title></title><meta property="og:title" content="Bo | LinkedIn"><meta property="og:image" content="b.png"><p>x &lt; y</p>', "", None])
    assert (one["title"], one["text"]) == ("A & B", "A & B\nVisible text\nafter the div")
    assert one["own"].asDict() == {"display_name": "Ann Lee", "bio": "Writes", "website": "https://ann.example", "location": "Pune, IN", "avatar": "l.png"}
    assert (og["title"], og["text"], og["own"]["display_name"], og["own"]["avatar"]) == ("", "x < y", "Bo", "b.png")
    assert (nothing["title"], nothing["text"]) == (null["title"], null["text"]) == ("Untitled Page", "")


@pytest.mark.parametrize("unit", ["<script>", "<nav>", "<div><nav>", "</nav>", "<p>a", '<a b="', "<", "<!--", "<option>", '<meta name=a content="'])
def test_a_megabyte_of_bad_markup_is_read_in_time(unit):
    began = time.process_time()
    P.read(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 5


def test_near_words_plainly(spark):
    text = "call our office at a@b.co " + "x" * 250 + " c@d.co " + "y" * 190 + " dean; C@D.CO again"
    row = spark.createDataFrame([(text, ["a@b.co", "c@d.co", "none@x.co"]), (None, ["a"]), ("office", [])], "t string, v array<string>").withColumn("n", P.near_words(F.col("t"), F.col("v"), "office|dean", 200))
    assert [r["n"] for r in row.collect()] == [[True, True, False], [False], []]


@pytest.mark.parametrize(("url", "name"), [("https://x.com/ann?x=1", "ann"), ("https://www.linkedin.com/in/bo-lee/", "bo-lee"), ("https://reddit.com/u/carl", "carl"), ("https://a.org/", None), (None, None)])
def test_names_in_addresses(spark, url, name):
    assert spark.createDataFrame([(url,)], "u string").select(P.username(F.col("u"))).first()[0] == name


def test_workers_get_batches_bounded_by_bytes(spark, tmp_path):
    from pyspark.sql import functions as F

    from exposark.sources import corpus

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(0, 200, 1, 1).select(F.col("id").alias("page_id"), F.repeat(F.lit("word "), 20_000).alias("html")).write.parquet(str(tmp_path / "pages.parquet"))

    @F.arrow_udf("int")
    def size(pages):
        import pyarrow as pa

        return pa.array([len(pages)] * len(pages), pa.int32())

    sizes = [r["n"] for r in corpus.table(spark, str(tmp_path), "pages").select(size("html").alias("n")).collect()]
    assert len(sizes) == 200
    assert max(sizes) <= 60  # of 100 000 bytes each, 42 fill 4 MB; all 200 came at once before


CUT = ("token = &quot", "Ann said token = &quot", "R&amp;D &am", "R&amp", "two &copy", "&quo", "&amplify", "a &quot;b&quot; &amp;quot; c")


@pytest.mark.parametrize("name", ["page_texts", "page_profile_text", "page_profiles", "url_findings", "url_score"])
def test_references_cut_short_are_read_as_in_sql(spark, tmp_path, name):
    import duckdb

    from exposark import catalogue

    html = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>The whole of the article, &middot; &copy; all told.</p></body></html>"
    spark.createDataFrame([(i, f"https://a.example/{i}", html.format(t)) for i, t in enumerate(CUT)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    ours = catalogue.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(ours.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()))
