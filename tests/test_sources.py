"""Landed sources, caches, page parsing, the paged data source and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tarnlake.sources import cache, html, landed, paged
from tarnlake.streaming import windows


def test_threads_flatten(spark):
    rows = [("t1", "v", {"id": "a", "text": "root", "likes": 1, "published_at": "", "author": "me"}, [{"id": "b", "text": "reply", "likes": None, "published_at": "", "author": None}]), ("t2", "v", {"id": "c", "text": " ", "likes": 0, "published_at": "", "author": ""}, None)]
    got = landed.flat_comments(spark.createDataFrame(rows, landed.THREAD)).orderBy("pos").collect()
    assert [(r["comment_id"], r["is_reply"], r["likes"]) for r in got] == [("a", False, 1), ("b", True, 0)] and len(got[0]["author_hash"]) == 12


def test_feeds_and_sitemaps(spark):
    rss = "<rss><channel><title>x</title><item><title>A</title><link>http://a</link><pubDate>Mon, 06 May 2024 10:00:00 +0000</pubDate><description>d</description></item><item><title>B</title><link>http://b</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>y</title><entry><title>C</title><updated>2024-05-06T01:00:00Z</updated><link href="http://c"/></entry></feed>'
    got = landed.feed_posts(spark.createDataFrame([("r", rss), ("a", atom), ("bad", "<oops"), ("none", None)], "url string, xml string")).orderBy("title").collect()
    assert [(r["title"], r["link"], r["published_at"]) for r in got] == [("A", "http://a", "2024-05-06T10:00:00Z"), ("B", "http://b", ""), ("C", "http://c", "2024-05-06T01:00:00Z")]
    site = "<urlset><url><loc>http://a/post/1</loc><lastmod>2024-01-02</lastmod></url><url><loc>http://a/about</loc></url></urlset>"
    pages = landed.sitemap_urls(spark.createDataFrame([("s", site)], "url string, xml string"))
    posts = landed.sitemap_posts(pages, spark.createDataFrame([("http://z", "t", "d")], "url string, title string, description string")).collect()
    assert [(r["loc"], r["title"]) for r in posts] == [("http://a/post/1", "1")]


def test_robots(spark):
    rules = landed.robots_rules(spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /x\nAllow: /x/ok\n\nUser-agent: bot\nDisallow: /")], "host string, text string"))
    u = spark.createDataFrame([("https://a.com/x/1",), ("https://a.com/x/ok",), ("https://b.com/x",)], "url string")
    assert {r["url"]: r["allowed"] for r in landed.allowed_by_robots(u, rules).collect()} == {"https://a.com/x/1": False, "https://a.com/x/ok": True, "https://b.com/x": True}


def test_cache(spark, tmp_path):
    path, now = str(tmp_path / "cache"), F.lit(dt.datetime(2024, 1, 2))
    inputs = cache.keyed(spark.createDataFrame([("a",), ("b",)], "text string"), "agent", "text")
    assert cache.lookup(inputs, cache.read(spark, path), "agent", now).where("hit").count() == 0
    cache.store(inputs.where("text = 'a'").withColumn("output", F.lit("out")), path, "agent", F.lit(dt.datetime(2024, 1, 1)))
    got = {r["text"]: (r["output"], r["hit"]) for r in cache.lookup(inputs, cache.read(spark, path), "agent", now, 48).collect()}
    assert got == {"a": ("out", True), "b": (None, False)}
    assert cache.lookup(inputs, cache.read(spark, path), "agent", now, 1).where("hit").count() == 0
    assert cache.statistics(cache.read(spark, path)).first()["keys"] == 1


def test_page_parser(spark):
    page = "<html><head><title>T</title><script>x=1</script><meta name=description content='D'></head><body><h1>H</h1><h1>H</h1><p>one &amp; two</p><time datetime='2024-01-01'></time></body></html>"
    m = html.page_metadata(spark.createDataFrame([(1, page), (2, None)], "id int, html string")).orderBy("id").collect()
    assert tuple(m[0][1:]) == ("T", "D", ["H"], "H\nH\none & two", "2024-01-01") and tuple(m[1][1:]) == ("", "", [], "", "")


def test_paged_source(spark, tmp_path):
    for q, pages in (("a", [[1, 2], [3]]), ("b", [[4]])):
        for i, items in enumerate([*pages, []]):
            (tmp_path / f"{q}-{i}.json").write_text(json.dumps({"items": items}))
    paged.register(spark)
    df = spark.read.format("paged_json").option("url", f"file://{tmp_path}/{{query}}-{{page}}.json").option("queries", json.dumps(["a", "b", "a"])).load()
    assert sorted((r["query"], r["page"], r["item"]) for r in df.collect()) == [("a", 0, "1"), ("a", 0, "2"), ("a", 1, "3"), ("b", 0, "4")]


def test_streams(spark, tmp_path):
    schema = "candidate string, polarity string, posted_at timestamp, text string"
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("c", "positive", at, "the same comment text"), ("c", "negative", at, "the same comment text"), ("c", "positive", at + dt.timedelta(days=40), "another comment text")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, want in (("monthly", windows.monthly(stream), 1), ("seen", windows.first_seen(stream), 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want
