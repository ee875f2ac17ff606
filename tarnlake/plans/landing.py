"""Registered queries on landed sources, caches and address functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as A
from ..operators import excerpt as E
from ..sources import cache as C
from ..sources import html as H
from ..sources import landed as S
from . import views as V
from .registry import Registry, listed, quoted

query = Registry()

# comment threads


@query("s03_flat_comments", """WITH root AS (SELECT conv_id FROM conversations WHERE turn = 0 AND length(trim(coalesce(text, ''))) > 0)
SELECT conv_id::VARCHAR AS thread_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, conv_id || '.' || turn AS comment_id, turn > 0 AS is_reply, text, CASE WHEN turn % 3 = 0 THEN 0 ELSE conv_id % 9 END::BIGINT AS likes, substring(sha256(coalesce(role, '')), 1, 12) AS author_hash
FROM conversations WHERE conv_id IN (SELECT conv_id FROM root)""")
def s03(spark, d):
    c = V.read(spark, d, "conversations")
    one = F.struct(F.concat_ws(".", "conv_id", "turn").alias("id"), "text", F.when(F.col("turn") % 3 > 0, F.col("conv_id") % 9).cast("long").alias("likes"), F.lit(None).cast("string").alias("published_at"), F.col("role").alias("author"))
    replies = F.transform(F.sort_array(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", one.alias("c"))))), lambda x: x["c"])
    threads = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, one)).alias("top"), replies.alias("replies"))
    nested = threads.select(F.col("conv_id").cast("string").alias("thread_id"), F.lit("v").alias("video_id"), "top", "replies")
    return S.flat_comments(nested).select("thread_id", "pos", "comment_id", "is_reply", "text", "likes", "author_hash")


@query("s34_namespaced", f"WITH {V.COMMENTS} SELECT 'u' || video_id || '::' || thread_id AS thread_id, pos FROM comments")
def s34(spark, d):
    c = V.comments(spark, d)
    return S.namespaced(c.withColumn("url", F.concat(F.lit("u"), "video_id"))).select("thread_id", "pos")


@query("s05_statistics", f"WITH {V.VIDEOS} SELECT s_suppkey, coalesce(n, 0) AS n, coalesce(likes, 0)::BIGINT AS likes FROM supplier LEFT JOIN (SELECT video_id // 1000000 AS k, count(*) AS n, sum(likes) AS likes FROM videos WHERE views >= 1500 GROUP BY 1) ON k = s_suppkey")
def s05(spark, d):
    v = V.videos(spark, d).where("views >= 1500")
    stats = v.groupBy(F.expr("video_id div 1000000").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum("likes").alias("likes"))
    return S.with_statistics(V.read(spark, d, "supplier").select("s_suppkey"), stats, "s_suppkey")


@query("s08_uploads", "SELECT o_custkey AS playlist_id, o_orderkey AS video_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def s08(spark, d):
    items = V.read(spark, d, "orders").select(F.col("o_custkey").alias("playlist_id"), F.col("o_orderkey").alias("video_id"), F.col("o_orderdate").alias("published_at"))
    return S.uploads(items, 3).select("playlist_id", "video_id")


# fetched pages


@query("s13_fetched_status", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'fetch_failed' WHEN length(coalesce(text, '')) < 200 THEN 'requires_dynamic_render' ELSE 'ok' END AS fetch_status, length(substring(text, 1, 3000)) AS n FROM documents")
def s13(spark, d):
    fetched = V.read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 503).otherwise(200).alias("status"), F.col("text").alias("content"))
    return S.fetched_status(fetched, 200, 3000).select("doc_id", "fetch_status", F.length("content").cast("long").alias("n"))


@query("s14_longer_text", "SELECT doc_id, sha256(CASE WHEN length(b) > length(a) THEN b ELSE a END) AS text FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE substring(coalesce(text, ''), 1, 400) END AS a, substring(coalesce(text, ''), 1, 150) AS b FROM documents)")
def s14(spark, d):
    first = F.when(F.col("doc_id") % 3 > 0, F.substring("text", 1, 400))
    return V.read(spark, d, "documents").select("doc_id", F.sha2(S.longer_text(first, F.substring("text", 1, 150)), 256).alias("text"))


@query("s16_to_fetch", f"WITH {V.COVERAGE} SELECT DISTINCT url FROM coverage WHERE url NOT IN (SELECT url FROM coverage WHERE tier = 1 AND candidate = 'c1') AND url NOT IN (SELECT url FROM coverage WHERE feature = 'f3' AND candidate = 'c2')")
def s16(spark, d):
    c = V.coverage(spark, d)
    return S.to_fetch(c, c.where("tier = 1 AND candidate = 'c1'"), c.where("feature = 'f3' AND candidate = 'c2'"))


_ROBOTS = "User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow: /p1 # all of them\nAllow: /p12\nDisallow:\nSitemap: /map"


@query("s18_site_text", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Body of ' || o_orderkey || chr(10) || 'second & line' WHEN 1 THEN 'Other ' || o_orderkey ELSE '' END AS body, CASE o_orderkey % 4 WHEN 0 THEN 'one two' || chr(10) || 'three' ELSE '' END AS comments FROM orders""")
def s18(spark, d):
    k = F.col("o_orderkey")
    one = F.concat(F.lit("<html><title>t</title><div class='head'>no</div><div class='x write'><p>Body of "), k, F.lit("</p><script>no</script><p>second &amp; line<br> - sent by app</p></div><ul><li class=c>one <b>two</b></li><li class='c d'>three<li class=c></li></ul>"))
    two = F.concat(F.lit("<div id=meta>views 3</div><article>Other "), k, F.lit("</article>"))
    page = F.when(k % 4 == 0, one).when(k % 4 == 1, two).when(k % 4 == 2, "<p>nothing</p>")
    pages = V.read(spark, d, "orders").select("o_orderkey", F.when(k % 4 < 2, F.concat(F.lit("site"), k % 4)).otherwise("site0").alias("site"), page.alias("html"))
    rules = {"site0": ((".write",), (".none", ".c")), "site1": (("#meta", "article"), (".c",))}
    return H.site_text(pages, rules, r"views \d+$", r"\s*- sent by app$").drop("site")


@query("s19_robots", f"WITH {V.COVERAGE} SELECT DISTINCT url, NOT (regexp_matches(url, '/p1') AND NOT regexp_matches(url, '/p12')) OR contains(url, '//www.s8.') AS allowed FROM coverage")
def s19(spark, d):
    hosts = spark.createDataFrame([(f"s{i}.example.com", _ROBOTS) for i in range(8)], "host string, text string")
    return S.allowed_by_robots(V.coverage(spark, d).select("url").distinct(), S.robots_rules(hosts)).select("url", "allowed")


@query("s20_feed_posts", """WITH i AS (SELECT s_suppkey, s_name, unnest([1, 2]) AS k FROM supplier WHERE s_suppkey % 3 < 2)
SELECT 'https://f' || s_suppkey || '.example.com/rss' AS url, s_name || ' & post ' || k AS title, 'https://f' || s_suppkey || '.example.com/' || k AS link, '2024-05-0' || k || 'T01:00:00Z' AS published_at, 'about ' || k AS summary FROM i""")
def s20(spark, d):
    s = V.read(spark, d, "supplier")
    url, name = F.concat(F.lit("https://f"), "s_suppkey", F.lit(".example.com/")), F.col("s_name")
    item = lambda k: F.concat(F.lit("<item><title> "), name, F.lit(f" &amp; post {k}</title><link>"), url, F.lit(f"{k}</link><dc:date>x</dc:date><pubDate>Mon, 0{k} May 2024 10:00:00 +0900</pubDate><description>about {k}</description></item>"))
    entry = lambda k: F.concat(F.lit("<entry><title>"), name, F.lit(f" &amp; post {k}</title><link href=\""), url, F.lit(f"{k}\"/><updated>2024-05-0{k}T01:00:00Z</updated><summary>about {k}</summary></entry>"))
    rss = F.concat(F.lit("<rss version=\"2.0\"><channel><title>t</title>"), item(1), item(2), F.lit("</channel></rss>"))
    atom = F.concat(F.lit("<feed><title>t</title>"), entry(1), entry(2), F.lit("</feed>"))
    xml = F.when(F.col("s_suppkey") % 3 == 0, rss).when(F.col("s_suppkey") % 3 == 1, atom).otherwise("no feed")
    return S.feed_posts(s.select(F.concat(url, F.lit("rss")).alias("url"), xml.alias("xml")))


_SITEMAPS = 2_000  # made in a task


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for each customer: 20 pages, of which some are posts; every fifth is an index."""
    c = V.read(spark, sf_dir, "customer")
    site = F.concat(F.lit("https://c"), "c_custkey", F.lit(".example.com"))
    page = lambda i: F.concat(F.lit("<url><loc> "), site, F.lit(f"/{'blog' if i % 4 else 'about'}/{i} </loc>{f'<lastmod>2024-{1 + i % 9:02d}-01</lastmod>' if i % 5 else ''}</url>"))
    pages = F.concat(F.lit('<urlset xmlns="x">'), *[page(i) for i in range(20)], F.lit("</urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), site, F.lit("/more.xml</loc><lastmod>2024-01-01</lastmod></sitemap></sitemapindex>"))
    c = c.select("c_custkey", F.concat(site, F.lit("/sitemap.xml")).alias("url"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-c.count() // _SITEMAPS))
    c = c.repartition(tasks, "url")  # a file of ids is one task's input, the documents made of it are not
    return c.select("url", F.when(F.col("c_custkey") % 5 == 0, index).otherwise(pages).alias("xml"))


_MAPS = """maps AS (SELECT 'https://c' || c_custkey || '.example.com/sitemap.xml' AS url, 'page' AS kind, 'https://c' || c_custkey || '.example.com/' || CASE WHEN i % 4 > 0 THEN 'blog/' ELSE 'about/' END || i AS loc, CASE WHEN i % 5 > 0 THEN '2024-0' || (1 + i % 9) || '-01' END AS lastmod
  FROM (SELECT c_custkey, unnest(range(20)) AS i FROM customer WHERE c_custkey % 5 > 0)
  UNION ALL SELECT 'https://c' || c_custkey || '.example.com/sitemap.xml', 'sitemap', 'https://c' || c_custkey || '.example.com/more.xml', '2024-01-01' FROM customer WHERE c_custkey % 5 = 0)"""


@query("s21_sitemap_urls", f"WITH {_MAPS} SELECT * FROM maps")
def s21(spark, d):
    return S.sitemap_urls(sitemaps(spark, d))


@query("s22_sitemap_posts", f"""WITH {_MAPS} SELECT url, loc, CAST(row_number() OVER (PARTITION BY url ORDER BY lastmod DESC NULLS LAST, loc) AS INTEGER) AS rank, CASE WHEN regexp_matches(loc, '/1[0-9]$') THEN 'titled' ELSE regexp_extract(loc, '[0-9]+$') END AS title
FROM maps WHERE kind = 'page' AND (regexp_matches(loc, '/(?:blog|post|news|article|entry)s?/|/[0-9]+$')) QUALIFY rank <= 6""")
def s22(spark, d):
    found = S.sitemap_urls(sitemaps(spark, d))
    meta = found.where(F.col("loc").rlike("/1[0-9]$")).select(F.col("loc").alias("url"), F.lit("titled").alias("title"), F.lit("").alias("description"))
    return S.sitemap_posts(found, meta, 6).select("url", "loc", "rank", "title")


@query("s24_press_lines", """SELECT 'u' || o_custkey AS url, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS rank, 'Release number ' || o_orderkey AS title, strftime(o_orderdate + INTERVAL 120 MONTH, '%Y-%m-%d') AS published_at FROM orders QUALIFY rank <= 4""")
def s24(spark, d):
    o = V.read(spark, d, "orders").withColumn("o_orderdate", F.add_months("o_orderdate", 120))
    shape = F.col("o_orderkey") % 3
    day, name = F.date_format("o_orderdate", "yyyy.MM.dd"), F.concat(F.lit("Release number "), "o_orderkey")
    spelt = F.concat(F.year("o_orderdate"), F.lit("년 "), F.month("o_orderdate"), F.lit("월 "), F.dayofmonth("o_orderdate"), F.lit("일"))
    block = F.when(shape == 0, F.concat(name, F.lit("  "), day)).when(shape == 1, F.concat(name, F.lit("\n "), day, F.lit(" \n"))).otherwise(F.concat(name, F.lit("\n"), spelt))
    pages = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))
    return E.press_lines(pages.select(F.concat(F.lit("u"), "o_custkey").alias("url"), "text"), 4)


@query("s25_reachability", f"""WITH {V.COVERAGE}, u AS (SELECT DISTINCT url FROM coverage), s AS (SELECT url, 200 + tier * 101 AS status, pos FROM coverage WHERE candidate <> 'c3')
SELECT u.url, CAST(coalesce(status, 0) AS INTEGER) AS status, CASE WHEN status < 400 THEN u.url || '/' END AS final_url FROM u LEFT JOIN (SELECT url, arg_max(status, pos) AS status FROM s GROUP BY url) s ON s.url = u.url""")
def s25(spark, d):
    c = V.coverage(spark, d)
    status = (200 + F.col("tier") * 101).cast("int")
    seen = c.where("candidate <> 'c3'").select("url", status.alias("status"), F.when(status < 400, F.concat("url", F.lit("/"))).alias("final_url"), F.col("pos").alias("checked_at"))
    return S.reachability(c.select("url").distinct(), seen).na.fill(0, ["status"])


# caches


def _entries(spark, d):
    o = V.read(spark, d, "orders")
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 86_400)
    return o.select(F.when(F.col("o_orderkey") % 4 == 0, "b").otherwise("a").alias("agent"), F.col("o_custkey").cast("string").alias("cache_key"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("output"), at.alias("created_at"))


_ENTRIES = "entries AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'b' ELSE 'a' END AS agent, o_custkey::VARCHAR AS cache_key, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS output, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS created_at FROM orders)"


@query("s35_cache_lookup", f"""WITH {_ENTRIES}, last AS (SELECT cache_key, arg_max({{'o': output}}, created_at) AS o FROM entries WHERE agent = 'a' AND created_at + INTERVAL 20000 HOUR >= TIMESTAMP '1998-08-01' GROUP BY cache_key)
SELECT c_custkey, o.o AS output, last.cache_key IS NOT NULL AS hit FROM customer LEFT JOIN last ON cache_key = c_custkey::VARCHAR""")
def s35(spark, d):
    inputs = V.read(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("cache_key"))
    return C.lookup(inputs, _entries(spark, d), "a", F.lit("1998-08-01").cast("timestamp"), 20_000).select("c_custkey", "output", "hit")


@query("s38_cache_statistics", f"WITH {_ENTRIES} SELECT agent, count(*) AS entries, count(DISTINCT cache_key) AS keys FROM entries GROUP BY agent")
def s38(spark, d):
    return C.statistics(_entries(spark, d)).select("agent", "entries", "keys")


@query("s40_compacted", f"WITH {_ENTRIES} SELECT agent, cache_key, arg_max({{'o': output}}, created_at).o AS output FROM entries GROUP BY agent, cache_key")
def s40(spark, d):
    return C.compacted(_entries(spark, d)).select("agent", "cache_key", "output")


@query("s42_changed_reports", "SELECT c_custkey AS report_id FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE last IS DISTINCT FROM '1-URGENT'")
def s42(spark, d):
    shots = V.read(spark, d, "orders").select(F.col("o_custkey").alias("report_id"), F.sha2("o_orderpriority", 256).alias("content_hash"), F.col("o_orderkey").alias("at"))
    return C.changed(V.read(spark, d, "customer").select(F.col("c_custkey").alias("report_id"), F.lit("1-URGENT").alias("content")), shots).select("report_id")


@query("s44_new_rejections", f"WITH {V.COVERAGE} SELECT DISTINCT candidate, url FROM coverage WHERE tier = 3 AND (candidate, url) NOT IN (SELECT (candidate, url) FROM coverage WHERE tier = 0)")
def s44(spark, d):
    c = V.coverage(spark, d).select("candidate", "url", "tier")
    return C.new_rejections(c.where("tier = 3").drop("tier"), c.where("tier = 0").select("candidate", "url").distinct())


# addresses

_URLS = (
    "https://www.youtube.com/watch?x=1&v={11}", "https://youtu.be/{11}?t=1", "https://www.youtube.com/@brand{}", "https://www.youtube.com/channel/UC{}/videos", "https://blog.naver.com/user{}/223", "https://team{}.tistory.com/entry/My-first_post%20{}+x/",
    "https://www.instagram.com/acct{}/", "https://x.com/name{}", "https://example.com/p/card-{}", "https://shop.example.com/", "http://www.clien.net/service/board/park/{}", "not an address {}",
)
_PLATFORMS = ("youtube_official", "blog_naver", "blog_tistory", "instagram", "x", "blog_self_hosted", "press_release")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address of each kind in turn for every order: id, url, platform."""
    o = V.read(spark, sf_dir, "orders")
    k = F.expr("o_orderkey div 7")
    shown = F.get(F.array(*[F.lit(u) for u in _URLS]), (k % len(_URLS)).cast("int"))
    url = F.replace(F.replace(shown, F.lit("{11}"), F.lpad(F.col("o_orderkey").cast("string"), 11, "0")), F.lit("{}"), F.col("o_orderkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), url.alias("url"), F.get(F.array(*[F.lit(p) for p in _PLATFORMS]), (F.col("o_orderkey") % len(_PLATFORMS)).cast("int")).alias("platform"))


ADDRESSES = f"""addresses AS (SELECT o_orderkey AS id, replace(replace({listed(_URLS)}[CAST((o_orderkey // 7) % {len(_URLS)} AS INTEGER) + 1], '{{11}}', lpad(o_orderkey::VARCHAR, 11, '0')), '{{}}', o_orderkey::VARCHAR) AS url, {listed(_PLATFORMS)}[CAST(o_orderkey % {len(_PLATFORMS)} AS INTEGER) + 1] AS platform FROM orders),
parts AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM addresses)"""
_IN = lambda *domains: "(" + " OR ".join(f"host = {quoted(x)} OR ends_with(host, {quoted('.' + x)})" for x in domains) + ")"


def each(name: str, column, sql: str):
    def run(spark, d):
        return addresses(spark, d).select("id", column().alias("value"))

    query(name, f"WITH {ADDRESSES} SELECT id, {sql} AS value FROM parts")(run)


each("f17_on_site", lambda: A.matches_domain(A.host("url"), "example.com"), _IN("example.com"))
each("f18_whitelisted", lambda: A.matches_any(A.host("url"), ["youtube.com", "youtu.be", "x.com"]), _IN("youtube.com", "youtu.be", "x.com"))
each("f19_host_suffix", lambda: A.matches_any(A.host("url"), F.array(F.lit("tistory.com"), F.lit("naver.com"))), _IN("tistory.com", "naver.com"))
each("f21_positive_gate", lambda: A.positive_gate("url", F.array(F.lit("example.com")), F.array(F.lit("team1"), F.lit("x"))), f"{_IN('example.com')} OR contains(host, 'team1')")
each("f22_fast_path", lambda: A.fast_path("url", F.array(F.lit("example.com"), F.lit("tistory.com")), F.array(F.lit("card"), F.lit("first_post"))), f"CASE WHEN {_IN('example.com', 'tistory.com')} AND (contains(lower(path), 'card') OR contains(lower(path), 'first_post')) THEN 0.95::DOUBLE WHEN {_IN('example.com', 'tistory.com')} AND len(list_filter(string_split(path, '/'), lambda s: s <> '')) <= 1 THEN 0.9::DOUBLE END")
each("f28_platform_guard", lambda: A.platform_allowed("url", "platform"), f"CASE platform WHEN 'blog_self_hosted' THEN NOT {_IN('youtube.com', 'instagram.com', 'x.com', 'blog.naver.com', 'tistory.com')} AND host <> '' WHEN 'youtube_official' THEN {_IN('youtube.com')} WHEN 'instagram' THEN {_IN('instagram.com')} WHEN 'x' THEN {_IN('x.com', 'twitter.com')} WHEN 'blog_naver' THEN {_IN('blog.naver.com')} WHEN 'blog_tistory' THEN {_IN('tistory.com')} ELSE host <> '' END")
each("h18_video_id", lambda: A.video_id("url"), r"regexp_extract(url, '(?:[?&]v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})', 1)")
each("h19_handle", lambda: A.handle("url", "platform"), r"CASE platform WHEN 'blog_tistory' THEN regexp_extract(host, '^([^.]+)\.tistory\.com$', 1) WHEN 'youtube_official' THEN CASE WHEN regexp_extract(regexp_replace(path, '^/+', ''), '^(?:channel|c|user)/([^/]+)', 1) <> '' THEN regexp_extract(regexp_replace(path, '^/+', ''), '^(?:channel|c|user)/([^/]+)', 1) ELSE regexp_replace(split_part(regexp_replace(path, '^/+', ''), '/', 1), '^@', '') END ELSE regexp_replace(split_part(regexp_replace(path, '^/+', ''), '/', 1), '^@', '') END")
each("h20_slug_title", lambda: A.slug_title("url"), "trim(regexp_replace(url_decode(replace(list_last(string_split(regexp_replace(path, '/+$', ''), '/')), '+', '%2B')), '[-_]+', ' ', 'g'))")
each("h21_mobile_rewrite", lambda: A.mobile_rewrite("url", {"clien.net": "m.clien.net", "x.com": "mobile.x.com"}), "replace(replace(replace(url, '://www.clien.net/', '://m.clien.net/'), '://clien.net/', '://m.clien.net/'), '://x.com/', '://mobile.x.com/')")
each("s23_feed_candidates", lambda: F.array_join(A.feed_candidates("url", "platform", A.handle("url", "platform")), "|"), r"CASE platform WHEN 'blog_naver' THEN 'https://rss.blog.naver.com/' || regexp_replace(split_part(regexp_replace(path, '^/+', ''), '/', 1), '^@', '') || '.xml' WHEN 'blog_tistory' THEN regexp_replace(url, '/+$', '') || '/rss' ELSE array_to_string(list_transform(['/feed', '/rss', '/rss.xml', '/atom.xml'], lambda x: regexp_replace(url, '/+$', '') || x), '|') END")
each("w29_handle_candidates", lambda: F.array_join(A.handle_candidates(F.array(A.handle("url", "platform"), F.concat(F.lit("the_"), F.substring("platform", 1, 5)))), "|"), "h")
query.sql["w29_handle_candidates"] = f"""WITH {ADDRESSES}, a AS (SELECT id, platform, CASE platform WHEN 'blog_tistory' THEN regexp_extract(host, '^([^.]+)\\.tistory\\.com$', 1) WHEN 'youtube_official' THEN CASE WHEN regexp_extract(regexp_replace(path, '^/+', ''), '^(?:channel|c|user)/([^/]+)', 1) <> '' THEN regexp_extract(regexp_replace(path, '^/+', ''), '^(?:channel|c|user)/([^/]+)', 1) ELSE regexp_replace(split_part(regexp_replace(path, '^/+', ''), '/', 1), '^@', '') END ELSE regexp_replace(split_part(regexp_replace(path, '^/+', ''), '/', 1), '^@', '') END AS h, 'the_' || substring(platform, 1, 5) AS k FROM parts),
b AS (SELECT id, list_filter([h, k, regexp_replace(lower(h), '[^a-z0-9]', '', 'g'), regexp_replace(lower(k), '[^a-z0-9]', '', 'g')], lambda x: x <> '') AS c FROM a)
SELECT id, array_to_string(list_transform(list_filter(list_transform(c, lambda x, i: {{'x': x, 'i': i}}), lambda s: list_position(c, s.x) = s.i), lambda s: s.x), '|') AS value FROM b"""


@query("f38_status_ok", "SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 9 > 0 THEN 150 + o_orderkey % 300 END BETWEEN 200 AND 399, false) AS value FROM orders")
def f38(spark, d):
    status = F.when(F.col("o_orderkey") % 9 > 0, 150 + F.col("o_orderkey") % 300)
    return V.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), A.status_ok(status).alias("value"))
