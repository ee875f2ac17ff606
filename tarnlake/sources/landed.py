"""Landed source data as tables: comment threads, statistics, feeds, sitemaps, pages, registries and caches.

Collectors land raw responses; everything after that is a DataFrame. Readers take a path that Spark reads, so local and remote
stores are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions import text as X
from ..functions import urls as U

REPLY = "struct<id:string,text:string,likes:bigint,published_at:string,author:string>"
THREAD = f"thread_id string, video_id string, top {REPLY}, replies array<{REPLY}>"


def flat_comments(threads: DataFrame) -> DataFrame:
    """A thread's root and replies as rows; threads whose root has no text are left out, authors are hashed."""
    row = lambda x, reply: F.struct(x["id"].alias("comment_id"), F.lit(reply).alias("is_reply"), x["text"].alias("text"), F.coalesce(x["likes"], F.lit(0)).alias("likes"), x["published_at"].alias("published_at"), F.substring(F.sha2(F.coalesce(x["author"], F.lit("")), 256), 1, 12).alias("author_hash"))
    replies = F.transform(F.coalesce("replies", F.array().cast(f"array<{REPLY}>")), lambda r: row(r, True))
    rows = F.concat(F.array(row(F.col("top"), False)), replies)
    known = threads.where(F.length(F.trim(F.coalesce(F.col("top.text"), F.lit("")))) > 0)
    return known.select("thread_id", "video_id", F.posexplode(rows).alias("pos", "c")).select("thread_id", "video_id", "pos", "c.*")


def with_statistics(rows: DataFrame, stats: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows with looked-up columns; counts that are missing become 0."""
    counts = [f.name for f in stats.schema if isinstance(f.dataType, T.LongType) and f.name != key]
    return rows.join(stats, key, "left").na.fill(0, counts)


def uploads(items: DataFrame, most: int) -> DataFrame:
    """The newest items of each playlist."""
    return items.withColumn("_rn", F.row_number().over(Window.partitionBy("playlist_id").orderBy(F.desc("published_at"), "video_id"))).where(F.col("_rn") <= most).drop("_rn")


_FEED = """
title STRING, entry ARRAY<STRUCT<title: STRING, updated: STRING, published: STRING, summary: STRING, link: ARRAY<STRUCT<_href: STRING>>>>,
channel STRUCT<title: STRING, item: ARRAY<STRUCT<title: STRING, link: STRING, pubDate: STRING, description: STRING>>>
"""


def feed_posts(feeds: DataFrame) -> DataFrame:
    """Posts of RSS 2.0 and Atom documents (columns url and xml): url, title, link, published_at, summary.

    Documents that cannot be read give no posts; namespaces of elements are ignored.
    """
    x = F.from_xml(F.regexp_replace("xml", r"<(/?)[A-Za-z0-9]+:", "<$1"), _FEED, {"mode": "PERMISSIVE"})
    parsed = feeds.select("url", x.alias("f"))
    rss = F.transform(F.coalesce("f.channel.item", F.array().cast("array<struct<title:string,link:string,pubDate:string,description:string>>")), lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), i["pubDate"].alias("at"), i["description"].alias("summary")))
    atom = F.transform(F.coalesce("f.entry", F.array().cast("array<struct<title:string,updated:string,published:string,summary:string,link:array<struct<_href:string>>>>")), lambda i: F.struct(i["title"].alias("title"), F.get(i["link"]["_href"], F.lit(0)).alias("link"), F.coalesce(i["published"], i["updated"]).alias("at"), i["summary"].alias("summary")))
    posts = parsed.select("url", F.explode(F.concat(rss, atom)).alias("p"))
    return posts.select("url", F.trim("p.title").alias("title"), F.trim("p.link").alias("link"), X.iso_time("p.at").alias("published_at"), F.col("p.summary").alias("summary"))


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """Addresses of urlset and sitemapindex documents (columns url and xml): url, kind (page or sitemap), loc, lastmod."""
    schema = "url ARRAY<STRUCT<loc: STRING, lastmod: STRING>>, sitemap ARRAY<STRUCT<loc: STRING, lastmod: STRING>>"
    parsed = sitemaps.select("url", F.from_xml(F.regexp_replace("xml", r"<(/?)[A-Za-z0-9]+:", "<$1"), schema, {"mode": "PERMISSIVE"}).alias("s"))
    tag = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<loc:string,lastmod:string>>")), lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x["loc"]).alias("loc"), x["lastmod"].alias("lastmod")))
    return parsed.select("url", F.explode(F.concat(tag("s.url", "page"), tag("s.sitemap", "sitemap"))).alias("x")).select("url", "x.*")


def sitemap_posts(pages: DataFrame, metadata: DataFrame, most: int = 15, pattern: str = r"/(?:blog|post|news|article|entry)s?/|/[0-9]+$") -> DataFrame:
    """The newest posts of each sitemap with their metadata; titles fall back on the address."""
    found = pages.where((F.col("kind") == "page") & F.col("loc").rlike(pattern)).groupBy("url", "loc").agg(F.max("lastmod").alias("lastmod"))
    newest = found.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy(F.desc_nulls_last("lastmod"), "loc"))).where(F.col("rank") <= most)
    m = metadata.select(F.col("url").alias("loc"), "title", "description")
    return newest.join(m, "loc", "left").withColumn("title", X.fallback("title", U.slug_title("loc")))


def fetched_status(fetched: DataFrame, least: int = 200, most: int = 50_000) -> DataFrame:
    """Ok, requires_dynamic_render or fetch_failed, and the content up to a cap."""
    n = F.length(F.coalesce("content", F.lit("")))
    state = F.when(~U.status_ok(F.col("status")), "fetch_failed").when(n < least, "requires_dynamic_render").otherwise("ok")
    return fetched.withColumn("fetch_status", state).withColumn("content", F.substring("content", 1, most))


def longer_text(primary: Column, second: Column) -> Column:
    """The longer of two extractions."""
    a, b = F.coalesce(primary, F.lit("")), F.coalesce(second, F.lit(""))
    return F.when(F.length(b) > F.length(a), b).otherwise(a)


def reachability(urls: DataFrame, statuses: DataFrame) -> DataFrame:
    """Latest known status and final address of each address; unknown ones are null."""
    last = statuses.groupBy("url").agg(F.max_by(F.struct("status", "final_url"), "checked_at").alias("s"))
    return urls.join(last, "url", "left").select(*urls.columns, "s.status", "s.final_url")


def to_fetch(wanted: DataFrame, landed: DataFrame, failed: DataFrame) -> DataFrame:
    """Distinct addresses neither landed nor known to fail."""
    return wanted.select("url").distinct().join(landed.select("url"), "url", "left_anti").join(failed.select("url"), "url", "left_anti")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, allow, prefix) of the group for an agent in robots.txt texts (host, text)."""
    lines = robots.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    field = F.lower(F.trim(F.regexp_extract("line", r"^([A-Za-z-]+)\s*:", 1)))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"^[A-Za-z-]+\s*:(.*)$", 1), "#.*", ""))
    w = Window.partitionBy("host").orderBy("pos")
    tagged = lines.select("host", "pos", field.alias("field"), value.alias("value")).withColumn("agent", F.last(F.when(F.col("field") == "user-agent", F.lower("value")), True).over(w))
    return tagged.where(F.col("field").isin("allow", "disallow") & (F.col("value") != "") & (F.col("agent") == agent)).select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("prefix"))


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Addresses with whether the longest matching rule of their host allows them; no rule allows."""
    keyed = urls.withColumn("host", U.host("url")).withColumn("_path", F.when(U.path("url") == "", "/").otherwise(U.path("url")))
    hits = keyed.join(rules, "host").where(F.col("_path").startswith(F.col("prefix")))
    best = hits.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), F.col("allow"))).alias("_allow"))
    return urls.join(best, "url", "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")


#: Copies that a file manager made of a landed file; they hold nothing new. Spaces stand coded in Spark's paths.
COPY = r"(?: |%20)[2-9]\.json(?:/[^/]*)?$"
_CACHED = "input struct<video_id: string, url: string>, output struct<items: array<struct<comment_id: string, text: string, likes: bigint>>>"


def landed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of landed JSON lines with _path and _written of their file; copies of files and lines that can't be read are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("_written")).where(F.col("_bad").isNull() & ~F.col("_path").rlike(COPY)).drop("_bad")


def _newest(entries: DataFrame, key: str, *columns: str) -> DataFrame:
    """The entry of each key in the file written last, then of the greatest path."""
    return entries.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_written", "_path")).alias("_e")).select(key, "_e.*")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """domain_id, taxonomy (a JSON text) and written of the landed taxonomies, the newest of each domain."""
    rows = landed_json(spark, path, "domain_id string, taxonomy string").where("domain_id IS NOT NULL")
    return _newest(rows.withColumn("written", F.col("_written")), "domain_id", "taxonomy", "written")


def recovered_taxonomy(wanted: DataFrame, registry: DataFrame, known: DataFrame) -> DataFrame:
    """Wanted (domain_name) with the taxonomy of the id that the registry (domain_id, domain_name) has for the name.

    Of several such ids that have one, the smallest counts. Where there is none, the newest taxonomy of all serves. `known` as
    taxonomy() gives it; nothing is registered anew.
    """
    own = registry.join(known, "domain_id").groupBy("domain_name").agg(F.min_by(F.struct("domain_id", "taxonomy"), "domain_id").alias("own"))
    newest = known.agg(F.max_by(F.struct("domain_id", "taxonomy"), F.struct("written", "domain_id")).alias("newest"))  # one row
    both = wanted.join(own, "domain_name", "left").join(F.broadcast(newest), how="left")
    got = F.coalesce("own", "newest")
    return both.select(*wanted.columns, got["domain_id"].alias("domain_id"), got["taxonomy"].alias("taxonomy"), F.col("own").isNull().alias("fallback"))


def raw_comments(spark: SparkSession, path: str, videos: DataFrame | None = None) -> DataFrame:
    """video_id, pos and the landed comments of some videos, or of all; of a video that lies in several files the newest counts."""
    rows = landed_json(spark, path, _CACHED).select(F.col("input.video_id").alias("video_id"), "output.items", "_written", "_path").where("video_id <> ''")
    if videos is not None:
        rows = rows.join(videos.select("video_id").distinct(), "video_id", "left_semi")
    return _newest(rows, "video_id", "items").select("video_id", F.posexplode("items").alias("pos", "c")).select("video_id", "pos", "c.*")


def community_lines(spark: SparkSession, path: str) -> DataFrame:
    """Url and the comment lines of each post, without white space at the ends, empty lines and the page's own captions; posts without lines are left out."""
    rows = landed_json(spark, path, _CACHED).select(F.col("input.url").alias("url"), "output.items", "_written", "_path").where("url <> ''")
    lines = F.transform("items", lambda i: F.btrim(F.coalesce(i["text"], F.lit("")), F.lit(" \t\n\r\x0b\f")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.isin(*L.COMMENT_CAPTIONS))
    return _newest(rows.withColumn("lines", kept).where(F.size("lines") > 0), "url", "lines")


def namespaced(comments: DataFrame) -> DataFrame:
    """Comments of posts with ids that hold the post's address."""
    return comments.withColumn("thread_id", F.concat_ws("::", "url", "thread_id"))
