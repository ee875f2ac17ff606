"""Registered queries that write landed files and stores from whole tables to the shared folder, and read them back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..sources import landed as L
from ..sources import store as S
from ..streaming import lookups as K
from . import views as V
from .registry import Registry

query = Registry()

_T0, _T1, _NOW = (dt.datetime(2026, 1, d) for d in (1, 2, 3))
#: Digits of a key that make its shard: these tables fill few shards.
_DIGITS = 1
_TTLS = [("search", 30.0), ("http", 36.0)]
_KEY = "sha256('{{\"k0\":' || to_json(lower(trim({0}, e' \\t\\n\\r\\x0b\\f'))) || ',\"k1\":\"{1}\"}}')"


def _place(spark) -> str:
    return S.scratch(spark, "stored")


def _at(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


# the store


def _checked(spark, d):
    """Addresses of all pages with what a check of them said; a null output is a failed check."""
    p = V.read(spark, d, "pages").where("url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
    said = F.to_json(F.struct(F.lit(200).alias("status"), F.concat("url", F.lit("#"), "n").alias("final_url")))
    return p.select("url", "page_id", S.query_key(F.col("url"), F.lit("ua")).alias("cache_key"), F.when(F.col("page_id") % 5 > 0, said).alias("output"))


@query("s36_stored_twice", f"""WITH p AS (SELECT url, min(page_id) AS page_id, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY url),
e AS (SELECT {_KEY.format('url', 'ua')} AS cache_key, page_id, CASE WHEN page_id % 5 > 0 THEN '{{"status":200,"final_url":' || to_json(url || '#' || n) || '}}' END AS output FROM p),
k AS (SELECT cache_key, max(output) AS first, max(output) FILTER (page_id % 3 = 0) AS second, bool_or(page_id % 3 = 0) AS again, count(*) FILTER (page_id % 2 = 0) AS hits FROM e GROUP BY cache_key)
SELECT 'http' AS agent, substring(cache_key, 1, 1) AS shard, cache_key, CASE WHEN again THEN replace(second, '200', '301') ELSE first END AS output, '2026-01-01' AS created_at, CASE WHEN again THEN '2026-01-02' ELSE '2026-01-01' END AS updated_at,
  hits AS hit_count, CASE WHEN hits > 0 THEN '2026-01-03' END AS last_hit_at FROM k""")
def s36_stored_twice(spark, d):
    """Everything twice at one time, then a third of it anew, then hits: what stands there in the end."""
    path, all_ = _place(spark), _checked(spark, d)
    for _ in range(2):
        S.put(all_, path, "http", F.lit(_T0), _DIGITS)
    S.put(all_.where("page_id % 3 = 0").withColumn("output", F.replace("output", F.lit("200"), F.lit("301"))), path, "http", F.lit(_T1), _DIGITS)
    S.record_hits(all_.where("page_id % 2 = 0"), path, "http", F.lit(_NOW), _DIGITS)
    return S.entries(spark, path).select("agent", "shard", "cache_key", "output", _at("created_at"), _at("updated_at"), "hit_count", _at("last_hit_at"))


@query("s37_remembered", f"""WITH p AS (SELECT url, min(page_id) AS page_id, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY url),
k AS (SELECT {_KEY.format('url', 'ua')} AS cache_key, max(CASE WHEN page_id % 5 > 0 THEN '{{"status":200,"final_url":' || to_json(url || '#' || n) || '}}' END) AS output, bool_or(page_id % 3 = 0) AS fresh, min(page_id) AS least FROM p GROUP BY 1),
old AS (SELECT {_KEY.format('url', 'ua')} AS cache_key, max(CASE WHEN page_id % 5 > 0 THEN '{{"status":200,"final_url":' || to_json(url || '#' || n) || '}}' END) AS output FROM p WHERE page_id % 3 = 0 GROUP BY 1)
SELECT page_id, true AS hit, CASE WHEN k.fresh THEN old.output WHEN least % 7 > 0 THEN '{{"status":404}}' END AS output
FROM pages JOIN k ON k.cache_key = {_KEY.format('url', 'ua')} LEFT JOIN old ON old.cache_key = k.cache_key""")
def s37_remembered(spark, d):
    """Stale entries for all addresses and fresh ones for a third; the others are asked for again, and some of these answers fail."""
    path, all_ = _place(spark), _checked(spark, d)
    ttls = spark.createDataFrame(_TTLS, "agent string, hours double")
    S.put(all_, path, "http", F.lit(_T0), _DIGITS)
    S.put(all_.where("page_id % 3 = 0"), path, "http", F.lit(_T1), _DIGITS)
    pages = V.read(spark, d, "pages").where("url IS NOT NULL").select("page_id", "url")
    least = all_.groupBy("cache_key").agg(F.min("page_id").alias("least"))
    answer = lambda missing: missing.join(least, "cache_key").select("cache_key", F.when(F.col("least") % 7 > 0, '{"status":404}').alias("output"))
    got = S.remember(pages, path, "http", S.query_key(F.col("url"), F.lit("ua")), answer, F.lit(_NOW), ttls, 24.0, _DIGITS)
    return got.select("page_id", "hit", "output")


@query("s38_expired_dropped", f"""WITH t AS (SELECT {_KEY.format('text', 'web')} AS cache_key, conv_id % 4 AS late FROM conversations WHERE text IS NOT NULL)
SELECT substring(cache_key, 1, 1) AS shard, count(DISTINCT cache_key) AS n FROM t WHERE late = 0 GROUP BY 1""")
def s38_expired_dropped(spark, d):
    """Searches of two days, of which the older ones are dropped from the store."""
    path = _place(spark)
    t = V.read(spark, d, "conversations").where("text IS NOT NULL").select(S.query_key(F.col("text"), F.lit("web")).alias("cache_key"), F.to_json(F.array("role")).alias("output"), (F.col("conv_id") % 4).alias("late"))
    S.put(t, path, "search", F.lit(_T0), _DIGITS)
    S.put(t.where("late = 0"), path, "search", F.lit(_T1), _DIGITS)
    S.drop_expired(path, spark, spark.createDataFrame(_TTLS, "agent string, hours double"), F.lit(_NOW), 24.0)
    return S.entries(spark, path).groupBy("shard").agg(F.count("*").alias("n"))


@query("s35_lookup_as_of", """WITH s AS (SELECT user_id, ts, CASE WHEN event_type <> 'error' THEN event_type || ' ' || event_id END AS output FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
l AS (SELECT user_id, event_id, ts FROM events WHERE event_type NOT IN ('purchase', 'signup', 'error'))
SELECT l.event_id AS lookup_id, coalesce(l.ts - s.ts <= INTERVAL 90 MINUTE, false) AS hit, CASE WHEN l.ts - s.ts <= INTERVAL 90 MINUTE THEN s.output END AS output FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts >= s.ts""")
def s35_lookup_as_of(spark, d):
    """Events as stores, failures among them, and lookups; an output lives an hour and a half."""
    e = V.read(spark, d, "events")
    store = F.col("event_type").isin("purchase", "signup", "error")
    output = F.when(store & (F.col("event_type") != "error"), F.concat_ws(" ", "event_type", "event_id"))
    rows = e.select(F.col("user_id").cast("string").alias("cache_key"), F.when(store, "store").otherwise("lookup").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("lookup_id"), output.alias("output"))
    return K.as_of(rows, 1.5).select("lookup_id", "hit", "output")


@query("s43_run_outputs", """WITH u AS (SELECT event_type, user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY ALL)
SELECT event_type AS run_id, 'candidate' AS kind, 'u' || user_id AS name, '{"n":' || n || ',"total":' || CASE WHEN event_type = 'click' THEN -1 ELSE total END || '}' AS body FROM u WHERE event_type <> 'click' OR user_id % 2 = 0
UNION ALL SELECT event_type, 'backlog', 'urls', '["u' || min(user_id) || '"]' FROM events WHERE event_type <> 'click' GROUP BY event_type
UNION ALL SELECT 'click', 'backlog', 'urls', '["u' || min(user_id) || '"]' FROM events WHERE event_type = 'click'""")
def s43_run_outputs(spark, d):
    """Outputs of runs by candidate with a backlog; one run is written again with fewer and other rows."""
    path, e = _place(spark), V.read(spark, d, "events")
    u = e.groupBy(F.col("event_type").alias("run_id"), "user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))
    out = lambda r: r.select("run_id", F.lit("candidate").alias("kind"), F.concat(F.lit("u"), "user_id").alias("name"), F.to_json(F.struct("n", "total")).alias("body"))
    backlog = e.groupBy(F.col("event_type").alias("run_id")).agg(F.to_json(F.array(F.concat(F.lit("u"), F.min("user_id")))).alias("body")).select("run_id", F.lit("backlog").alias("kind"), F.lit("urls").alias("name"), "body")
    S.write_run(out(u).unionByName(backlog), path)
    S.write_run(out(u.where("run_id = 'click' AND user_id % 2 = 0").withColumn("total", F.lit(-1))), path)
    return S.read_run(spark, path).select("run_id", "kind", "name", "body")


# landed files


def _landed(spark, d, path: str) -> None:
    """Comments of all conversations as landed files: an old collection, a newer one of some videos, a file manager's copy, and garbage."""
    c = V.read(spark, d, "conversations")

    def entries(rows, mark: str):
        item = F.struct(F.concat_ws(".", "conv_id", "turn").alias("comment_id"), F.concat(F.lit(mark), F.coalesce("text", F.lit(""))).alias("text"), (F.col("conv_id") % 9).alias("likes"))
        extra = F.transform(F.array(F.lit("댓글"), F.lit(" \t"), F.lit("댓글 영역")), lambda t: F.struct(F.lit("x").alias("comment_id"), t.alias("text"), F.lit(0).cast("long").alias("likes")))
        items = F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("c")))), lambda x: x["c"])
        one = rows.groupBy("conv_id").agg(F.concat(items, extra).alias("items"))
        video, url = F.concat(F.lit("v"), "conv_id").alias("video_id"), F.concat(F.lit("https://forum.example/p/"), "conv_id").alias("url")
        return one.select(F.struct(video, url).alias("input"), F.struct("items").alias("output"))

    entries(c, "").write.json(f"{path}/old.json")
    c.select(F.concat(F.lit('{"input": '), F.coalesce("role", F.lit("")))).write.text(f"{path}/broken.json")
    entries(c.where("conv_id % 3 = 0"), " new ").write.json(f"{path}/new.json")
    entries(c, "copy ").write.json(f"{path}/new 2.json")


_TEXT = "CASE WHEN conv_id % 3 = 0 THEN ' new ' ELSE '' END || coalesce(text, '')"


@query("s32_raw_comments", f"""WITH w AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 3),
t AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, {_TEXT} AS text FROM conversations WHERE conv_id IN (FROM w))
SELECT 'v' || conv_id AS video_id, pos, conv_id || '.' || turn AS comment_id, text, conv_id % 9 AS likes FROM t
UNION ALL SELECT 'v' || conv_id, CAST(max(pos) + 1 + i AS INTEGER), 'x', ['댓글', e' \\t', '댓글 영역'][i + 1], 0 FROM t, range(3) r(i) GROUP BY conv_id, i""")
def s32_raw_comments(spark, d):
    path = _place(spark)
    _landed(spark, d, path)
    wanted = V.read(spark, d, "conversations").groupBy("conv_id").count().where("count > 3")
    return L.raw_comments(spark, path, wanted.select(F.concat(F.lit("v"), "conv_id").alias("video_id")))


@query("s33_community_lines", f"""WITH t AS (SELECT conv_id, turn, trim({_TEXT}, e' \\t\\n\\r\\x0b\\f') AS line FROM conversations)
SELECT 'https://forum.example/p/' || conv_id AS url, string_agg(line, '|' ORDER BY turn) AS lines FROM t WHERE line <> '' GROUP BY conv_id""")
def s33_community_lines(spark, d):
    path = _place(spark)
    _landed(spark, d, path)
    return L.community_lines(spark, path).withColumn("lines", F.array_join("lines", "|"))


@query("s27_recovered_taxonomy", """WITH known AS (SELECT n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_regionkey < 3 THEN '{"of":"' || n_regionkey || '","second":true}' ELSE '{"of":"' || n_regionkey || '"}' END AS taxonomy FROM nation WHERE n_nationkey % 4 > 0),
latest AS (SELECT max(id) AS id FROM known JOIN nation ON n_nationkey::VARCHAR = id WHERE n_regionkey < 3)
SELECT c_custkey, n_name AS domain_name, coalesce(k.id, l.id) AS domain_id, coalesce(k.taxonomy, f.taxonomy) AS taxonomy, k.id IS NULL AS fallback
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN known k ON k.name = n_name, latest l JOIN known f ON f.id = l.id""")
def s27_recovered_taxonomy(spark, d):
    """Taxonomies of most nations, of some a second file; every customer's nation is looked up, the newest file serves where there is none."""
    path, n = _place(spark), V.read(spark, d, "nation")
    some = n.where("n_nationkey % 4 > 0").select(F.col("n_nationkey").cast("string").alias("domain_id"), "n_regionkey")
    of = F.col("n_regionkey").cast("string").alias("of")
    some.select("domain_id", F.to_json(F.struct(of)).alias("taxonomy")).write.json(f"{path}/first_slug.json")
    some.where("n_regionkey < 3").select("domain_id", F.to_json(F.struct(of, F.lit(True).alias("second"))).alias("taxonomy")).coalesce(1).write.json(f"{path}/second_slug.json")
    registry = n.select(F.col("n_nationkey").cast("string").alias("domain_id"), F.col("n_name").alias("domain_name"))
    wanted = V.read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("domain_name"))
    return L.recovered_taxonomy(wanted, registry, L.taxonomy(spark, path))
