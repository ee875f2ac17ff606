"""Views of the generic tables on which the registered queries run, each as a DataFrame and as the same view in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinion units from events: unit_id, candidate, polarity, intensity, channel, aspect, perspective, source_url, posted_at, quote."""
    e = read(spark, sf_dir, "events")
    user, k = F.col("user_id"), F.regexp_extract("props", "[0-9]+", 0).cast("int")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("unit_id"),
        F.when(user % 7 == 0, None).when(user % 4 == 0, "own_0").otherwise(F.concat(F.lit("comp_"), user % 4)).alias("candidate"),
        F.when(kind.isin("purchase", "signup"), "positive").when(kind == "error", "negative").otherwise("neutral").alias("polarity"),
        (1 + F.col("event_id") % 3).cast("int").alias("intensity"),
        F.when(user % 3 == 0, "community").otherwise("youtube").alias("channel"),
        F.concat(F.lit("a"), k % 6).alias("aspect"),
        F.concat(F.lit("p"), k % 8).alias("perspective"),
        F.concat(F.lit("u"), user).alias("source_url"),
        F.date_format("ts", "yyyy-MM-dd").alias("posted_at"),
        F.concat(F.lit("quote "), kind, F.lit(" "), k, F.lit(" of "), F.col("event_id") % 40).alias("quote"),
    )


UNITS = """
units AS (
  SELECT event_id AS unit_id,
    CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'own_0' ELSE 'comp_' || (user_id % 4) END AS candidate,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS polarity,
    CAST(1 + event_id % 3 AS INTEGER) AS intensity,
    CASE WHEN user_id % 3 = 0 THEN 'community' ELSE 'youtube' END AS channel,
    'a' || (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 6) AS aspect,
    'p' || (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 8) AS perspective,
    'u' || user_id AS source_url,
    strftime(ts, '%Y-%m-%d') AS posted_at,
    'quote ' || event_type || ' ' || CAST(regexp_extract(props, '[0-9]+') AS INTEGER) || ' of ' || (event_id % 40) AS quote
  FROM events)"""

_TYPES = ("feasibility", "method", "cost", "condition", "comparison", "recommendation", "troubleshooting", "safety_anxiety", "other")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from the users' turns: question_id, candidate, question_type, aspect, channel, quote."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    conv = F.col("conv_id")
    kinds = F.array(*[F.lit(t) for t in _TYPES])
    return c.select(
        (conv * 100 + F.col("turn")).alias("question_id"),
        F.when(conv % 5 == 4, None).when(conv % 4 == 0, "own_0").otherwise(F.concat(F.lit("comp_"), conv % 4)).alias("candidate"),
        F.get(kinds, ((conv + F.col("turn")) % 9).cast("int")).alias("question_type"),
        F.concat(F.lit("a"), conv % 6).alias("aspect"),
        F.when(conv % 3 == 0, "community").otherwise("youtube").alias("channel"),
        F.coalesce("text", F.lit("")).alias("quote"),
    )


QUESTIONS = f"""
questions AS (
  SELECT conv_id * 100 + turn AS question_id,
    CASE WHEN conv_id % 5 = 4 THEN NULL WHEN conv_id % 4 = 0 THEN 'own_0' ELSE 'comp_' || (conv_id % 4) END AS candidate,
    [{", ".join(f"'{t}'" for t in _TYPES)}][CAST((conv_id + turn) % 9 AS INTEGER) + 1] AS question_type,
    'a' || (conv_id % 6) AS aspect,
    CASE WHEN conv_id % 3 = 0 THEN 'community' ELSE 'youtube' END AS channel,
    coalesce(text, '') AS quote
  FROM conversations WHERE role = 'user')"""


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments from conversations: thread_id, pos (within the thread), is_reply, text; turn 0 is the thread's root."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), (F.col("turn") > 0).alias("is_reply"), F.coalesce("text", F.lit("")).alias("text"), (F.col("conv_id") % 50).alias("video_id"))


COMMENTS = """
comments AS (
  SELECT conv_id AS thread_id, turn AS pos, turn > 0 AS is_reply, coalesce(text, '') AS text, conv_id % 50 AS video_id FROM conversations)"""

#: Keywords of the comment queries: syllables that are frequent in the tables' prose.
KEYWORDS = ("thand", "ingth", "queo", "eaux", "ung")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts from documents: post_id, site, candidate, body, score (0 to 3 from the labels, null without)."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    score = l.groupBy("doc_id").agg(F.max(F.col("quality") * 2 + (1 - F.col("toxic"))).alias("score"))
    return d.join(score, "doc_id", "left").select(F.col("doc_id").alias("post_id"), F.col("source").alias("site"), F.concat(F.lit("c"), F.col("doc_id") % 4).alias("candidate"), F.coalesce("text", F.lit("")).alias("body"), "score")


POSTS = """
posts AS (
  SELECT d.doc_id AS post_id, d.source AS site, 'c' || (d.doc_id % 4) AS candidate, coalesce(d.text, '') AS body, l.score
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality * 2 + (1 - toxic)) AS score FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature coverage from line items: report, feature, candidate, source, coverage, url, tier, pos."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(
        F.concat(F.lit("r"), F.col("l_partkey") % 3).alias("report"), F.concat(F.lit("f"), F.col("l_partkey") % 12).alias("feature"), F.concat(F.lit("c"), F.col("l_suppkey") % 4).alias("candidate"),
        F.get(F.array(*[F.lit(s) for s in ("official", "blog_community", "owned_channels", "macro")]), (F.col("l_orderkey") % 4).cast("int")).alias("source"),
        F.get(F.array(*[F.lit(s) for s in ("not_found", "partial", "sufficient")]), (F.col("l_linenumber") % 3).cast("int")).alias("coverage"),
        F.concat(F.lit("https://www.s"), F.col("l_suppkey") % 9, F.lit(".example.com/p"), F.col("l_orderkey") % 50).alias("url"), (F.col("l_linenumber") % 4).cast("int").alias("tier"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )


COVERAGE = """
coverage AS (
  SELECT 'r' || (l_partkey % 3) AS report, 'f' || (l_partkey % 12) AS feature, 'c' || (l_suppkey % 4) AS candidate,
    ['official', 'blog_community', 'owned_channels', 'macro'][CAST(l_orderkey % 4 AS INTEGER) + 1] AS source,
    ['not_found', 'partial', 'sufficient'][CAST(l_linenumber % 3 AS INTEGER) + 1] AS coverage,
    'https://www.s' || (l_suppkey % 9) || '.example.com/p' || (l_orderkey % 50) AS url, CAST(l_linenumber % 4 AS INTEGER) AS tier, l_orderkey * 10 + l_linenumber AS pos
  FROM lineitem)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted values: feature, candidate, value, value_numeric, unit, as_of, status, promotional; many pairs have none."""
    x = read(spark, sf_dir, "lineitem")
    states = F.array(*[F.lit(s) for s in ("explicit", "partial", "inferred", "requires_manual_check")])
    return x.groupBy((F.col("l_partkey") % 40).alias("k"), (F.col("l_suppkey") % 6).alias("s")).agg(F.min("l_quantity").alias("q"), F.count("*").alias("n")).select(
        F.concat(F.lit("f"), "k").alias("feature"), F.when(F.col("s") == 0, "own_0").otherwise(F.concat(F.lit("comp_"), "s")).alias("candidate"),
        F.concat(F.col("q").cast("int"), F.lit(" %")).alias("value"), F.when(F.col("n") % 3 > 0, F.col("q")).alias("value_numeric"), F.when(F.col("n") % 2 == 0, "%").otherwise("").alias("unit"),
        F.when(F.col("n") % 4 > 0, "2026-05").otherwise("").alias("as_of"), F.get(states, (F.col("n") % 4).cast("int")).alias("status"), (F.col("n") % 5 == 0).alias("promotional"),
    ).where("(substring(feature, 2) + length(candidate)) % 4 > 0")


CELLS = """
cells AS (
  SELECT * FROM (
    SELECT 'f' || k AS feature, CASE WHEN s = 0 THEN 'own_0' ELSE 'comp_' || s END AS candidate, CAST(q AS INTEGER) || ' %' AS value, CASE WHEN n % 3 > 0 THEN q END AS value_numeric,
      CASE WHEN n % 2 = 0 THEN '%' ELSE '' END AS unit, CASE WHEN n % 4 > 0 THEN '2026-05' ELSE '' END AS as_of,
      ['explicit', 'partial', 'inferred', 'requires_manual_check'][CAST(n % 4 AS INTEGER) + 1] AS status, n % 5 = 0 AS promotional
    FROM (SELECT l_partkey % 40 AS k, l_suppkey % 6 AS s, min(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL))
  WHERE (CAST(substring(feature, 2) AS INTEGER) + length(candidate)) % 4 > 0)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of owned channels from orders: candidate (nation), platform, item_id, month, related."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("n"), "c_nationkey").alias("candidate"), F.substring("o_orderpriority", 3, 20).alias("platform"), F.col("o_orderkey").alias("item_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_orderkey") % 3 == 0).alias("related"),
    )


CHANNELS = """
channels AS (
  SELECT 'n' || c_nationkey AS candidate, substring(o_orderpriority, 3, 20) AS platform, o_orderkey AS item_id, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey % 3 = 0 AS related
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos from line items: candidate, video_id, views, likes, comments, subscribers."""
    x = read(spark, sf_dir, "lineitem")
    return x.groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("likes"), F.count("*").alias("comments"), F.sum(F.col("l_orderkey") % 1000).alias("views")).select(
        F.concat(F.lit("c"), F.col("l_suppkey") % 20).alias("candidate"), (F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).alias("video_id"), "views", "likes", "comments", (F.col("l_suppkey") % 20 * 100).alias("subscribers"),
    )


VIDEOS = """
videos AS (
  SELECT 'c' || (l_suppkey % 20) AS candidate, l_suppkey * 1000000 + l_partkey AS video_id, CAST(views AS BIGINT) AS views, CAST(likes AS BIGINT) AS likes, comments, l_suppkey % 20 * 100 AS subscribers
  FROM (SELECT l_suppkey, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS likes, count(*) AS comments, sum(l_orderkey % 1000) AS views FROM lineitem GROUP BY ALL))"""
