"""Registered queries on joins, guards, merges and rankings of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import channels as C
from ..operators import classify as K
from ..operators import excerpt as E
from ..operators import matrix as M
from ..operators import quotes as Q
from ..operators import resolve as R
from ..operators import sentiment as O
from ..operators import threads as T
from ..operators import urls as U
from . import programs as P
from . import views as V
from .registry import Registry, listed
from .texts import REMARKS_SQL, remarks

query = Registry()
_COUNTS = "count(*) AS n, count(*) FILTER (polarity = 'positive') AS pos, count(*) FILTER (polarity = 'negative') AS neg, count(*) FILTER (polarity = 'neutral') AS neu"

# opinions


@query("a03_counts", f"WITH {V.UNITS} SELECT aspect, channel, {_COUNTS} FROM units GROUP BY aspect, channel")
def a03(spark, d):
    return V.units(spark, d).groupBy("aspect", "channel").agg(*O.counts())


@query("a04_sample_level", "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 20 THEN 'ratio' WHEN count(*) >= 10 THEN 'direction' WHEN count(*) >= 5 THEN 'thin' ELSE 'count_only' END AS level FROM orders GROUP BY o_custkey")
def a04(spark, d):
    n = V.read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.withColumn("level", O.sample_level(F.col("n")))


@query("a23_own_perspectives", f"WITH {V.UNITS} SELECT perspective, count(*) AS n FROM units WHERE candidate LIKE 'own%' GROUP BY perspective")
def a23(spark, d):
    return O.perspective_own(V.units(spark, d))


@query("a47_negative_causes", f"WITH {V.UNITS} SELECT aspect, perspective, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY aspect) AS share FROM units WHERE polarity = 'negative' GROUP BY aspect, perspective")
def a47(spark, d):
    return O.shares(V.units(spark, d).where("polarity = 'negative'"), "perspective", "aspect")


@query("a61_report_payload", f"WITH {V.UNITS} SELECT CASE candidate WHEN 'own_0' THEN 'Ours' WHEN 'comp_1' THEN 'One' ELSE candidate END AS name, channel, {_COUNTS} FROM units WHERE candidate IS NOT NULL GROUP BY GROUPING SETS ((candidate, channel), (candidate))")
def a61(spark, d):
    names = spark.createDataFrame([("own_0", "Ours"), ("comp_1", "One")], "candidate string, name string")
    return P.report_payload({"channels": O.channel_split(V.units(spark, d))}, names)


@query("a63_review_payload", f"WITH {V.UNITS} SELECT candidate, polarity, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY candidate) AS share FROM units WHERE candidate IS NOT NULL GROUP BY candidate, polarity")
def a63(spark, d):
    return O.shares(V.units(spark, d).where("candidate IS NOT NULL"), "polarity", "candidate")


@query("j07_side", f"WITH {V.UNITS} SELECT unit_id, CASE WHEN candidate IS NULL THEN 'excluded' WHEN candidate LIKE 'own%' THEN 'own' ELSE 'competitor' END AS side FROM units")
def j07(spark, d):
    return V.units(spark, d).select("unit_id", O.side().alias("side"))


# threads and posts


@query("a43_channel_counts", f"WITH {V.UNITS} SELECT channel, count(*) AS n, count(*) FILTER (intensity > 1) AS comments, count(DISTINCT source_url) AS urls FROM units GROUP BY channel")
def a43(spark, d):
    return T.channel_counts(V.units(spark, d).withColumn("is_comment", F.col("intensity") > 1))


@query("a65_failures", "SELECT CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'quota' WHEN 2 THEN 'schema' ELSE 'other' END AS cause, count(*) AS n, CAST(sum(event_id % 3) AS BIGINT) AS items FROM events GROUP BY 1")
def a65(spark, d):
    message = F.get(F.array(*[F.lit(m) for m in ("Request timed out", "429 from host", "not valid against Schema", "refused", "")]), (F.col("event_id") % 5).cast("int"))
    return T.failures(V.read(spark, d, "events").select(message.alias("message"), (F.col("event_id") % 3).alias("items")))


@query("w04_newest_first", "SELECT event_id, min(ts) OVER (PARTITION BY user_id) AS thread_start, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS member FROM events")
def w04(spark, d):
    rows = V.read(spark, d, "events").select("event_id", F.col("user_id").alias("thread_id"), F.col("ts").alias("posted_at"), F.col("event_id").alias("pos"))
    return T.newest_first(rows).select("event_id", "thread_start", "member")


@query("j15_merged_posts", "SELECT o_custkey AS url, string_agg(o_orderpriority || o_orderkey, chr(10) ORDER BY o_orderkey) AS body, CASE WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey END AS comments FROM orders GROUP BY o_custkey")
def j15(spark, d):
    o = V.read(spark, d, "orders")
    chunks = o.select(F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("chunk_index"), F.concat("o_orderpriority", "o_orderkey").alias("body"))
    return T.merged_posts(chunks, o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("url"), F.concat(F.lit("c"), "o_custkey").alias("comments")).distinct())


@query("j16_members", """WITH m AS (SELECT doc_id AS url, list_slice(list_filter([CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END, substring(coalesce(text, ''), 1, 50), lang, lang || '!'], lambda t: length(t) > 0), 1, 3) AS x FROM documents)
SELECT url, CASE WHEN i = 0 THEN 't' ELSE 'c' END || i AS local_id, x[i + 1] AS text FROM (SELECT url, x, unnest(range(len(x))) AS i FROM m)""")
def j16(spark, d):
    p = V.read(spark, d, "documents").select(F.col("doc_id").alias("url"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise("").alias("title"), F.substring(F.coalesce("text", F.lit("")), 1, 50).alias("body"), F.array("lang", F.concat("lang", F.lit("!"))).alias("comments"))
    return T.members(p, 3)


@query("j17_remapped", "SELECT o_orderkey AS thread_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 ELSE -1 END AS score FROM orders")
def j17(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("thread_id"), F.expr("o_orderkey div 10").alias("batch"), (F.col("o_orderkey") % 10).alias("position"))
    output = o.where("thread_id % 3 > 0").select("batch", "position", (F.col("thread_id") % 4).alias("score"))
    return T.remapped(output, o).select("thread_id", F.coalesce("score", F.lit(-1)).alias("score"))


@query("j18_with_thread", f"WITH {V.UNITS}, t AS (SELECT o_orderkey AS thread_id, o_orderpriority AS importance FROM orders) SELECT unit_id, importance FROM units LEFT JOIN t ON thread_id = unit_id")
def j18(spark, d):
    units = V.units(spark, d).select("unit_id", F.col("unit_id").alias("thread_id"))
    threads = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("thread_id"), F.lit("c").alias("channel"), F.lit("u").alias("source_url"), F.col("o_orderpriority").alias("importance"))
    return T.with_thread(units, threads).select("unit_id", "importance")


@query("f29_guarded", f"""WITH {V.UNITS}, items AS (SELECT user_id, regexp_replace(event_type || ' ' || CAST(regexp_extract(props, '[0-9]+') AS INTEGER) || ' of', '\\s+', '', 'g') AS t FROM events WHERE event_id % 3 = 0)
SELECT unit_id FROM units u WHERE aspect IN ('a1', 'a2', 'a3') AND EXISTS (SELECT 1 FROM items i WHERE 'u' || i.user_id = u.source_url AND contains('quote' || i.t || '0to39', regexp_replace(split_part(quote, ' of', 1) || ' of', '\\s+', '', 'g')))""")
def f29(spark, d):
    u = V.units(spark, d)
    items = u.where("unit_id % 3 = 0").select("source_url", F.concat(F.split_part("quote", F.lit(" of"), F.lit(1)), F.lit(" of 0 to 39")).alias("text"))
    tuples = u.withColumn("quote", F.concat(F.split_part("quote", F.lit(" of"), F.lit(1)), F.lit(" of")))
    return T.guarded(tuples, items, spark.createDataFrame([("a1",), ("a2",), ("a3",), ("a1",)], "aspect string")).select("unit_id")


@query("f54_noise_profile", f"""WITH {REMARKS_SQL}, s AS (SELECT id // 100 AS video_id, id, text FROM remarks),
w AS (SELECT video_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM s),
g AS (SELECT video_id, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS gram FROM w WHERE len(w) >= 3),
t AS (SELECT video_id, max(n) AS top FROM (SELECT video_id, gram, count(*) AS n FROM g GROUP BY ALL) GROUP BY video_id)
SELECT video_id, count(*) AS n, count(*) FILTER (regexp_matches(text, '^\\s*[\\[(].*[\\])]\\s*$')) AS noise, coalesce(any_value(top), 0) AS top_trigram FROM s LEFT JOIN t USING (video_id) GROUP BY video_id""")
def f54(spark, d):
    return E.noise_profile(remarks(spark, d).select(F.expr("id div 100").alias("video_id"), "text"))


# ids and lookups


@query("j04_with_meta", "SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new ' || o_orderkey WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS title FROM orders")
def j04(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderstatus").alias("title"))
    changed = o.where("video_id % 3 < 2").select("video_id", F.when(F.col("video_id") % 3 == 0, F.concat(F.lit("new "), "video_id")).otherwise("").alias("title"))
    return R.with_meta(o.select("video_id"), o.where("video_id % 2 = 0"), changed)


@query("j04_first_wins", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def j04b(spark, d):
    return R.first_wins(V.read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("j05_channel_records", "SELECT c_custkey AS channel_id, coalesce(count(o_orderkey), 0) AS n, CAST(coalesce(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 ELSE 0 END), 0) AS BIGINT) AS views FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j05(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("channel_id"))
    stats = o.where("video_id % 2 = 0").select("video_id", (F.col("video_id") % 100).alias("views"), F.lit(1).cast("long").alias("likes"), F.lit(0).cast("long").alias("comments"))
    out = R.channel_records(V.read(spark, d, "customer").select(F.col("c_custkey").alias("channel_id")), o, stats)
    recent = F.coalesce("recent", F.array().cast("array<struct<video_id:bigint,views:bigint,likes:bigint,comments:bigint>>"))
    return out.select("channel_id", F.size(recent).cast("long").alias("n"), F.aggregate(recent, F.lit(0).cast("long"), lambda a, x: a + x["views"]).alias("views"))


@query("j08_name_map", "SELECT 'own' AS candidate, 'Ours' AS name UNION ALL SELECT 'c' || n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def j08(spark, d):
    n = V.read(spark, d, "nation")
    rivals = n.select(F.concat(F.lit("c"), "n_nationkey").alias("candidate"), F.col("n_name").alias("name"))
    chosen = n.where("n_regionkey IN (1, 3)").select(F.concat(F.lit("c"), "n_nationkey").alias("candidate"))
    return R.name_map(spark.createDataFrame([("own", "Ours")], "candidate string, name string"), rivals, chosen)


@query("j31_latest", "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) = 1")
def j31(spark, d):
    return R.latest(V.read(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), "o_orderkey", "o_custkey", "o_orderstatus")


@query("j32_draft_diff", """WITH b AS (SELECT p_partkey AS field, p_name AS old FROM part WHERE p_partkey % 4 > 0), e AS (SELECT p_partkey AS field, CASE WHEN p_partkey % 5 = 0 THEN 'changed' WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS new FROM part WHERE p_partkey % 6 > 0)
SELECT field, old, new FROM b FULL JOIN e USING (field) WHERE old IS DISTINCT FROM new""")
def j32(spark, d):
    p = V.read(spark, d, "part")
    base = p.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("field"), F.col("p_name").alias("value"))
    value = F.when(F.col("p_partkey") % 5 == 0, "changed").when(F.col("p_partkey") % 7 > 0, F.col("p_name"))
    return R.draft_diff(base, p.where("p_partkey % 6 > 0").select(F.col("p_partkey").alias("field"), value.alias("value")))


@query("j33_overridden", f"""WITH {V.CELLS}, o AS (SELECT 'f' || unnest(range(0, 60, 3)) AS feature, 'comp_1' AS candidate, 'set' AS value)
SELECT feature, candidate, coalesce(o.value, c.value) AS value, status FROM cells c FULL JOIN o USING (feature, candidate)""")
def j33(spark, d):
    o = spark.createDataFrame([(f"f{i}", "comp_1", "set") for i in range(0, 60, 3)], "feature string, candidate string, value string")
    return R.overridden(V.cells(spark, d).select("feature", "candidate", "value", "status"), o, ["feature", "candidate"], ["value"])


@query("j34_segment_weights", "SELECT p_partkey AS segment, CASE WHEN p_partkey % 10 = 0 THEN 9 ELSE p_size END::BIGINT AS weight FROM part")
def j34(spark, d):
    p = V.read(spark, d, "part")
    return R.overridden(p.select(F.col("p_partkey").alias("segment"), F.col("p_size").cast("long").alias("weight")), p.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("segment"), F.lit(9).cast("long").alias("weight")), ["segment"], ["weight"])


@query("j35_external_view", """SELECT 'c' || n_nationkey AS candidate, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AS history, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 3 = 0) AS finance, 0::BIGINT AS market, false AS own FROM nation""")
def j35(spark, d):
    n, s, c = V.read(spark, d, "nation"), V.read(spark, d, "supplier"), V.read(spark, d, "customer")
    of = lambda df, key, fact: df.select(F.concat(F.lit("c"), key).alias("candidate"), F.col(fact).alias("fact"))
    out = R.external_view(n.select(F.concat(F.lit("c"), "n_nationkey").alias("candidate")), of(s.where("s_acctbal > 0"), "s_nationkey", "s_suppkey"), of(c.where("c_custkey % 3 = 0"), "c_nationkey", "c_custkey"), of(s.limit(0), "s_nationkey", "s_suppkey"))
    size = lambda x: F.when(F.col(x).isNull(), 0).otherwise(F.size(x)).cast("long").alias(x)
    return out.select("candidate", size("history"), size("finance"), size("market"), "own")


@query("j37_enriched", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'cached' WHEN c_custkey % 2 = 0 THEN 'fetched' END AS handle FROM customer")
def j37(spark, d):
    c = V.read(spark, d, "customer").select("c_custkey")
    return R.enriched(c, c.where("c_custkey % 3 = 0").withColumn("handle", F.lit("cached")), c.where("c_custkey % 2 = 0").withColumn("handle", F.lit("fetched")), "c_custkey", "handle")


@query("j38_references", f"WITH {V.CELLS} SELECT DISTINCT value FROM cells WHERE value IS NOT NULL")
def j38(spark, d):
    return M.references(V.cells(spark, d), "value")


@query("j44_zone_weights", "SELECT p_size AS use_case, p_brand AS zone, CAST(row_number() OVER (PARTITION BY p_size ORDER BY n DESC, p_brand) AS INTEGER) AS rank FROM (SELECT p_size, p_brand, count(*) AS n FROM part GROUP BY ALL) QUALIFY rank <= 3")
def j44(spark, d):
    z = V.read(spark, d, "part").groupBy(F.col("p_size").alias("use_case"), F.col("p_brand").alias("zone")).agg(F.count("*").alias("weight"))
    return M.zone_weights(z).select("use_case", "zone", "rank")


@query("x01_appended", "SELECT 0::INTEGER AS part, o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 2, c_custkey FROM customer")
def x01(spark, d):
    o, c = V.read(spark, d, "orders"), V.read(spark, d, "customer")
    return R.appended(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")), o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k")), c.select(F.col("c_custkey").alias("k"))).select("part", "k")


@query("x04_intersection", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def x04(spark, d):
    allowed = V.read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return Q.restricted(V.read(spark, d, "orders").select("o_orderkey", "o_custkey"), allowed, "o_custkey").select("o_orderkey")


@query("x09_map_merge", "SELECT p_partkey, p_brand || ',' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END || ',' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '-' END AS merged FROM part")
def x09(spark, d):
    left = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_name"))
    right = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("b"), F.col("p_type"), F.lit("c"), F.col("p_name"))).otherwise(F.create_map().cast("map<string,string>"))
    m = V.read(spark, d, "part").select("p_partkey", R.map_merge(left, right).alias("m"))
    return m.select("p_partkey", F.concat_ws(",", F.col("m")["a"], F.col("m")["b"], F.coalesce(F.col("m")["c"], F.lit("-"))).alias("merged"))


@query("a48_used_documents", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations UNION SELECT conv_id + turn FROM conversations)")
def a48(spark, d):
    nested = V.read(spark, d, "conversations").select(F.array(F.array("conv_id"), F.array(F.col("conv_id") + F.col("turn"))).alias("ids"))
    return R.used_documents(nested, V.read(spark, d, "documents").select("doc_id"))


# guards and lists


@query("f30_aspect_guard", f"WITH {V.UNITS} SELECT unit_id FROM units WHERE aspect IN (SELECT DISTINCT aspect FROM units WHERE candidate = 'own_0' AND intensity = 3 AND polarity = 'negative')")
def f30(spark, d):
    u = V.units(spark, d)
    return Q.restricted(u, u.where("candidate = 'own_0' AND intensity = 3 AND polarity = 'negative'"), "aspect").select("unit_id")


@query("f32_id_guard", "SELECT conv_id, array_to_string(list_sort(list_distinct(list_filter(ids, lambda x: x IN ('1', '2', '3')))), ',') AS ids, CAST(len(list_distinct(ids)) - len(list_distinct(list_filter(ids, lambda x: x IN ('1', '2', '3')))) AS INTEGER) AS n_dropped FROM (SELECT conv_id, list(turn::VARCHAR) AS ids FROM conversations GROUP BY conv_id)")
def f32(spark, d):
    rows = V.read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("turn").cast("string")).alias("ids"))
    return Q.restricted_lists(rows, "ids", ["1", "2", "3"]).select("conv_id", F.array_join(F.array_sort("ids"), ",").alias("ids"), "n_dropped")


_ORIGINS = ("blog_community", "owned_channel", "macro", "youtube", "official")


@query("f34_validated", f"""SELECT o_orderkey, CASE {listed(_ORIGINS)}[CAST(o_orderkey % 5 AS INTEGER) + 1] WHEN 'blog_community' THEN ok AND o_orderdate >= DATE '1998-08-01' - INTERVAL 1080 DAY WHEN 'owned_channel' THEN ok AND o_custkey % 2 = 0
  WHEN 'macro' THEN ok AND o_custkey % 3 = 0 WHEN 'youtube' THEN o_custkey % 4 = 0 ELSE ok END AS validated FROM (SELECT *, o_orderkey % 7 > 1 AS ok FROM orders)""")
def f34(spark, d):
    origin = F.get(F.array(*[F.lit(x) for x in _ORIGINS]), (F.col("o_orderkey") % 5).cast("int"))
    rows = V.read(spark, d, "orders").select(
        "o_orderkey", origin.alias("source_origin"), F.when(F.col("o_orderkey") % 7 > 1, 200).when(F.col("o_orderkey") % 7 == 1, 500).alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"),
        F.lit("Travel Card").alias("brand"), F.when(F.col("o_custkey") % 2 == 0, "travelcard official").otherwise("someone").alias("account"), (F.col("o_custkey") % 3 == 0).alias("whitelisted"), (F.col("o_custkey") % 4 == 0).alias("video_known"),
    )
    return U.validated(rows, 36, F.lit("1998-08-01").cast("timestamp")).select("o_orderkey", "validated")


@query("f39_prejudged", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND contains(lower(p_name || ' ' || p_type), 'steel') OR p_partkey % 3 = 1 AND (contains(lower(p_name || ' ' || p_type), 'a') OR contains(lower(p_name || ' ' || p_type), 'brass'))")
def f39(spark, d):
    items = V.read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("candidate"), F.col("p_name").alias("title"), F.col("p_type").alias("excerpt"))
    return C.prejudged(items, spark.createDataFrame([(0, "steel"), (1, "a"), (1, "brass")], "candidate long, token string")).select("p_partkey")


@query("f44_failed_sources", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'case1' WHEN c_custkey % 4 = 0 THEN 'case2_1' WHEN c_custkey % 4 < c_custkey % 5 THEN 'case2_2' ELSE 'none' END AS case, c_custkey % 9 = 0 AS critical FROM customer WHERE c_custkey % 2 = 0")
def f44(spark, d):
    k = F.col("c_custkey")
    rows = V.read(spark, d, "customer").select("c_custkey", F.when(k % 9 == 0, "own_1").otherwise("comp_1").alias("candidate"), (k % 5).alias("n_urls"), (k % 4).alias("n_ok"), (k % 2 == 1).alias("validated"))
    return U.failed_sources(rows).select("c_custkey", "case", "critical")


@query("f46_repaired", "SELECT c_custkey AS candidate, CASE WHEN c_custkey % 5 = 0 THEN 'manual' ELSE c_name END AS url, c_custkey % 5 = 0 OR c_custkey % 3 = 0 AS validated FROM customer WHERE c_custkey % 7 > 0")
def f46(spark, d):
    c = V.read(spark, d, "customer").select(F.col("c_custkey").alias("candidate"), F.col("c_name").alias("url"), (F.col("c_custkey") % 3 == 0).alias("validated"))
    return U.repaired(c, c.where("candidate % 5 = 0").select("candidate", F.lit("manual").alias("url")), c.where("candidate % 7 = 0"))


@query("f48_lint", f"""WITH {REMARKS_SQL}, a AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS cost, min(o_orderkey % 4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM orders)
SELECT id::VARCHAR AS "where", 'index literal' AS warning FROM remarks WHERE regexp_matches(text || CASE WHEN id % 3 = 0 THEN ' is -0.25' ELSE '' END, '[-+−]?[01]\\.[0-9]{{2}}')
UNION ALL SELECT o_orderkey::VARCHAR, 'cost order' FROM a WHERE cost = 3 AND later <= 1 UNION ALL SELECT c_custkey::VARCHAR, 'missing part' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0""")
def f48(spark, d):
    lines = remarks(spark, d).select(F.col("id").cast("string").alias("path"), F.concat("text", F.when(F.col("id") % 3 == 0, " is -0.25").otherwise("")).alias("text"))
    actions = V.read(spark, d, "orders").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("action_id"), (F.col("o_orderkey") % 4).alias("cost"))
    k = F.col("c_custkey")
    chances = V.read(spark, d, "customer").select(k.cast("string").alias("item_id"), F.when(k % 2 == 0, "기회").otherwise("위협").alias("kind"), F.array(F.lit("a"), F.when(k % 3 > 0, "b").otherwise(" "), F.lit("c")).alias("parts"))
    return Q.lint(lines, actions, chances)


@query("f56_enum_guard", f"WITH {V.QUESTIONS} SELECT question_id, CASE WHEN question_type IN ('cost', 'method') THEN question_type ELSE 'other' END AS question_type FROM questions")
def f56(spark, d):
    return K.guarded(V.questions(spark, d), "question_type", ["cost", "method"]).select("question_id", "question_type")


_CONFIG = "config AS (SELECT 'r' || p_partkey AS report, p_partkey % 4 > 0 AS active, ['A', 'B', 'A+B'][CAST(p_partkey % 3 AS INTEGER) + 1] AS source_flow FROM part)"


def _config(spark, d):
    k = F.col("p_partkey")
    hint = lambda source, template: F.struct(source.cast("string").alias("source"), template.alias("template"))
    hints = F.array(hint(F.lit("blog"), F.concat(F.lit("{c} "), "p_brand")), hint(F.when(k % 2 == 0, "macro"), F.concat(F.lit("{c} "), "p_type")))
    return V.read(spark, d, "part").select(F.concat(F.lit("r"), k).alias("report"), (k % 4 > 0).alias("active"), F.get(F.array(F.lit("A"), F.lit("B"), F.lit("A+B")), (k % 3).cast("int")).alias("source_flow"), hints.alias("hints"))


@query("f24_active_reports", f"WITH {_CONFIG} SELECT report, source_flow FROM config WHERE active AND source_flow <> 'B'")
def f24(spark, d):
    return P.active_reports(_config(spark, d)).select("report", "source_flow")


@query("f25_hints", "SELECT 'r' || p_partkey AS report, '{c} ' || p_type AS template FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 3 <> 1")
def f25(spark, d):
    return P.hints_for(_config(spark, d), "macro")


# addresses


@query("j09_merged_sources", f"WITH {V.COVERAGE}, a AS (SELECT candidate, url, CASE WHEN source = 'official' THEN 0 ELSE 1 END AS o FROM coverage) SELECT candidate, url, CASE WHEN min(o) = 0 THEN 'official' ELSE 'search' END AS source_type FROM a GROUP BY candidate, url")
def j09(spark, d):
    c = V.coverage(spark, d).select("candidate", "url", "pos", "source")
    return U.merged_sources(c.where("source = 'official'"), c.where("source <> 'official'"))


@query("j25_injected", f"WITH {V.COVERAGE}, t AS (SELECT DISTINCT candidate, url FROM coverage WHERE tier = 1), e AS (SELECT DISTINCT candidate, url FROM coverage WHERE tier = 2) SELECT candidate, url, 1 AS tier FROM t UNION ALL SELECT candidate, url, 3 FROM e WHERE (candidate, url) NOT IN (SELECT (candidate, url) FROM t)")
def j25(spark, d):
    c = V.coverage(spark, d)
    of = lambda tier: c.where(F.col("tier") == tier).select("candidate", "url", "tier", F.lit("f").alias("features")).distinct()
    return U.injected(of(1), of(2)).select("candidate", "url", "tier")


@query("j26_matched_pool", f"WITH {V.COVERAGE} SELECT regexp_replace(url, '^https://www\\.', '') AS key, arg_min(url, pos) AS url, string_agg(DISTINCT candidate, ',' ORDER BY candidate) AS matched FROM coverage GROUP BY 1")
def j26(spark, d):
    return U.matched_pool(V.coverage(spark, d)).withColumn("matched", F.array_join("matched", ","))


@query("j30_resolved_source", "SELECT o_custkey AS candidate, arg_min(o_orderkey::VARCHAR, (o_orderkey % 4) * 100000000 + o_orderkey) AS url, count(*) - 1 AS fallbacks FROM orders WHERE o_orderkey % 3 > 0 GROUP BY o_custkey")
def j30(spark, d):
    k = F.col("o_orderkey")
    options = V.read(spark, d, "orders").select(F.col("o_custkey").alias("candidate"), F.lpad(k.cast("string"), 12, "0").alias("url"), (k % 4).alias("priority"), F.when(k % 3 > 0, 200).otherwise(404).alias("status"))
    return U.resolved_source(options).withColumn("url", F.col("url").cast("long").cast("string"))


@query("j42_restored_selection", f"""WITH {V.COVERAGE}, s AS (SELECT DISTINCT url FROM coverage), f AS (SELECT url, (min({{'p': pos, 'f': feature}})).f AS query FROM coverage WHERE tier = 2 AND candidate = 'c1' GROUP BY url)
SELECT s.url, CASE WHEN s.url IN (SELECT url FROM coverage WHERE tier = 1 AND candidate = 'c2') THEN 'carried' WHEN query IS NOT NULL THEN 'search' ELSE 'unresolved' END AS origin, query FROM s LEFT JOIN f ON f.url = s.url""")
def j42(spark, d):
    c = V.coverage(spark, d)
    search = c.where("tier = 2 AND candidate = 'c1'").select("url", F.col("pos").alias("rank"), F.col("feature").alias("query"))
    return U.restored_selection(c.select("url").distinct(), c.where("tier = 1 AND candidate = 'c2'").select("url"), search)


@query("w14_round_robin_merge", f"""WITH {V.COVERAGE}, r AS (SELECT report, feature, url, row_number() OVER (PARTITION BY report, feature ORDER BY pos, url) AS rank FROM coverage),
o AS (SELECT report, url, min(rank * 1000 + CAST(substring(feature, 2) AS INTEGER)) AS place FROM r GROUP BY report, url) SELECT report, url, CAST(row_number() OVER (PARTITION BY report ORDER BY place) AS INTEGER) AS rank FROM o QUALIFY rank <= 40""")
def w14(spark, d):
    found = U.ranked(V.coverage(spark, d).select("report", F.substring("feature", 2, 9).cast("int").alias("query"), "url", "pos"), ["report", "query"], ["pos", "url"])
    return U.merged_results(found, 40, "report")


@query("w16_newest", "SELECT o_custkey, o_orderkey AS url, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 5")
def w16(spark, d):
    pool = V.read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("url"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")).alias("published_at"))
    return U.newest(pool, 5, "o_custkey").select("o_custkey", "url", "rank")


@query("w19_first_by_platform", f"WITH {V.CHANNELS} SELECT candidate, platform, min(item_id) AS item_id FROM channels GROUP BY candidate, platform")
def w19(spark, d):
    return U.best_by(V.channels(spark, d).withColumn("score", F.lit(1)), "score", "item_id", "candidate", "platform").select("candidate", "platform", "item_id")


@query("w20_owned_channels", "SELECT o_custkey AS candidate, o_orderkey % 5 AS channel_id, arg_min(u, (CASE WHEN contains(u, '/@') THEN 0 ELSE 1 END)::VARCHAR || u) AS url FROM (SELECT *, 'https://y.com/' || CASE WHEN o_orderkey % 3 = 0 THEN '@' ELSE 'c' END || o_orderkey AS u FROM orders) GROUP BY 1, 2")
def w20(spark, d):
    k = F.col("o_orderkey")
    return U.owned_channels(V.read(spark, d, "orders").select(F.col("o_custkey").alias("candidate"), (k % 5).alias("channel_id"), F.concat(F.lit("https://y.com/"), F.when(k % 3 == 0, "@").otherwise("c"), k).alias("url")))


@query("w24_help_articles", f"WITH {V.COVERAGE} SELECT url, max(tier * 3 + length(feature)) AS score FROM coverage GROUP BY url ORDER BY score DESC, url LIMIT 60")
def w24(spark, d):
    return U.help_articles(V.coverage(spark, d).select("url", (F.col("tier") * 3 + F.length("feature")).cast("long").alias("score")), 60)


@query("w27_candidate_order", "SELECT CASE WHEN n_nationkey % 10 = 0 THEN 'own_' ELSE 'comp_' END || n_nationkey AS candidate, CAST(row_number() OVER (ORDER BY n_nationkey % 10 > 0, n_regionkey DESC, CASE WHEN n_nationkey % 10 = 0 THEN 'own_' ELSE 'comp_' END || n_nationkey) AS INTEGER) AS rank FROM nation")
def w27(spark, d):
    n = V.read(spark, d, "nation").select(F.concat(F.when(F.col("n_nationkey") % 10 == 0, "own_").otherwise("comp_"), "n_nationkey").alias("candidate"), F.col("n_regionkey").alias("confidence"))
    return U.candidate_order(n).select("candidate", "rank")


@query("w28_feature_order", "SELECT p_brand AS report, p_name AS feature, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_name) AS INTEGER) AS rank FROM (SELECT p_brand, p_name, max(p_size) AS s FROM part GROUP BY ALL)")
def w28(spark, d):
    f = V.read(spark, d, "part").groupBy(F.col("p_brand").alias("report"), F.col("p_name").alias("feature")).agg(F.max("p_size").alias("importance"))
    return M.ordered_features(f).select("report", "feature", "rank")


# reports


def _states(spark, d):
    n = V.channels(spark, d).groupBy("candidate", "platform").agg(F.count("*").alias("n"))
    return n.select("candidate", "platform", F.when(F.col("n") % 3 == 0, "none").otherwise("measured").alias("state"))


@query("a31_marketing_rubric", f"""WITH {V.CHANNELS}, s AS (SELECT candidate, platform, CASE WHEN count(*) % 3 = 0 THEN 'none' ELSE 'measured' END AS state FROM channels GROUP BY ALL),
g AS (SELECT count(DISTINCT platform) AS gaps FROM s WHERE candidate <> 'n3' AND state <> 'none' AND platform IN (SELECT platform FROM s WHERE candidate = 'n3' AND state = 'none')), k AS (SELECT count(DISTINCT platform) AS kinds FROM s WHERE state <> 'none')
SELECT kinds, gaps, CASE WHEN kinds < 2 THEN 2 WHEN gaps > 0 THEN 4 ELSE 5 END AS score FROM k, g""")
def a31(spark, d):
    return C.rubric(_states(spark, d), "n3")


@query("a32_insight_rubric", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 4 END ELSE 3 END AS score FROM orders")
def a32(spark, d):
    k = F.col("o_orderkey")
    rows = V.read(spark, d, "orders").select(k, (k % 3).alias("opportunities"), (k % 4).alias("actions"), (k % 5).alias("limitations"), (k % 2).alias("lint"), F.when(k % 11 > 0, k % 7).alias("pending"))
    return Q.rubric_insight(rows).select("o_orderkey", "score")


query.sql["a32_insight_rubric"] = query.sql["a32_insight_rubric"].replace("WHEN o_orderkey % 7 = 0 THEN 5", "WHEN o_orderkey % 11 > 0 AND o_orderkey % 7 = 0 THEN 5")


@query("a37_channel_matrix", f"WITH {V.CHANNELS}, n AS (SELECT candidate, platform, count(*) AS total, count(*) FILTER (related) AS related FROM channels GROUP BY ALL), o AS (SELECT DISTINCT 'n' || n_nationkey AS candidate, 'URGENT' AS platform FROM nation) SELECT candidate, platform, coalesce(total, 0) AS total, coalesce(related, 0) AS related FROM n FULL JOIN o USING (candidate, platform)")
def a37(spark, d):
    owned = V.read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("candidate"), F.lit("URGENT").alias("platform"))
    return C.channel_matrix(V.channels(spark, d), owned)


@query("a62_envelope", "SELECT o_custkey AS report, 'insight' AS report_type, '2' AS rubric_version, '[' || string_agg('\"' || o_orderstatus || o_orderkey || '\"', ',' ORDER BY o_orderkey) || ']' AS content FROM orders GROUP BY o_custkey")
def a62(spark, d):
    rows = V.read(spark, d, "orders").select(F.col("o_custkey").alias("report"), F.col("o_orderkey").alias("pos"), F.concat("o_orderstatus", "o_orderkey").alias("text"))
    return M.envelope(rows, "insight", "2")


@query("p02_recovered", "SELECT o_custkey AS report_type, 'now' AS output FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT c_custkey, 'saved' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def p02(spark, d):
    branch = V.read(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("report_type"), F.lit("now").alias("output"))
    return P.recovered(branch, V.read(spark, d, "customer").select(F.col("c_custkey").alias("report_type"), F.lit("saved").alias("output")))


@query("p10_steps", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'error' WHEN o_orderkey % 2 = 0 THEN 'skipped' ELSE 'completed' END AS status FROM orders")
def p10(spark, d):
    k = F.col("o_orderkey")
    return P.steps(V.read(spark, d, "orders").select(k, F.when(k % 5 == 0, "failed").otherwise("").alias("error"), (k % 2 == 1).alias("active"))).select("o_orderkey", "status")


# classifiers by rules

_RULES = (("money", ("수수료", "환율", "fee")), ("card", ("카드", "card")))


@query("u13_prescreen", f"WITH {REMARKS_SQL} SELECT id, contains(text, '카드') OR contains(text, '환율') AS keep, CASE WHEN contains(text, '카드') OR contains(text, '환율') THEN 2 ELSE 0 END AS score FROM remarks")
def u13(spark, d):
    return K.prescreen(remarks(spark, d), ["카드", "환율"]).select("id", "keep", "score")


_UNITS = f"""base AS (SELECT id AS thread_id, CASE WHEN contains(text, '수수료') THEN '수수료' WHEN contains(text, 'fee') THEN 'fee' WHEN contains(text, '카드') THEN '카드' ELSE '' END AS target_term, substring(text, 1, 120) AS quote, regexp_matches(text, '{L.QUESTION_END}') AS asks FROM remarks)"""
_TERMS = ("수수료", "카드", "fee")
_UNITS = _UNITS.replace("CASE WHEN contains(text, '수수료') THEN '수수료' WHEN contains(text, 'fee') THEN 'fee'", "CASE WHEN contains(text, 'fee') THEN 'fee' WHEN contains(text, '수수료') THEN '수수료'")


@query("u14_extract_units", f"WITH {REMARKS_SQL}, {_UNITS} SELECT thread_id, target_term, quote, 'unit' AS kind, 'neutral' AS polarity FROM base UNION ALL SELECT thread_id, target_term, quote, 'question', NULL FROM base WHERE asks")
def u14(spark, d):
    return K.extract_units(remarks(spark, d).withColumnRenamed("id", "thread_id"), _TERMS)


_CLUSTERS = "clusters AS (SELECT target_term, count(*) AS n, min(quote) AS quote, CASE WHEN contains(target_term, '수수료') OR contains(target_term, '환율') OR contains(target_term, 'fee') THEN 'money' WHEN contains(target_term, '카드') OR contains(target_term, 'card') THEN 'card' ELSE 'uncategorized' END AS cluster FROM base GROUP BY target_term)"


@query("u16_cluster_terms", f"WITH {REMARKS_SQL}, {_UNITS}, {_CLUSTERS} SELECT * FROM clusters")
def u16(spark, d):
    return K.cluster_terms(K.extract_units(remarks(spark, d).withColumnRenamed("id", "thread_id"), _TERMS).where("kind = 'unit'"), _RULES)


@query("u17_canonical_labels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS label FROM orders")
def u17(spark, d):
    labels = V.read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    return K.canonical_labels(labels, spark.createDataFrame([("F", "filled"), ("X", "none")], "label string, canonical string"))


@query("u18_super_clusters", """WITH n AS (SELECT p_type AS cluster, count(*) AS n, CASE WHEN contains(p_type, 'BRASS') THEN 'b' WHEN contains(p_type, 'STEEL') THEN 's' WHEN contains(p_type, 'TIN') THEN 't' ELSE '기타' END AS super FROM part GROUP BY p_type),
r AS (SELECT super, row_number() OVER (ORDER BY sum(n) DESC, super) AS rn FROM n GROUP BY super) SELECT cluster, n, CASE WHEN rn <= 2 THEN super ELSE '기타' END AS super FROM n JOIN r USING (super)""")
def u18(spark, d):
    c = V.read(spark, d, "part").groupBy(F.col("p_type").alias("cluster")).agg(F.count("*").alias("n"))
    return K.super_clusters(c, (("b", ("BRASS",)), ("s", ("STEEL",)), ("t", ("TIN",))), 2)


@query("u21_map_questions", f"""WITH {REMARKS_SQL}, q AS (SELECT id, list_filter(string_split_regex(lower(text), '{L.LABEL_SPLIT}'), lambda x: x <> '') AS w FROM remarks)
SELECT id AS question_id, CASE WHEN list_has_any(w, ['환율', '우대']) THEN '환율 우대' WHEN list_has_any(w, ['카드', 'the']) THEN '카드 THE' WHEN list_has_any(w, ['로그인']) THEN '로그인' ELSE '기타' END AS aspect FROM q""")
def u21(spark, d):
    axes = spark.createDataFrame([("로그인", 3), ("환율 우대", 1), ("카드 THE", 2)], "axis string, rank int")
    return K.map_questions(remarks(spark, d).select(F.col("id").alias("question_id"), F.col("text").alias("quote")), axes).select("question_id", "aspect")


@query("u22_assigned", f"WITH {REMARKS_SQL}, {_UNITS}, {_CLUSTERS} SELECT thread_id, cluster, CASE cluster WHEN 'money' THEN 'costs' ELSE '기타' END AS aspect FROM base JOIN clusters USING (target_term)")
def u22(spark, d):
    units = K.extract_units(remarks(spark, d).withColumnRenamed("id", "thread_id"), _TERMS).where("kind = 'unit'")
    return K.assigned(units, K.cluster_terms(units, _RULES), spark.createDataFrame([("money", "costs")], "cluster string, super string")).select("thread_id", "cluster", "aspect")


@query("h42_repaired_output", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 2 ELSE -1 END AS n, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS first FROM part")
def h42(spark, d):
    item = F.concat(F.lit("{\"name\":\""), "p_brand", F.lit("\"},{\"name\":\"b\"}"))
    k = F.col("p_partkey")
    output = F.when(k % 3 == 0, F.concat(F.lit(" ["), item, F.lit("]"))).when(k % 3 == 1, F.concat(F.lit("{\"features\":["), item, F.lit("]}"))).otherwise("none")
    made = K.repaired(V.read(spark, d, "part").select("p_partkey", output.alias("output")), "name: string")
    return made.select("p_partkey", F.when(F.col("features").isNotNull(), F.size("features")).otherwise(-1).alias("n"), F.get("features", F.lit(0))["name"].alias("first"))
