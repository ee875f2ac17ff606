"""Registered queries on comments, posts, pages, addresses, tables and channels, with the same results in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as A
from ..operators import channels as C
from ..operators import excerpt as E
from ..operators import matrix as M
from ..operators import resolve as R
from ..operators import threads as T
from ..operators import urls as U
from ..operators.bounds import dimension
from . import views as V
from .registry import listed, quoted
from .texts import ASK_SQL, DROP_SQL

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


_KW = "(" + " OR ".join(f"contains(t, '{k}')" for k in V.KEYWORDS) + ")"
_COMMENTS = f"""WITH {V.COMMENTS}, c AS (SELECT *, trim(text) AS t FROM comments),
f AS (SELECT *, {DROP_SQL("t")} AS d, {_KW} AS hit, {ASK_SQL("t")} AS ask FROM c)"""


@query("f07_basic_filter", f"{_COMMENTS} SELECT thread_id, pos FROM f WHERE d IS NULL QUALIFY row_number() OVER (PARTITION BY substring(t, 1, 200) ORDER BY pos, thread_id) = 1")
def f07(spark, d):
    return T.basic_filter(V.comments(spark, d)).select("thread_id", "pos")


@query("f08_prefilter", f"""{_COMMENTS}, k AS (SELECT *, bool_or(NOT is_reply AND hit) OVER (PARTITION BY thread_id) AS root FROM f WHERE d IS NULL AND NOT coalesce(ask, false))
SELECT thread_id, pos FROM k WHERE hit OR (is_reply AND root)""")
def f08(spark, d):
    return T.prefilter(V.comments(spark, d), V.KEYWORDS).select("thread_id", "pos")


_ROUTED = f"""{_COMMENTS}, n AS (SELECT *, d IS NULL AND row_number() OVER (PARTITION BY substring(t, 1, 200), d IS NULL ORDER BY is_reply, pos, thread_id) > 1 AS dup FROM f),
r AS (SELECT *, CASE WHEN is_reply THEN NULL WHEN d IS NOT NULL THEN d WHEN dup THEN 'drop_duplicate' WHEN ask AND hit THEN 'question' WHEN ask THEN 'drop_question_noise' WHEN hit THEN 'content' ELSE 'drop_keyword_miss' END AS root FROM n),
g AS (SELECT *, bool_or(coalesce(root IN ('content', 'question'), false)) OVER (PARTITION BY thread_id) AS good FROM r),
routed AS (SELECT thread_id, pos, is_reply, text, coalesce(root, CASE WHEN d IS NOT NULL THEN d WHEN dup THEN 'drop_duplicate' WHEN good THEN 'content' ELSE 'drop_orphan' END) AS route FROM g)"""


@query("f09_route", f"{_ROUTED} SELECT thread_id, pos, route FROM routed")
def f09(spark, d):
    return T.route(V.comments(spark, d), V.KEYWORDS).select("thread_id", "pos", "route")


@query("j13_threads", f"""{_ROUTED} SELECT thread_id, coalesce(arg_min(text, pos) FILTER (NOT is_reply), '') AS root_text,
  coalesce(array_to_string(list_slice(list(text ORDER BY pos, text) FILTER (is_reply AND route = 'content'), 1, 5), '|'), '') AS replies, count(*) FILTER (is_reply AND route = 'content') AS n_replies
FROM routed GROUP BY thread_id HAVING bool_or(NOT is_reply AND route IN ('content', 'question')) OR count(*) FILTER (is_reply AND route = 'content') > 0""")
def j13(spark, d):
    return T.assemble(T.route(V.comments(spark, d), V.KEYWORDS)).withColumn("replies", F.array_join("replies", "|"))


@query("f53_prefilter_variants", f"{_COMMENTS} SELECT thread_id, pos, hit AS v1, hit AND NOT coalesce(ask, false) AS v2, hit AND NOT coalesce(ask, false) AND d IS NULL AS v3 FROM f")
def f53(spark, d):
    return T.prefilter_variants(V.comments(spark, d), V.KEYWORDS)


@query("f10_auto_dropped", f"""{_ROUTED}, a AS (SELECT thread_id, concat_ws(' ', coalesce(arg_min(text, pos) FILTER (NOT is_reply), ''), array_to_string(list_slice(list(text ORDER BY pos, text) FILTER (is_reply AND route = 'content'), 1, 5), ' ')) AS t
  FROM routed GROUP BY thread_id HAVING bool_or(NOT is_reply AND route IN ('content', 'question')) OR count(*) FILTER (is_reply AND route = 'content') > 0)
SELECT thread_id FROM a WHERE length(t) < 2000 AND NOT {_KW}""")
def f10(spark, d):
    return T.auto_dropped(T.assemble(T.route(V.comments(spark, d), V.KEYWORDS)), V.KEYWORDS, 2000).select("thread_id")


@query("j12_reply_context", f"""WITH {V.COMMENTS} SELECT r.thread_id, r.pos, p.text AS parent_text FROM comments r LEFT JOIN (SELECT thread_id, arg_min(text, pos) AS text FROM comments WHERE NOT is_reply GROUP BY thread_id) p USING (thread_id) WHERE r.is_reply""")
def j12(spark, d):
    return T.reply_context(V.comments(spark, d)).select("thread_id", "pos", "parent_text")


@query("f13_score_cut", f"WITH {V.POSTS} SELECT post_id, score FROM posts WHERE score >= 2 ORDER BY score DESC, post_id LIMIT 75")
def f13(spark, d):
    return T.score_cut(V.posts(spark, d), 75, order="post_id").select("post_id", "score")


@query("w11_batches", f"WITH {V.POSTS} SELECT post_id, CAST(floor((row_number() OVER (PARTITION BY site ORDER BY post_id) - 1) / 15) AS BIGINT) AS batch FROM posts")
def w11(spark, d):
    return T.batches(V.posts(spark, d), 15, ["site"], ["post_id"]).select("post_id", "batch")


@query("w09_channel_cut", f"""WITH {V.POSTS}, r AS (SELECT post_id, row_number() OVER w AS rn, sum(length(body) // 100 + 1) OVER (PARTITION BY site ORDER BY (post_id % 2 = 0) DESC, post_id % 31 DESC, post_id ROWS UNBOUNDED PRECEDING) AS running FROM posts WINDOW w AS (PARTITION BY site ORDER BY (post_id % 2 = 0) DESC, post_id % 31 DESC, post_id))
SELECT post_id, CAST(running AS BIGINT) AS running FROM r WHERE rn = 1 OR running <= 300""")
def w09(spark, d):
    rows = V.posts(spark, d).select(F.col("post_id").alias("thread_id"), F.col("site").alias("channel"), (F.col("post_id") % 2 == 0).alias("relevant"), (F.col("post_id") % 31).alias("posted_at"), F.expr("length(body) div 100 + 1").alias("items"))
    return T.channel_cut(rows, 300).select(F.col("thread_id").alias("post_id"), "running")


@query("w08_chunks", f"""WITH RECURSIVE {V.POSTS}, r AS (SELECT post_id, site AS channel, CAST(length(body) AS INTEGER) AS chars, row_number() OVER (PARTITION BY site ORDER BY post_id) AS rn FROM posts),
f(post_id, channel, chars, rn, now, chunk) AS (SELECT post_id, channel, chars, rn, chars, 0 FROM r WHERE rn = 1
  UNION ALL SELECT r.post_id, r.channel, r.chars, r.rn, CASE WHEN f.now + r.chars > 12000 AND f.now >= 8000 THEN r.chars ELSE f.now + r.chars END, f.chunk + CASE WHEN f.now + r.chars > 12000 AND f.now >= 8000 THEN 1 ELSE 0 END FROM f JOIN r ON r.channel = f.channel AND r.rn = f.rn + 1)
SELECT post_id, channel, chars, CAST(chunk AS INTEGER) AS chunk FROM f""")
def w08(spark, d):
    rows = V.posts(spark, d).select("post_id", F.col("site").alias("channel"), F.length("body").alias("chars"))
    return T.chunk(rows, 12_000, 8_000, order="post_id")


@query("x06_deduplicated_tuples", f"WITH {V.UNITS} SELECT unit_id FROM units QUALIFY row_number() OVER (PARTITION BY aspect, source_url, regexp_replace(quote, '\\s+', '', 'g') ORDER BY unit_id) = 1")
def x06(spark, d):
    return T.deduplicated_tuples(V.units(spark, d)).select("unit_id")


@query("x07_absa_inputs", f"""WITH {V.POSTS}, {V.COMMENTS}, a AS (SELECT candidate, body AS text, post_id AS pos, 0 AS o FROM posts UNION ALL SELECT 'c' || (thread_id % 4), text, thread_id * 100 + pos, 1 FROM comments)
SELECT candidate, pos, CAST(o AS INTEGER) AS source_order FROM a QUALIFY row_number() OVER (PARTITION BY candidate, substring(regexp_replace(text, '\\s+', '', 'g'), 1, 200) ORDER BY o, pos) = 1""")
def x07(spark, d):
    a = V.posts(spark, d).select("candidate", F.col("body").alias("text"), F.col("post_id").alias("pos"))
    b = V.comments(spark, d).select(F.concat(F.lit("c"), F.col("thread_id") % 4).alias("candidate"), "text", (F.col("thread_id") * 100 + F.col("pos")).alias("pos"))
    return T.absa_inputs(a, b).select("candidate", "pos", "source_order")


@query("a50_hit_rates", f"""WITH {V.COMMENTS}, k(aspect, a, b) AS (VALUES ('one', 'thand', 'queo'), ('two', 'ingth', 'eaux'))
SELECT aspect, count(*) AS n, count(*) FILTER (contains(text, a) OR contains(text, b)) AS hits, count(DISTINCT video_id) FILTER (contains(text, a) OR contains(text, b)) AS videos FROM comments, k GROUP BY aspect""")
def a50(spark, d):
    return T.keyword_hits(V.comments(spark, d), {"one": ("thand", "queo"), "two": ("ingth", "eaux")})


@query("j02_video_index", f"WITH {V.VIDEOS} SELECT video_id % 997 AS video_id, array_to_string(list_sort(list_distinct(list(candidate))), ',') AS candidates FROM videos GROUP BY 1")
def j02(spark, d):
    return R.video_index(V.videos(spark, d).withColumn("video_id", F.col("video_id") % 997)).withColumn("candidates", F.array_join("candidates", ","))


@query("j03_multitag", f"WITH {V.VIDEOS}, {V.COMMENTS}, i AS (SELECT DISTINCT video_id % 50 AS video_id, candidate FROM videos) SELECT candidate, count(*) AS n FROM comments JOIN i USING (video_id) GROUP BY candidate")
def j03(spark, d):
    index = R.video_index(V.videos(spark, d).withColumn("video_id", F.col("video_id") % 50))
    return T.tag_candidates(V.comments(spark, d), index).groupBy("candidate").agg(F.count("*").alias("n"))


@query("j01_without_owned", "SELECT s_suppkey, s_nationkey AS channel_id FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j01(spark, d):
    owned = V.read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("channel_id"))
    return R.without_owned(V.read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("channel_id")), owned)


_NORM = "regexp_replace(lower({}), '[^0-9a-z가-힣]', '', 'g')"


@query("j06_label_map", f"""WITH l AS (SELECT DISTINCT substring(n_name, 1, 6) AS label FROM nation UNION SELECT DISTINCT c_mktsegment FROM customer), p AS (SELECT 'c' || n_nationkey AS candidate, n_nationkey AS pos, n_name AS name FROM nation)
SELECT label, arg_min(candidate, pos) AS candidate FROM l JOIN p ON contains({_NORM.format('label')}, {_NORM.format('name')}) OR contains({_NORM.format('name')}, {_NORM.format('label')}) GROUP BY label""")
def j06(spark, d):
    n = V.read(spark, d, "nation")
    labels = n.select(F.substring("n_name", 1, 6).alias("label")).unionByName(V.read(spark, d, "customer").select(F.col("c_mktsegment").alias("label")))
    return R.label_map(labels, n.select(F.concat(F.lit("c"), "n_nationkey").alias("candidate"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name")))


@query("j11_cache_split", "SELECT o_orderkey AS cache_key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS cached, o_orderkey % 3 = 0 AS hit FROM orders")
def j11(spark, d):
    o = V.read(spark, d, "orders")
    return R.cache_split(o.select(F.col("o_orderkey").alias("cache_key")), o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("cache_key"), F.col("o_orderstatus").alias("output")))


@query("s39_upsert", "SELECT o_custkey % 200 AS k, max(o_orderkey) AS o FROM orders GROUP BY 1")
def s39(spark, d):
    o = V.read(spark, d, "orders").select((F.col("o_custkey") % 200).alias("k"), F.col("o_orderkey").alias("o"))
    return R.upserted(o.where("o % 2 = 0"), o.where("o % 2 = 1"), "k", "o")


@query("x08_prefix_dominated", "WITH n AS (SELECT DISTINCT lower(substring(p_name, 1, 3 + p_partkey % 9)) AS name FROM part) SELECT name FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.name <> n.name AND starts_with(m.name, n.name))")
def x08(spark, d):
    names = V.read(spark, d, "part").select(F.lower(F.substring(F.col("p_name"), F.lit(1), (F.lit(3) + F.col("p_partkey") % 9).cast("int"))).alias("name")).distinct()
    return R.prefix_dominated(names)


@query("s29_domain_ids", "SELECT c_mktsegment AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 7 ELSE 7 + row_number() OVER (PARTITION BY c_mktsegment = 'BUILDING' ORDER BY c_mktsegment) END::BIGINT AS id FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def s29(spark, d):
    names = V.read(spark, d, "customer").select(F.col("c_mktsegment").alias("name"))
    return R.domain_ids(names.where("name = 'BUILDING'").distinct().select("name", F.lit(7).cast("long").alias("id")), names)


_SRC = "list_position(['official', 'blog_community', 'owned_channels', 'macro'], source)"


@query("j22_coverage_union", f"""WITH {V.COVERAGE} SELECT report, feature, candidate, ['not_found', 'partial', 'sufficient'][max(list_position(['not_found', 'partial', 'sufficient'], coverage))] AS coverage,
  arg_min(source, {_SRC}) AS source, count(DISTINCT url) AS n_urls, min(url) AS first_url FROM coverage GROUP BY report, feature, candidate""")
def j22(spark, d):
    return U.coverage_union(V.coverage(spark, d))


@query("j22_first_origin", f"WITH {V.COVERAGE} SELECT report, feature, candidate, url, source FROM coverage QUALIFY row_number() OVER (PARTITION BY report, feature, candidate, url ORDER BY {_SRC}, pos) = 1")
def j22b(spark, d):
    return U.first_origin(V.coverage(spark, d)).select("report", "feature", "candidate", "url", "source")


_TARGETS = f"""WITH {V.COVERAGE}, b AS (SELECT feature, candidate, url, min(tier) AS tier FROM coverage WHERE coverage <> 'not_found' GROUP BY ALL),
k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY feature, candidate ORDER BY tier, url) <= 5)
SELECT candidate, url, min(tier) AS tier, string_agg(DISTINCT feature, ',' ORDER BY feature) AS features FROM k GROUP BY candidate, url"""


@query("j24_targets", _TARGETS)
def j24(spark, d):
    return U.extraction_targets(V.coverage(spark, d)).withColumn("features", F.array_join("features", ","))


@query("w15_cover")
def w15(spark, d):
    return U.cover(U.extraction_targets(V.coverage(spark, d), 12), 25).withColumn("features", F.array_join("features", ","))


@query("j27_search_plan", """WITH h AS (SELECT 'r' || r_regionkey AS report, CASE WHEN r_regionkey < 3 THEN '{candidate} fee' ELSE '{candidate} ' || lower(r_name) END AS template FROM region), c AS (SELECT 'c' || n_nationkey AS candidate, n_name AS name FROM nation)
SELECT trim(replace(template, '{candidate}', name)) AS query, min(candidate) AS candidate, string_agg(DISTINCT report, ',' ORDER BY report) AS reports, count(*) AS n FROM c, h GROUP BY 1""")
def j27(spark, d):
    r = V.read(spark, d, "region")
    hints = r.select(F.concat(F.lit("r"), "r_regionkey").alias("report"), F.when(F.col("r_regionkey") < 3, "{candidate} fee").otherwise(F.concat(F.lit("{candidate} "), F.lower("r_name"))).alias("template"))
    return U.search_plan(V.read(spark, d, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("candidate"), F.col("n_name").alias("name")), hints)


_HOST = "regexp_replace(lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"


@query("f27_gated", f"WITH {V.COVERAGE} SELECT DISTINCT candidate, url FROM coverage WHERE (candidate = 'c1' AND (ends_with({_HOST.format('url')}, '.example.com'))) OR (candidate = 'c2' AND {_HOST.format('url')} = 's3.example.com')")
def f27(spark, d):
    domains = spark.createDataFrame([("c1", "example.com"), ("c2", "s3.example.com")], "candidate string, domain string")
    return U.gated(V.coverage(spark, d).select("candidate", "url"), domains)


@query("f20_blocked", f"SELECT page_id, url FROM pages WHERE NOT (ends_with({_HOST.format('url')}, '.example.org') OR {_HOST.format('url')} = 'example.org') OR url IS NULL")
def f20(spark, d):
    return U.blocked(V.read(spark, d, "pages").select("page_id", "url"), spark.createDataFrame([("example.org",)], "domain string"))


@query("h17_host", f"SELECT page_id, coalesce({_HOST.format('url')}, '') AS host FROM pages")
def h17(spark, d):
    return V.read(spark, d, "pages").select("page_id", A.host("url").alias("host"))


@query("h16_dedup_key", f"""WITH p AS (SELECT page_id, {_HOST.format('url')} || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS base,
  array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.+') AND NOT regexp_matches(regexp_extract(x, '^([^=]*)', 1), '^(?:utm_.*|fbclid|gclid|igshid|ref)$')), '&') AS q FROM pages)
SELECT page_id, CASE WHEN q <> '' THEN base || '?' || q ELSE base END AS key FROM p""")
def h16(spark, d):
    return V.read(spark, d, "pages").select("page_id", A.dedup_key("url").alias("key"))


@query("s12_page_meta", r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?is)<meta[^>]+name=["'']description["''][^>]+content=["'']([^"'']*)', 1) AS description FROM pages""")
def s12(spark, d):
    return V.read(spark, d, "pages").select("page_id", A.meta("html").alias("m")).select("page_id", "m.title", "m.description")


@query("h38_links", r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref=["'']([^"''#]+)', 1))) AS links FROM pages""")
def h38(spark, d):
    return V.read(spark, d, "pages").select("page_id", F.size(A.links("html")).cast("long").alias("links"))


@query("w13_round_robin", f"""WITH {V.POSTS}, r AS (SELECT candidate, site, post_id, CAST(row_number() OVER (PARTITION BY candidate, site ORDER BY score DESC NULLS LAST, post_id) AS INTEGER) AS round FROM posts)
SELECT candidate, post_id, round, CAST(row_number() OVER (PARTITION BY candidate ORDER BY round, site, post_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 40""")
def w13(spark, d):
    pool = V.posts(spark, d).select("candidate", "site", F.col("score").alias("published_at"), F.col("post_id").alias("url"))
    return U.round_robin(pool, 40).select("candidate", F.col("url").alias("post_id"), "round", "rank")


@query("w12_capped", f"""WITH {V.COVERAGE}, u AS (SELECT candidate, url, min(pos) AS pos, min(tier) = 3 AS carried, feature AS category FROM coverage GROUP BY candidate, url, feature),
c AS (SELECT *, row_number() OVER (PARTITION BY candidate, carried, category ORDER BY pos, url) AS cc FROM u),
k AS (SELECT candidate, url, category, carried, CAST(row_number() OVER (PARTITION BY candidate ORDER BY CASE WHEN carried THEN 0 WHEN cc = 1 THEN 1 ELSE 2 END, pos, url, category) AS INTEGER) AS rank FROM c)
SELECT candidate, url, category, rank FROM k WHERE carried OR rank <= 30""")
def w12(spark, d):
    rows = V.coverage(spark, d).groupBy("candidate", "url", F.col("feature").alias("category")).agg(F.min("pos").alias("pos"), (F.min("tier") == 3).alias("carried"))
    return U.capped(rows, 30).select("candidate", "url", "category", "rank")


@query("w17_representative", f"WITH {V.VIDEOS} SELECT candidate, arg_max(video_id, views * 1000000000000 - video_id) AS video_id, max(views) AS views, count(*) - 1 AS others FROM videos GROUP BY candidate")
def w17(spark, d):
    return U.representative(V.videos(spark, d), "candidate")


@query("w18_best", "SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1")
def w18(spark, d):
    return U.best_by(V.read(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", "s_nationkey")


@query("f14_video_thresholds", f"WITH {V.VIDEOS} SELECT DISTINCT candidate, video_id FROM videos WHERE views >= 1000 AND comments >= 2")
def f14(spark, d):
    return U.video_thresholds(V.videos(spark, d), 1000, 2).select("candidate", "video_id")


@query("a39_coverage_class", f"""WITH {V.COVERAGE}, g AS (SELECT feature, candidate, count(DISTINCT url) AS n_urls, count(DISTINCT source) AS n_platforms FROM coverage GROUP BY ALL)
SELECT *, CASE WHEN n_urls >= 10 THEN 'sufficient' WHEN n_urls >= 3 THEN 'partial' ELSE 'not_found' END AS by_urls, CASE WHEN n_platforms >= 3 THEN 'sufficient' WHEN n_platforms >= 1 THEN 'partial' ELSE 'not_found' END AS by_platforms FROM g""")
def a39(spark, d):
    return U.coverage_class(V.coverage(spark, d).withColumnRenamed("source", "platform"), "feature", "candidate")


@query("a41_coverage_summary", f"WITH {V.COVERAGE} SELECT report, feature, count(*) FILTER (coverage = 'not_found') AS not_found, count(*) FILTER (coverage = 'partial') AS partial, count(*) FILTER (coverage = 'sufficient') AS sufficient FROM coverage GROUP BY report, feature")
def a41(spark, d):
    return U.coverage_summary(V.coverage(spark, d))


@query("a49_baseline", f"WITH {V.COVERAGE} SELECT count(*) FILTER (coverage = 'not_found') AS not_found, count(*) AS n, count(*) FILTER ({_HOST.format('url')} <> 's1.example.com') AS external, count(DISTINCT url) AS urls, count(DISTINCT report || feature || candidate) AS cells FROM coverage")
def a49(spark, d):
    return U.baseline(V.coverage(spark, d), ["s1.example.com"])


@query("a44_deficit", "WITH n AS (SELECT l_partkey AS feature, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT p_partkey AS feature, coalesce(n, 0) AS n FROM part LEFT JOIN n ON feature = p_partkey WHERE coalesce(n, 0) < 9")
def a44(spark, d):
    found = V.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("feature"))
    return U.deficit(V.read(spark, d, "part").select(F.col("p_partkey").alias("feature")), found, 9)


@query("a51_recall_table", f"WITH {V.COVERAGE}, u AS (SELECT source AS site, url, count(*) AS n, count(DISTINCT candidate) AS c, count(*) FILTER (tier > 0) AS dated FROM coverage GROUP BY ALL) SELECT site, CAST(sum(n) AS BIGINT) AS n, count(*) AS urls, count(*) FILTER (c > 1) AS multi, CAST(sum(dated) AS BIGINT) AS dated FROM u GROUP BY site")
def a51(spark, d):
    return U.recall_table(V.coverage(spark, d).select(F.col("source").alias("site"), "url", "candidate", F.when(F.col("tier") > 0, "2026").alias("published_at")))


@query("a52_profile", f"WITH {V.VIDEOS} SELECT candidate AS host, CAST(comments AS INTEGER) AS status, count(*) AS n, max(likes) AS max_likes, list_sort(list(likes))[CAST(count(*) // 2 AS INTEGER) + 1] AS median_likes FROM videos GROUP BY ALL")
def a52(spark, d):
    return U.profile(V.videos(spark, d).select(F.col("candidate").alias("host"), F.col("comments").cast("int").alias("status"), "likes"))


@query("w23_page_budget", f"WITH {V.POSTS} SELECT post_id, CAST(least(6000, 30000 // count(*) OVER (PARTITION BY site)) AS INTEGER) AS budget FROM posts")
def w23(spark, d):
    return U.page_budget(V.posts(spark, d), "site").select("post_id", "budget")


@query("w25_expand_links", """WITH l AS (SELECT DISTINCT l_partkey AS src, l_suppkey * 7 AS dst FROM lineitem), r0 AS (SELECT DISTINCT p_partkey AS url FROM part WHERE p_size = 50),
r1 AS (SELECT DISTINCT dst AS url FROM l JOIN r0 ON src = url WHERE dst NOT IN (SELECT url FROM r0) ORDER BY 1 LIMIT 50),
r2 AS (SELECT DISTINCT dst AS url FROM l JOIN r1 ON src = url WHERE dst NOT IN (SELECT url FROM r0 UNION ALL SELECT url FROM r1) ORDER BY 1 LIMIT 50)
SELECT url, 0::INTEGER AS hop FROM r0 UNION ALL SELECT url, 1 FROM r1 UNION ALL SELECT url, 2 FROM r2""")
def w25(spark, d):
    x = V.read(spark, d, "lineitem")
    return U.expand_links(V.read(spark, d, "part").where("p_size = 50").select(F.col("p_partkey").alias("url")), x.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 7).alias("dst")).distinct(), 50, 2)


_GRID = f"WITH {V.CELLS}, grid AS (SELECT f.feature, k.candidate, value, value_numeric, unit, as_of, coalesce(status, 'not_found') AS status, promotional FROM (SELECT DISTINCT feature FROM cells) f CROSS JOIN (SELECT DISTINCT candidate FROM cells) k LEFT JOIN cells c ON c.feature = f.feature AND c.candidate = k.candidate)"


def _grid(spark, d):
    cells = V.cells(spark, d)
    return M.dense(cells, cells, cells)


@query("j19_dense", f"{_GRID} SELECT feature, candidate, value, status FROM grid")
def j19(spark, d):
    return _grid(spark, d).select("feature", "candidate", "value", "status")


@query("j20_display", f"{_GRID} SELECT feature, candidate, CASE WHEN status IN ('not_found', 'unknown') OR value IS NULL THEN '미확인' ELSE value || CASE WHEN status = 'requires_manual_check' THEN ' (수동 검토 필요)' ELSE '' END || CASE WHEN promotional THEN ' [기간한정]' ELSE '' END END AS shown FROM grid")
def j20(spark, d):
    return M.display(_grid(spark, d)).select("feature", "candidate", "shown")


@query("j21_identical", f"{_GRID} SELECT feature, count(DISTINCT value) AS values, count(value) AS known, count(*) AS n, count(DISTINCT value) = 1 AND count(value) = count(*) AS same FROM grid GROUP BY feature")
def j21(spark, d):
    return M.identical(_grid(spark, d))


@query("a45_manual_review", f"{_GRID} SELECT candidate, count(*) AS n, count(*) FILTER (status = 'explicit') AS explicit, count(*) FILTER (status = 'not_found') AS missing, count(*) FILTER (status = 'not_found') > 0 OR count(*) FILTER (status = 'explicit') < count(*) * 0.5 AS review FROM grid GROUP BY candidate")
def a45(spark, d):
    return M.manual_review(_grid(spark, d))


@query("a46_footnotes", f"{_GRID} SELECT candidate, feature, CAST(row_number() OVER (ORDER BY candidate NOT LIKE 'own%', candidate, feature) AS INTEGER) AS note FROM grid WHERE promotional")
def a46(spark, d):
    return M.footnotes(_grid(spark, d))


@query("a46_traps", f"{_GRID} SELECT feature, candidate, 'no date' AS trap FROM grid WHERE value_numeric IS NOT NULL AND coalesce(as_of, '') = ''")
def a46b(spark, d):
    return M.traps(_grid(spark, d))


@query("a30_rubric", f"""{_GRID}, a AS (SELECT count(value_numeric) AS numbers, count(*) FILTER (value_numeric IS NOT NULL AND unit <> '') AS with_unit, count(*) FILTER (value_numeric IS NOT NULL AND as_of = '') AS undated, count(*) FILTER (promotional) AS notes FROM grid)
SELECT *, CAST(CASE WHEN numbers = 0 OR with_unit < numbers THEN 2 WHEN notes > 0 AND undated = 0 THEN 5 ELSE 4 END AS INTEGER) AS score FROM a""")
def a30(spark, d):
    return M.rubric(_grid(spark, d))


_MONTHS = [f"1996-{m:02d}" for m in range(1, 13)]


@query("a33_frequency", f"""WITH {V.CHANNELS}, g AS (SELECT candidate, month FROM (SELECT DISTINCT candidate FROM channels), (SELECT unnest({_MONTHS!r}) AS month)), n AS (SELECT candidate, month, count(*) AS total, count(*) FILTER (related) AS related FROM channels GROUP BY ALL)
SELECT candidate, month, coalesce(total, 0) AS total, coalesce(related, 0) AS related FROM g LEFT JOIN n USING (candidate, month)""")
def a33(spark, d):
    return C.frequency(V.channels(spark, d), F.array(*[F.lit(m) for m in _MONTHS]))


@query("a34_engagement", f"""WITH {V.VIDEOS} SELECT candidate, median(CASE WHEN views > 0 THEN (likes + comments)::DOUBLE / views END) AS per_view, median(CASE WHEN subscribers > 0 THEN (likes + comments)::DOUBLE / subscribers END) AS per_subscriber,
  CAST(sum(views) AS BIGINT) AS views, CAST(sum(likes) AS BIGINT) AS likes, count(*) AS n FROM videos GROUP BY candidate""")
def a34(spark, d):
    return C.engagement(V.videos(spark, d))


_P = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_STATES = f"""WITH {V.CHANNELS}, o AS (SELECT DISTINCT candidate, platform FROM channels WHERE month = '1992-02'), m AS (SELECT DISTINCT candidate, platform FROM channels WHERE month = '1992-02' AND related), f AS (SELECT candidate, platform, min('feed_ok') AS feed FROM channels WHERE month = '1995-03' GROUP BY ALL),
states AS (SELECT candidate, platform, CASE WHEN m.platform IS NOT NULL THEN 'measured' WHEN feed IS NOT NULL THEN feed WHEN o.platform IS NOT NULL THEN 'presence_only' ELSE 'none' END AS state
FROM (SELECT DISTINCT candidate FROM o) c CROSS JOIN (SELECT unnest({[p[2:] for p in _P]!r}) AS platform) p LEFT JOIN o USING (candidate, platform) LEFT JOIN m USING (candidate, platform) LEFT JOIN f USING (candidate, platform))"""


def _states(spark, d):
    x = V.channels(spark, d)
    return C.presence(x.where("month = '1992-02'"), x.where("month = '1992-02' AND related"), x.where("month = '1995-03'").withColumn("state", F.lit("feed_ok")), [p[2:] for p in _P])


@query("a35_presence", f"{_STATES} SELECT * FROM states")
def a35(spark, d):
    return _states(spark, d)


@query("a36_gaps", f"{_STATES} SELECT platform, string_agg(DISTINCT candidate, ',' ORDER BY candidate) AS holders FROM states WHERE candidate <> 'n3' AND state <> 'none' AND platform IN (SELECT platform FROM states WHERE candidate = 'n3' AND state = 'none') GROUP BY platform")
def a36(spark, d):
    return C.gaps(_states(spark, d), "n3")


@query("x05_feed_overlap", f"""WITH {V.CHANNELS}, t AS (SELECT DISTINCT candidate, platform AS feed, item_id % 211 AS title FROM channels), s AS (SELECT candidate, feed, count(*) AS size FROM t GROUP BY ALL),
c AS (SELECT a.candidate, a.feed AS first, b.feed AS second, count(*) AS common FROM t a JOIN t b ON a.candidate = b.candidate AND a.title = b.title AND a.feed < b.feed GROUP BY ALL)
SELECT c.candidate, first, second, common FROM c JOIN s x ON x.candidate = c.candidate AND x.feed = first JOIN s y ON y.candidate = c.candidate AND y.feed = second WHERE common >= least(x.size, y.size) * 0.5""")
def x05(spark, d):
    t = V.channels(spark, d).select("candidate", F.col("platform").alias("feed"), (F.col("item_id") % 211).alias("title"))
    return C.feed_overlap(t).select("candidate", "first", "second", "common")


@query("a42_reaction_preview", f"WITH {V.POSTS}, n AS (SELECT site, count(*) AS n, count(DISTINCT post_id) AS posts, count(DISTINCT candidate) AS candidates FROM posts GROUP BY site) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, site) AS INTEGER) AS rank FROM n")
def a42(spark, d):
    return C.reaction_preview(V.posts(spark, d))


@query("w22_interval_merge", """WITH i AS (SELECT l_suppkey AS k, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem), n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT k, min(s) AS start, max(e) AS "end" FROM g GROUP BY k, island""")
def w22(spark, d):
    x = V.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return E.merged_intervals(x, "k")


def excerpt_sql(keywords, head: int = E.HEAD, radius: int = E.RADIUS, most: int = E.MATCHES) -> str:
    """CTEs after `src` (id, text, budget) up to `excerpts` (id, excerpt), by islands and a greedy recursion."""
    mark, words = quoted(E.OMITTED), sorted(keywords)
    merged = lambda name, of: f"""{name}_reach AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {of}),
{name}_island AS (SELECT *, count(*) FILTER (reach IS NULL OR s > reach) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_reach),
{name} AS (SELECT id, min(s) AS s, max(e) AS e FROM {name}_island GROUP BY id, island)"""  # noqa: E731
    return f"""long AS (SELECT * FROM src WHERE length(text) > budget),
word(k) AS (SELECT unnest({listed(words)})),
part AS (SELECT id, text, k, string_split(text, k) AS p FROM long, word WHERE contains(text, k)),
hit AS (SELECT id, length(text) AS n, length(k) AS m, list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(k) AS o FROM part, range(1, {most + 1}) r(i) WHERE i < len(p)),
win AS (SELECT id, greatest(o - {radius}, 0)::BIGINT AS s, least(o + m + {radius}, n)::BIGINT AS e FROM hit),
{merged('windows', 'win')},
line AS (SELECT id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM long),
placed AS (SELECT id, x, i, coalesce(sum(length(x) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM line),
must AS (SELECT id, 0::BIGINT AS s, least({head}, length(text))::BIGINT AS e FROM long UNION ALL SELECT id, o, (o + length(x))::BIGINT FROM placed WHERE starts_with(x, '#')),
{merged('taken', 'must')},
ranked AS (
  SELECT w.id, s, e, budget, row_number() OVER (PARTITION BY w.id ORDER BY len(list_filter({listed(words)}, lambda k: contains(text[s + 1:e], k))) DESC, s) AS i FROM windows w JOIN long USING (id)),
fill(id, i, used, ok) AS (
  SELECT id, 0::BIGINT, CAST(sum(e - s + {len(E.OMITTED)}) AS BIGINT), false FROM taken GROUP BY id
  UNION ALL
  SELECT f.id, r.i, CASE WHEN f.used + r.e - r.s + {len(E.OMITTED)} > budget THEN f.used ELSE f.used + r.e - r.s + {len(E.OMITTED)} END, f.used + r.e - r.s + {len(E.OMITTED)} <= budget
  FROM fill f JOIN ranked r ON r.id = f.id AND r.i = f.i + 1),
chosen AS (SELECT id, s, e FROM taken UNION ALL SELECT r.id, s, e FROM ranked r JOIN fill f ON f.id = r.id AND f.i = r.i WHERE ok),
{merged('picked', 'chosen')},
piece AS (SELECT p.id, s, e, text, budget, CASE WHEN s > coalesce(lag(e) OVER (PARTITION BY p.id ORDER BY s), 0) THEN {mark} ELSE '' END || text[s + 1:e] AS x FROM picked p JOIN long USING (id)),
excerpts AS (
  SELECT id, (string_agg(x, '' ORDER BY s) || CASE WHEN max(e) < length(any_value(text)) THEN {mark} ELSE '' END)[1:any_value(budget)] AS excerpt FROM piece GROUP BY id
  UNION ALL SELECT id, text FROM src WHERE length(text) <= budget)"""


@query("w21_excerpts", f"WITH RECURSIVE {V.POSTS}, src AS (SELECT post_id AS id, body AS text, 1500 AS budget FROM posts), {excerpt_sql(V.KEYWORDS)} SELECT id AS post_id, excerpt FROM excerpts")
def w21(spark, d):
    return E.excerpts(V.posts(spark, d).withColumnRenamed("body", "text"), list(V.KEYWORDS), 1500).select("post_id", "excerpt")


@query("w26_sentence_chunks", rf"""WITH RECURSIVE {V.POSTS},
t AS (SELECT post_id, string_split(regexp_replace(regexp_replace(regexp_replace(body, '^\s+|\s+$', '', 'g'), '([.!?。])\s+', '\1' || chr(31), 'g'), '\n+', chr(31), 'g'), chr(31)) AS s FROM posts),
e AS (SELECT post_id, i, s[i] AS s FROM (SELECT post_id, s, unnest(range(1, len(s) + 1)) AS i FROM t)),
p AS (SELECT post_id, i, j, substring(s, j * 3000 + 1, 3000) AS s, (j + 1) * 3000 < length(s) AS hard FROM (SELECT *, unnest(range(0, CAST(greatest(1, ceil(length(s) / 3000.0)) AS BIGINT))) AS j FROM e)),
k AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY i, j) AS n FROM p),
f(post_id, n, now, done) AS (
  SELECT post_id, 0::BIGINT, ''::VARCHAR, []::VARCHAR[] FROM t
  UNION ALL SELECT k.post_id, k.n, CASE WHEN hard THEN '' WHEN now <> '' AND length(now) + 1 + length(s) > 3000 THEN s ELSE regexp_replace(now || ' ' || s, '^\s+|\s+$', '', 'g') END,
    CASE WHEN hard AND now <> '' THEN list_concat(done, [now, s]) WHEN hard THEN list_append(done, s) WHEN now <> '' AND length(now) + 1 + length(s) > 3000 THEN list_append(done, now) ELSE done END
  FROM f JOIN k ON k.post_id = f.post_id AND k.n = f.n + 1 WHERE len(f.done) < 3),
c AS (SELECT post_id, list_slice(CASE WHEN now <> '' THEN list_append(done, now) ELSE done END, 1, 3) AS c FROM f QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY n DESC) = 1)
SELECT post_id, CAST(i AS INTEGER) AS chunk_index, c[i + 1] AS text FROM (SELECT post_id, c, unnest(range(len(c))) AS i FROM c)""")
def w26(spark, d):
    return E.chunked(V.posts(spark, d).select("post_id", F.col("body").alias("text")))


@query("h12_clean_body", r"SELECT doc_id AS post_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM documents")
def h12(spark, d):
    return V.posts(spark, d).select("post_id", X.clean_body("body", F.lit("")).alias("body"))


@query("h14_real_length", r"SELECT doc_id AS post_id, CAST(length(trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>|https?://\S+|\[링크\]', '', 'g'), '\s+', ' ', 'g'))) AS INTEGER) AS n FROM documents")
def h14(spark, d):
    return V.posts(spark, d).select("post_id", X.real_length("body", F.lit("")).alias("n"))


@query("h03_slug", "SELECT p_partkey, regexp_replace(lower(p_name), '[^가-힣a-z0-9]', '', 'g') AS slug FROM part")
def h03(spark, d):
    return V.read(spark, d, "part").select("p_partkey", X.slug("p_name").alias("slug"))


@query("h24_fuzzy_match", """WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, lower(replace(trim(a.n_name), ' ', '')) AS x, lower(replace(trim(b.n_name), ' ', '')) AS y FROM nation a, nation b),
q AS (SELECT *, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda k: substring(x, 1, k) = substring(y, 1, k))) AS c FROM p) SELECT a, b FROM q WHERE x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x) OR c::DOUBLE / greatest(length(x), length(y)) >= 0.5)""")
def h24(spark, d):
    n = V.read(spark, d, "nation")
    dimension(n, "names", 10_000)
    pairs = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")).crossJoin(F.broadcast(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))))
    return pairs.where(X.fuzzy_match("x", "y", 0.5)).select("a", "b")


@query("h32_short_id", "SELECT doc_id, 'cm_' || substring(sha1(coalesce(text, '')), 1, 12) AS id FROM documents")
def h32(spark, d):
    return V.read(spark, d, "documents").select("doc_id", X.short_id("text").alias("id"))


@query("h36_rank_confidence", "SELECT s_suppkey, greatest(50, 90 - 5 * (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1))::BIGINT AS confidence FROM supplier")
def h36(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    return V.read(spark, d, "supplier").select("s_suppkey", F.round(X.rank_confidence(rank) * 100).cast("long").alias("confidence"))


@query("u12_relevance_gate", """SELECT doc_id, CASE WHEN trim(concat_ws(' ', lang, coalesce(text, ''))) = '' THEN 'unknown' WHEN contains(lower(coalesce(text, '')), 'thand') OR contains(lower(coalesce(text, '')), 'queo') THEN 'relevant' ELSE 'irrelevant' END AS gate FROM documents""")
def u12(spark, d):
    return V.read(spark, d, "documents").select("doc_id", X.relevance_gate("lang", "text", ["thand", "queo"]).alias("gate"))


