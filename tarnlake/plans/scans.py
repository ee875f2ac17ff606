"""Registered queries over landed responses of paged services, written to the shared folder and read back, and over files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import landed as L
from ..sources import pdf as P
from ..sources import scans as C
from ..sources import store as S
from . import views as V
from .registry import Registry

query = Registry()

#: Keys that make a query of a service, and items of a page.
_SPAN, _SIZE = 60, 5


def _responses(spark, d, table: str, key: str, item):
    """Responses made of a whole table: a query for every 60 keys, a page for every 5; some pages were refused first, some always, some are empty or gone."""
    rows = V.read(spark, d, table).where(f"{key} IS NOT NULL")
    k = F.col(key)
    pages = rows.groupBy(F.expr(f"{key} div {_SPAN}").alias("q"), F.expr(f"{key} % {_SPAN} div {_SIZE}").cast("int").alias("page")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), item.alias("item")))).alias("x"))
    q, page = F.col("q"), F.col("page")
    status = F.when((q % 9 == 8) & (page == 0), 404).when((q % 10 == 9) & (page >= 2), 403).when((page + q) % 11 == 10, 429).otherwise(200)
    items = F.when(F.col("status") == 200, F.when((q % 8 == 7) & (page >= 3), "[]").otherwise(F.concat(F.lit("["), F.array_join("x.item", ","), F.lit("]"))))
    token = F.when(~((q % 3 == 0) & (page == 4)), F.concat(F.lit("t"), page + 1))
    tried = F.when((page * 7 + q) % 5 == 0, F.array(F.struct(F.lit(1).alias("attempt"), F.lit(429).alias("status")), F.struct(F.lit(2).alias("attempt"), status.alias("status")))).otherwise(F.array(F.struct(F.lit(1).alias("attempt"), status.alias("status"))))
    return pages.select("q", "page", "x", F.explode(tried).alias("t")).select("q", "page", "x", "t.*").select(F.concat(F.lit("q"), q).alias("query"), "page", "attempt", "status", token.alias("next_token"), items.alias("items"))


def _landed(spark, rows):
    path = S.scratch(spark, "responses")
    rows.write.json(path)
    return spark.read.schema(C.RESPONSE).json(path)


def _scan_sql(table: str, key: str, item: str, most: str = "NULL") -> str:
    """The same scans in SQL: pages p with their final status, ends by window over the pages of a query, `kept` the pages that count."""
    return f"""
pages_of AS (
  SELECT {key} // {_SPAN} AS q, CAST({key} % {_SPAN} // {_SIZE} AS INTEGER) AS page, list({{'k': {key}, 'item': {item}}} ORDER BY {key}, {item}) AS x FROM {table} WHERE {key} IS NOT NULL GROUP BY ALL),
answered AS (
  SELECT *, CASE WHEN q % 9 = 8 AND page = 0 THEN 404 WHEN q % 10 = 9 AND page >= 2 THEN 403 WHEN (page + q) % 11 = 10 THEN 429 ELSE 200 END AS status, q % 8 = 7 AND page >= 3 AS hollow, q % 3 = 0 AND page = 4 AS final,
    lead(page) OVER (PARTITION BY q ORDER BY page) AS following, min(page) OVER (PARTITION BY q) AS beginning FROM pages_of),
stops AS (
  SELECT *, CASE WHEN status = 404 THEN 'missing' WHEN status = 429 THEN 'throttled' WHEN status = 403 THEN 'quota' WHEN hollow OR final THEN 'exhausted' WHEN page + 1 >= {most} THEN 'limited' WHEN following IS DISTINCT FROM page + 1 THEN 'partial' END AS why FROM answered),
ends AS (SELECT q, CASE WHEN min(beginning) = 0 THEN min(page) FILTER (why IS NOT NULL) ELSE -1 END AS last, CASE WHEN min(beginning) = 0 THEN arg_min(why, page) FILTER (why IS NOT NULL) ELSE 'partial' END AS ended FROM stops GROUP BY q),
kept AS (SELECT 'q' || s.q AS query, s.page, s.x FROM stops s JOIN ends e ON e.q = s.q WHERE s.page <= e.last AND s.status = 200 AND NOT s.hollow)"""


_MOST = 10  # the search service has no more pages
_SEARCH = _scan_sql("documents", "doc_id", "coalesce(doc_id::VARCHAR || ' ' || source, '')", str(_MOST))


def _searches(spark, d):
    item = F.to_json(F.struct(F.coalesce(F.concat_ws(" ", F.when(F.col("source").isNotNull(), F.col("doc_id")), "source"), F.lit("")).alias("title")))
    return _landed(spark, _responses(spark, d, "documents", "doc_id", item))


@query("s09_search_results", f"WITH {_SEARCH} SELECT query, page, i - 1 AS pos, x[i].item AS title FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM kept)")
def s09_search_results(spark, d):
    return C.scanned(_searches(spark, d), _MOST).select("query", "page", "pos", F.get_json_object("item", "$.title").alias("title"))


@query("s09_scan_states", f"""WITH {_SEARCH}, n AS (SELECT query, count(*) AS n_pages, sum(len(x)) AS n_items FROM kept GROUP BY query)
SELECT 'q' || q AS query, ended, coalesce(n_pages, 0) AS n_pages, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, ended IN ('exhausted', 'limited') AND coalesce(n_items, 0) > 0 AS stored FROM ends LEFT JOIN n ON query = 'q' || q""")
def s09_scan_states(spark, d):
    return C.scan_states(_searches(spark, d), _MOST)


def _videos(spark, d):
    """Responses of a video search from orders: a video of a customer each, its channel a nation; and statistics of most videos."""
    k = F.col("o_orderkey")
    item = F.to_json(F.struct(F.when(k % 13 > 0, (k % 20_000).cast("string")).alias("video_id"), F.concat(F.lit("ch"), k % 25).alias("channel_id"), F.concat(F.lit("video "), k).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("published_at")))
    x = V.read(spark, d, "lineitem").where("l_orderkey % 7 > 0")
    stats = x.groupBy((F.col("l_orderkey") % 20_000).cast("string").alias("video_id")).agg((F.sum("l_partkey") % 5000).cast("long").alias("views"), F.sum(F.col("l_quantity").cast("long")).alias("likes"), (F.count("*") * 4).alias("comments"))
    return _landed(spark, _responses(spark, d, "orders", "o_orderkey", item)), stats


_VIDEO_ITEM = "{'video_id': CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey % 20000)::VARCHAR END, 'channel_id': 'ch' || (o_orderkey % 25), 'title': 'video ' || o_orderkey, 'published_at': strftime(o_orderdate, '%Y-%m-%dT00:00:00Z')}"
_VIDEOS = _scan_sql("orders", "o_orderkey", _VIDEO_ITEM) + """,
stats AS (SELECT (l_orderkey % 20000)::VARCHAR AS video_id, CAST(sum(l_partkey) % 5000 AS BIGINT) AS views, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS likes, count(*) * 4 AS comments FROM lineitem WHERE l_orderkey % 7 > 0 GROUP BY 1),
places AS (SELECT query, page, i, x[i].item AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM kept)),
firsts AS (SELECT query, v.video_id AS video_id, arg_min(v, page * 1000 + i) AS v FROM places WHERE v.video_id <> '' GROUP BY ALL),
found AS (SELECT query, video_id, v.channel_id AS channel_id, v.title AS title, v.published_at AS published_at, coalesce(views, 0) AS views, coalesce(likes, 0) AS likes, coalesce(comments, 0) AS comments FROM firsts LEFT JOIN stats USING (video_id)),
targets AS (SELECT DISTINCT CASE WHEN c_custkey % 5 = 4 THEN 'own' ELSE 'c' || (c_custkey % 70) END AS candidate, 'q' || c_custkey AS query FROM customer)"""


def _targets(spark, d):
    n = F.col("c_custkey")
    return V.read(spark, d, "customer").select(F.when(n % 5 == 4, "own").otherwise(F.concat(F.lit("c"), n % 70)).alias("candidate"), F.concat(F.lit("q"), n).alias("query")).distinct()


@query("s01_found_videos", f"WITH {_VIDEOS} SELECT query, video_id, channel_id, title, published_at, views, likes, comments FROM found")
def s01_found_videos(spark, d):
    return C.found_videos(*_videos(spark, d))


@query("p16_discovered_videos", f"""WITH {_VIDEOS}, r AS (SELECT candidate, f.* FROM found f JOIN targets USING (query) WHERE candidate <> 'own' AND published_at >= '1993-06-01T00:00:00Z' AND views >= 500 AND comments >= 4)
SELECT candidate, video_id, count(*) OVER (PARTITION BY candidate) AS of_candidate FROM (SELECT DISTINCT candidate, video_id FROM r)""")
def p16_discovered_videos(spark, d):
    """The videos alone: of one that several of a candidate's queries found, any row may stay."""
    rows = C.discovered_videos(_targets(spark, d), C.found_videos(*_videos(spark, d)), "1993-06-01T00:00:00Z", 500, 4)
    n = rows.groupBy("candidate").agg(F.count("*").alias("of_candidate"))
    return rows.join(n, "candidate").select("candidate", "video_id", "of_candidate")


@query("p16_discovery_steps", f"""WITH {_VIDEOS}, n AS (SELECT query, sum(len(x)) AS n_items FROM kept GROUP BY query)
SELECT candidate, CASE WHEN n_items IS NULL AND ended = 'quota' THEN 'quota_skip' WHEN n_items IS NULL AND (ended IS NULL OR ended NOT IN ('exhausted', 'limited', 'missing')) THEN 'skipped' ELSE 'completed' END AS status,
  CASE WHEN ended IS NULL THEN 'not asked' WHEN ended NOT IN ('exhausted', 'limited', 'missing') THEN ended ELSE '' END AS error
FROM targets t LEFT JOIN ends e ON t.query = 'q' || e.q LEFT JOIN n ON n.query = t.query WHERE candidate <> 'own'""")
def p16_discovery_steps(spark, d):
    return C.discovery_steps(_targets(spark, d), C.scan_states(_videos(spark, d)[0]))


_COMMENT_ITEM = "{'thread_id': conv_id::VARCHAR, 'text': coalesce(text, ''), 'author': role}"
_COMMENTS = _scan_sql("(SELECT * FROM conversations WHERE turn = 0)", "conv_id", _COMMENT_ITEM)


@query("s04_comments_scanned", f"""WITH {_COMMENTS}, threads AS (SELECT query, page, x[i].item AS c FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM kept)),
r AS (SELECT conv_id::VARCHAR AS thread_id, turn, text, role FROM conversations WHERE turn > 0)
SELECT query AS video_id, c.thread_id AS thread_id, false AS is_reply, c.text AS text, substring(sha256(coalesce(c.author, '')), 1, 12) AS author_hash FROM threads WHERE trim(c.text) <> ''
UNION ALL SELECT query, c.thread_id, true, r.text, substring(sha256(coalesce(role, '')), 1, 12) FROM threads JOIN r ON r.thread_id = c.thread_id WHERE trim(c.text) <> ''""")
def s04_comments_scanned(spark, d):
    """All threads of all pages, flattened by the operator of S03; replies lie inline in a thread's item."""
    c = V.read(spark, d, "conversations")
    reply = F.struct(F.col("turn").cast("string").alias("id"), "text", F.lit(0).cast("long").alias("likes"), F.lit("").alias("published_at"), F.col("role").alias("author"))
    replies = c.where("turn > 0").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", reply.alias("r")))).alias("x")).select(F.col("conv_id").alias("_c"), F.col("x.r").alias("replies"))
    roots = c.where("turn = 0").join(replies, F.col("conv_id") == F.col("_c"), "left")
    path = S.scratch(spark, "threads")
    roots.select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("thread_id"), F.struct(F.lit("0").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("long").alias("likes"), F.lit("").alias("published_at"), F.col("role").alias("author")).alias("top"), F.coalesce("replies", F.array().cast(f"array<{L.REPLY}>")).alias("replies"))).alias("item")).write.parquet(f"{path}/threads.parquet")
    scan = C.scanned(_landed(spark, _responses(spark, path, "threads", "conv_id", F.col("item"))))
    thread = F.from_json("item", f"struct<thread_id:string,top:{L.REPLY},replies:array<{L.REPLY}>>")
    threads = scan.select(F.col("query").alias("video_id"), thread.alias("t")).select("t.thread_id", "video_id", "t.top", "t.replies")
    return L.flat_comments(threads).select("video_id", "thread_id", "is_reply", "text", "author_hash")


_LINES = 40  # of a page


def _as_pdf(lines):
    """Lines as a PDF file made by column expressions: pages of 40 lines, shown by a font of two-byte codes that a map takes to Unicode. `lines` is a column that is there: an expression would be computed again for each page."""
    shown = lambda line: F.concat(F.lit("<"), F.hex(F.encode(line, "UTF-16BE")), F.lit("> Tj T*"))
    stream = lambda n, body: F.concat(n.cast("string"), F.lit(" 0 obj\n<< /Length "), F.length(body).cast("string"), F.lit(" >>\nstream\n"), body, F.lit("\nendstream\nendobj\n"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / _LINES).cast("int"))
    content = lambda i: F.concat(F.lit("BT /F1 12 Tf 14 TL\n"), F.array_join(F.transform(F.slice(lines, i * _LINES + 1, F.lit(_LINES)), shown), "\n"), F.lit("\nET"))
    page = lambda i: F.concat((5 + 2 * i).cast("string"), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R /Contents "), (6 + 2 * i).cast("string"), F.lit(" 0 R >>\nendobj\n"), stream(6 + 2 * i, content(i)))
    kids = F.array_join(F.transform(numbers, lambda i: F.concat((5 + 2 * i).cast("string"), F.lit(" 0 R"))), " ")
    head = F.concat(
        F.lit("%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Kids ["), kids, F.lit("] >>\nendobj\n3 0 obj\n<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>\nendobj\n"),
        stream(F.lit(4), F.lit("1 beginbfrange\n<0000> <FFFF> <0000>\nendbfrange")),
    )
    return F.concat(head, F.array_join(F.transform(numbers, page), ""), F.lit("trailer\n<< /Root 1 0 R >>\n%%EOF")).cast("binary")


@query("s15_pdf_text", f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
t AS (SELECT doc_id, len(x) AS n, array_to_string(list_filter(x[1:{P.PAGES * _LINES}], lambda y: y <> ''), chr(10)) AS text FROM l)
SELECT doc_id, CASE WHEN text = '' THEN 'empty' ELSE 'ok' END AS status, CAST((n + {_LINES - 1}) // {_LINES} AS INTEGER) AS n_pages, text FROM t""")
def s15_pdf_text(spark, d):
    """Every document as a PDF file and back, all its pages."""
    lines = V.read(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    return lines.select("doc_id", P.read(_as_pdf(F.col("lines")), pages=None).alias("p")).select("doc_id", "p.*")
