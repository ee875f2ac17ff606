"""Registered queries on extraction that fails, splits and is tried again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import retry as R
from ..sources import store as S
from . import views as V
from .registry import Registry

query = Registry()

_SIZE, _MOST, _BROKEN = 16, 900, "%%%"
_LABELS = [("first", "thand"), ("second", "eaux"), ("third", "ung")]


def _chunks(spark, d):
    c = V.comments(spark, d)
    items = c.select(F.concat(F.lit("c"), F.col("thread_id") % 4).alias("candidate"), F.concat_ws(".", "thread_id", "pos").alias("item_id"), "text", (F.col("thread_id") * 64 + F.col("pos")).alias("at"))
    return R.chunks(items, "at", 64 * _SIZE)


def _settled(spark, d):
    return R.extract(_chunks(spark, d), R.rule_engine(_LABELS, _MOST, _BROKEN), S.scratch(spark, "retry"), F.lit(dt.datetime(2026, 1, 1)), digits=1)


_ITEMS = f"""item AS (
  SELECT 'c' || (thread_id % 4) AS candidate, (thread_id * 64 + pos) // {64 * _SIZE} AS chunk, thread_id || '.' || pos AS item_id, text, row_number() OVER (PARTITION BY thread_id % 4, (thread_id * 64 + pos) // {64 * _SIZE} ORDER BY thread_id * 64 + pos) AS i FROM comments),
run AS (SELECT *, sum(length(text)) OVER w AS upto, count(*) FILTER (contains(text, '{_BROKEN}')) OVER w AS bad FROM item WINDOW w AS (PARTITION BY candidate, chunk ORDER BY i)),
piece(candidate, chunk, lo, hi, round) AS (
  SELECT candidate, chunk, 0::BIGINT, max(i), 0 FROM run GROUP BY candidate, chunk
  UNION ALL
  SELECT p.candidate, p.chunk, CASE WHEN h = 0 THEN lo ELSE (lo + hi) // 2 END, CASE WHEN h = 0 THEN (lo + hi) // 2 ELSE hi END, round + 1
  FROM piece p JOIN run z ON z.candidate = p.candidate AND z.chunk = p.chunk AND z.i = p.hi LEFT JOIN run a ON a.candidate = p.candidate AND a.chunk = p.chunk AND a.i = p.lo, (VALUES (0), (1)) half(h)
  WHERE z.upto - coalesce(a.upto, 0) > {_MOST} AND hi - lo > 1),
judged AS (
  SELECT p.*, CASE WHEN z.upto - coalesce(a.upto, 0) > {_MOST} THEN 'timeout' WHEN z.bad > coalesce(a.bad, 0) THEN 'schema' END AS cause
  FROM piece p JOIN run z ON z.candidate = p.candidate AND z.chunk = p.chunk AND z.i = p.hi LEFT JOIN run a ON a.candidate = p.candidate AND a.chunk = p.chunk AND a.i = p.lo),
settled AS (SELECT * FROM judged WHERE cause IS DISTINCT FROM 'timeout' OR hi - lo = 1)"""


@query("u23_item_outcomes", f"""WITH RECURSIVE {V.COMMENTS}, {_ITEMS}
SELECT i.candidate, i.chunk, item_id, cause IS NULL AS ok, cause, round::INTEGER AS round FROM item i JOIN settled s ON s.candidate = i.candidate AND s.chunk = i.chunk AND i.i > lo AND i.i <= hi""")
def u23_item_outcomes(spark, d):
    return R.outcomes(_settled(spark, d))


@query("u23_tuples", f"""WITH RECURSIVE {V.COMMENTS}, {_ITEMS}, label(name, word) AS (VALUES {', '.join(f"('{n}', '{k}')" for n, k in _LABELS)})
SELECT i.candidate, item_id, name AS label FROM item i JOIN settled s ON s.candidate = i.candidate AND s.chunk = i.chunk AND i.i > lo AND i.i <= hi, label WHERE cause IS NULL AND contains(text, word)""")
def u23_tuples(spark, d):
    return _settled(spark, d).select("candidate", F.explode("tuples").alias("t")).select("candidate", "t.item_id", "t.label")


@query("u23_failures", f"""WITH RECURSIVE {V.COMMENTS}, {_ITEMS}
SELECT cause, count(*) AS pieces, CAST(sum(hi - lo) AS BIGINT) AS items FROM settled WHERE cause IS NOT NULL GROUP BY cause""")
def u23_failures(spark, d):
    return R.failures(_settled(spark, d))


@query("w10_resplit", """WITH RECURSIVE item AS (
  SELECT thread_id, pos, text, row_number() OVER (PARTITION BY thread_id ORDER BY pos) AS i FROM (SELECT conv_id AS thread_id, turn AS pos, coalesce(text, '') AS text FROM conversations)),
fold(thread_id, i, pos, piece, n) AS (
  SELECT thread_id, i, pos, 0, length(text) FROM item WHERE i = 1
  UNION ALL
  SELECT f.thread_id, t.i, t.pos, CASE WHEN f.n + length(t.text) > 600 THEN piece + 1 ELSE piece END, CASE WHEN f.n + length(t.text) > 600 THEN length(t.text) ELSE f.n + length(t.text) END FROM fold f JOIN item t ON t.thread_id = f.thread_id AND t.i = f.i + 1)
SELECT thread_id, pos, piece FROM fold""")
def w10_resplit(spark, d):
    c = V.comments(spark, d)
    threads = c.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(F.col("pos").cast("string").alias("item_id"), "text").alias("item")))).alias("x"))
    cut = threads.select("thread_id", F.posexplode(R.by_chars(600)(F.transform("x", lambda x: x["item"]))).alias("piece", "items"))
    return cut.select("thread_id", "piece", F.explode("items.item_id").alias("pos")).select("thread_id", F.col("pos").cast("long").alias("pos"), "piece")
