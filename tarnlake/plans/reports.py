"""Registered queries on whole report programs (A14, P18): many sections from one pass over each fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import excerpt as E

from . import programs as P
from . import views as V
from .collections import excerpt_sql
from .opinions import _COUNTS, _GROUP, _IDX, _PARTS, _SIDE
from .registry import Registry

query = Registry()

_STRONG = "count(*) FILTER (intensity >= 3) AS strong, coalesce(CAST(sum(CASE polarity WHEN 'positive' THEN intensity WHEN 'negative' THEN -intensity ELSE 0 END) FILTER (intensity >= 3) AS BIGINT), 0) AS snum, coalesce(CAST(sum(intensity) FILTER (intensity >= 3) AS BIGINT), 0) AS sden"
_KEYS = ("aspect", "candidate", "channel", "perspective", "side", "question_type", "question_group")

#: Whole numbers that some sections lack; as doubles they compare alike everywhere.
_GAPS = ("pos", "neg", "neu", "num", "den", "strong", "idx", "strong_idx", "place", "share")


def _of(name: str, by: tuple[str, ...], table: str) -> str:
    keys = ", ".join(k if k in by else f"NULL::VARCHAR AS {k}" for k in _KEYS)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    known = "WHERE candidate IS NOT NULL" if "candidate" in by else ""
    measures = f"{_COUNTS}, {_PARTS}, {_STRONG}" if table == "u" else "count(*) AS n, " + ", ".join(f"NULL::BIGINT AS {m}" for m in ("pos", "neg", "neu", "num", "den", "strong", "snum", "sden"))
    return f"SELECT '{name}' AS section, {keys}, {measures} FROM {table} {known} {group}"


_STATISTICS = f"""WITH {V.UNITS}, {V.QUESTIONS}, u AS (SELECT *, {_SIDE} AS side FROM units), q AS (SELECT *, {_SIDE} AS side, {_GROUP} AS question_group FROM questions),
s AS ({" UNION ALL ".join([*[_of(n, by, 'u') for n, by in P.UNIT_SECTIONS.items()], *[_of(n, by, 'q') for n, by in P.QUESTION_SECTIONS.items()]])}),
i AS (SELECT *, CASE WHEN den > 0 THEN {_IDX} END AS idx, CASE WHEN sden > 0 THEN {_IDX.replace('num', 'snum').replace('den', 'sden')} END AS strong_idx FROM s)
SELECT section, {', '.join(_KEYS)}, n, {', '.join(f'{c}::DOUBLE AS {c}' for c in _GAPS[:-2])}, CASE WHEN n >= 20 THEN 'ratio' WHEN n >= 10 THEN 'direction' WHEN n >= 5 THEN 'thin' ELSE 'count_only' END AS level,
  CASE WHEN candidate IS NOT NULL AND idx IS NOT NULL AND section <> 'cube' THEN rank() OVER (PARTITION BY section, aspect, perspective, channel ORDER BY idx DESC NULLS LAST)::DOUBLE END AS place,
  CASE WHEN starts_with(section, 'question') THEN CAST(1000 * n // sum(n) OVER (PARTITION BY section) AS DOUBLE) END AS share FROM i"""


@query("a14_statistics", _STATISTICS)
def a14_statistics(spark, d):
    made = P.statistics(V.units(spark, d), V.questions(spark, d))
    return made.withColumns({c: F.col(c).cast("double") for c in _GAPS})


@query("p18_report", f"""WITH {V.UNITS}, h AS (
  SELECT aspect, count(*) FILTER (polarity = 'positive' AND side = 'own') - count(*) FILTER (polarity = 'negative' AND side = 'own') AS own_net, count(*) FILTER (side = 'own') AS own_n,
    count(*) FILTER (polarity = 'positive' AND side = 'competitor') - count(*) FILTER (polarity = 'negative' AND side = 'competitor') AS comp_net, count(*) FILTER (side = 'competitor') AS comp_n, count(*) AS volume
  FROM (SELECT *, {_SIDE} AS side FROM units) GROUP BY aspect),
g AS (SELECT *, CAST(floor((own_net * comp_n - comp_net * own_n) * 1000 / (own_n * comp_n)::DOUBLE) AS BIGINT) AS gap FROM h WHERE own_n > 0 AND comp_n > 0)
SELECT 'weakness' AS section, aspect, own_net AS value, row_number() OVER (ORDER BY own_net, aspect)::INTEGER AS rank, NULL::DOUBLE AS running FROM h WHERE own_n > 0
UNION ALL SELECT 'opportunity', aspect, gap, row_number() OVER (ORDER BY gap DESC, aspect)::INTEGER, NULL FROM g WHERE gap > 0
UNION ALL SELECT 'volume', aspect, volume, row_number() OVER w ::INTEGER, CAST(1000 * sum(volume) OVER (w ROWS UNBOUNDED PRECEDING) // sum(volume) OVER () AS DOUBLE) FROM h WINDOW w AS (ORDER BY volume DESC, aspect)""")
def p18_report(spark, d):
    return P.reaction_sections(V.units(spark, d)).withColumn("running", F.col("running").cast("double"))


@query("j41_payload", f"""WITH RECURSIVE page AS (
  SELECT 'c' || (doc_id // 8) AS candidate, 'https://' || source || '.example/' || doc_id AS url, doc_id AS id, text FROM documents WHERE n_chars >= 200 AND text IS NOT NULL),
src AS (SELECT id, text, least({E.PAGE}, greatest(1, {E.CANDIDATE} // count(*) OVER (PARTITION BY candidate))) AS budget, count(*) OVER (PARTITION BY candidate) AS n_pages FROM page),
{excerpt_sql(V.KEYWORDS)},
feature AS (SELECT DISTINCT 'c' || (doc_id // 8) AS candidate, n_name AS feature_id FROM documents JOIN nation ON n_regionkey = (doc_id // 8) % 6),
about AS (SELECT candidate, string_agg(feature_id, ',' ORDER BY feature_id) AS features FROM feature GROUP BY candidate),
keyed AS (
  SELECT p.candidate, coalesce(any_value(features), '') AS features, sha256(p.candidate || chr(10) || coalesce(any_value(features), '') || chr(10) || string_agg(url || ' ' || sha256(excerpt), chr(10) ORDER BY url)) AS payload_key
  FROM page p JOIN excerpts e ON e.id = p.id LEFT JOIN about a ON a.candidate = p.candidate GROUP BY p.candidate)
SELECT p.candidate, url, n_pages, s.budget::INTEGER AS budget, excerpt, features, payload_key FROM page p JOIN src s ON s.id = p.id JOIN excerpts e ON e.id = p.id JOIN keyed k ON k.candidate = p.candidate""")
def j41_payload(spark, d):
    """Pages in small groups as candidates; short and missing ones count as not fetched; a sixth of the candidates has no feature."""
    x, n = V.read(spark, d, "documents"), V.read(spark, d, "nation")
    k = F.expr("doc_id div 8")
    candidate = F.concat(F.lit("c"), k).alias("candidate")
    status = F.when((F.col("n_chars") >= 200) & F.col("text").isNotNull(), "ok").otherwise("requires_dynamic_render").alias("fetch_status")
    pages = x.select(candidate, F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id").alias("url"), status, "text")
    features = x.select(candidate, (k % 6).alias("of")).distinct().join(n, F.col("of") == F.col("n_regionkey")).select("candidate", F.col("n_name").alias("feature_id"))
    made = E.extraction_payload(pages, features, list(V.KEYWORDS))
    return made.select("candidate", "url", "n_pages", "budget", "excerpt", F.array_join("features", ",").alias("features"), "payload_key")
