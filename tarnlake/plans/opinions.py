"""Registered queries on opinions and questions, with the same results in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import quotes as Q
from ..operators import sentiment as S
from . import views as V

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


_U, _Q = f"WITH {V.UNITS}", f"WITH {V.UNITS}, {V.QUESTIONS}"
_SIGN = "CASE polarity WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END"
_COUNTS = "count(*) AS n, count(*) FILTER (polarity = 'positive') AS pos, count(*) FILTER (polarity = 'negative') AS neg, count(*) FILTER (polarity = 'neutral') AS neu"
_PARTS = f"CAST(sum({_SIGN} * intensity) AS BIGINT) AS num, CAST(sum(intensity) AS BIGINT) AS den"
_INDEX = f"sum({_SIGN} * intensity)::DOUBLE / sum(intensity) AS index"
_SIDE = "CASE WHEN candidate IS NULL THEN 'excluded' WHEN candidate LIKE 'own%' THEN 'own' ELSE 'competitor' END"
_LEVEL = "CASE WHEN count(*) >= 20 THEN 'ratio' WHEN count(*) >= 10 THEN 'direction' WHEN count(*) >= 5 THEN 'thin' ELSE 'count_only' END AS sample_level"
_IDX = "CAST(sign(num) * ((200 * abs(num) + den) // (2 * den)) AS BIGINT)"


@query("a01_aspect_matrix", f"""{_U}, w AS (SELECT *, CASE WHEN channel = 'youtube' THEN 10 ELSE 9 END AS w FROM units WHERE candidate IS NOT NULL)
SELECT aspect, candidate, {_COUNTS}, CAST(sum({_SIGN} * intensity * w) AS BIGINT) AS num, CAST(sum(intensity * w) AS BIGINT) AS den,
  sum({_SIGN} * intensity * w)::DOUBLE / sum(intensity * w) AS weighted_sentiment FROM w GROUP BY aspect, candidate""")
def a01(spark, d):
    return S.aspect_matrix(V.units(spark, d))


@query("a02_index_by_candidate", f"{_U} SELECT candidate, {_COUNTS}, {_PARTS}, {_INDEX}, {_LEVEL} FROM units WHERE candidate IS NOT NULL GROUP BY candidate")
def a02(spark, d):
    return S.index_by(V.units(spark, d).where("candidate IS NOT NULL"), "candidate")


@query("a05_channel_split", f"{_U} SELECT candidate, channel, {_COUNTS}, {_PARTS}, {_INDEX} FROM units WHERE candidate IS NOT NULL GROUP BY GROUPING SETS ((candidate), (candidate, channel))")
def a05(spark, d):
    return S.channel_split(V.units(spark, d))


_VERDICT = f"""facts AS (SELECT aspect, candidate, count(*) AS n, {_PARTS} FROM units WHERE candidate IS NOT NULL AND aspect <> '기타' GROUP BY ALL),
idx AS (SELECT *, {_IDX} AS i FROM facts),
best AS (SELECT aspect, candidate AS best, i AS best_index FROM idx WHERE candidate NOT LIKE 'own%' QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY i DESC, n DESC, candidate) = 1),
own AS (SELECT aspect, n AS own_n, i AS own_index FROM idx WHERE candidate LIKE 'own%'),
joined AS (SELECT a.aspect, coalesce(own_n, 0) AS own_n, own_index, best, best_index, own_index - best_index AS gap
  FROM (SELECT DISTINCT aspect FROM facts) a LEFT JOIN own USING (aspect) LEFT JOIN best USING (aspect)),
verdicts AS (SELECT *, CASE WHEN own_n = 0 THEN '측정 불가' WHEN own_n < 5 THEN '표본 부족' WHEN gap IS NULL THEN '판단 불가' WHEN gap = 0 THEN '동률' WHEN abs(gap) < 10 THEN '접전' WHEN gap > 0 THEN '우위' ELSE '열위' END AS verdict FROM joined)"""


@query("a06_aspect_verdict", f"{_U}, {_VERDICT} SELECT * FROM verdicts")
def a06(spark, d):
    return S.aspect_verdict(V.units(spark, d))


@query("a13_focus_aspect", f"{_U}, {_VERDICT} SELECT aspect, own_n, gap FROM verdicts WHERE verdict = '열위' ORDER BY own_n DESC, aspect LIMIT 1")
def a13_focus(spark, d):
    return S.focus_aspect(S.aspect_verdict(V.units(spark, d)))


@query("a07_perspective_rank", f"""{_U}, facts AS (SELECT perspective, CASE WHEN candidate LIKE 'own%' THEN 'own' ELSE candidate END AS who, {_PARTS} FROM units WHERE candidate IS NOT NULL AND perspective <> 'other' GROUP BY ALL),
idx AS (SELECT perspective, who, {_IDX} AS i FROM facts),
r AS (SELECT *, rank() OVER (PARTITION BY perspective ORDER BY i DESC) AS place, count(*) OVER (PARTITION BY perspective) AS ranked, count(*) OVER (PARTITION BY perspective, i) AS same FROM idx)
SELECT p.perspective, i AS own_index, CAST(place AS INTEGER) AS place, ranked,
  CASE WHEN i IS NULL THEN '측정 불가' WHEN place = 1 AND same = 1 THEN '단독 1위' WHEN same > 1 THEN place || '위 동률' WHEN place = ranked THEN '최하' ELSE place || '위' END AS position
FROM (SELECT DISTINCT perspective FROM idx) p LEFT JOIN (SELECT * FROM r WHERE who = 'own') o USING (perspective)""")
def a07(spark, d):
    return S.perspective_rank(V.units(spark, d))


_GROUP = "CASE WHEN question_type IN ('feasibility', 'condition', 'comparison', 'method') THEN 'info' WHEN question_type IN ('recommendation', 'cost', 'troubleshooting') THEN question_type ELSE 'other' END"


@query("a08_question_stats", f"{_Q} SELECT question_type, any_value({_GROUP}) AS question_group, count(*) AS n, count(candidate) AS attributed, count(*) FILTER (candidate LIKE 'own%') AS own, count(*) FILTER (channel = 'youtube') AS youtube FROM questions GROUP BY question_type")
def a08(spark, d):
    return S.question_stats(V.questions(spark, d))


@query("a08_adoption_share", f"{_Q} SELECT candidate, count(*) FILTER ({_GROUP} IN ('info', 'recommendation')) AS adopting, count(*) AS n, (count(*) FILTER ({_GROUP} IN ('info', 'recommendation')))::DOUBLE / count(*) AS share FROM questions WHERE candidate IS NOT NULL GROUP BY candidate")
def a08b(spark, d):
    return S.adoption_share(V.questions(spark, d))


@query("a09_own_negatives", f"{_U} SELECT aspect, perspective, count(*) AS n FROM units WHERE candidate LIKE 'own%' AND polarity = 'negative' GROUP BY ALL")
def a09(spark, d):
    return S.own_negatives(V.units(spark, d))


@query("a10_strong_opinions", f"{_U} SELECT candidate, {_COUNTS}, {_PARTS}, {_INDEX}, {_LEVEL} FROM units WHERE candidate IS NOT NULL AND intensity >= 3 GROUP BY candidate")
def a10(spark, d):
    return S.strong_opinions(V.units(spark, d))


@query("a11_confirm_questions", f"""{_Q}, hit AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY question_id) AS rn FROM questions WHERE regexp_matches(quote, 'th.*ing'))
SELECT candidate, count(*) AS n, string_agg(question_id::VARCHAR, ',' ORDER BY question_id) FILTER (rn <= 5) AS examples FROM hit GROUP BY candidate""")
def a11(spark, d):
    return S.confirm_questions(V.questions(spark, d), "th.*ing")


@query("a12_totals", f"""{_Q}, t AS (SELECT 'unit' AS kind, {_SIDE} AS side, channel FROM units UNION ALL SELECT 'question', {_SIDE}, channel FROM questions)
SELECT kind, side, channel, count(*) AS n FROM t GROUP BY ALL""")
def a12(spark, d):
    return S.totals(V.units(spark, d), V.questions(spark, d))


@query("a13_evidence", f"{_U} SELECT polarity, CAST(row_number() OVER (PARTITION BY polarity ORDER BY intensity DESC, unit_id) AS INTEGER) AS rank, unit_id, aspect FROM units WHERE candidate LIKE 'own%' AND polarity <> 'neutral' QUALIFY rank <= 60")
def a13(spark, d):
    return S.evidence(V.units(spark, d))


@query("a15_heat_map", f"{_U} SELECT aspect, {_SIDE} AS side, {_COUNTS}, count(*) FILTER (polarity = 'positive') - count(*) FILTER (polarity = 'negative') AS net FROM units GROUP BY aspect, side")
def a15(spark, d):
    return S.heat_map(V.units(spark, d))


_NET = f"nets AS (SELECT aspect, {_SIDE} AS side, count(*) AS n, count(*) FILTER (polarity = 'positive') - count(*) FILTER (polarity = 'negative') AS net FROM units GROUP BY ALL)"


@query("a16_weakness_rank", f"{_U}, {_NET} SELECT aspect, net, CAST(row_number() OVER (ORDER BY net, aspect) AS INTEGER) AS rank FROM nets WHERE side = 'own'")
def a16(spark, d):
    return S.weakness_rank(V.units(spark, d))


@query("a16_opportunity_rank", f"""{_U}, {_NET}, g AS (SELECT o.aspect, (c.net * o.n - o.net * c.n)::DOUBLE / (o.n * c.n) AS gap FROM nets o JOIN nets c ON o.aspect = c.aspect AND o.side = 'own' AND c.side = 'competitor')
SELECT aspect, gap, CAST(row_number() OVER (ORDER BY gap, aspect) AS INTEGER) AS rank FROM g WHERE gap < 0""")
def a16b(spark, d):
    return S.opportunity_rank(V.units(spark, d))


@query("a17_perspective_histogram", f"{_U} SELECT aspect, perspective, count(*) AS n FROM units GROUP BY ALL")
def a17(spark, d):
    return S.histogram(V.units(spark, d), "aspect", "perspective")


@query("a18_perspective_cube", f"{_U} SELECT aspect, candidate, perspective, {_COUNTS} FROM units WHERE candidate IS NOT NULL GROUP BY aspect, candidate, perspective")
def a18(spark, d):
    return S.perspective_cube(V.units(spark, d))


@query("w05_top_aspects", f"""{_U}, v AS (SELECT aspect, count(*) AS volume FROM units WHERE candidate IS NOT NULL AND aspect NOT IN ('기타', '종합') GROUP BY aspect),
r AS (SELECT *, sum(volume) OVER () AS total, count(*) OVER () AS k, sum(volume) OVER (ORDER BY volume DESC, aspect ROWS UNBOUNDED PRECEDING) AS running FROM v)
SELECT aspect, volume, CAST(running AS BIGINT) AS running FROM r WHERE volume * k >= total * 0.5 AND running - volume < total * 0.5""")
def w05(spark, d):
    return S.top_aspects(V.units(spark, d))


@query("a20_own_only_flags", f"""{_U}, facts AS (SELECT aspect, CASE WHEN candidate LIKE 'own%' THEN 'own' ELSE candidate END AS who, {_COUNTS} FROM units WHERE candidate IS NOT NULL GROUP BY aspect, who HAVING count(*) >= 4),
long AS (SELECT aspect, who, 'negative' AS flag, neg::DOUBLE / n AS rate FROM facts UNION ALL SELECT aspect, who, 'positive', pos::DOUBLE / n FROM facts)
SELECT o.aspect, o.flag, o.rate AS own_rate, r.rate AS rival_rate FROM (SELECT * FROM long WHERE who = 'own') o
JOIN (SELECT aspect, flag, max(rate) AS rate FROM long WHERE who <> 'own' GROUP BY ALL) r USING (aspect, flag) WHERE o.rate >= 0.2 AND o.rate - r.rate >= -0.1""")
def a20(spark, d):
    return S.own_only_flags(V.units(spark, d), 0.2, -0.1)


@query("a21_card_stats", f"""{_U}, own AS (SELECT aspect, {_COUNTS} FROM units WHERE candidate LIKE 'own%' GROUP BY aspect),
top AS (SELECT aspect, perspective AS top_perspective FROM units WHERE candidate LIKE 'own%' GROUP BY aspect, perspective QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY count(*) DESC, perspective) = 1),
rival AS (SELECT aspect, count(*) AS rival_n, count(*) FILTER (polarity = 'negative') AS rival_neg FROM units WHERE candidate NOT LIKE 'own%' GROUP BY aspect)
SELECT * FROM own LEFT JOIN top USING (aspect) LEFT JOIN rival USING (aspect)""")
def a21(spark, d):
    return S.card_stats(V.units(spark, d))


@query("a22_channel_detail", f"""{_Q}, u AS (SELECT candidate, count(DISTINCT source_url) FILTER (channel = 'youtube') AS videos, count(DISTINCT source_url) FILTER (channel <> 'youtube') AS posts, count(*) AS units FROM units WHERE candidate IS NOT NULL GROUP BY candidate),
q AS (SELECT candidate, count(*) AS questions FROM questions WHERE candidate IS NOT NULL GROUP BY candidate)
SELECT candidate, coalesce(videos, 0) AS videos, coalesce(posts, 0) AS posts, coalesce(units, 0) AS units, coalesce(questions, 0) AS questions FROM u FULL JOIN q USING (candidate)""")
def a22(spark, d):
    return S.channel_detail(V.units(spark, d), V.questions(spark, d))


@query("a24_question_shares", f"{_Q} SELECT question_type, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM questions WHERE candidate LIKE 'own%' GROUP BY question_type")
def a24(spark, d):
    return S.shares(V.questions(spark, d).where(S.is_own()), "question_type")


@query("a25_question_overview", f"{_Q} SELECT aspect, count(*) AS n FROM questions GROUP BY aspect ORDER BY n DESC, aspect LIMIT 6")
def a25(spark, d):
    return S.top_values(V.questions(spark, d), "aspect", 6)


@query("a26_distinct_terms", f"{_U} SELECT quote AS term, count(*) AS n FROM units GROUP BY quote")
def a26(spark, d):
    return S.histogram(V.units(spark, d).withColumnRenamed("quote", "term"), "term")


@query("a27_cross_tab", f"""{_Q}, u AS (SELECT aspect, {_COUNTS} FROM units GROUP BY aspect), q AS (SELECT aspect, count(*) AS questions FROM questions GROUP BY aspect)
SELECT aspect, coalesce(n, 0) AS n, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(neu, 0) AS neu, coalesce(questions, 0) AS questions FROM u FULL JOIN q USING (aspect)""")
def a27(spark, d):
    return S.cross_tab(V.units(spark, d), V.questions(spark, d))


@query("a28_timeline", f"{_U} SELECT candidate, substring(posted_at, 1, 7) AS month, {_COUNTS}, CAST(sum({_SIGN}) AS BIGINT) AS signed, sum({_SIGN})::DOUBLE / count(*) AS mean_sign FROM units WHERE candidate IS NOT NULL GROUP BY candidate, month")
def a28(spark, d):
    return S.timeline(V.units(spark, d))


@query("a29_rubric_reaction", f"{_U} SELECT count(*) AS n, count(*) FILTER (length(posted_at) > 0) AS dated, CAST(CASE WHEN count(*) = 0 THEN 2 WHEN count(DISTINCT channel) < 2 THEN 3 ELSE 5 END AS INTEGER) AS score FROM units")
def a29(spark, d):
    units = V.units(spark, d)
    return S.rubric_reaction(units, units.where("intensity = 3"))


@query("a53_shares", f"{_U} SELECT aspect, perspective, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY aspect) AS share FROM units GROUP BY aspect, perspective")
def a53(spark, d):
    return S.shares(V.units(spark, d), "perspective", "aspect")


@query("a54_caption", f"""{_U}, o AS (SELECT perspective, count(*) AS own_n FROM units WHERE candidate LIKE 'own%' GROUP BY ALL), a AS (SELECT perspective, count(*) AS all_n FROM units GROUP BY ALL),
r AS (SELECT *, CAST(sum(own_n) OVER () AS BIGINT) AS own_total, CAST(sum(own_n) OVER (ORDER BY own_n DESC, perspective ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, (SELECT count(*) FROM units) AS all_total FROM o JOIN a USING (perspective))
SELECT *, own_n::DOUBLE / own_total - all_n::DOUBLE / all_total AS bias FROM r WHERE running - own_n < own_total * 0.5""")
def a54(spark, d):
    return S.caption(V.units(spark, d), "perspective")


@query("a55_question_scatter", f"""{_Q}, t AS (SELECT aspect, count(*) AS questions FROM questions GROUP BY aspect ORDER BY questions DESC, aspect LIMIT 6), u AS (SELECT aspect, count(*) AS units, count(*) FILTER (polarity = 'negative') AS neg FROM units GROUP BY aspect)
SELECT *, neg::DOUBLE / units AS negative_rate FROM t LEFT JOIN u USING (aspect)""")
def a55(spark, d):
    return S.question_scatter(V.units(spark, d), V.questions(spark, d))


@query("a57_takeaways", f"""{_U}, f AS (SELECT aspect, candidate, count(*) AS n, {_PARTS}, {_INDEX} FROM units WHERE candidate IS NOT NULL GROUP BY aspect, candidate),
r AS (SELECT aspect, sum(CAST(trunc(num * 1000000.0::DOUBLE / den) AS BIGINT))::DOUBLE / count(*) / 1000000 AS ri FROM f WHERE candidate NOT LIKE 'own%' GROUP BY aspect),
g AS (SELECT aspect, n AS own_n, index - ri AS gap FROM f JOIN r USING (aspect) WHERE candidate LIKE 'own%')
SELECT aspect, own_n, gap, CASE WHEN gap > 0.15 THEN 'ahead' WHEN gap < -0.15 THEN 'behind' ELSE 'level' END AS zone, own_n * greatest(abs(gap), 0.01) AS importance FROM g""")
def a57(spark, d):
    return S.takeaways(V.units(spark, d))


@query("a58_perspective_own", f"{_U} SELECT perspective, count(*) AS n FROM units WHERE candidate LIKE 'own%' GROUP BY perspective")
def a58(spark, d):
    return S.perspective_own(V.units(spark, d))


_SCORE = "intensity + CASE WHEN channel = 'youtube' THEN 1.0 ELSE 0.9 END::DOUBLE * 0.5 + 1 + CASE WHEN length(trim(quote)) < 15 THEN -1.0 WHEN length(trim(quote)) > 220 THEN -0.5 ELSE 1.0 END::DOUBLE * 0.5"
_POLAR = "units WHERE candidate IS NOT NULL AND polarity <> 'neutral'"


@query("w01_top_quotes", f"""{_U}, s AS (SELECT *, {_SCORE} AS score, quote AS masked, substring(regexp_replace(lower(quote), '[^0-9a-z가-힣]', '', 'g'), 1, 40) AS key FROM {_POLAR}),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY aspect, candidate, polarity, key ORDER BY score DESC, masked, unit_id) = 1)
SELECT aspect, candidate, polarity, CAST(row_number() OVER (PARTITION BY aspect, candidate, polarity ORDER BY score DESC, masked, unit_id) AS INTEGER) AS rank, unit_id, round(score * 100)::BIGINT AS score, masked FROM o QUALIFY rank <= 3""")
def w01(spark, d):
    return Q.top_quotes(V.units(spark, d)).withColumn("score", F.round(F.col("score") * 100).cast("long"))


@query("w02_representative_quotes", f"""{_U}, s AS (SELECT *, {_SCORE} AS score FROM {_POLAR}),
dom AS (SELECT aspect, candidate, polarity, perspective AS dominant FROM s GROUP BY aspect, candidate, polarity, perspective QUALIFY row_number() OVER (PARTITION BY aspect, candidate, polarity ORDER BY count(*) DESC, perspective) = 1)
SELECT aspect, candidate, polarity, CAST(row_number() OVER (PARTITION BY aspect, candidate, polarity ORDER BY perspective <> dominant, score DESC, unit_id) AS INTEGER) AS rank, unit_id, dominant FROM s JOIN dom USING (aspect, candidate, polarity) QUALIFY rank <= 3""")
def w02(spark, d):
    return Q.representative_quotes(V.units(spark, d))


@query("w03_suggestions", f"""{_U}, s AS (SELECT *, {_SCORE} AS score FROM units WHERE candidate IS NOT NULL AND unit_id % 4 = 0)
SELECT candidate, aspect, CAST(row_number() OVER (PARTITION BY candidate, aspect ORDER BY score DESC, quote, unit_id) AS INTEGER) AS rank, unit_id FROM s QUALIFY rank <= 3""")
def w03(spark, d):
    return Q.suggestions(V.units(spark, d).withColumn("is_suggestion", F.col("unit_id") % 4 == 0))


@query("w07_positional_ids", f"{_U} SELECT unit_id, printf('u%03d', row_number() OVER (ORDER BY unit_id) - 1) AS position_id FROM units")
def w07(spark, d):
    return Q.positional_ids(V.units(spark, d), ["unit_id"], bucket_rows=1000).select("unit_id", "position_id")


@query("x03_resolved_evidence", f"""{_U}, known AS (SELECT unit_id FROM units WHERE candidate LIKE 'own%' AND polarity = 'negative'),
claims AS (SELECT unit_id, 'k' || (unit_id % 5) AS cluster, intensity AS pos FROM units WHERE unit_id % 3 = 0 UNION ALL SELECT unit_id, 'z', 9 FROM units WHERE unit_id % 6 = 0),
once AS (SELECT unit_id, cluster FROM claims WHERE unit_id IN (SELECT unit_id FROM known) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY pos) = 1)
SELECT * FROM once UNION ALL SELECT unit_id, 'unclassified' FROM known WHERE unit_id NOT IN (SELECT unit_id FROM once)""")
def x03(spark, d):
    units = V.units(spark, d)
    a = units.where("unit_id % 3 = 0").select("unit_id", F.concat(F.lit("k"), F.col("unit_id") % 5).alias("cluster"), F.col("intensity").alias("pos"))
    b = units.where("unit_id % 6 = 0").select("unit_id", F.lit("z").alias("cluster"), F.lit(9).alias("pos"))
    return Q.resolved_evidence(a.unionByName(b), units.where(S.is_own() & (F.col("polarity") == "negative")))


@query("h09_quote_score", f"{_U} SELECT unit_id, round(({_SCORE}) * 100)::BIGINT AS score FROM units")
def h09(spark, d):
    return V.units(spark, d).select("unit_id", F.round(X.quote_score("quote", "intensity", "channel") * 100).cast("long").alias("score"))


@query("u20_question_types", f"{_Q} SELECT question_id, CASE WHEN contains(quote, 'thand') OR contains(quote, 'queo') THEN 'cost' WHEN contains(quote, 'ingth') THEN 'method' ELSE 'other' END AS question_type FROM questions")
def u20(spark, d):
    return V.questions(spark, d).select("question_id", X.question_type("quote", (("cost", ("thand", "queo")), ("method", ("ingth",)))).alias("question_type"))


@query("a02_question_side", f"{_Q} SELECT {_SIDE} AS side, count(*) AS n FROM questions GROUP BY 1")
def j07(spark, d):
    return V.questions(spark, d).groupBy(S.side().alias("side")).agg(F.count("*").alias("n"))


