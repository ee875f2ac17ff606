"""Registered queries on the text functions, over remarks in the languages that the fixed patterns know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from . import views as V
from .registry import Registry, listed, quoted

query = Registry()

#: Remarks of every kind that the patterns tell apart, and some that they must leave alone.
REMARKS = (
    "ㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋ", "ㅠㅠ 12!!", "좋아요!!", "굿", "최고예요~", "영상 너무 잘 봤습니다 감사합니다", "편집 최고 진짜로 최고", "3 등!!", "환율 우대가 좋아서 계속 쓰고 있습니다", "해외에서 결제가 안 되는데 이유가 뭔가요?",
    "환전 수수료는 얼마인가요", "수수료가 3% 라서 다른 카드보다 10원 싸요", "좋아요. 그런데 환율 우대 되나요?", "되나요? 정말요?", "시발 환전 수수료가 너무 비싸서 존나 짜증", "What the Fuck is this fee, shit", "시발 ㅋㅋㅋㅋㅋㅋㅋㅋㅋ!",
    "https://example.com/a?b=1 https://example.org/c 참고하세요", "문의는 카톡 주세요 010-1234-5678", "[링크]\nExample title\nwww.example.com\n본문은 여기", "12\n34\n닉네임\n첫 줄입니다\n둘째 줄입니다\n2024-01-02", "7\n닉네임", "# 제목 줄\n본문 줄",
    "\n\n  둘째 줄이 제목  \n셋째", "", "   ", "The new update made the app slower than before because of the login", "Is it 5% cheaper? Why!", "라운지 혜택 때문에 마일리지 카드 보다 이 카드", "404 Not Found\nthe page is gone", "로그인이 필요 합니다", "Access denied",
    "Samsung Pay / Apple-Pay (2024) {beta}", "own_toss", "9 lives, and more", "!!", "토스 트래블카드 2", "KB국민카드 · 신한 SOL", "이 카드 아닌가요", "아 시 발 ㅋㅋ ㅎㅎ 12", "미쳤다!!", "맞나요? 하나요 될까요", "분실 신고는 어떻게 하나요 방법이 있나요", "앱 오류로 로그인 안돼서 문제",
)


#: Where the ids of texts as they were said, and of documents, begin: beyond those of remarks.
_SAID, _WHOLE = 10**14, 10**15


def remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remark for each turn of a conversation, and the texts of conversations and documents whole: id, text, title, other (another text, null for some)."""
    c, d = V.read(spark, sf_dir, "conversations"), V.read(spark, sf_dir, "documents")
    pick = lambda at: F.get(F.array(*[F.lit(r) for r in REMARKS]), (at % len(REMARKS)).cast("int"))
    k = F.col("conv_id") * 5 + F.col("turn")
    said = c.select((_SAID + F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("title"), F.lit(None).cast("string").alias("other"))
    whole = d.select((_WHOLE + F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("title"), F.concat_ws(" ", "lang", "source").alias("other"))
    made = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(pick(k), F.when(F.col("conv_id") % 4 == 3, F.concat(F.lit(" "), F.col("conv_id").cast("string"))).otherwise("")).alias("text"), F.col("role").alias("title"), F.when(k % 7 > 0, pick(k * 3 + 1)).alias("other"))
    return made.union(said).union(whole)


REMARKS_SQL = f"""
remarks AS (
  SELECT conv_id * 100 + turn AS id, {listed(REMARKS)}[CAST((conv_id * 5 + turn) % {len(REMARKS)} AS INTEGER) + 1] || CASE WHEN conv_id % 4 = 3 THEN ' ' || conv_id ELSE '' END AS text, role AS title,
    CASE WHEN (conv_id * 5 + turn) % 7 > 0 THEN {listed(REMARKS)}[CAST(((conv_id * 5 + turn) * 3 + 1) % {len(REMARKS)} AS INTEGER) + 1] END AS other
  FROM conversations
  UNION ALL SELECT {_SAID} + conv_id * 100 + turn, coalesce(text, ''), coalesce(role, ''), NULL FROM conversations
  UNION ALL SELECT {_WHOLE} + doc_id, coalesce(text, ''), coalesce(source, ''), concat_ws(' ', lang, source) FROM documents)"""

_R = f"WITH {REMARKS_SQL}"
_TRIM = "trim(text)"
_ANY = lambda column, words: "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"

#: The fixed comment predicates on a column, for the SQL of other queries too.
NOISE_SQL = lambda t: f"(regexp_matches({t}, {quoted(L.PURE_FILLER)}) OR (length({t}) < 30 AND (" + " OR ".join(f"regexp_matches({t}, {quoted(p)})" for p in L.NOISE_SHORT) + ")))"
FILLER_SQL = lambda t: f"(length(regexp_replace(regexp_replace(regexp_replace({t}, {quoted(L.EXPLETIVE)}, '', 'g'), {quoted(L.LAUGHTER)}, '', 'g'), '[^0-9A-Za-z가-힣]', '', 'g')) < 2)"
DROP_SQL = lambda t: f"CASE WHEN length({t}) < 10 OR NOT regexp_matches({t}, '[0-9A-Za-z가-힣]') THEN 'drop_short' WHEN {NOISE_SQL(t)} OR {FILLER_SQL(t)} THEN 'drop_noise' END"
ASK_SQL = lambda t: (
    f"(length({t}) <= 100 AND regexp_matches({t}, {quoted(L.QUESTION_END)}) AND NOT coalesce(list_bool_or(list_transform(list_filter(list_transform(string_split_regex({t}, {quoted(L.SENTENCE_SPLIT)}), lambda s: trim(s)), lambda s: s <> ''),"
    f" lambda s: NOT regexp_matches(s, {quoted(L.QUESTION_END)}))), false))"
)
_KEYS = ("환율", "수수료", "환전 수수료", "fee", "카드", "혜택")


def each(name: str, column, sql: str, field: str = "value", cast: str = ""):
    """A query that gives a column of every remark."""

    def run(spark, d):
        c = column()
        return remarks(spark, d).select("id", (c.cast(cast) if cast else c).alias(field))

    query(name, f"{_R} SELECT id, {sql} AS {field} FROM remarks")(run)


each("f01_basic_drop", lambda: X.basic_drop("text"), DROP_SQL(_TRIM))
each("f02_noise", lambda: X.is_noise("text"), NOISE_SQL(_TRIM))
each("f03_filler", lambda: X.is_filler("text"), FILLER_SQL("text"))
each("f04_has_any", lambda: X.has_any("text", _KEYS), _ANY("text", _KEYS))
each("f05_first_keyword", lambda: X.first_keyword("text", _KEYS), "CASE WHEN contains(text, '환전 수수료') THEN '환전 수수료' WHEN contains(text, 'fee') THEN 'fee' WHEN contains(text, '수수료') THEN '수수료' WHEN contains(text, '카드') THEN '카드' WHEN contains(text, '혜택') THEN '혜택' WHEN contains(text, '환율') THEN '환율' ELSE '' END")
each("f06_pure_question", lambda: X.is_pure_question("text"), ASK_SQL(_TRIM))
each("f10_auto_drop", lambda: X.auto_drop("text", L.ALL_KEYWORDS), f"length(text) < 40 AND NOT {_ANY('text', L.ALL_KEYWORDS)}")
each("f11_relevance_gate", lambda: X.relevance_gate("title", "other", ["카드", "Fee"]), "CASE WHEN trim(title || ' ' || coalesce(other, '')) = '' THEN 'unknown' WHEN contains(lower(title || ' ' || coalesce(other, '')), '카드') OR contains(lower(title || ' ' || coalesce(other, '')), 'fee') THEN 'relevant' ELSE 'irrelevant' END")
each("f15_snippet_relevance", lambda: X.passes_tokens("title", "text", ["user", "카드"]), "contains(lower(title || ' ' || text), 'user') OR contains(lower(title || ' ' || text), '카드')")
each("f16_filter_tokens", lambda: F.array_join(X.filter_tokens("text", ["the", "카드"]), "|"), "")
each("f41_contaminated", lambda: X.contaminated("text"), r"regexp_matches(substring(text, 1, 200), '(?i)^\s*(?:error|404|403|access denied|not found|로그인이 필요)')")
each("h01_squeezed", lambda: X.squeezed("text"), r"regexp_replace(text, '\s+', '', 'g')")
each("h02_letters_and_digits", lambda: X.letters_and_digits("other"), "regexp_replace(lower(coalesce(other, '')), '[^0-9a-z가-힣]', '', 'g')")
each("h04_with_prefix", lambda: X.with_prefix("text", F.lit("own")), "CASE WHEN starts_with(text, 'own_') THEN text ELSE 'own_' || text END")
each("h05_snake_id", lambda: X.snake_id("text"), "CASE WHEN regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'unknown' WHEN regexp_matches(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '^[0-9]') THEN 'n_' || regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') ELSE regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END")
each("h07_substance", lambda: X.substance("text"), " + ".join(f"CAST(regexp_matches(text, {quoted(p)}) AS INTEGER)" for p in L.SUBSTANCE), cast="int")
each("h08_length_score", lambda: X.length_score("text"), "CASE WHEN length(trim(text)) < 15 THEN -1.0::DOUBLE WHEN length(trim(text)) > 220 THEN -0.5::DOUBLE ELSE 1.0::DOUBLE END")
each("h10_links_marked", lambda: X.links_marked("text"), r"regexp_replace(regexp_replace(text, 'https?://\S+', '[링크]', 'g'), '(?:\[링크\]\s*){2,}', '[링크] ', 'g')")
each("h11_embed_cards", lambda: X.without_embed_cards("text"), f"regexp_replace(text, {quoted(L.EMBED_CARD)}, '[링크]' || chr(10), 'g')")
each("h15_title", lambda: X.title_of("text"), "coalesce(regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '^[# ]+', ''), '')")
each("h22_substituted", lambda: X.substituted(F.lit("{a} about  {b}"), {"a": "title", "b": "other"}), "trim(regexp_replace(replace(replace('{a} about  {b}', '{a}', title), '{b}', coalesce(other, '')), ' +', ' ', 'g'))")
each("h25_tokens", lambda: F.array_join(F.array_sort(X.tokens("text", 2, ["pay"])), "|"), f"array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), {quoted(L.LABEL_SPLIT)}), lambda t: length(t) >= 2 AND t <> 'pay'))), '|')")
each("h27_label_pool", lambda: F.size(X.tokens("text", 1)), f"len(list_distinct(list_filter(string_split_regex(lower(text), {quoted(L.LABEL_SPLIT)}), lambda t: length(t) >= 1)))", cast="long")
each("h31_keyword_score", lambda: X.keyword_score("text", ["카드", "FEE", "환율"]), "CAST(contains(lower(text), '카드') AS INTEGER) + CAST(contains(lower(text), 'fee') AS INTEGER) + CAST(contains(lower(text), '환율') AS INTEGER)")
each("h33_fingerprint", lambda: X.fingerprint_of(F.split("text", " ")), "sha256(array_to_string(list_sort(list_distinct(string_split(text, ' '))), chr(31)))")
each("h35_fallback", lambda: X.fallback("other", "text", "title"), "coalesce(nullif(other, ''), nullif(text, ''), nullif(title, ''), '')")
each("h40_label_keywords", lambda: F.array_join(F.slice(X.tokens("text"), 1, 3), "|"), "")
each("f40_post_status", lambda: X.post_status("text", "title", F.when(F.col("id") % 5 == 0, "fetch_failed").otherwise("ok")), r"CASE WHEN id % 5 = 0 THEN 'fetch_failed' WHEN length(trim(regexp_replace(regexp_replace(CASE WHEN starts_with(text, title) THEN substring(text, length(title) + 1) ELSE text END, '<[^>]+>|https?://\S+|\[링크\]', '', 'g'), '\s+', ' ', 'g'))) = 0 THEN 'empty_body' WHEN length(trim(regexp_replace(regexp_replace(CASE WHEN starts_with(text, title) THEN substring(text, length(title) + 1) ELSE text END, '<[^>]+>|https?://\S+|\[링크\]', '', 'g'), '\s+', ' ', 'g'))) < 20 THEN 'snippet_only' ELSE 'ok' END")
each("f49_failure_class", lambda: X.failure_class(F.concat("text", F.get(F.array(*[F.lit(x) for x in (" Timed Out", " HTTP 429", " schema mismatch", "")]), (F.col("id") % 4).cast("int")))), "CASE WHEN id % 4 = 0 OR regexp_matches(lower(text), 'timeout|timed out') THEN 'timeout' WHEN id % 4 = 1 OR regexp_matches(lower(text), 'quota|rate limit|429') THEN 'quota' WHEN id % 4 = 2 OR regexp_matches(lower(text), 'schema|json|validat') THEN 'schema' ELSE 'other' END")
each("f58_fetch_class", lambda: X.fetch_class((F.lit(200) + F.col("id") % 6 * 41 + F.when(F.col("id") % 11 == 0, 39).otherwise(0)).cast("int"), "text"), "CASE WHEN s IN (404, 410) THEN 'deleted' WHEN s IN (401, 403, 429) THEN 'blocked' WHEN s >= 400 THEN 'http_error' WHEN regexp_matches(lower(text), 'captcha|challenge|just a moment') THEN 'challenge' WHEN length(trim(text)) < 50 THEN 'extract_failed' ELSE 'recoverable' END")
# words in the order in which they come first: a row a word, as whole texts hold thousands
_FIRSTS = lambda words, keep, most: f"""{_R}, l AS (SELECT id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT id, {words} AS x FROM remarks)), m AS (SELECT id, w, min(i) AS i FROM l WHERE {keep} GROUP BY id, w),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS rn FROM m) SELECT r.id, coalesce(string_agg(w, '|' ORDER BY i), '') AS value FROM remarks r LEFT JOIN n ON n.id = r.id AND {most} GROUP BY r.id"""  # noqa: E731
query.sql["f16_filter_tokens"] = _FIRSTS("regexp_extract_all(lower(text), '[a-z가-힣]{2,}')", "w NOT IN ('the', '카드')", "true")
query.sql["h40_label_keywords"] = _FIRSTS(f"string_split_regex(lower(text), {quoted(L.LABEL_SPLIT)})", "length(w) >= 2", "rn <= 3")
query.sql["f58_fetch_class"] = query.sql["f58_fetch_class"].replace("FROM remarks", "FROM (SELECT *, 200 + id % 6 * 41 + CASE WHEN id % 11 = 0 THEN 39 ELSE 0 END AS s FROM remarks)")

# a dictionary word at a time, each in what the words before have left
_STEPS = ", ".join(f"regexp_replace(t{i}, {quoted('(?i)' + w)}, {quoted(w[0] + '*' * (len(w) - 1))}, 'g') AS t{i + 1}" for i, w in enumerate(L.PROFANITY))
_HITS = " + ".join(f"len(regexp_extract_all(t{i}, {quoted('(?i)' + w)}))" for i, w in enumerate(L.PROFANITY))


@query("h06_masked", f"{_R} SELECT id, t{len(L.PROFANITY)} AS masked, CAST({_HITS} AS INTEGER) AS hits FROM (SELECT id, text AS t0, {_STEPS} FROM remarks)")
def h06(spark, d):
    return remarks(spark, d).select("id", X.masked("text").alias("masked"), X.profanity_hits("text").alias("hits"))


@query("h13_clean_comment", f"""{_R}, l AS (SELECT id, text, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS x FROM remarks),
m AS (SELECT *, list_position(list_transform(x, lambda y: NOT regexp_matches(y, '^[0-9]+$')), true) AS a, len(x) + 1 - list_position(list_reverse(list_transform(x, lambda y: NOT regexp_matches(y, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'))), true) AS b FROM l)
SELECT id, CASE WHEN len(x) >= 3 AND regexp_matches(x[1], '^[0-9]+$') THEN trim(array_to_string(list_filter(list_slice(x, a + 1, b), lambda y: y <> ''), ' ')) ELSE trim(text) END AS value FROM m""")
def h13(spark, d):
    return remarks(spark, d).select("id", X.clean_comment("text").alias("value"))


@query("h23_site_filter", "SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'site:' || lower(n_name) ELSE '(site:' || lower(n_name) || ' OR site:b.com)' END AS value FROM nation")
def h23(spark, d):
    name = F.lower("n_name")
    domains = F.when(F.col("n_nationkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("n_nationkey") % 3 == 1, F.array(name)).otherwise(F.array(name, F.lit("b.com")))
    return V.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), X.site_filter(domains).alias("value"))


@query("h28_iso_time", """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'some day' ELSE strftime(date_trunc('second', ts) - CASE WHEN event_id % 5 = 3 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM events""")
def h28(spark, d):
    at = F.col("ts").cast("timestamp")
    shown = lambda f: F.date_format(at, f)
    text = (
        F.when(F.col("event_id") % 5 == 0, shown("EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(F.col("event_id") % 5 == 1, shown("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 5 == 2, shown("yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 5 == 3, shown("EEE, dd MMM yyyy HH:mm:ss '+0900'")).otherwise("some day")
    )
    return V.read(spark, d, "events").select("event_id", X.iso_time(text).alias("at"))


@query("h29_month_window", "SELECT o_orderkey, array_to_string(list_transform(range(1, 4), lambda k: strftime(date_trunc('month', o_orderdate) - to_months(CAST(3 - k AS INTEGER)), '%Y-%m')), ',') AS months, strftime(date_trunc('week', o_orderdate::TIMESTAMP + INTERVAL 3 HOUR - INTERVAL 5 HOUR) + INTERVAL 5 HOUR, '%Y-%m-%d %H') AS week FROM orders")
def h29(spark, d):
    at = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 3 HOURS")
    return V.read(spark, d, "orders").select("o_orderkey", F.array_join(X.month_window(3, F.col("o_orderdate").cast("date")), ",").alias("months"), F.date_format(X.week_start(at), "yyyy-MM-dd HH").alias("week"))


@query("f23_recent", "SELECT o_orderkey, o_orderkey % 5 = 0 OR o_orderdate >= DATE '1998-08-01' - INTERVAL 360 DAY AS recent FROM orders")
def f23(spark, d):
    written = F.when(F.col("o_orderkey") % 5 == 0, "unclear").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return V.read(spark, d, "orders").select("o_orderkey", X.is_recent(written, F.lit("1998-08-01").cast("timestamp"), 12).alias("recent"))


@query("f47_expired", "SELECT o_orderkey, o_orderkey % 7 = 0 OR o_orderdate::TIMESTAMP + INTERVAL 48 HOUR < TIMESTAMP '1996-01-01' AS expired FROM orders")
def f47(spark, d):
    written = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate").cast("timestamp"))
    return V.read(spark, d, "orders").select("o_orderkey", X.expired(written, F.lit("1996-01-01").cast("timestamp"), 48).alias("expired"))


@query("h41_cache_key", "SELECT n_nationkey, sha256('{\"k0\":\"agent\",\"k1\":\"' || n_name || '\",\"k2\":\"\"}') AS cache_key FROM nation")
def h41(spark, d):
    return V.read(spark, d, "nation").select("n_nationkey", X.canonical_key(F.lit("agent"), "n_name", F.lit(None).cast("string")).alias("cache_key"))
