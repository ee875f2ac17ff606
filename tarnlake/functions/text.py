"""Text as Column expressions: normal forms, cleaning, comment predicates and scores.

All take a Column (or a column's name) and parameters; null texts count as empty unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

Text = Column | str


def _c(text: Text) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if list(values) else F.array().cast("array<string>")


# normal forms


def squeezed(text: Text) -> Column:
    """Without white space."""
    return F.regexp_replace(_c(text), r"\s+", "")


def letters_and_digits(text: Text) -> Column:
    """Lower-cased digits, Latin letters and Hangul only."""
    return F.regexp_replace(F.lower(_c(text)), "[^0-9a-z가-힣]", "")


def composed_form(text: Column) -> Column:
    """Unicode NFC, for which Spark has no function."""

    @F.pandas_udf("string")
    def nfc(texts):
        return texts.str.normalize("NFC")

    return nfc(text)


def slug(name: Text, composed: bool = True) -> Column:
    """Slug of a name. Names that are not `composed` (NFC) already are composed by a small UDF first."""
    c = _c(name) if composed else composed_form(_c(name))
    return F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^가-힣a-z0-9]", "")


def with_prefix(name: Text, role: Text) -> Column:
    """role_ before a slug, unless it is there already."""
    c, prefix = _c(name), F.concat(_c(role), F.lit("_"))
    return F.when(c.startswith(prefix), c).otherwise(F.concat(prefix, c))


def snake_id(text: Text, fallback: str = "unknown") -> Column:
    """snake_case identifier; runs of other characters become one underscore, none at the ends."""
    c = F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(c == "", fallback).when(c.rlike("^[0-9]"), F.concat(F.lit("n_"), c)).otherwise(c)


def tokens(text: Text, least: int = 2, without: Iterable[str] = ()) -> Column:
    """Distinct lower-cased tokens of at least `least` characters, less a stop list."""
    parts = F.filter(F.split(F.lower(_c(text)), L.LABEL_SPLIT), lambda t: F.length(t) >= least)
    return F.array_except(F.array_distinct(parts), words(without))


def filter_tokens(text: Text, stop: Iterable[str] = ()) -> Column:
    """F16: words of a text that hold no digit, less a stop list."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z가-힣]{2,}"), 0)
    return F.array_except(F.array_distinct(found), words(stop))


# keywords


def has_any(text: Text, keywords: Column | Iterable[str]) -> Column:
    """the text holds one of the keywords."""
    c = _c(text)
    if isinstance(keywords, Column):
        return F.exists(keywords, lambda k: c.contains(k))
    found = F.lit(False)
    for k in keywords:
        found = found | c.contains(k)
    return found


def first_keyword(text: Text, keywords: Iterable[str]) -> Column:
    """the longest keyword that occurs, of equally long ones the first by name; empty where none does."""
    c = _c(text)
    return F.coalesce(*[F.when(c.contains(k), F.lit(k)) for k in sorted(set(keywords), key=lambda k: (-len(k), k))], F.lit(""))


def keyword_score(text: Text, keywords: Iterable[str]) -> Column:
    """How many keywords occur, case aside."""
    c = F.lower(_c(text))
    score = F.lit(0)
    for k in keywords:
        score = score + c.contains(k.lower()).cast("int")
    return score


def first_match(text: Text, rules: Iterable[tuple[str, Iterable[str]]], otherwise: str) -> Column:
    """The first rule one of whose words occurs in the text."""
    c = F.lit(None).cast("string")
    return F.coalesce(c, *[F.when(has_any(text, ws), F.lit(name)) for name, ws in rules], F.lit(otherwise))


# comments


def is_filler(text: Text) -> Column:
    """fewer than two letters or digits are left without expletives, laughter and symbols."""
    rest = F.regexp_replace(F.regexp_replace(_c(text), L.EXPLETIVE, ""), L.LAUGHTER, "")
    return F.length(F.regexp_replace(rest, "[^0-9A-Za-z가-힣]", "")) < 2


def is_noise(text: Text, patterns: Iterable[str] = L.NOISE_SHORT, filler: str = L.PURE_FILLER, short: int = 30) -> Column:
    """nothing but filler, or a short text that one of the patterns matches."""
    c = F.trim(_c(text))
    match = F.lit(False)
    for p in patterns:
        match = match | c.rlike(p)
    return c.rlike(filler) | ((F.length(c) < short) & match)


def basic_drop(text: Text, least: int = L.MIN_COMMENT_CHARS) -> Column:
    """drop_short, drop_noise or null for the trimmed text."""
    c = F.trim(_c(text))
    return F.when((F.length(c) < least) | ~c.rlike(L.HAS_CONTENT), "drop_short").when(is_noise(c) | is_filler(c), "drop_noise")


def is_pure_question(text: Text, most: int = L.QUESTION_MAX_CHARS, ending: str = L.QUESTION_END) -> Column:
    """at most `most` characters, and every sentence ends like a question."""
    c = F.trim(_c(text))
    sentences = F.filter(F.transform(F.split(c, L.SENTENCE_SPLIT), lambda s: F.trim(s)), lambda s: s != "")
    return (F.length(c) <= most) & c.rlike(ending) & F.forall(sentences, lambda s: s.rlike(ending))


def question_type(text: Text, rules=L.QUESTION_RULES) -> Column:
    """Stand-in classifier of questions by words."""
    return first_match(text, rules, "other")


def auto_drop(joined: Text, keywords: Iterable[str], most: int = 40) -> Column:
    """a thread's joined text is shorter than `most` and holds no keyword."""
    return (F.length(_c(joined)) < most) & ~has_any(joined, keywords)


def relevance_gate(title: Text, description: Text, signals: Iterable[str]) -> Column:
    """Unknown without text, else relevant if a signal occurs, else irrelevant."""
    blob = F.lower(F.concat_ws(" ", _c(title), _c(description)))
    return F.when(F.trim(blob) == "", "unknown").when(has_any(blob, [s.lower() for s in signals]), "relevant").otherwise("irrelevant")


def passes_tokens(title: Text, snippet: Text, wanted: Iterable[str]) -> Column:
    """any token occurs; without tokens all pass."""
    wanted = list(wanted)
    return has_any(F.lower(F.concat_ws(" ", _c(title), _c(snippet))), wanted) if wanted else F.lit(True)


def confirms(text: Text) -> Column:
    """Asks for a confirmation; a lower bound, as only these forms count."""
    return _c(text).rlike(L.CONFIRM_REQUEST)


# quotes


def _censored(text: Text, dictionary: Iterable[str]) -> Column:
    """(text, hits) after each dictionary word in turn is cut to its first character and stars, case aside."""
    c, ws = _c(text), list(dictionary)
    pairs = F.array(*[F.struct(F.lit(f"(?i){w}").alias("word"), F.lit(w[0] + "*" * (len(w) - 1)).alias("stars")) for w in ws])
    start = F.struct(c.alias("text"), F.lit(0).alias("hits"))
    step = lambda s, w: F.struct(F.regexp_replace(s["text"], w["word"], w["stars"]).alias("text"), (s["hits"] + F.regexp_count(s["text"], w["word"])).alias("hits"))
    return F.when(c.rlike("(?i)" + "|".join(ws)), F.aggregate(pairs, start, step)).otherwise(start)


def profanity_hits(text: Text, dictionary: Iterable[str] = L.PROFANITY) -> Column:
    """Occurrences of dictionary words, each counted in what the words before have left."""
    return _censored(text, dictionary)["hits"]


def masked(text: Text, dictionary: Iterable[str] = L.PROFANITY) -> Column:
    """Dictionary words cut to their first character and stars, in the order of the dictionary."""
    return _censored(text, dictionary)["text"]


def substance(text: Text, patterns: Iterable[str] = L.SUBSTANCE) -> Column:
    """How many of the patterns match."""
    return sum((_c(text).rlike(p).cast("int") for p in patterns), F.lit(0))


def length_score(text: Text) -> Column:
    """-1 under 15 characters, -0.5 over 220, else 1."""
    n = F.length(F.trim(_c(text)))
    return F.when(n < 15, -1.0).when(n > 220, -0.5).otherwise(1.0)


def channel_weight(channel: Text, weights: Mapping[str, float] = L.CHANNEL_WEIGHTS) -> Column:
    c = _c(channel)
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in weights.items()], F.lit(1.0))


def quote_score(quote: Text, intensity: Text, channel: Text, spam: str = L.SPAM) -> Column:
    """Intensity + 0.5 weight + substance + 0.5 length - 0.7 profanity; null for spam."""
    i = F.coalesce(F.nullif(F.col(intensity) if isinstance(intensity, str) else intensity, F.lit(0)), F.lit(1))
    score = i + channel_weight(channel) * 0.5 + substance(quote) + length_score(quote) * 0.5 - profanity_hits(quote) * 0.7
    return F.when(~_c(quote).rlike(spam), score)


# posts


def links_marked(text: Text, mark: str = L.LINK_MARK) -> Column:
    """Addresses replaced by a mark, repeated marks by one."""
    quoted = mark.replace("[", r"\[").replace("]", r"\]")
    return F.regexp_replace(F.regexp_replace(_c(text), r"https?://\S+", mark), rf"(?:{quoted}\s*){{2,}}", f"{mark} ")


def without_embed_cards(text: Text) -> Column:
    """Previews of shared links cut down to their mark."""
    return F.regexp_replace(_c(text), L.EMBED_CARD, f"{L.LINK_MARK}\n")


def _untitled(body: Text, title: Text) -> Column:
    b, t = _c(body), _c(title)
    return F.when((t != "") & b.startswith(t), F.substring(b, F.length(t) + 1, F.length(b))).otherwise(b)


def clean_body(body: Text, title: Text, chrome: str = r"(?!)") -> Column:
    """Body without its title in front, the site's chrome (a pattern) and tags; blank ends of lines go."""
    b = F.regexp_replace(F.regexp_replace(_untitled(body, title), chrome, ""), "<[^>]+>", "")
    return F.regexp_replace(F.regexp_replace(b, r"[ \t]*\n[ \t]*", "\n"), r"^\s+|\s+$", "")


def real_length(body: Text, title: Text, chrome: str = r"(?!)") -> Column:
    """Characters of a body that are its own text."""
    b = F.regexp_replace(F.regexp_replace(_untitled(body, title), chrome, ""), r"<[^>]+>|https?://\S+|\[링크\]", "")
    return F.length(F.trim(F.regexp_replace(b, r"\s+", " ")))


def clean_comment(text: Text) -> Column:
    """Content of a comment that starts with lines of digits and a nickname and ends with dates; others only trimmed."""
    lines = F.transform(F.split(_c(text), "\n"), lambda x: F.trim(x))
    digits = lambda x: x.rlike("^[0-9]+$")
    first = F.aggregate(F.transform(lines, lambda x, i: F.when(~digits(x), i).otherwise(1_000_000)), F.lit(1_000_000), lambda a, x: F.least(a, x))
    last = F.aggregate(F.transform(lines, lambda x, i: F.when(~x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), i).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))
    rest = F.filter(lines, lambda x, i: (i > first) & (i <= last) & (x != ""))
    scaffold = (F.size(lines) >= 3) & digits(F.get(lines, F.lit(0)))
    return F.when(scaffold, F.trim(F.array_join(rest, " "))).otherwise(F.trim(_c(text)))


def title_of(content: Text) -> Column:
    """First line that is not blank, without heading marks."""
    lines = F.filter(F.transform(F.split(_c(content), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.regexp_replace(F.get(lines, F.lit(0)), "^[# ]+", ""), F.lit(""))


def post_status(body: Text, title: Text, fetched: Text = "ok", thin: int = 20) -> Column:
    """ok, snippet_only or empty_body by the body's own length; the fetch's failure where it failed."""
    n = real_length(body, title)
    state = F.col(fetched) if isinstance(fetched, str) and fetched != "ok" else (F.lit("ok") if isinstance(fetched, str) else fetched)
    return F.when(state != "ok", state).when(n == 0, "empty_body").when(n < thin, "snippet_only").otherwise("ok")


def contaminated(text: Text, pattern: str = r"(?i)^\s*(?:error|404|403|access denied|not found|로그인이 필요)", prefix: int = 200) -> Column:
    """the first characters look like an error or navigation page."""
    return F.substring(_c(text), 1, prefix).rlike(pattern)


def failure_class(message: Text) -> Column:
    """cause of a failed chunk by its message."""
    c = F.lower(_c(message))
    return F.when(c.rlike("timeout|timed out"), "timeout").when(c.rlike("quota|rate limit|429"), "quota").when(c.rlike("schema|json|validat"), "schema").otherwise("other")


def fetch_class(status: Column, body: Text) -> Column:
    """audit class of a fetch by status and body."""
    c = F.lower(_c(body))
    return (
        F.when(status.isin(404, 410), "deleted").when(status.isin(401, 403, 429), "blocked").when(status.isNull() | (status >= 400), "http_error")
        .when(c.rlike("captcha|challenge|just a moment"), "challenge").when(F.length(F.trim(c)) < 50, "extract_failed").otherwise("recoverable")
    )


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.size(same)


def fuzzy_match(a: Text, b: Text, threshold: float = 0.7) -> Column:
    """One holds the other, case and spaces aside, or their common prefix is `threshold` of the longer."""
    x, y = (F.replace(F.trim(F.lower(_c(t))), F.lit(" "), F.lit("")) for t in (a, b))
    prefix = common_prefix(x, y) / F.greatest(F.length(x), F.length(y))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x) | (prefix >= threshold))


def substituted(template: Text, values: Mapping[str, Text]) -> Column:
    """{name} replaced by values."""
    c = _c(template)
    for k, v in values.items():
        c = F.replace(c, F.lit("{" + k + "}"), _c(v))
    return F.trim(F.regexp_replace(c, " +", " "))


def site_filter(domains: Column, joined: str = " OR ") -> Column:
    """(site:a OR site:b)."""
    parts = F.transform(domains, lambda d: F.concat(F.lit("site:"), d))
    return F.when(F.size(domains) == 0, "").when(F.size(domains) == 1, F.get(parts, F.lit(0))).otherwise(F.concat(F.lit("("), F.array_join(parts, joined), F.lit(")")))


def rank_confidence(rank: Column, base: float = 0.9, step: float = 0.05, floor: float = 0.5) -> Column:
    """Confidence that falls with the rank, down to a floor."""
    return F.round(F.greatest(F.lit(floor), F.lit(base) - rank * step), 2)


def canonical_key(*parts: Text) -> Column:
    """SHA-256 of the parts as JSON in a fixed order."""
    return F.sha2(F.to_json(F.struct(*[_c(p).alias(f"k{i}") for i, p in enumerate(parts)])), 256)


def short_id(text: Text, prefix: str = "cm_", length: int = 12) -> Column:
    """Prefix and the head of a SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(_c(text)), 1, length))


def fingerprint_of(values: Column) -> Column:
    """A hash of a set of texts, whatever their order."""
    return F.sha2(F.array_join(F.sort_array(F.array_distinct(values)), "\x1f"), 256)


def fallback(*columns: Text) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in columns], F.lit(""))


# dates


def iso_time(text: Text) -> Column:
    """RFC 822 and ISO dates as ISO-8601 in UTC; others pass through."""
    c = F.trim(_c(text))
    bare = F.regexp_replace(c, r"^[A-Za-z]{3}, ", "")
    zone = F.regexp_replace(bare, r" (?:GMT|UTC|Z)$", " +0000")
    parsed = F.coalesce(*[F.try_to_timestamp(zone, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss")], F.try_to_timestamp(c))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'Z'"), c)


def is_recent(published: Text, now: Column, months: int) -> Column:
    """published within `months` of 30 days; what cannot be read passes."""
    at = F.try_to_timestamp(_c(published))
    return at.isNull() | (at >= now - F.make_dt_interval(F.lit(30 * months)))


def month_window(n: int, now: Column) -> Column:
    """The last n months as yyyy-MM, oldest first."""
    month = F.trunc(now, "month")
    return F.transform(F.sequence(F.lit(1 - n), F.lit(0)), lambda k: F.date_format(F.add_months(month, k), "yyyy-MM"))


def week_start(at: Column, hour: int = 5) -> Column:
    """The latest Monday at `hour`, not after `at`."""
    return F.date_trunc("week", at - F.make_dt_interval(F.lit(0), F.lit(hour))) + F.make_dt_interval(F.lit(0), F.lit(hour))


def expired(written: Column, now: Column, hours: float) -> Column:
    """older than a time to live; what has no time is expired."""
    return F.coalesce(written + F.make_dt_interval(hours=F.lit(hours).cast("int")) < now, F.lit(True))
