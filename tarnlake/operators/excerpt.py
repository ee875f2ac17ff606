"""Excerpts and chunks of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARK = "\n[...]\n"


def merged_intervals(intervals: DataFrame, *keys: str) -> DataFrame:
    """Overlapping or touching (start, end) of each key as one, by a running maximum and islands."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = intervals.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def keyword_windows(docs: DataFrame, keywords: list[str], radius: int = 300, most: int = 10) -> DataFrame:
    """Windows around the first matches of each keyword: id, keyword, start, end (from 0, end exclusive)."""
    def matches(k: str):
        lengths = F.transform(F.slice(F.split(F.lower("text"), re.escape(k.lower()), -1), 1, most + 1), lambda s: F.length(s))
        n = F.size(lengths) - 1
        starts = F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x) + (i - 1) * len(k))
        at = F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda p: F.struct(F.lit(k).alias("keyword"), F.greatest(p - radius, F.lit(0)).alias("start"), F.least(p + len(k) + radius, F.length("text")).alias("end")))

    hits = [matches(k) for k in keywords]
    return docs.select("id", F.explode(F.concat(*hits)).alias("w")).select("id", "w.*")


def excerpt(text: str, keywords: list[str], budget: int, radius: int = 300, most: int = 10, head: int = 500) -> str:
    """Keyword-in-context excerpt of one text within a budget of characters.

    Short texts pass whole. The head and heading lines come first; then merged windows by distinct keywords, those that no
    longer fit being skipped for later ones; parts stand in order, with marks between.
    """
    if len(text) <= budget:
        return text
    low = text.lower()
    spans = []
    for k in {k.lower() for k in keywords if k}:
        at, n = low.find(k), 0
        while at >= 0 and n < most:
            spans.append((max(0, at - radius), min(len(text), at + len(k) + radius)))
            at, n = low.find(k, at + len(k)), n + 1
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    taken = [(0, min(head, budget))]
    taken += [m.span() for m in re.finditer(r"(?m)^#{1,6} .*$", text) if m.start() >= head]
    used = sum(b - a for a, b in taken)
    ranked = sorted(merged, key=lambda s: (-sum(k.lower() in low[s[0] : s[1]] for k in set(keywords)), s[0]))
    for a, b in ranked:
        if used + b - a + len(_MARK) <= budget:
            taken.append((a, b))
            used += b - a + len(_MARK)
    out, end = "", 0
    for a, b in sorted(taken):
        if b <= end:
            continue
        a = max(a, end)
        out += (_MARK if out and a > end else "") + text[a:b]
        end = b
    return out[:budget]


#: Characters at the head that are always kept, around a match, and of all pages of a candidate; matches of a keyword; the mark of what is left out.
HEAD, RADIUS, PAGE, CANDIDATE, MATCHES = 500, 300, 6000, 30_000, 10
OMITTED = "\n[... 본문 일부 생략 ...]\n"
_SPANS = "array<struct<s:int,e:int>>"


def _span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def _located(pieces: Column, gap: int, span) -> Column:
    """Spans by a walk over the pieces that a text was split in: `span` gets a piece and the place of its start, and may give null."""
    start = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {_SPANS})").alias("spans"))

    def step(state, piece):
        new = span(piece, state["at"])
        return F.struct((state["at"] + F.length(piece) + gap).alias("at"), F.when(new.isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(new))).alias("spans"))

    return F.aggregate(pieces, start, step, lambda state: state["spans"])


def keyword_spans(text: str, keyword: str, radius: int = RADIUS, most: int = MATCHES) -> Column:
    """Spans around the first matches of a keyword, within the text."""
    parts = F.split(text, re.escape(keyword), most + 1)
    before = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    end = len(keyword) + radius
    return _located(before, len(keyword), lambda p, at: _span(F.greatest(at + F.length(p) - radius, F.lit(0)), F.least(at + F.length(p) + end, F.length(text))))


def heading_spans(text: str) -> Column:
    """Spans of lines that begin with `#`."""
    spans = _located(F.split(text, "\n"), 1, lambda line, at: F.when(line.startswith("#"), _span(at, at + F.length(line))))
    return F.when(F.col(text).startswith("#") | F.col(text).contains("\n#"), spans).otherwise(F.expr(f"CAST(array() AS {_SPANS})"))


def merged_spans(spans: Column | str) -> Column:
    """W22 within a row: overlapping or touching spans as one, in order."""

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_span(last["s"], F.greatest(last["e"], x["e"]))))
        return F.when((F.size(done) > 0) & (x["s"] <= last["e"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(spans), F.expr(f"CAST(array() AS {_SPANS})"), step)


def excerpts(docs: DataFrame, keywords: list[str], budget: int | str = PAGE, text: str = "text", name: str = "excerpt") -> DataFrame:
    """Each row's keyword-in-context excerpt, within a budget of characters (a number or a column's name); null texts give empty ones.

    Texts within the budget pass whole. The head and the heading lines are always taken. Then come merged windows around the first
    matches of each keyword, those with the most different keywords first, then the earlier ones; a window that no longer fits is
    passed over, a later one may fit. Parts stand in order, with a mark where something is left out, and the whole is cut to the
    budget. All of it is arrays folded within the row: no shuffle, no Python.
    """
    words = sorted({k.strip() for k in keywords if k and k.strip()})
    most = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    staged = docs.withColumns({"_text": F.coalesce(text, F.lit("")), "_budget": most})
    found = F.concat(F.expr(f"CAST(array() AS {_SPANS})"), *[keyword_spans("_text", k) for k in words])
    long = F.length("_text") > F.col("_budget")
    staged = staged.withColumns({"_taken": F.when(long, merged_spans(F.concat(F.array(_span(F.lit(0), F.least(F.lit(HEAD), F.length("_text")))), heading_spans("_text")))), "_ranked": F.when(long, merged_spans(found))})
    kinds = lambda x: sum((F.when(F.substring(F.col("_text"), x["s"] + 1, x["e"] - x["s"]).contains(k), 1).otherwise(0) for k in words), F.lit(0))
    staged = staged.withColumn("_ranked", F.sort_array(F.transform("_ranked", lambda x: F.struct((-kinds(x)).alias("k"), x["s"].alias("s"), x["e"].alias("e")))))
    used = F.aggregate("_taken", F.lit(0), lambda n, x: n + x["e"] - x["s"] + len(OMITTED))

    def fill(state, x):
        n = state["used"] + x["e"] - x["s"] + len(OMITTED)
        return F.when(n > F.col("_budget"), state).otherwise(F.struct(n.alias("used"), F.concat(state["spans"], F.array(_span(x["s"], x["e"]))).alias("spans")))

    filled = F.aggregate("_ranked", F.struct(used.alias("used"), F.col("_taken").alias("spans")), fill, lambda state: state["spans"])
    staged = staged.withColumn("_picked", filled).withColumn("_picked", merged_spans("_picked"))

    def piece(x, i):
        before = F.when(i == 0, 0).otherwise(F.get(F.col("_picked"), i - 1)["e"])
        return F.concat(F.when(x["s"] > before, OMITTED).otherwise(""), F.substring(F.col("_text"), x["s"] + 1, x["e"] - x["s"]))

    tail = F.when(F.element_at("_picked", -1)["e"] < F.length("_text"), OMITTED).otherwise("")
    whole = F.substring(F.concat(F.array_join(F.transform("_picked", piece), ""), tail), F.lit(1), F.col("_budget"))
    return staged.withColumn(name, F.when(long, whole).otherwise(F.col("_text"))).select(*docs.columns, name)


def extraction_payload(pages: DataFrame, features: DataFrame, keywords: list[str], page: int = PAGE, candidate: int = CANDIDATE) -> DataFrame:
    """What an extraction is given: one row a reachable page of a candidate, with its excerpt and the candidate's features and payload key.

    `pages` have candidate, url, fetch_status and text; `features` candidate and feature_id. Only pages whose status is ok count.
    They share the candidate's budget evenly, each up to `page` characters. The key is of the candidate, its features and the
    hashes of all excerpts, whatever their order; candidates without a reachable page have no rows. What is grouped by candidate
    is a hash a page and the features; the texts stay where they are.
    """
    fetched = pages.where("fetch_status = 'ok'")
    n = fetched.groupBy("candidate").agg(F.count("*").alias("n_pages"))
    shared = fetched.join(n, "candidate").withColumn("budget", F.least(F.lit(page), F.greatest(F.lit(1), F.expr(f"{candidate} div n_pages"))).cast("int"))
    cut = excerpts(shared, keywords, "budget").drop("text")
    about = features.groupBy("candidate").agg(F.sort_array(F.collect_set("feature_id")).alias("features"))
    hashes = cut.groupBy("candidate").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "url", F.sha2("excerpt", 256)))).alias("_h"))
    key = F.sha2(F.concat_ws("\n", "candidate", F.concat_ws(",", "features"), F.concat_ws("\n", "_h")), 256)
    keyed = hashes.join(about, "candidate", "left").withColumn("features", F.coalesce("features", F.array().cast("array<string>"))).select("candidate", "features", key.alias("payload_key"))
    return cut.join(keyed, "candidate")


def sentence_chunks(text: str, size: int = 3000, most: int = 3) -> list[str]:
    """Chunks of whole sentences up to `size` characters, longer sentences cut hard, at most `most` chunks."""
    out, now = [], ""
    for s in re.split(r"(?<=[.!?。])\s+|\n+", text.strip()):
        while len(s) > size:
            if now:
                out.append(now)
                now = ""
            out.append(s[:size])
            s = s[size:]
        if now and len(now) + 1 + len(s) > size:
            out.append(now)
            now = s
        else:
            now = f"{now} {s}".strip()
    return (out + [now] if now else out)[:most]


def chunked(docs: DataFrame, size: int = 3000, most: int = 3) -> DataFrame:
    """One row per chunk of each row's text, with its number; empty texts give none."""
    rest = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = rows.assign(chunk=[list(enumerate(sentence_chunks(t or "", size, most))) for t in rows["text"]])[[*rest, "chunk"]].explode("chunk").dropna(subset=["chunk"])
            yield parts.assign(chunk_index=[c[0] for c in parts["chunk"]], text=[c[1] for c in parts["chunk"]])[[*rest, "chunk_index", "text"]]

    return docs.mapInPandas(run, f"{kinds}, chunk_index int, text string")


def press_lines(docs: DataFrame, most: int = 50) -> DataFrame:
    """Releases of a press page: a line with a date, titled by the line before, else after; each title once, at most `most`.

    `docs` have url and text. Dates are YYYY.MM.DD, YYYY-MM-DD or YYYY년 M월 D일.
    """
    date = r"(20[0-9]{2})\s*[.년/-]\s*([0-9]{1,2})\s*[.월/-]\s*([0-9]{1,2})"
    lines = docs.select("url", F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "line"))
    w = Window.partitionBy("url").orderBy("pos")
    bare = F.trim(F.regexp_replace("line", date + r"[.일]?", ""))
    dated = F.col("line").rlike(date)
    near = lines.select("*", F.lag("line").over(w).alias("_before"), F.lead("line").over(w).alias("_after")).where(dated)
    title = F.when(F.length(bare) >= 8, bare).when(F.length("_before") >= 8, F.col("_before")).otherwise(F.col("_after"))
    day = F.concat_ws("-", F.regexp_extract("line", date, 1), F.lpad(F.regexp_extract("line", date, 2), 2, "0"), F.lpad(F.regexp_extract("line", date, 3), 2, "0"))
    found = near.select("url", "pos", title.alias("title"), day.alias("published_at")).where("title IS NOT NULL")
    once = found.withColumn("_rn", F.row_number().over(Window.partitionBy("url", "title").orderBy("pos"))).where("_rn = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).where(F.col("rank") <= most).select("url", "rank", "title", "published_at")


def noise_profile(segments: DataFrame, noise: str = r"^\s*[\[(].*[\])]\s*$") -> DataFrame:
    """by transcript, segments, noise segments, and the most frequent word trigram's count."""
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = segments.repartition(tasks, "video_id")  # texts travel once; their trigrams, several times as large, are counted where they are made
    words = segments.select("video_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("w"))  # split once, not for each trigram
    at = lambda i: F.get("w", i)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.concat(at(i), F.lit(" "), at(i + 1), F.lit(" "), at(i + 2)))
    base = segments.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(noise)).alias("noise"))
    tops = words.where(F.size("w") >= 3).select("video_id", F.explode(grams).alias("gram")).groupBy("video_id", "gram").count().groupBy("video_id").agg(F.max("count").alias("top_trigram"))
    return base.join(tops, "video_id", "left").na.fill(0, ["top_trigram"])


def hits_of(text: Column, keywords: list[str]) -> Column:
    """How many distinct keywords a text holds."""
    return F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: text.contains(k)))
