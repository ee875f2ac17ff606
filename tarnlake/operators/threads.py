"""Comment threads: filters, routing, assembly, chunking and budgets.

`comments` have thread_id, pos (order within the table), is_reply and text. Order is always carried by a column; ties of pos
are broken by thread_id.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _first_of(partition: list, *order) -> F.Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def basic_filter(comments: DataFrame, prefix: int = 200) -> DataFrame:
    """comments that pass the basic cut, the first of each 200-character beginning."""
    kept = comments.withColumn("text", F.trim("text")).where(X.basic_drop("text").isNull())
    return kept.withColumn("_rn", _first_of([F.substring("text", 1, prefix)], "pos", "thread_id")).where("_rn = 1").drop("_rn")


def prefilter(comments: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """no noise, no pure questions, and a keyword; replies need none where their root has one."""
    keywords = list(keywords)
    clean = comments.where(X.basic_drop("text").isNull() & ~X.is_pure_question("text")).withColumn("_hit", X.has_any("text", keywords))
    root = F.max(~F.col("is_reply") & F.col("_hit")).over(Window.partitionBy("thread_id"))
    return clean.withColumn("_root", root).where(F.col("_hit") | (F.col("is_reply") & F.col("_root"))).drop("_hit", "_root")


def prefilter_variants(comments: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """three filter variants as flags over one scan: keyword; and no pure question; and no noise."""
    hit = X.has_any("text", list(keywords))
    ask, noise = X.is_pure_question("text"), X.basic_drop("text").isNotNull()
    return comments.select("thread_id", "pos", hit.alias("v1"), (hit & ~ask).alias("v2"), (hit & ~ask & ~noise).alias("v3"))


def route(comments: DataFrame, keywords: Iterable[str], keep_all_replies: bool = False) -> DataFrame:
    """a route for every comment: content, question, or a drop_ reason.

    Roots are judged before replies, and share with them one set of 200-character beginnings of comments that pass the basic
    cut; a reply is content if its thread's root is content or a question, whatever its words.
    """
    keywords = list(keywords)
    t = F.trim(F.coalesce("text", F.lit("")))
    base = comments.withColumn("_t", t).withColumn("_drop", X.basic_drop(t)).withColumn("_hit", X.has_any(t, keywords)).withColumn("_ask", X.is_pure_question(t))
    nth = _first_of([F.substring("_t", 1, 200), F.col("_drop").isNull()], "is_reply", "pos", "thread_id")
    base = base.withColumn("_dup", F.col("_drop").isNull() & (nth > 1))
    root = (
        F.when(F.col("_drop").isNotNull(), F.col("_drop")).when(F.col("_dup"), "drop_duplicate").when(F.col("_ask") & F.col("_hit"), "question")
        .when(F.col("_ask"), "drop_question_noise").when(F.col("_hit"), "content").otherwise("drop_keyword_miss")
    )
    base = base.withColumn("_root", F.when(~F.col("is_reply"), root))
    good = F.max(F.coalesce(F.col("_root").isin("content", "question"), F.lit(False))).over(Window.partitionBy("thread_id"))
    reply = F.when(F.col("_drop").isNotNull(), F.col("_drop")).when(F.col("_dup"), "drop_duplicate").when(F.lit(keep_all_replies) | good, "content").otherwise("drop_orphan")
    return base.withColumn("route", F.coalesce("_root", reply)).drop("_t", "_drop", "_hit", "_ask", "_dup", "_root")


def assemble(routed: DataFrame, most_replies: int = 5) -> DataFrame:
    """One row per kept thread: root text and its first content replies.

    A thread is kept if its root is content or a question, or a reply is content; a root that was dropped still gives its text.
    """
    reply = F.when(F.col("is_reply") & (F.col("route") == "content"), F.struct("pos", "text"))
    root = F.when(~F.col("is_reply"), F.struct("pos", "text"))
    threads = routed.groupBy("thread_id").agg(
        F.min(root)["text"].alias("root_text"), F.slice(F.sort_array(F.collect_list(reply)), 1, most_replies).alias("replies"),
        F.max(~F.col("is_reply") & F.col("route").isin("content", "question")).alias("root_kept"), F.count(reply).alias("n_replies"),
    )
    return threads.where("root_kept OR n_replies > 0").select("thread_id", F.coalesce("root_text", F.lit("")).alias("root_text"), F.col("replies.text").alias("replies"), "n_replies")


def auto_dropped(threads: DataFrame, keywords: Iterable[str], most: int = 40) -> DataFrame:
    """assembled threads too short and without a keyword."""
    joined = F.concat_ws(" ", F.array("root_text"), "replies")
    return threads.where(X.auto_drop(joined, list(keywords), most))


def reply_context(comments: DataFrame) -> DataFrame:
    """Every reply with the text of its thread's root."""
    root = comments.where("NOT is_reply").groupBy("thread_id").agg(F.min_by("text", "pos").alias("parent_text"))
    return comments.where("is_reply").join(root, "thread_id", "left")


def score_cut(rows: DataFrame, cap: int, least: int = 2, order: str = "pos") -> DataFrame:
    """rows of a sufficient score, the best `cap`, ties in order."""
    return rows.where(F.col("score") >= least).orderBy(F.desc("score"), order).limit(cap)


def newest_first(rows: DataFrame) -> DataFrame:
    """Place of each row when threads stand newest first and members in order of time."""
    first = F.min("posted_at").over(Window.partitionBy("thread_id"))
    dated = rows.withColumn("thread_start", first)
    return dated.withColumn("member", F.row_number().over(Window.partitionBy("thread_id").orderBy("posted_at", "pos")))


def batches(rows: DataFrame, size: int, within: list[str], order: list[str]) -> DataFrame:
    """Number of the fixed-size batch of each row within a group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1) / size))


def chunk(threads: DataFrame, budget: int, least: int = 0, group: str = "channel", order: str = "pos", size: str = "chars") -> DataFrame:
    """Number of the chunk of each thread.

    A chunk is closed before a thread if it has threads, would exceed the budget and has reached `least`; threads stay whole.
    The running size is reset at each cut, which no window frame expresses, so each group (one video or channel) is folded in
    order in pandas with a row of three numbers per thread.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order])
        now = n = at = 0
        out = []
        for s in rows[size]:
            if n and now + s > budget and now >= least:
                at, now, n = at + 1, 0, 0
            now, n = now + s, n + 1
            out.append(at)
        return rows.assign(chunk=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in threads.schema)
    return threads.groupBy(group).applyInPandas(fold, f"{kinds}, chunk int")


def resplit(items: DataFrame, budget: int, group: str, order: str = "pos", size: str = "chars") -> DataFrame:
    """Smaller chunks of single items, for another try."""
    return chunk(items, budget, 0, group, order, size)


def channel_cut(threads: DataFrame, budget: int, by: str = "channel") -> DataFrame:
    """Threads per channel, relevant first and newest first, up to the first that would exceed the budget of items; the first always."""
    w = Window.partitionBy(by).orderBy(F.desc("relevant"), F.desc("posted_at"), "thread_id")
    ranked = threads.select("*", F.row_number().over(w).alias("_rn"), F.sum("items").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    return ranked.where((F.col("_rn") == 1) | (F.col("running") <= budget)).drop("_rn")


def tag_candidates(comments: DataFrame, index: DataFrame) -> DataFrame:
    """Each comment once for every candidate of its video."""
    return comments.join(index, "video_id").withColumn("candidate", F.explode("candidates")).drop("candidates")


def merged_posts(chunks: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Bodies of the chunks of each address in order, and its comments."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "body")))
    whole = chunks.groupBy("url").agg(F.array_join(F.transform(parts, lambda p: p["body"]), "\n").alias("body"))
    return whole if comments is None else whole.join(comments, "url", "left")


def members(posts: DataFrame, most: int = 20) -> DataFrame:
    """Members of a post's thread: title t0, body c1, comments c2 and so on."""
    texts = F.slice(F.filter(F.concat(F.array("title", "body"), F.coalesce("comments", F.array().cast("array<string>"))), lambda t: F.length(t) > 0), 1, most)
    return posts.select("url", F.posexplode(texts).alias("at", "text")).select("url", F.concat(F.when(F.col("at") == 0, "t").otherwise("c"), F.col("at")).alias("local_id"), "text")


def remapped(output: DataFrame, batches_of: DataFrame) -> DataFrame:
    """Model output by batch and position put back on the threads; threads without output get empty values."""
    return batches_of.join(output, ["batch", "position"], "left")


def with_thread(units: DataFrame, threads: DataFrame) -> DataFrame:
    """Units with their thread's channel, address and importance."""
    return units.join(threads.select("thread_id", "channel", "source_url", "importance"), "thread_id", "left")


def deduplicated_tuples(tuples: DataFrame) -> DataFrame:
    """First of each normalised quote within aspect and address."""
    return tuples.withColumn("_rn", _first_of(["aspect", "source_url", X.squeezed("quote")], "unit_id")).where("_rn = 1").drop("_rn")


def absa_inputs(*sources: DataFrame, prefix: int = 200) -> DataFrame:
    """Sources in the given order united, the first of each candidate's squeezed 200-character beginning."""
    tagged = [s.withColumn("source_order", F.lit(i)) for i, s in enumerate(sources)]
    rows = tagged[0]
    for s in tagged[1:]:
        rows = rows.unionByName(s)
    return rows.withColumn("_rn", _first_of(["candidate", F.substring(X.squeezed("text"), 1, prefix)], "source_order", "pos")).where("_rn = 1").drop("_rn")


def guarded(tuples: DataFrame, items: DataFrame, aspects: DataFrame) -> DataFrame:
    """tuples whose aspect is in the codebook, whose address was read, and whose quote stands in a text read there."""
    known = tuples.join(aspects.select("aspect").distinct(), "aspect", "left_semi")
    squeezed = items.select(F.col("source_url").alias("_url"), X.squeezed("text").alias("_text"))
    return known.join(squeezed, (known["source_url"] == squeezed["_url"]) & squeezed["_text"].contains(X.squeezed(known["quote"])), "left_semi")


def channel_counts(items: DataFrame) -> DataFrame:
    """Items, comments and distinct addresses by channel."""
    return items.groupBy("channel").agg(F.count("*").alias("n"), F.count_if("is_comment").alias("comments"), F.count_distinct("source_url").alias("urls"))


def failures(messages: DataFrame) -> DataFrame:
    """Failed chunks and their items by cause."""
    return messages.groupBy(X.failure_class("message").alias("cause")).agg(F.count("*").alias("n"), F.sum("items").alias("items"))


def keyword_hits(comments: DataFrame, codebook: dict[str, Iterable[str]]) -> DataFrame:
    """Comments and videos with a keyword of each aspect; one pass with a flag per aspect."""
    flags = F.array(*[F.struct(F.lit(a).alias("aspect"), X.has_any("text", list(k)).alias("hit")) for a, k in codebook.items()])
    return comments.select("video_id", F.explode(flags).alias("f")).groupBy("f.aspect").agg(F.count("*").alias("n"), F.count_if("f.hit").alias("hits"), F.count_distinct(F.when(F.col("f.hit"), F.col("video_id"))).alias("videos"))
