"""Scans of paged services over landed responses: which pages of a query count, why its scan ended, and the items.

A collector lands every response as it comes, failures and second attempts too. What a scan gives is decided here, on tables,
so that any scan can be judged again without asking the service. No step holds all pages of a query in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A landed response. Pages count from 0, attempts from 1; items is a JSON list, null where the response held none.
RESPONSE = "query string, page int, attempt int, status int, next_token string, items string"
#: Reasons a scan ends, in the words of `ended`: no more pages, the most pages asked for, refused for now or for good, gone, and a page that never landed.
ENDINGS = ("exhausted", "limited", "throttled", "quota", "missing", "failed", "partial")


def _why(answer: Column, page: Column, most: int | None) -> Column:
    """Why a scan ends with this answer; null where it goes on."""
    status, some = answer["status"], F.coalesce(F.json_array_length(answer["items"]), F.lit(0)) > 0
    return (
        F.when(status.isNull(), "failed").when(status == 404, "missing").when(status == 429, "throttled").when(status == 403, "quota").when(status != 200, "failed")
        .when(~some | F.coalesce(answer["next_token"], F.lit("")).eqNullSafe(""), "exhausted").when(page + 1 >= F.lit(most), "limited")
    )


def answers(responses: DataFrame) -> DataFrame:
    """The answer that counts for each page: query, page, answer (status, next_token, items), and `landed`, false for a page that only follows one.

    Of several attempts the last that succeeded counts, else the last; equal attempts go by status, token and items. Rows
    without a query or page, and pages below 0, are left out.
    """
    known = responses.where("query IS NOT NULL AND page >= 0")
    answer = F.struct((F.coalesce(F.col("status"), F.lit(0)) == 200).alias("ok"), "attempt", "status", "next_token", "items")
    rows = known.select("query", F.col("page").alias("at"), answer.alias("answer"))
    # each page makes the one after it wanted: gaps show in the same shuffle that picks the answers
    both = rows.select("query", F.explode(F.array(F.struct("at", "answer"), F.struct((F.col("at") + 1).alias("at"), F.lit(None).cast(rows.schema["answer"].dataType).alias("answer")))).alias("x"))
    best = both.groupBy("query", F.col("x.at").alias("page")).agg(F.max("x.answer").alias("answer"))
    return best.select("query", "page", "answer", F.col("answer").isNotNull().alias("landed"))


def endings(answered: DataFrame, most: int | None = None) -> DataFrame:
    """Where the scan of each query ends: query, last (page, -1 where the first never landed), ended (one of ENDINGS)."""
    why = _why(F.col("answer"), F.col("page"), most)
    end = F.when(~F.col("landed"), F.struct((F.col("page") - 1).alias("page"), F.lit(1).alias("late"), F.lit("partial").alias("why"))).when(why.isNotNull(), F.struct("page", F.lit(0).alias("late"), why.alias("why")))
    ends = answered.groupBy("query").agg(F.min(end).alias("end"), F.min(F.when(F.col("landed"), F.col("page"))).alias("first"))
    began = F.col("first") == 0
    return ends.select("query", F.when(began, F.col("end.page")).otherwise(-1).alias("last"), F.when(began, F.col("end.why")).otherwise("partial").alias("ended"))


def scanned(responses: DataFrame, most: int | None = None) -> DataFrame:
    """Items of each query's scan: query, page, pos (in the page), item (JSON).

    Pages are read from the first on until one is empty, has no token for a next one, was refused after all attempts, or never
    landed, and at most `most` of them; what came before counts (a partial result). Items may repeat: services move them
    between pages, and callers decide what is the same. Texts that aren't JSON lists hold no items.
    """
    answered = answers(responses)
    ok = answered.where("landed AND answer.status = 200").select("query", "page", "answer.items")
    kept = ok.join(endings(answered, most), "query").where("page <= last").select("query", "page", "items")
    return kept.select("query", "page", F.posexplode(F.from_json("items", "array<string>")).alias("pos", "item"))


def scan_states(responses: DataFrame, most: int | None = None) -> DataFrame:
    """One row a query: ended (one of ENDINGS), n_pages and n_items that count, and stored: an empty result isn't remembered, nor is one that was cut short."""
    answered = answers(responses)
    ends = endings(answered, most)
    counts = answered.where("landed AND answer.status = 200").select("query", "page", F.coalesce(F.json_array_length("answer.items"), F.lit(0)).alias("n"))
    n = counts.join(ends, "query").where("page <= last AND n > 0").groupBy("query").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_items"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ends.join(n, "query", "left").select("query", "ended", zero("n_pages"), zero("n_items"), (F.col("ended").isin("exhausted", "limited") & (F.coalesce("n_items", F.lit(0)) > 0)).alias("stored"))


def found_videos(responses: DataFrame, statistics: DataFrame, most: int | None = None) -> DataFrame:
    """Videos of each query's scan with their counts (views, likes, comments; 0 where unknown), each once per query, at its first place.

    Items without a video id are left out. A query refused from its first page on has no rows; scan_states() tells why.
    """
    item = F.from_json("item", "struct<video_id:string,channel_id:string,title:string,published_at:string>")
    place = F.struct("page", "pos")
    rows = scanned(responses, most).select("query", place.alias("place"), item.alias("v")).where("v.video_id <> ''")
    first = rows.groupBy("query", "v.video_id").agg(F.min_by("v", "place").alias("v"))
    known = statistics.groupBy("video_id").agg(*[F.max(c).alias(c) for c in ("views", "likes", "comments")])
    video = first.select("query", "video_id", F.coalesce("v.channel_id", F.lit("")).alias("channel_id"), F.coalesce("v.title", F.lit("")).alias("title"), F.coalesce("v.published_at", F.lit("")).alias("published_at"))
    return video.join(known, "video_id", "left").na.fill(0, ["views", "likes", "comments"])


def discovered_videos(targets: DataFrame, found: DataFrame, since: str, views: int = 1000, comments: int = 10) -> DataFrame:
    """Videos of the candidates that are searched by name (candidate, query): new and seen enough, each once per candidate.

    Dates are compared as ISO texts; videos without one are left out, as the service is asked for later ones only.
    """
    from ..operators.urls import video_thresholds

    asked = targets.where("candidate <> 'own' AND query <> ''").select("candidate", "query").distinct()
    rows = found.where(F.col("published_at") >= since).join(asked, "query")
    return video_thresholds(rows, views, comments).select("candidate", "video_id", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"), "channel_id", "views", "likes", "comments", "published_at")


def discovery_steps(targets: DataFrame, states: DataFrame) -> DataFrame:
    """What a discovery reports for each candidate: quota_skip or skipped where refused without a result, else completed; error where its scan was cut short."""
    asked = targets.where("candidate <> 'own' AND query <> ''").select("candidate", "query").distinct()
    cut = ~F.col("ended").isin("exhausted", "limited", "missing")
    none = F.col("n_items") == 0
    status = F.when(none & (F.col("ended") == "quota"), "quota_skip").when(none & F.coalesce(cut, F.lit(True)), "skipped").otherwise("completed")
    return asked.join(states, "query", "left").na.fill(0, ["n_items"]).select("candidate", status.alias("status"), F.when(F.col("ended").isNull(), "not asked").when(cut, F.col("ended")).otherwise("").alias("error"))
