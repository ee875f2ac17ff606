"""Measures of owned channels: frequency, engagement, presence, gaps and feed overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L


def frequency(items: DataFrame, months: Column) -> DataFrame:
    """Posts of each candidate in each month of a grid, in all and related; months outside it are ignored."""
    grid = items.select("candidate").distinct().select("candidate", F.explode(months).alias("month"))
    n = items.groupBy("candidate", "month").agg(F.count("*").alias("total"), F.count_if("related").alias("related"))
    return grid.join(n, ["candidate", "month"], "left").na.fill(0, ["total", "related"])


def related_ratio(frequencies: DataFrame) -> DataFrame:
    """Related posts among all in the window, 0 without posts."""
    s = frequencies.groupBy("candidate").agg(F.sum("total").alias("total"), F.sum("related").alias("related"))
    return s.withColumn("ratio", F.when(F.col("total") > 0, F.col("related") / F.col("total")).otherwise(0.0))


def engagement(videos: DataFrame) -> DataFrame:
    """Exact medians of (likes + comments) per view and per subscriber; videos without views, channels without subscribers, give none."""
    acts = F.col("likes") + F.col("comments")
    per_view, per_sub = F.when(F.col("views") > 0, acts / F.col("views")), F.when(F.col("subscribers") > 0, acts / F.col("subscribers"))
    return videos.groupBy("candidate").agg(F.median(per_view).alias("per_view"), F.median(per_sub).alias("per_subscriber"), F.sum("views").alias("views"), F.sum("likes").alias("likes"), F.count("*").alias("n"))


def presence(owned: DataFrame, measured: DataFrame, feeds: DataFrame, platforms=L.PLATFORMS) -> DataFrame:
    """State of each candidate on each platform: measured, else the feed's state, else presence_only, else none."""
    grid = owned.select("candidate").distinct().select("candidate", F.explode(F.array(*[F.lit(p) for p in platforms])).alias("platform"))
    has = owned.select("candidate", "platform", F.lit(True).alias("_has")).distinct()
    got = measured.select("candidate", "platform", F.lit(True).alias("_got")).distinct()
    feed = feeds.groupBy("candidate", "platform").agg(F.min("state").alias("_feed"))
    keys = ["candidate", "platform"]
    joined = grid.join(has, keys, "left").join(got, keys, "left").join(feed, keys, "left")
    return joined.select(*keys, F.when(F.col("_got"), "measured").when(F.col("_feed").isNotNull(), F.col("_feed")).when(F.col("_has"), "presence_only").otherwise("none").alias("state"))


def gaps(states: DataFrame, own: str) -> DataFrame:
    """Platforms that one lacks and competitors hold, with those who do."""
    mine = states.where((F.col("candidate") == own) & (F.col("state") == "none")).select("platform")
    held = states.where((F.col("candidate") != own) & (F.col("state") != "none"))
    return held.join(mine, "platform", "left_semi").groupBy("platform").agg(F.array_join(F.array_sort(F.collect_set("candidate")), ",").alias("holders"))


def channel_matrix(items: DataFrame, owned: DataFrame) -> DataFrame:
    """Items and related ones of each candidate's platforms, with those that are only owned."""
    n = items.groupBy("candidate", "platform").agg(F.count("*").alias("total"), F.count_if("related").alias("related"))
    return owned.select("candidate", "platform").distinct().join(n, ["candidate", "platform"], "full").na.fill(0, ["total", "related"])


def rubric(states: DataFrame, own: str) -> DataFrame:
    """2 under two kinds of channels, 4 while there are gaps, else 5."""
    kinds = states.where("state <> 'none'").agg(F.count_distinct("platform").alias("kinds"))
    open_gaps = gaps(states, own).agg(F.count("*").alias("gaps"))
    return kinds.crossJoin(open_gaps).withColumn("score", F.when(F.col("kinds") < 2, 2).when(F.col("gaps") > 0, 4).otherwise(5))


def feed_overlap(titles: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of one candidate's feeds whose overlap coefficient of titles reaches `least`.

    Feeds meet only where they share a title. Titles that very many feeds share are met once per pair of feeds of the same
    candidate, whose feeds are few.
    """
    t = titles.select("candidate", "feed", "title").distinct()
    size = t.groupBy("candidate", "feed").agg(F.count("*").alias("size"))
    a, b = t.withColumnRenamed("feed", "first"), t.withColumnRenamed("feed", "second")
    common = a.join(b, ["candidate", "title"]).where("first < second").groupBy("candidate", "first", "second").agg(F.count("*").alias("common"))
    s1, s2 = size.select("candidate", F.col("feed").alias("first"), F.col("size").alias("size1")), size.select("candidate", F.col("feed").alias("second"), F.col("size").alias("size2"))
    return common.join(s1, ["candidate", "first"]).join(s2, ["candidate", "second"]).where(F.col("common") >= F.least("size1", "size2") * least)


def kept_feeds(feeds: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Feeds that are not merged into an earlier kept one; the greedy fold runs per candidate over its few feeds."""
    near = overlaps.groupBy("candidate", F.col("second").alias("feed")).agg(F.collect_set("first").alias("near"))
    rows = feeds.select("candidate", "feed").distinct().join(near, ["candidate", "feed"], "left")
    ordered = rows.groupBy("candidate").agg(F.sort_array(F.collect_list(F.struct("feed", F.coalesce("near", F.array().cast("array<string>")).alias("near")))).alias("all"))
    start = F.array().cast("array<string>")
    kept = F.aggregate("all", start, lambda acc, x: F.when(F.arrays_overlap(acc, x["near"]), acc).otherwise(F.concat(acc, F.array(x["feed"]))))
    return ordered.select("candidate", F.explode(kept).alias("feed"))


def prejudged(items: DataFrame, tokens: DataFrame) -> DataFrame:
    """items whose title or excerpt holds a token of their candidate."""
    t = tokens.groupBy("candidate").agg(F.collect_set("token").alias("_tokens"))
    blob = F.lower(F.concat_ws(" ", "title", "excerpt"))
    return items.join(t, "candidate", "left").where(F.exists("_tokens", lambda x: blob.contains(x))).drop("_tokens")


def reaction_preview(posts: DataFrame) -> DataFrame:
    """Posts and distinct addresses by site, most posts first."""
    n = posts.groupBy("site").agg(F.count("*").alias("n"), F.count_distinct("post_id").alias("posts"), F.count_distinct("candidate").alias("candidates"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "site")))
