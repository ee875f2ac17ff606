"""Ids, labels and lookups: anti and semi joins, inverted indices, overrides and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from .bounds import DIMENSION_ROWS, dimension

def without_owned(videos: DataFrame, owned: DataFrame) -> DataFrame:
    """Videos whose channel is not owned; unknown channels stay."""
    return videos.join(owned.where(F.length(F.col("channel_id").cast("string")) > 0).select("channel_id").distinct(), "channel_id", "left_anti")


def video_index(videos: DataFrame) -> DataFrame:
    """Sorted distinct candidates of each video."""
    return videos.groupBy("video_id").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")


def with_meta(rows: DataFrame, meta: DataFrame, override: DataFrame, key: str = "video_id") -> DataFrame:
    """Title from the override where it has one, else from the metadata."""
    o = override.select(key, F.col("title").alias("_new"))
    return rows.join(meta.select(key, F.col("title").alias("_old")), key, "left").join(o, key, "left").withColumn("title", X.fallback("_new", "_old")).drop("_new", "_old")


def channel_records(channels: DataFrame, videos: DataFrame, stats: DataFrame) -> DataFrame:
    """Recent videos of each channel with statistics, 0 where there are none."""
    s = videos.join(stats, "video_id", "left").na.fill(0, ["views", "likes", "comments"])
    nested = s.groupBy("channel_id").agg(F.sort_array(F.collect_list(F.struct("video_id", "views", "likes", "comments"))).alias("recent"))
    return channels.join(nested, "channel_id", "left")


def label_map(labels: DataFrame, profiles: DataFrame, excluded: tuple[str, ...] = L.EXCLUDED_LABELS) -> DataFrame:
    """Label to candidate: normal forms contain one another; the first profile wins.

    A theta join of two dimensions, each of at most DIMENSION_ROWS distinct values; facts join its result by label.
    """
    l = labels.select("label").distinct().where(~F.col("label").isin(*excluded)).withColumn("_l", X.letters_and_digits("label")).where("_l <> ''")
    p = profiles.select("candidate", F.col("pos").alias("_pos"), X.letters_and_digits("name").alias("_p")).where("_p <> ''")
    for side in (l, p):
        dimension(side, "labels and profiles", DIMENSION_ROWS)
    hits = l.join(F.broadcast(p), F.col("_l").contains(F.col("_p")) | F.col("_p").contains(F.col("_l")))
    return hits.groupBy("label").agg(F.min_by("candidate", "_pos").alias("candidate"))


def name_map(own: DataFrame, rivals: DataFrame, selected: DataFrame) -> DataFrame:
    """Names of selected candidates, one's own always."""
    return own.unionByName(rivals.join(selected.select("candidate"), "candidate", "left_semi"))


def cache_split(inputs: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Inputs with their cached output, and whether there is one."""
    known = cache.select(key, F.col("output").alias("cached"), F.lit(True).alias("_known"))
    return inputs.join(known, key, "left").withColumn("hit", F.coalesce("_known", F.lit(False))).drop("_known")


def enriched(rows: DataFrame, cache: DataFrame, looked_up: DataFrame, key: str, value: str) -> DataFrame:
    """A value from the cache, for misses from a lookup."""
    c = cache.select(key, F.col(value).alias("_cached"))
    n = looked_up.join(cache, key, "left_anti").select(key, F.col(value).alias("_new"))
    return rows.join(c, key, "left").join(n, key, "left").withColumn(value, F.coalesce("_cached", "_new")).drop("_cached", "_new")


def upserted(store: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a store after changes; of each key the newest row stays, a change before a stored row of the same time."""
    rows = store.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new")))).where("_rn = 1").drop("_rn", "_new")


def latest(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


def overridden(cells: DataFrame, overrides: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Cells whose columns an override replaces; overrides of missing cells are added."""
    o = overrides.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    merged = cells.join(o, keys, "full")
    return merged.select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in columns), *(c for c in cells.columns if c not in {*keys, *columns}))


def draft_diff(base: DataFrame, edited: DataFrame) -> DataFrame:
    """Fields (field, value) that an edit changed, added or cleared."""
    e = edited.select("field", F.col("value").alias("new"))
    return base.select("field", F.col("value").alias("old")).join(e, "field", "full").where(~F.col("old").eqNullSafe(F.col("new")))


def prefix_dominated(names: DataFrame) -> DataFrame:
    """Names of which no other name is a longer form; an equi-join on the proper prefixes of lengths that names have instead of a theta join."""
    n = F.length("name")
    lengths = names.agg(F.collect_set(n).alias("_lengths"))
    shorter = F.filter("_lengths", lambda k: k < n)
    prefixes = names.crossJoin(F.broadcast(lengths)).select(F.explode(F.transform(shorter, lambda k: F.substring(F.col("name"), F.lit(1), k))).alias("name")).distinct()
    return names.join(prefixes, "name", "left_anti")


def map_merge(left: Column, right: Column) -> Column:
    """Right-biased union of two maps."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def appended(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of all tables, tagged with the order of their table."""
    out = first.withColumn("part", F.lit(0))
    for i, df in enumerate(more, 1):
        out = out.unionByName(df.withColumn("part", F.lit(i)))
    return out


def domain_ids(known: DataFrame, names: DataFrame) -> DataFrame:
    """Ids of names: known ones keep theirs, new ones continue after the largest, by name. New names are a dimension, numbered in one task."""
    new = dimension(names.distinct().join(known, "name", "left_anti"), "new names")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return known.unionByName(new.crossJoin(F.broadcast(top)).select("name", (F.col("_top") + F.row_number().over(Window.orderBy("name"))).cast("long").alias("id")))


def external_view(candidates: DataFrame, history: DataFrame, finance: DataFrame, market: DataFrame) -> DataFrame:
    """Blocks of external facts on each candidate, null where there are none."""
    def block(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != "candidate"]
        return df.groupBy("candidate").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))

    out = candidates
    for df, name in ((history, "history"), (finance, "finance"), (market, "market")):
        out = out.join(block(df, name), "candidate", "left")
    return out.withColumn("own", F.col("candidate").startswith("own"))


def used_documents(nested: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose id stands in a nested list of ids."""
    return documents.join(nested.select(F.explode(F.flatten("ids")).alias("doc_id")).distinct(), "doc_id", "left_semi")
