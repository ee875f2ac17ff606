"""Selection of quotes and suggestions, and evidence lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def scored(units: DataFrame) -> DataFrame:
    """Units with a score and the masked quote; spam is left out."""
    return units.withColumn("score", X.quote_score("quote", "intensity", "channel")).where("score IS NOT NULL").withColumn("masked", X.masked("quote"))


def top_quotes(units: DataFrame, per_bucket: int = 3, prefix: int = 40) -> DataFrame:
    """Best quotes by aspect, candidate and polarity; of those alike in their first normalised characters only the best.

    Neutral units and spam are left out; a quote without letters and digits is like no other.
    """
    rows = scored(units.where("candidate IS NOT NULL AND polarity IN ('positive', 'negative')"))
    key = F.substring(X.letters_and_digits("masked"), 1, prefix)
    key = F.when(key == "", F.concat(F.lit("#"), F.col("unit_id").cast("string"))).otherwise(key)
    order = [F.desc("score"), "masked", "unit_id"]
    bucket = ["aspect", "candidate", "polarity"]
    once = rows.withColumn("_dup", F.row_number().over(Window.partitionBy(*bucket, key).orderBy(*order))).where("_dup = 1")
    best = once.withColumn("rank", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))).where(F.col("rank") <= per_bucket)
    return best.select(*bucket, "rank", "unit_id", "score", "masked")


def representative_quotes(units: DataFrame, per_bucket: int = 3) -> DataFrame:
    """Quotes of the bucket's most frequent perspective first (ties by name), then by score, then by order."""
    rows = scored(units.where("candidate IS NOT NULL AND polarity IN ('positive', 'negative')"))
    bucket = ["aspect", "candidate", "polarity"]
    n = rows.groupBy(*bucket, "perspective").agg(F.count("*").alias("k"))
    dominant = n.withColumn("_rn", F.row_number().over(Window.partitionBy(*bucket).orderBy(F.desc("k"), "perspective"))).where("_rn = 1").select(*bucket, F.col("perspective").alias("dominant"))
    ranked = rows.join(dominant, bucket).withColumn("rank", F.row_number().over(Window.partitionBy(*bucket).orderBy(F.col("perspective") != F.col("dominant"), F.desc("score"), "unit_id")))
    return ranked.where(F.col("rank") <= per_bucket).select(*bucket, "rank", "unit_id", "dominant")


def suggestions(units: DataFrame, per_aspect: int = 3) -> DataFrame:
    """Best suggestions by candidate and aspect."""
    rows = scored(units.where("candidate IS NOT NULL AND is_suggestion"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("candidate", "aspect").orderBy(F.desc("score"), "masked", "unit_id")))
    return ranked.where(F.col("rank") <= per_aspect).select("candidate", "aspect", "rank", "unit_id")


def positional_ids(rows: DataFrame, order: list[str], prefix: str = "u", bucket_rows: int = 100_000) -> DataFrame:
    """u000, u001 and so on in the order of columns, of which the first is an integer.

    Rows are numbered within ranges of the first column whose starts come from counts, so that no task orders all rows.
    """
    first = F.floor(F.col(order[0]) / bucket_rows)
    counts = rows.groupBy(first.alias("_range")).agg(F.count("*").alias("_n"))
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_range", first).join(starts, "_range")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_start")
    return numbered.withColumn("position_id", F.format_string(f"{prefix}%03d", nth)).drop("_range", "_start")


def resolved_evidence(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Claimed ids in their first cluster only, unknown ones dropped, and the rest as unclassified."""
    once = claims.join(known.select("unit_id"), "unit_id", "left_semi").withColumn("_rn", F.row_number().over(Window.partitionBy("unit_id").orderBy("pos"))).where("_rn = 1").select("unit_id", "cluster")
    rest = known.select("unit_id").join(once, "unit_id", "left_anti").select("unit_id", F.lit("unclassified").alias("cluster"))
    return once.unionByName(rest)


def unassigned(every: DataFrame, used: DataFrame, key: str = "unit_id") -> DataFrame:
    """Rows whose key is not used."""
    return every.join(used.select(key), key, "left_anti")


def restricted(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is allowed."""
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def restricted_lists(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Lists cut to allowed ids, with how many went."""
    kept = F.array_intersect(column, X.words(allowed))
    return rows.withColumn("n_dropped", F.size(F.array_distinct(column)) - F.size(kept)).withColumn(column, kept)


def lint(lines: DataFrame, actions: DataFrame, opportunities: DataFrame) -> DataFrame:
    """warnings on a report.

    `lines` (path, text) that quote an index; `actions` (section, pos, action_id, cost from 0 none to 3 high) of high cost that
    stand before one of low cost (1 or less); `opportunities` (item_id, kind, parts: an array of three texts) of the kind 기회
    that lack a part.
    """
    literal = lines.where(F.col("text").rlike(r"[-+−]?[01]\.[0-9]{2}")).select(F.col("path").alias("where"), F.lit("index literal").alias("warning"))
    later = F.min("cost").over(Window.partitionBy("section").orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    order = actions.withColumn("_later", later).where("cost = 3 AND _later <= 1").select(F.col("action_id").alias("where"), F.lit("cost order").alias("warning"))
    lacking = opportunities.where((F.col("kind") == "기회") & F.exists("parts", lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")).select(F.col("item_id").alias("where"), F.lit("missing part").alias("warning"))
    return literal.unionByName(order).unionByName(lacking)


def rubric_insight(reports: DataFrame) -> DataFrame:
    """3, or 4 with an opportunity, actions, limitations and no lint, or 5 if besides nothing is pending (null: unknown)."""
    four = (F.col("opportunities") > 0) & (F.col("actions") > 0) & (F.col("limitations") > 0) & (F.col("lint") == 0)
    return reports.withColumn("score", F.when(four & F.coalesce(F.col("pending") == 0, F.lit(False)), 5).when(four, 4).otherwise(3))
