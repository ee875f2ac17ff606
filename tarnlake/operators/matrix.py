"""Feature by candidate tables: dense grids, display values, summaries and the comparison's rubric.

`cells` have feature, candidate, value, value_numeric, unit, as_of, status and promotional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bounds import dimension

UNCONFIRMED, MANUAL, LIMITED = "미확인", " (수동 검토 필요)", " [기간한정]"


def dense(cells: DataFrame, features: DataFrame, candidates: DataFrame, most: int = 100_000) -> DataFrame:
    """A cell for every feature and candidate, not_found where there is none.

    The grid is the result asked for; candidates, which are few, are broadcast after a check of their number.
    """
    few = dimension(candidates.select("candidate").distinct(), "candidates", most)
    grid = features.select("feature").distinct().crossJoin(F.broadcast(few))
    return grid.join(cells, ["feature", "candidate"], "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


def display(grid: DataFrame) -> DataFrame:
    """The text of each cell."""
    s = F.col("status")
    shown = F.concat(F.col("value"), F.when(s == "requires_manual_check", MANUAL).otherwise(""), F.when(F.col("promotional"), LIMITED).otherwise(""))
    return grid.withColumn("shown", F.when(s.isin("not_found", "unknown") | F.col("value").isNull(), UNCONFIRMED).otherwise(shown))


def footnotes(grid: DataFrame) -> DataFrame:
    """Numbers of promotional cells in row-major order, own candidates first, numbered from 1.

    Only promotional cells, a report's footnotes, reach the numbering window.
    """
    order = Window.orderBy(~F.col("candidate").startswith("own"), "candidate", "feature")
    noted = dimension(grid.where("promotional"), "footnotes")
    return noted.select("candidate", "feature", F.row_number().over(order).alias("note"))


def traps(grid: DataFrame, absolute: str = "무조건|전부|모든|항상|완전") -> DataFrame:
    """Cells to be warned of: partial values in absolute words, numbers without a date."""
    partial = grid.where((F.col("status") == "partial") & F.col("value").rlike(absolute)).select("feature", "candidate", F.lit("absolute word").alias("trap"))
    undated = grid.where("value_numeric IS NOT NULL AND coalesce(as_of, '') = ''").select("feature", "candidate", F.lit("no date").alias("trap"))
    return partial.unionByName(undated).distinct()


def identical(grid: DataFrame) -> DataFrame:
    """Features whose value is the same for every candidate of the grid."""
    facts = grid.groupBy("feature").agg(F.count_distinct("value").alias("values"), F.count("value").alias("known"), F.count("*").alias("n"))
    return facts.withColumn("same", (F.col("values") == 1) & (F.col("known") == F.col("n")))


def manual_review(grid: DataFrame, least: float = 0.5) -> DataFrame:
    """Candidates with missing cells or fewer than half explicit ones."""
    facts = grid.groupBy("candidate").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "explicit").alias("explicit"), F.count_if(F.col("status") == "not_found").alias("missing"))
    return facts.withColumn("review", (F.col("missing") > 0) | (F.col("explicit") < F.col("n") * least))


def rubric(grid: DataFrame) -> DataFrame:
    """2 unless there are numbers and each has a unit, 5 with footnotes and no number without a date, else 4."""
    number = F.col("value_numeric").isNotNull()
    facts = grid.agg(F.count_if(number).alias("numbers"), F.count_if(number & (F.col("unit") != "")).alias("with_unit"), F.count_if(number & (F.col("as_of") == "")).alias("undated"), F.count_if("promotional").alias("notes"))
    score = F.when((F.col("numbers") == 0) | (F.col("with_unit") < F.col("numbers")), 2).when((F.col("notes") > 0) & (F.col("undated") == 0), 5).otherwise(4)
    return facts.withColumn("score", score)


def references(grid: DataFrame, column: str) -> DataFrame:
    """Distinct sources in order."""
    return grid.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def ordered_features(features: DataFrame) -> DataFrame:
    """Features by importance, then by name, with their place."""
    return features.withColumn("rank", F.row_number().over(Window.partitionBy("report").orderBy(F.desc("importance"), "feature")))


def zone_weights(zones: DataFrame, most: int = 3) -> DataFrame:
    """The heaviest zones of each use case."""
    return zones.withColumn("rank", F.row_number().over(Window.partitionBy("use_case").orderBy(F.desc("weight"), "zone"))).where(F.col("rank") <= most)


def envelope(content: DataFrame, report_type: str, version: str) -> DataFrame:
    """A report's rows as one JSON document per report, in the order of pos, with its version.

    `content` has report, pos and text; a report's rows are bounded by the limits of the operators that made them.
    """
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    body = content.groupBy("report").agg(F.to_json(F.transform(parts, lambda p: p["text"])).alias("content"))
    return body.select("report", F.lit(report_type).alias("report_type"), F.lit(version).alias("rubric_version"), "content")
