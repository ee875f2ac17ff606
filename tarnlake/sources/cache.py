"""Content-addressed results and sinks: Parquet tables keyed by a hash, written only where something changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as X

SCHEMA = "agent string, cache_key string, output string, created_at timestamp"


def keyed(inputs: DataFrame, agent: str, *columns: str) -> DataFrame:
    """Inputs with the key of their content and the agent's name."""
    return inputs.withColumn("cache_key", X.canonical_key(F.lit(agent), *columns))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a cache; an empty table where nothing was written yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def lookup(inputs: DataFrame, entries: DataFrame, agent: str, now: Column, ttl_hours: float | None = None) -> DataFrame:
    """Inputs with the latest output of their key that has not expired, and whether there is one.

    A stored null output is a hit: failures are remembered too.
    """
    mine = entries.where(F.col("agent") == agent)
    if ttl_hours is not None:
        mine = mine.where(~X.expired(F.col("created_at"), now, ttl_hours))
    last = mine.groupBy("cache_key").agg(F.max_by(F.struct("output"), "created_at").alias("_o"))
    return inputs.join(last, "cache_key", "left").withColumn("hit", F.col("_o").isNotNull()).withColumn("output", F.col("_o.output")).drop("_o")


def store(results: DataFrame, path: str, agent: str, now: Column) -> None:
    """Append results (cache_key, output), in folders by agent."""
    results.select(F.lit(agent).alias("agent"), "cache_key", "output", now.alias("created_at")).write.mode("append").partitionBy("agent").parquet(path)


def statistics(entries: DataFrame) -> DataFrame:
    """Entries and distinct keys of each agent."""
    return entries.groupBy("agent").agg(F.count("*").alias("entries"), F.count_distinct("cache_key").alias("keys"), F.max("created_at").alias("latest"))


def compacted(entries: DataFrame) -> DataFrame:
    """The latest entry of each key."""
    return entries.groupBy("agent", "cache_key").agg(F.max_by(F.struct("output", "created_at"), "created_at").alias("e")).select("agent", "cache_key", "e.*")


def changed(reports: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Reports (report_id, content) whose content differs from their latest snapshot (report_id, content_hash, at)."""
    last = snapshots.groupBy("report_id").agg(F.max_by("content_hash", "at").alias("_hash"))
    now = reports.withColumn("content_hash", F.sha2("content", 256))
    return now.join(last, "report_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("_hash"))).drop("_hash")


def new_rejections(rejected: DataFrame, known: DataFrame) -> DataFrame:
    """Rejected (candidate, url) that are not recorded yet."""
    return rejected.dropDuplicates(["candidate", "url"]).join(known, ["candidate", "url"], "left_anti")


def write_csv(rows: DataFrame, path: str) -> None:
    """Results as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results written by write_csv()."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("overwrite").json(path)
