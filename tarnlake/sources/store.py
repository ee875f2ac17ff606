"""A store of results keyed by content: sharded, written by replacing shards, the same whether a write runs once or twice.

Entries lie as Parquet under agent=…/shard=…, the shard being the head of the key. A write reads the shards that its keys fall
into, merges them, and replaces just these (dynamic partition overwrite): other shards aren't read or touched, a rerun after a
lost executor or driver leaves the same rows, and a busy agent is spread over all its shards. Writers of one shard take turns.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as X

SCHEMA = "cache_key string, output string, created_at timestamp, updated_at timestamp, hit_count long, last_hit_at timestamp, agent string, shard string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="tarnlake-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, where it may lie."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _scratch:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            return


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a store; none where nothing was written yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def _replace(rows: DataFrame, path: str) -> None:
    """Write whole shards over those that are there."""
    dealt = rows.repartition("agent", "shard")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("agent", "shard").parquet(path)


def _touched(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("agent", "shard").distinct(), ["agent", "shard"], "left_semi")


def put(results: DataFrame, path: str, agent: str, now: Column, digits: int = 2) -> None:
    """Store results (cache_key, output); a null output is remembered as a failure.

    A key keeps its first created_at and its hits; output and updated_at are those of this write. Of a key that comes twice
    the greatest output stays, a null one only alone. Null keys are left out.
    """
    new = results.where("cache_key IS NOT NULL").groupBy("cache_key").agg(F.max("output").alias("_output")).select(
        F.lit(agent).alias("agent"), F.substring("cache_key", 1, digits).alias("shard"), "cache_key", "_output", now.alias("_at")
    )
    old = _touched(entries(results.sparkSession, path), new)
    both = old.join(new, ["agent", "shard", "cache_key"], "full")
    written = F.col("_at").isNotNull()
    merged = both.select(
        "cache_key", F.when(written, F.col("_output")).otherwise(F.col("output")).alias("output"), F.coalesce("created_at", "_at").alias("created_at"), F.coalesce("_at", "updated_at").alias("updated_at"),
        F.coalesce("hit_count", F.lit(0)).alias("hit_count"), "last_hit_at", "agent", "shard",
    )
    _replace(merged, path)


def record_hits(hits: DataFrame, path: str, agent: str, now: Column, digits: int = 2) -> None:
    """Count hits (cache_key) and their time; what a hit does not do is prolong an entry's life."""
    new = hits.groupBy("cache_key").agg(F.count("*").alias("_n")).select(F.lit(agent).alias("agent"), F.substring("cache_key", 1, digits).alias("shard"), "cache_key", "_n")
    old = _touched(entries(hits.sparkSession, path), new)
    both = old.join(new, ["agent", "shard", "cache_key"], "left")
    counted = both.withColumns({"hit_count": F.col("hit_count") + F.coalesce("_n", F.lit(0)), "last_hit_at": F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_hit_at"))})
    _replace(counted.select(*entries(hits.sparkSession, path).columns), path)


def drop_expired(path: str, spark: SparkSession, ttls: DataFrame, now: Column, fallback: float) -> None:
    """Rewrite the shards that hold expired entries, without these. A shard of which nothing is left keeps no rows."""
    aged = _aged(entries(spark, path), ttls, now, fallback)
    kept = _touched(aged, aged.where("_expired")).where("NOT _expired").drop("_expired")
    gone = aged.where("_expired").select("agent", "shard").distinct().join(kept.select("agent", "shard").distinct(), ["agent", "shard"], "left_anti")
    empty = [(r["agent"], r["shard"]) for r in gone.collect()]  # folders, 16**digits an agent at most
    _replace(kept.select(*entries(spark, path).columns), path)
    for agent, shard in empty:
        delete(spark, f"{path}/agent={agent}/shard={shard}")


def _aged(rows: DataFrame, ttls: DataFrame, now: Column, fallback: float) -> DataFrame:
    """`rows` with whether their agent's time to live, of `ttls` (agent, hours), is over; no time means expired."""
    hours = F.coalesce("_hours", F.lit(fallback)).cast("double")
    over = F.coalesce(F.unix_micros(now) - F.unix_micros("updated_at") > hours * 3_600_000_000, F.lit(True))
    return rows.join(ttls.select("agent", F.col("hours").alias("_hours")), "agent", "left").withColumn("_expired", over).drop("_hours")


def look_up(inputs: DataFrame, stored: DataFrame, agent: str, now: Column, ttls: DataFrame, fallback: float, schema: str | None = None) -> DataFrame:
    """Inputs (cache_key and more) with hit and output. A stored failure is a hit with a null output.

    Expired entries are misses, and so are outputs that are no JSON object of the fields of `schema`, if one is asked for.
    """
    live = _aged(stored.where(F.col("agent") == agent), ttls, now, fallback).where("NOT _expired")
    if schema:
        live = live.where(F.col("output").isNull() | F.from_json("output", f"struct<_bad: string, {schema}>", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNull())
    return inputs.join(live.select("cache_key", F.col("output"), F.lit(True).alias("hit")), "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def remember(inputs: DataFrame, path: str, agent: str, key: Column, work: Callable[[DataFrame], DataFrame], now: Column, ttls: DataFrame, fallback: float, digits: int = 2) -> DataFrame:
    """Outputs of all inputs; `work` (distinct missing inputs with cache_key to cache_key and output) is asked for the missing alone, and what it says is stored.

    The store is written once, before the result is read: inputs that `work` gives no row for come back with hit false.
    """
    keyed = inputs.withColumn("cache_key", key)
    spark = inputs.sparkSession
    missing = look_up(keyed, entries(spark, path), agent, now, ttls, fallback).where("NOT hit").drop("hit", "output").dropDuplicates(["cache_key"])
    put(work(missing).select("cache_key", "output"), path, agent, now, digits)
    return look_up(keyed, entries(spark, path), agent, now, ttls, fallback)


def ttl_table(spark: SparkSession, path: str) -> DataFrame:
    """Agent and hours of a text of lines `agent: hours` under `defaults:`; comments and other lines are passed over, a missing file gives no rows."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], "agent string, hours double")
    got = lines.select(F.regexp_extract("value", r"^\s+([A-Za-z0-9_]+)\s*:\s*[0-9]", 1).alias("agent"), F.regexp_extract("value", r":\s*([0-9]+(?:\.[0-9]+)?)\s*(?:#.*)?$", 1).alias("hours"))
    return got.where("agent <> '' AND hours <> ''").select("agent", F.col("hours").cast("double").alias("hours"))


def query_key(*parts: Column) -> Column:
    """Key of a search or an address: its parts without white space at the ends, the first in lower case."""
    bare = [F.btrim(p, F.lit(" \t\n\r\x0b\f")) for p in parts]
    return X.canonical_key(F.lower(bare[0]), *bare[1:])


def write_run(outputs: DataFrame, path: str) -> None:
    """What runs gave (run_id, kind, name, body) as JSON lines, by run; a run that is written again is replaced whole."""
    outputs.repartition("run_id", "kind").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "kind").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, body string, run_id string, kind string").json(path)
