"""What several training-data operators use: cut lineage, text columns, connected components, runs of sorted rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_scratch: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="tarnlake-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def free(name: str, *tables: DataFrame) -> str:
    """`name`, with underscores until no column of the tables has it."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: lineage ends there, and lost executors cost nothing that is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """cut() with the rows bucketed by `key`, in as many buckets as there are shuffle partitions: joins by `key` move the other side alone."""
    spark = df.sparkSession
    name = f"scratch_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).format("parquet").option("path", path).saveAsTable(name)
    _scratch.append((spark, path))
    return spark.table(name)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(df.sparkSession, path)
            _scratch[:] = [x for x in _scratch if x[1] != path]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that Spark wrote, where it may lie."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _scratch:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            return


def crc32_of(column: str) -> Column:
    """CRC-32 of an id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


#: Bytes of rows that a function on batches gets at a time, if a row isn't larger.
BATCH_BYTES = 4_000_000


def small(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes: what a task makes of them is many times as large."""
    step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    return (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: T.StructType | str, most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow with a function from a batch to a dict of columns, which works row by row: it gets small() slices of about `most` bytes."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small(whole, most)):
            if (made := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([_arrow(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, kind)


def _arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def sorted_runs(batches: Iterator[pa.RecordBatch], key: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of whole runs: (rows, start of each run). The input is sorted by what `key` numbers; a run never spans two blocks."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = key(batch)
        change = np.flatnonzero(_differs(keys))
        if kept and not _same(last, keys[:1]):
            yield _block(kept, key)
            kept = []
        last = keys[-1:]
        if len(change):
            at = int(change[-1]) + 1
            kept.append(batch.slice(0, at))
            yield _block(kept, key)
            kept = [batch.slice(at)]
        else:
            kept.append(batch)
    if kept:
        yield _block(kept, key)


def _differs(keys: np.ndarray) -> np.ndarray:
    return keys[1:] != keys[:-1]


def _same(a: np.ndarray, b: np.ndarray) -> bool:
    return bool((a == b).all())


def _block(parts: list[pa.RecordBatch], key) -> tuple[pa.RecordBatch, np.ndarray]:
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
    starts = np.concatenate([[0], np.flatnonzero(_differs(key(whole))) + 1])
    return whole, starts


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of an edge table (src, dst).

    Each round every node hooks to its first neighbour in the order of a hash, follows two further hooks, and the edges
    are contracted to the roots so found. Hash order keeps chains of hooks short, so that a logarithmic number of rounds
    is expected whatever the shape. Hubs are only met by aggregates that combine before the shuffle and by joins that
    adaptive execution splits; nothing but the count of remaining edges reaches the driver. Null ends, self-loops and
    repeated edges change nothing; no edges give an empty result.
    """
    at = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    left = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    member = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hook = cut(
            both.groupBy("src").agg(F.min(at("dst")).alias("best"))
            .select(F.col("src").alias("node"), F.least(at("src"), "best")["id"].alias("root"))
        )
        first, second, third = (hook.select(F.col("node").alias(f"n{i}"), F.col("root").alias(f"r{i}")) for i in range(3))
        roots = cut(
            first.join(second, F.col("r0") == F.col("n1")).join(third, F.col("r1") == F.col("n2"))
            .select(F.col("n0").alias("node"), F.col("r2").alias("root"))
        )
        src, dst = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("src", "dst"))
        contracted = cut(
            left.join(src, "src").join(dst, "dst").where("src_root <> dst_root")
            .select(F.least("src_root", "dst_root").alias("src"), F.greatest("src_root", "dst_root").alias("dst")).distinct()
        )
        if member is None:
            now = roots
        else:
            new = roots.select(F.col("node").alias("root"), F.col("root").alias("to"))
            now = cut(member.join(new, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            forget(roots, member)
        forget(hook, left)
        member, left = now, contracted
    forget(left)
    if member is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    lowest = member.groupBy("root").agg(F.min("node").alias("component"))
    return member.join(lowest, "root").select("node", "component")
