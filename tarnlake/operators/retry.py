"""Extraction over chunks that may fail: look up, run what is missing, split what timed out, and again, until nothing is open.

Every item ends in exactly one success or one named failure. A chunk is a row with its items, bounded when chunks are cut, so
each step is a plan over rows: an anti-join with the store, the engine, a fold that splits. Rounds are written to the shared
folder, which cuts lineage and is the record of progress; only the number of open chunks reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import store as S

ITEM = "struct<item_id: string, text: string>"
TUPLE = "struct<item_id: string, label: string>"
#: From chunks (chunk_key, candidate, items) to chunk_key, cause (null for a success) and tuples.
Engine = Callable[[DataFrame], DataFrame]


def chunks(items: DataFrame, order: str, size: int) -> DataFrame:
    """Items (candidate, item_id, text and `order`, a number unique in the candidate) in chunks of up to `size` consecutive numbers."""
    at = F.floor(F.col(order) / size).cast("long")
    grouped = items.groupBy("candidate", at.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.struct(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).alias("item")))).alias("_x"))
    return grouped.select("candidate", "chunk", F.transform("_x", lambda x: x["item"]).alias("items"))


def chars(items: Column | str) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, i: a + F.length(i["text"]))


def halves(items: Column | str) -> Column:
    """A chunk's items in two, the first no longer than the second."""
    n, of = F.size(items), F.floor(F.size(items) / 2).cast("int")
    return F.array(F.slice(items, F.lit(1), of), F.slice(items, of + 1, n - of))


def by_chars(budget: int) -> Callable[[Column], Column]:
    """A chunk's items anew, a piece being closed before the item that would take it over `budget` characters."""

    def split(items):
        start = F.struct(F.expr(f"CAST(array() AS array<array<{ITEM}>>)").alias("done"), F.expr(f"CAST(array() AS array<{ITEM}>)").alias("now"), F.lit(0).alias("n"))

        def step(s, i):
            n = F.length(i["text"])
            full = (F.size(s["now"]) > 0) & (s["n"] + n > budget)
            return F.struct(
                F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(full, F.array(i)).otherwise(F.concat(s["now"], F.array(i))).alias("now"),
                F.when(full, n).otherwise(s["n"] + n).alias("n"),
            )

        return F.aggregate(items, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))

    return split


def chunk_key(aspects: str, head: int = 64) -> Column:
    """Key of a chunk's content: candidate, aspects, and the squeezed heads of its texts in order, with ids and lengths beside them, as results carry the ids."""
    heads = F.transform("items", lambda i: F.concat_ws("\x1f", i["item_id"], F.substring(X.squeezed(i["text"]), 1, head), F.length(i["text"]).cast("string")))
    return F.sha2(F.to_json(F.struct("candidate", F.lit(aspects).alias("aspects"), heads.alias("items"))), 256)


def extract(parts: DataFrame, engine: Engine, path: str, now: Column, aspects: str = "", split: Callable[[Column], Column] = halves, retry: str = "timeout", rounds: int = 40, agent: str = "absa", ttl_hours: float = 24.0 * 365, digits: int = 2) -> DataFrame:
    """Results of all chunks (candidate, chunk, items): candidate, chunk, piece, round, cached, cause, items and tuples, one row a piece that is settled.

    `piece` tells where in its chunk a piece lies (places of splits, dotted; empty for the whole). Pieces whose cause is `retry`
    are split if that makes them smaller, all others are settled with their cause. Successful pieces go to the store at
    `path`/store, and so does a whole chunk once all its pieces have succeeded, so that a second run asks for nothing but failures.
    Chunks without items are settled at once; equal chunks reach the engine once. After `rounds` what is open is settled with `retry`.
    """
    spark = parts.sparkSession
    ttls = spark.createDataFrame([], "agent string, hours double")
    store, progress = f"{path}/store", f"{path}/progress"
    open_ = parts.select("candidate", "chunk", F.lit("").alias("piece"), "items")
    columns = ["candidate", "chunk", "piece", "round", "cached", "cause", "items", "tuples"]
    for n in range(rounds + 1):
        keyed = open_.withColumn("cache_key", chunk_key(aspects))
        seen = S.look_up(keyed, S.entries(spark, store), agent, now, ttls, ttl_hours)
        missing = seen.where("NOT hit").groupBy("cache_key").agg(F.min(F.struct("candidate", "items")).alias("_c"))
        ran = engine(missing.select(F.col("cache_key").alias("chunk_key"), "_c.candidate", "_c.items"))
        ran = ran.select(F.col("chunk_key").alias("cache_key"), F.struct("cause", "tuples").alias("_ran"))
        told = seen.join(ran, "cache_key", "left")
        tuples = F.when(F.col("hit"), F.from_json("output", f"array<{TUPLE}>")).otherwise(F.col("_ran.tuples"))
        cause = F.when(F.col("hit"), None).when(F.col("_ran").isNull(), "no answer").otherwise(F.col("_ran.cause"))
        pieces = F.filter(split(F.col("items")), lambda p: F.size(p) > 0)
        told = told.withColumns({"round": F.lit(n), "cached": F.col("hit"), "cause": cause, "tuples": F.when(cause.isNull(), tuples), "_pieces": pieces})
        again = (F.col("cause") == retry) & (F.size("_pieces") > 1) & F.lit(n < rounds)
        told.select(*columns, "cache_key", F.coalesce(again, F.lit(False)).alias("again"), F.when(again, F.col("_pieces")).alias("pieces")).write.parquet(f"{progress}/round={n}")
        told = spark.read.parquet(f"{progress}/round={n}").withColumn("round", F.lit(n))
        S.put(told.where("cause IS NULL AND NOT cached").select("cache_key", F.to_json("tuples").alias("output")), store, agent, now, digits)
        left = told.where("again")
        if left.isEmpty():
            break
        open_ = left.select("candidate", "chunk", "piece", F.posexplode("pieces").alias("at", "items")).select("candidate", "chunk", F.concat_ws(".", F.nullif("piece", F.lit("")), F.col("at").cast("string")).alias("piece"), "items")
    settled = spark.read.parquet(progress).where("NOT again")
    whole = settled.groupBy("candidate", "chunk").agg(F.bool_and(F.col("cause").isNull()).alias("complete"), F.max("round").alias("last"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.transform(F.split("piece", r"\."), lambda p: p.try_cast("int")).alias("at"), F.coalesce("tuples", F.array().cast(f"array<{TUPLE}>")).alias("t")))), lambda x: x["t"])).alias("tuples"))
    complete = parts.join(whole.where("complete AND last > 0").drop("complete", "last"), ["candidate", "chunk"]).select(chunk_key(aspects).alias("cache_key"), F.to_json("tuples").alias("output"))
    S.put(complete, store, agent, now, digits)
    return settled.select(*columns)


def outcomes(settled: DataFrame) -> DataFrame:
    """One row an item: candidate, chunk, item_id, ok, cause (null for a success) and the round it was settled in."""
    return settled.select("candidate", "chunk", F.explode("items.item_id").alias("item_id"), F.col("cause").isNull().alias("ok"), "cause", "round")


def failures(settled: DataFrame) -> DataFrame:
    """Pieces and items that failed, by cause."""
    return settled.where("cause IS NOT NULL").groupBy("cause").agg(F.count("*").alias("pieces"), F.sum(F.size("items")).cast("long").alias("items"))


def rule_engine(labels: list[tuple[str, str]], most_chars: int, broken: str) -> Engine:
    """A deterministic engine: one tuple for each label whose keyword an item holds; more than `most_chars` time out, an item that matches `broken` breaks the answer."""

    def run(parts: DataFrame) -> DataFrame:
        cause = F.when(chars("items") > most_chars, "timeout").when(F.exists("items", lambda i: i["text"].rlike(broken)), "schema")
        found = F.flatten(F.transform("items", lambda i: F.filter(F.array(*[F.when(i["text"].contains(k), F.struct(i["item_id"].alias("item_id"), F.lit(name).alias("label"))) for name, k in labels]), lambda t: t.isNotNull())))
        return parts.select("chunk_key", cause.alias("cause"), found.alias("tuples"))

    return run
