"""Classification with pluggable engines: a rule engine by default, or any function over Arrow batches.

The reference behaviour of these operators is a call to an outside model. An engine here is a function from a pandas frame of
rows to a frame of results; the default engines are the deterministic rules, as Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..sources import cache as C

Engine = Callable[[pd.DataFrame], pd.DataFrame]


def run(rows: DataFrame, engine: Engine, schema: str) -> DataFrame:
    """An engine over Arrow batches of rows; rows in and out need not be as many."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield engine(part)

    return rows.mapInPandas(batches, schema)


def run_cached(rows: DataFrame, engine: Engine, entries: DataFrame, agent: str, now, *columns: str, ttl_hours: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows with their output, new results to store): only rows that the cache lacks reach the engine.

    The engine gets cache_key and `columns` of distinct keys, and returns cache_key and output.
    """
    looked = C.lookup(C.keyed(rows, agent, *columns), entries, agent, now, ttl_hours)
    missing = looked.where("NOT hit").select("cache_key", *columns).dropDuplicates(["cache_key"])
    new = run(missing, engine, "cache_key string, output string")
    made = looked.join(new.withColumnRenamed("output", "_new"), "cache_key", "left").withColumn("output", F.coalesce("output", "_new")).drop("_new")
    return made, new


def prescreen(threads: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """Keep and grade of each thread (text): 2 with a keyword, else 0."""
    hit = X.has_any("text", list(keywords))
    return threads.withColumn("keep", hit).withColumn("score", F.when(hit, 2).otherwise(0))


def extract_units(threads: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """One unit per thread, on the first keyword of its text, and one question where it asks."""
    term = X.first_keyword("text", keywords)
    base = threads.select("thread_id", term.alias("target_term"), F.substring("text", 1, 120).alias("quote"), F.col("text").rlike(L.QUESTION_END).alias("asks"))
    unit = F.struct(F.lit("unit").alias("kind"), F.lit("neutral").alias("polarity"))
    question = F.struct(F.lit("question").alias("kind"), F.lit(None).cast("string").alias("polarity"))
    return base.select("thread_id", "target_term", "quote", F.explode(F.when(F.col("asks"), F.array(unit, question)).otherwise(F.array(unit))).alias("x")).select("thread_id", "target_term", "quote", "x.*")


def cluster_terms(units: DataFrame, rules: Iterable[tuple[str, Iterable[str]]], other: str = "uncategorized") -> DataFrame:
    """Label of each distinct term, its count and first quote."""
    terms = units.groupBy("target_term").agg(F.count("*").alias("n"), F.min("quote").alias("quote"))
    return terms.withColumn("cluster", X.first_match("target_term", rules, other))


def canonical_labels(labels: DataFrame, canonical: DataFrame) -> DataFrame:
    """Labels under their canonical form where one is known."""
    return labels.join(canonical, "label", "left").withColumn("label", F.coalesce("canonical", "label")).drop("canonical")


def super_clusters(clusters: DataFrame, rules: Iterable[tuple[str, Iterable[str]]], most: int = 12) -> DataFrame:
    """Upper label of each cluster by rules; beyond the `most` most frequent ones all are other."""
    named = clusters.groupBy("cluster").agg(F.sum("n").alias("n")).withColumn("super", X.first_match("cluster", rules, L.OTHER))
    ranked = named.groupBy("super").agg(F.sum("n").alias("k")).withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("k"), "super")))
    return named.join(ranked.select("super", "_rn"), "super").select("cluster", "n", F.when(F.col("_rn") <= most, F.col("super")).otherwise(L.OTHER).alias("super"))


def guarded(rows: DataFrame, column: str, allowed: Iterable[str], default: str = "other") -> DataFrame:
    """Values of an enumeration; others, and missing ones, become the default."""
    return rows.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(default))


def map_questions(questions: DataFrame, axes: DataFrame) -> DataFrame:
    """Axis of each question: of the labels with a token in the quote, the first by rank; else other.

    Labels are a small dimension; their tokens are met by an equi-join with the quote's words.
    """
    t = axes.select("axis", "rank", F.explode(X.tokens("axis")).alias("token"))
    words = questions.select("question_id", F.explode(F.array_distinct(F.split(F.lower("quote"), L.LABEL_SPLIT))).alias("token"))
    best = words.join(t, "token").groupBy("question_id").agg(F.min_by("axis", "rank").alias("_axis"))
    return questions.join(best, "question_id", "left").withColumn("aspect", F.coalesce("_axis", F.lit(L.OTHER))).drop("_axis")


def assigned(units: DataFrame, clusters: DataFrame, supers: DataFrame) -> DataFrame:
    """Units with the cluster of their term and its upper label; a cached axis is passed as `supers`."""
    return units.join(clusters.select("target_term", "cluster"), "target_term", "left").join(supers.select("cluster", F.col("super").alias("aspect")), "cluster", "left").na.fill(L.OTHER, ["aspect"])


def repaired(outputs: DataFrame, schema: str) -> DataFrame:
    """Model output that is a bare array, or an object that wraps it in `features`, as one array column."""
    bare = F.from_json("output", f"array<struct<{schema}>>")
    wrapped = F.from_json("output", f"struct<features: array<struct<{schema}>>>")["features"]
    return outputs.withColumn("features", F.when(F.ltrim("output").startswith("["), bare).otherwise(wrapped))
