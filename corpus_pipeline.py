"""Five stages from raw documents to packed training sequences, each written as Parquet and read by the next.

Stages keep the columns of documents, whatever else these hold, up to the last one, which gives a row a piece with its place. Null
and empty texts pass through all stages as they are and are packed as one end token; a null doc_id is an id like any other;
rows that share an id are told apart by their texts; equal rows are near-duplicates, of which one stays; an empty table gives
an empty result of the same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import lines, packing, pii, quality
from tarnlake.llm._shared import delete, read, shared_dir
from tarnlake.llm.queries import tokenizer_path

#: No stage can be written in SQL.
ORACLE_SQL = None
#: Bytes that Spark puts into an Arrow batch: texts lie in batches in the JVM and in Python at once, beside what is made of them.
ARROW_BYTES = "2m"
#: Differing bits of fingerprints up to which operator 3 links documents.
SIMHASH_BITS = 4


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return lines.drop_duplicate_lines(docs).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return lines.drop_similar_documents(docs, distance=SIMHASH_BITS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("lines", dedup_lines), ("near_duplicates", dedup_documents), ("personal_data", redact), ("packing", pack)]


def _through(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Callable]]) -> DataFrame:
    """Some first stages over the documents of `sf_dir`; a stage's table is deleted once the next one is written."""
    docs = read(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in stages:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:  # what follows reads the new table alone
            delete(spark, f"{place}/{before}")
        before = name
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages: the place of each piece of the kept and redacted texts."""
    return _through(spark, sf_dir, STAGES)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, to the training data itself: sequence_id, ids (at most 4096), and doc_ids and lengths of the pieces in order."""
    docs = _through(spark, sf_dir, STAGES[:-1])
    return packing.sequences(docs, tokenizer_path("word_bpe_49k.json"))
