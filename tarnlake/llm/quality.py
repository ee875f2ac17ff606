"""Quality classifier: gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from ._shared import crc32_of, cut, free, map_batches

#: Statistics of a text, in the order of document_statistics().
STATISTICS = (
    "log_chars log_words word_chars upper digit point symbol pipe newline space other_ascii non_ascii entropy distinct_words "
    "top_word upper_words symbol_words longest_word log_lines line_words repeated_lines"
).split()
#: Fitted on at most so many labelled rows, the first in the order of a hash of doc_id.
TRAIN_ROWS = 20_000

_CLASS = np.full(256, 7)
_CLASS[128:] = 8
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), (b"0123456789", 1), (b".,;:!?'\"()-", 2), (b"#$%&*+/<=>@[\\]^_`{}~", 3), (b"|", 4), (b"\n\r", 5), (b" \t", 6), (b"abcdefghijklmnopqrstuvwxyz", 9)):
    _CLASS[list(_chars)] = _kind
_SYMBOL = frozenset(b"#$%&*!|")


def document_statistics(text: str | None) -> np.ndarray:
    """The STATISTICS of a whole text, from its bytes; null counts as empty, and an empty text gives zeros."""
    raw = (text or "").encode()
    out = np.zeros(len(STATISTICS))
    words = raw.split()
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=10) / len(raw)
    p = counts[counts > 0] / len(raw)
    lines = raw.split(b"\n")
    n = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    out[:13] = [np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, *share[[0, 1, 2, 3, 4, 5, 6, 7, 8]], -(p * np.log2(p)).sum()]
    upper = symbol = 0
    for w, k in seen.items():
        upper += k * w.isupper()
        symbol += k * (w[-1] in _SYMBOL)
    out[13:18] = [len(seen) / n, max(seen.values(), default=0) / n, upper / n, symbol / n, max(map(len, seen), default=0)]
    out[18:] = [np.log1p(len(lines)), len(words) / len(lines), 1 - len(set(lines)) / len(lines)]
    return out


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns `keep` of every row of `docs` and its statistics as an array of doubles."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def fn(batch):
        stats = [document_statistics(t) for t in batch.column("text").to_pylist()]
        return {k: batch.column(k) for k in keep} | {"statistics": stats}

    return map_batches(docs.select(*keep, "text"), fn, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "statistics array<double>"]))


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labels that may be learnt from: crc32(doc_id) mod 3 is not 1, null labels left out, the lowest of a document's labels."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.where(crc32_of("doc_id") % 3 != 1)


def first_by_hash(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """At most `most` rows, first in the order of a hash of doc_id. All but about twice as many are set aside before the sort."""
    h = F.xxhash64("doc_id")
    share = 2 * (most + 1000) / max(1, rows.count())
    if share < 1:
        rows = rows.where(h < int(-(1 << 63) + share * (1 << 64)))
    return rows.orderBy(h, "doc_id", *order).limit(most)


def fit(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> trees.Forest:
    """Fit on at most `train_rows` usable() labelled rows; `stats` has doc_id and statistics. The driver gets a few numbers of each."""
    known = stats.select("doc_id", "statistics").join(usable(labels), "doc_id")
    sample = first_by_hash(known, train_rows, "statistics").select("statistics", "quality").toPandas()
    x = np.stack(sample["statistics"]) if len(sample) else np.zeros((0, len(STATISTICS)))
    return trees.fit(x, sample["quality"].to_numpy(dtype=float))


def score_statistics(stats: DataFrame, forest: trees.Forest) -> DataFrame:
    """`stats` with a column score in place of statistics."""

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(forest.probability(np.stack(column)) if len(column) else [])

    return stats.withColumn("score", score("statistics")).drop("statistics")


def score_documents(docs: DataFrame, forest: trees.Forest, name: str = "score") -> DataFrame:
    """`docs` with the quality score of each whole text (0 to 1; null and empty texts are scored as empty)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(forest.probability(np.stack([document_statistics(t) for t in texts])) if len(texts) else [])

    return docs.withColumn(name, score("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`.

    The statistics of all documents are taken once and kept in the shared folder; training and scoring read them there. A
    null doc_id is scored like any other (its crc32 is that of empty text); repeated rows are each scored; columns beyond
    doc_id and text are not read. Without usable labels every score is 0.5.
    """
    stats = cut(statistics(docs, "doc_id"))
    scored = score_statistics(stats, fit(stats, labels))
    return scored.select("doc_id", (crc32_of("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score reaches `threshold`, with their columns unchanged.

    The labels to learn from are chosen first, so that statistics for the fit are taken of their documents alone.
    """
    ids = docs.select("doc_id").distinct()
    chosen = cut(first_by_hash(usable(labels).join(ids, "doc_id", "left_semi"), TRAIN_ROWS))
    forest = fit(statistics(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"), "doc_id"), chosen)
    name = free("score", docs)
    return score_documents(docs, forest, name).where(F.col(name) >= threshold).drop(name)
