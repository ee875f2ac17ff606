"""Removal of passages that already stand earlier in the corpus, by difference-cover anchors.

COVER is a difference cover modulo PERIOD: for any two places in two documents some shift below PERIOD takes both to places
of the cover. Two equal windows of `window` words so share an anchor, a shorter run of words that begins at such a place.
Anchors alone, three in seven places, are counted over the corpus; only around repeated ones are whole windows looked at.

The texts are written once, in compressed chunks, bucketed by chunk, so that what the corpus says about a chunk's anchors and
windows meets it there without moving a text again. Between them travel hashes: 5 bytes an anchor and chunk, 16 a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bucketed, free, small
from .lines import _hashed

#: Words of a passage.
WINDOW = 20
#: Every residue modulo PERIOD is a difference of two of these.
PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of texts in a chunk, if a text isn't longer; anchors in a bucket of their hashes.
CHUNK_BYTES, BUCKET_ANCHORS = 4_000_000, 1_000_000

_K, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bytes of an anchor's hash beside those that its bucket tells.
_BYTES = 5
_WINDOW = np.dtype([("high", "<u8"), ("low", "<u4"), ("start", "<u4")])
_ORDER = np.dtype([("first", "<u4"), ("doc", "<i8"), ("tie", "<i8")])
_LAST = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C
    x = (x ^ (x >> np.uint64(27))) * _D
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` words from each place on, by doubling; empty where there are fewer."""
    if len(words) < length:
        return words[:0]
    n = len(words) - length + 1
    power, size, out, done = words, 1, None, 0
    while True:
        if length & size:
            out = power[:n] if out is None else _mixed(out * _K + power[done : done + n])
            done += size
        if done == length:
            return out
        power = _mixed(power[:-size] * _K + power[size:])
        size *= 2


class Chunk:
    """Documents of a chunk as one row of word hashes, with what is looked up by place in it."""

    def __init__(self, texts: pa.Array, window: int):
        distinct, code, self.n = _hashed(texts)
        self.words, self.window, self.anchor = distinct[code], window, window - PERIOD + 1
        self.first = np.cumsum(self.n) - self.n
        place = np.arange(len(self.words)) - np.repeat(self.first, self.n)
        left = np.repeat(self.n, self.n) - place
        self.whole = left >= window
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        self.at = np.flatnonzero(cover[place % PERIOD] & (left >= self.anchor) & (np.repeat(self.n, self.n) >= window))
        hashes = run_hashes(self.words, self.anchor)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.anchors, self.which, self.count = np.unique(hashes, return_inverse=True, return_counts=True)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Places where a window begins that holds a repeated anchor."""
        there = np.zeros(len(self.words) + 1, np.int64)
        there[self.at[repeated[self.which]] + 1] = 1
        total = np.concatenate([np.cumsum(there), np.full(PERIOD, there.sum())])
        return np.flatnonzero(self.whole & (total[PERIOD : PERIOD + len(self.words)] > total[: len(self.words)]))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of the windows that begin at some places."""
        high = run_hashes(self.words, self.window)[at]
        low = np.zeros(len(at), np.uint64)
        for k in range(self.window):
            low += (self.words[at + k] ^ (self.words[at + k] >> np.uint64(29))) * (_mixed(np.full(1, k + 1, np.uint64))[0] | np.uint64(1))
        return high, (low >> np.uint64(32)).astype(np.uint32)


def _bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in hashes that ascend."""
    return np.searchsorted((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _as_before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[False], x[1:] == x[:-1]])[: len(x)]


def _among_equals(x: np.ndarray) -> np.ndarray:
    """Which of sorted values stand beside an equal one."""
    same = _as_before(x)
    return same | np.concatenate([same[1:], [False]])[: len(x)]


def _packed(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]


def _texts(batch: pa.RecordBatch, text: str) -> pa.Array:
    return pc.fill_null(batch.column(text), "")


def _chunked(docs: DataFrame, text: str) -> DataFrame:
    """Rows in chunks: chunk (a number of its own), words and rows (packed). Bucketed by chunk in the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in small(whole, CHUNK_BYTES)):
            if batch.num_rows:
                _, _, n = _hashed(_texts(batch, text))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([int(n.sum())]), pa.array([_packed(batch)], pa.binary())], names=["chunk", "words", "rows"])
                chunk += 1

    return bucketed(docs.mapInArrow(pack, "chunk long, words long, rows binary"), "chunk")


def _anchors(window: int, text: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in zip(batch.column("chunk").to_pylist(), batch.column("rows").to_pylist()):
                hashes = Chunk(_texts(_unpacked(rows), text), window).anchors
                bound = _bounds(hashes, buckets)
                some = np.flatnonzero(np.diff(bound))
                keys = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES])
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([chunk] * len(some), pa.int64()), pa.array([keys[bound[b] : bound[b + 1]].tobytes() for b in some], pa.binary())], names=["bucket", "chunk", "keys"])

    return run


def _repeated(rows: pa.Table) -> pa.Table:
    """Of each chunk's anchors of a bucket, as bits, which stand in another chunk too."""
    chunks, parts = rows.column("chunk").to_pylist(), [np.frombuffer(k, np.uint8).reshape(-1, _BYTES) for k in rows.column("keys").to_pylist()]
    wide = np.zeros((sum(map(len, parts)), 8), np.uint8)
    wide[:, :_BYTES] = np.concatenate(parts)
    keys = wide.view("<u8").ravel()
    order = np.argsort(keys, kind="stable")
    twice = np.zeros(len(keys), bool)
    twice[order] = _among_equals(keys[order])
    ends = np.cumsum([len(p) for p in parts])
    bits = [twice[end - len(p) : end] for p, end in zip(parts, ends)]
    some = [i for i, b in enumerate(bits) if b.any()]
    bucket = rows.column("bucket").to_pylist()
    return pa.table({"chunk": pa.array([chunks[i] for i in some], pa.int64()), "bucket": pa.array([bucket[i] for i in some], pa.int32()), "bits": pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary())})


def _windows(window: int, text: str, doc: str, tie: str, buckets: int):
    """Of each chunk the first window of each kind that holds a repeated anchor, by bucket, with the order of its document; and the others, which are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = _unpacked(row["rows"])
                c = Chunk(_texts(rows, text), window)
                bound = _bounds(c.anchors, buckets)
                repeated = c.count > 1
                for found in row["found"] or []:
                    lo, hi = bound[found["bucket"]], bound[found["bucket"] + 1]
                    repeated[lo:hi] |= np.unpackbits(np.frombuffer(found["bits"], np.uint8), count=hi - lo).astype(bool)
                at = c.candidates(repeated)
                if not len(at):
                    continue
                ids = pc.fill_null(rows.column(doc).cast(pa.int64()), _LAST).to_numpy()
                ties = rows.column(tie).to_numpy()
                rank = np.empty(len(ids), np.int64)
                rank[np.lexsort((ties, ids))] = np.arange(len(ids))
                owner = np.searchsorted(c.first, at, side="right") - 1
                at = at[np.lexsort((at, rank[owner]))]
                high, low = c.windows(at)
                order = np.lexsort((low, high))
                at, high, low = at[order], high[order], low[order]
                later = _as_before(high) & _as_before(low)
                out = []
                bound = _bounds(high, buckets)
                for b in np.flatnonzero(np.diff(bound)).tolist():
                    lo, hi = bound[b], bound[b + 1]
                    new = np.flatnonzero(~later[lo:hi]) + lo
                    kept = np.empty(len(new), _WINDOW)
                    kept["high"], kept["low"], kept["start"] = high[new], low[new], at[new]
                    docs = np.unique(np.searchsorted(c.first, at[new], side="right") - 1)
                    known = np.empty(len(docs), _ORDER)
                    known["first"], known["doc"], known["tie"] = c.first[docs], ids[docs], ties[docs]
                    out.append((b, row["chunk"], kept.tobytes(), known.tobytes(), b""))
                if later.any():  # in a bucket that the chunk decides, so that a frequent passage doesn't bring its own together
                    out.append((int(_mixed(np.array([row["chunk"]], np.uint64))[0] % np.uint64(buckets)), row["chunk"], b"", b"", at[later].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "windows", "docs", "repeats"])

    return run


def _later(rows: pa.Table) -> pa.Table:
    """Of each chunk the places of its windows of a bucket that stand earlier, in another chunk or the same."""
    chunks = np.array(rows.column("chunk").to_pylist(), np.int64)
    parts = [np.frombuffer(w, _WINDOW) for w in rows.column("windows").to_pylist()]
    source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    w = np.concatenate(parts)
    order = np.argsort(w["high"], kind="stable")
    some = np.sort(order[_among_equals(w["high"][order])])  # a kind that one chunk alone has is new
    doc, tie = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
    cuts = np.searchsorted(source[some], np.arange(len(parts) + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        mine = slice(cuts[i], cuts[i + 1])
        known = np.frombuffer(rows.column("docs")[i].as_py(), _ORDER)
        of = np.searchsorted(known["first"], w["start"][some[mine]], side="right") - 1
        doc[mine], tie[mine] = known["doc"][of], known["tie"][of]
    by = np.lexsort((w["start"][some], chunks[source[some]], tie, doc, w["low"][some], w["high"][some]))
    some = some[by]
    gone = np.sort(some[_as_before(w["high"][some]) & _as_before(w["low"][some])])
    cuts = np.searchsorted(source[gone], np.arange(len(parts) + 1))
    places = [w["start"][gone[cuts[i] : cuts[i + 1]]].astype("<u4").tobytes() + r for i, r in enumerate(rows.column("repeats").to_pylist())]
    full = [i for i, p in enumerate(places) if p]
    return pa.table({"chunk": pa.array(chunks[full], pa.int64()), "places": pa.array([places[i] for i in full], pa.binary())})


def _without(window: int, text: str, names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, packed in zip(batch.column("found").to_pylist(), batch.column("rows").to_pylist()):
                rows = _unpacked(packed)
                gone = np.concatenate([np.frombuffer(p, "<u4") for p in found]).astype(np.int64) if found else np.zeros(0, np.int64)
                texts, n_words, n_removed = [], [], []
                split = [t.split() for t in _texts(rows, text).cast(pa.binary()).to_pylist()]
                n = np.array([len(s) for s in split], np.int64)
                edge = np.zeros(int(n.sum()) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + window, -1)
                keep = np.cumsum(edge)[:-1] == 0
                start = np.cumsum(n) - n
                for s, a, m in zip(split, start.tolist(), n.tolist()):
                    mine = keep[a : a + m]
                    if not mine.all():
                        s = [s[i] for i in np.flatnonzero(mine).tolist()]
                    texts.append(b" ".join(s))
                    n_words.append(m)
                    n_removed.append(m - len(s))
                made = dict(zip(names, (pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()))))
                columns = [made[f.name] if f.name in made else rows.column(f.name) for f in schema]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the words of passages that stand earlier, and n_words and n_removed of each row.

    A passage is any `window` consecutive words of a text (split at ASCII white space, otherwise unchanged) that also begin
    earlier: in a document with a smaller id, or before in the same one. All words of all such windows go, judged on the
    input; the kept words are joined by one space. Rows that share an id come in the order of a hash of their texts, rows
    without an id after all others, and of equal rows one keeps its words. Null texts are empty and have no words. Other
    columns pass through; n_words and n_removed take underscores where they clash. An empty table stays empty.

    A passage in many documents is one anchor and one window a chunk, so no bucket grows with the length of such a group.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window has more than {PERIOD} words")
    spark = docs.sparkSession
    tie = free("tie", docs)
    names = [text, free("n_words", docs), free("n_removed", docs)]
    chunks = _chunked(docs.withColumn(text, F.col(text).cast("string")).withColumn(tie, F.xxhash64(text)), text)
    words = chunks.agg(F.sum("words")).first()[0] or 0
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parallel, words * len(COVER) // PERIOD // BUCKET_ANCHORS)
    anchors = chunks.select("chunk", "rows").mapInArrow(_anchors(window, text, buckets), "bucket int, chunk long, keys binary")
    twice = anchors.groupBy("bucket").applyInArrow(_repeated, "chunk long, bucket int, bits binary")
    found = twice.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("found"))  # one a bucket at most
    near = chunks.select("chunk", "rows").join(found, "chunk", "left").mapInArrow(_windows(window, text, doc_id, tie, buckets), "bucket int, chunk long, windows binary, docs binary, repeats binary")
    later = near.groupBy("bucket").applyInArrow(_later, "chunk long, places binary")
    gone = later.groupBy("chunk").agg(F.collect_list("places").alias("found"))  # one a bucket at most
    from pyspark.sql.pandas.types import to_arrow_schema

    plain = docs.withColumn(text, F.col(text).cast("string")).withColumns({c: F.lit(0).cast("long") for c in names[1:]}).schema
    return chunks.select("chunk", "rows").join(gone, "chunk", "left").mapInArrow(_without(window, text, names, to_arrow_schema(plain)), plain)
