"""SimHash near-duplicates through a segment-popcount embedding and a grid range join."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import connected_components, cut, forget, free, map_batches, sorted_runs

#: 64 bits are cut into 32 segments of two bits.
SEGMENTS = 32
#: Unrelated points that a cell may be expected to hold before the grids are made finer.
STRANGERS = 4096
#: Cells with more members are split into chunks of about this size.
CHUNK = 1024
_EVEN = 0x5555555555555555
_ONES = 64


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of bytes other than ASCII space, tab to carriage return."""
    return (text or "").encode().lower().split()


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash over the XXH64 of all word shingles, repeats included; zero without words."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype=np.uint64, count=len(words) - shingle + 1)
    ones = np.zeros(_ONES, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and the fingerprint (a signed long) of every row; null and empty texts have fingerprint zero."""

    def fn(batch: pa.RecordBatch) -> dict:
        made = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()), dtype=np.uint64, count=batch.num_rows)
        return {"doc_id": batch.column("doc_id"), "fingerprint": made.view(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), fn, "doc_id long, fingerprint long")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 segments, each written in unary in its two bits (0, 01, 11).

    The Manhattan distance of two such count vectors is the number of differing bits of their codes, and is a lower bound
    of the Hamming distance of the fingerprints: swapping the two bits of a segment changes no count.
    """
    half, low = F.shiftrightunsigned(fp, 1), F.lit(_EVEN)
    some, both = fp.bitwiseOR(half).bitwiseAND(low), fp.bitwiseAND(half).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def grid(rows: int, distance: int, segments: int = SEGMENTS) -> list[int]:
    """Masks of the grid's cells over the embedding.

    Cutting the segments into b ranges, two vectors within Manhattan distance d agree in all counts of b - d ranges or
    more, so each choice of b - d ranges is one grid whose cells are the counts there. Every b gives the same result; two
    ranges to a cell do until a cell would hold more than STRANGERS unrelated points.
    """
    return _masks(rows, distance, segments, 1.4, distance + 2)


def block_grid(rows: int, distance: int) -> list[int]:
    """Like grid(), with the plain bits as coordinates: pigeonhole blocks."""
    return _masks(rows, distance, 64, 1.0, distance + 1)


def _masks(rows: int, distance: int, units: int, bits: float, ranges: int) -> list[int]:
    """`units` coordinates of about `bits` bits of information each, in `ranges` ranges or more."""
    while rows * 2.0 ** (-bits * units * (ranges - distance) / ranges) > STRANGERS and ranges < units:
        ranges += 1
    edges, width = [round(i * units / ranges) for i in range(ranges + 1)], 64 // units
    parts = [((1 << (width * b)) - 1) ^ ((1 << (width * a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, ranges - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(points: DataFrame, masks: list[int], code: Column, chunk: int = CHUNK) -> DataFrame:
    """One row for each point and grid: (grid, cell, a, b, point), to be grouped by the first four.

    Hot cells, found from a sixteenth of the points, are split: each point is dealt to a chunk of its cell and meets every
    chunk there in a task of its own, (a, b) being the two chunks. So no task holds more than about two chunks of a cell.
    """
    dealt = points.select("point", F.posexplode(F.array(*[code.bitwiseAND(F.lit(signed(m))) for m in masks])).alias("grid", "cell"))
    counted = dealt.where(F.pmod(F.xxhash64("point", F.lit(7)), F.lit(16)) == 0).groupBy("grid", "cell").count()
    hot = cut(counted.where(F.col("count") * 16 >= 2 * chunk).select("grid", "cell", F.ceil(F.col("count") * 16 / chunk).cast("int").alias("chunks")))
    many = hot.count()
    if not many:
        return dealt.select("grid", "cell", F.lit(0).alias("a"), F.lit(0).alias("b"), "point")
    found = dealt.join(F.broadcast(hot) if many <= 100_000 else hot, ["grid", "cell"], "left")
    mine = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("point", F.lit(11)), F.col("chunks")).cast("int"))
    found = found.withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1))
    return found.select("grid", "cell", "mine", other.alias("other"), "point").select("grid", "cell", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "point")


def _codes(x: np.ndarray) -> np.ndarray:
    half, low = x >> np.uint64(1), np.uint64(_EVEN)
    return ((x | half) & low) | (((x & half) & low) << np.uint64(1))


def links_in_runs(points: np.ndarray, starts: np.ndarray, distance: int, embed: bool = True) -> list[tuple[int, int]]:
    """A spanning forest, as row pairs, of the links (distance or fewer differing bits) inside each run of rows."""
    code = _codes(points) if embed else points
    size = np.diff(np.append(starts, len(points)))
    run = np.repeat(np.arange(len(starts)), size)
    small = size <= 128
    parent: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    live, step = np.flatnonzero(small[run]), 1
    while len(live):
        live = live[live + step < len(points)]
        live = live[run[live + step] == run[live]]
        near = live[np.bitwise_count(code[live] ^ code[live + step]) <= distance]
        near = near[np.bitwise_count(points[near] ^ points[near + step]) <= distance]
        for i in near.tolist():
            a, b = root(i), root(i + step)
            if a != b:
                parent[b] = a
                out.append((i, i + step))
        step += 1
    for k in np.flatnonzero(~small):
        rest = np.arange(starts[k], starts[k] + size[k])
        while len(rest):
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                hit = np.bitwise_count(code[rest] ^ code[at]) <= distance
                hit[hit] = np.bitwise_count(points[rest[hit]] ^ points[at]) <= distance
                met = rest[hit].tolist()
                out += [(at, x) for x in met]
                queue += met
                rest = rest[~hit]
    return out


def linked(points: DataFrame, rows: int, distance: int, embed: bool = True) -> DataFrame:
    """Edges (src, dst) that connect the same distinct longs `point` as all pairs with `distance` or fewer differing bits do.

    With `embed` the grid lies over the segment counts and the Manhattan bound is tested first; without, over the bits.
    Each task keeps a spanning forest of what it found in a cell, so edges grow with points and not with pairs.
    """
    code = embedding(F.col("point")) if embed else F.col("point")
    dealt = cells(points, grid(rows, distance) if embed else block_grid(rows, distance), code)
    keys = ["grid", "cell", "a", "b"]

    def run(batches):
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
        key = lambda b: np.rec.fromarrays([b.column(k).to_numpy() for k in keys])
        for block, starts in sorted_runs(batches, key):
            point = block.column("point").to_numpy()
            pairs = np.array(links_in_runs(point.view(np.uint64), starts, distance, embed), dtype=np.int64).reshape(-1, 2)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(point[pairs.min(axis=1)]), pa.array(point[pairs.max(axis=1)])], schema=schema)

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "point").mapInArrow(run, "src long, dst long")


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (src, dst) that connect the ids of `prints` (id, fingerprint) as all pairs with `distance` or fewer differing bits do.

    Each distinct fingerprint is compared once, by linked(); ids that share one are linked with the smallest of them.
    """
    prints = cut(prints)
    distinct = cut(prints.groupBy(F.col("fingerprint").alias("point")).agg(F.min("id").alias("first")))
    same = prints.join(distinct, F.col("fingerprint") == F.col("point")).select(F.col("first").alias("src"), F.col("id").alias("dst"))
    a, b = (distinct.select(F.col("point").alias(c), F.col("first").alias(f"{c}_first")) for c in ("src", "dst"))
    near = linked(distinct, distinct.count(), distance).join(a, "src").join(b, "dst").select(F.col("src_first").alias("src"), F.col("dst_first").alias("dst"))
    found = cut(same.unionByName(near).where("src <> dst").distinct())
    forget(prints, distinct)
    return found


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `docs`.

    Documents link if their fingerprints differ in `distance` bits or fewer; a component has the smallest doc_id that can be
    reached. Only distinct fingerprints are compared, so copies cost nothing. Null texts count as empty; all texts without
    words have fingerprint zero and are one group. Rows with a null doc_id have a result but never name a component, unless
    it has no other. Repeated rows are each returned; columns beyond doc_id and text are not read.
    """
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy(F.col("fingerprint").alias("point")).agg(F.min("doc_id").alias("first_id")))
    member = cut(connected_components(linked(distinct, distinct.count(), distance)))
    named = distinct.join(member, F.col("point") == F.col("node"), "left").select("point", "first_id", F.coalesce("component", "point").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = cut(named.join(lowest, "component").select(F.col("point").alias("fingerprint"), "component_id"))
    forget(distinct, member)
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """One document of each group of near_duplicates() stays: the one whose doc_id names the component.

    Of rows that repeat a doc_id the one with the smallest text stays. Rows with a null doc_id cannot be told apart by id:
    of those, one for each distinct text stays.
    """
    found = near_duplicates(docs, distance, shingle)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    same = F.when(F.col("doc_id").isNull(), F.sha2("text", 256))
    nth = free("_nth", docs)
    stay = docs.join(gone, "doc_id", "left_anti").withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", same).orderBy("text")))
    return stay.where(F.col(nth) == 1).select(docs.columns)
