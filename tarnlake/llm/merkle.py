"""Merkle manifest of a table: a tree of hashes for each group of rows, one root above them, proofs of every row.

Each sorted partition numbers its rows. A pass over rows with known numbers keeps a stack of peaks, one list of unfinished
siblings a level: FANOUT of them carry into the level above, and what a run of consecutive rows cannot finish itself, at its
two ends, is left open. Open nodes, a few a level and run, are merged level by level in DataFrame operations, which also
hash the short last run of each level without any padding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut, forget

FANOUT = 8
#: Levels of a tree that one task rebuilds at once for proofs: FANOUT**BLOCK_LEVELS leaves.
BLOCK_LEVELS = 3
#: What a document's leaf holds, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "array<struct<before:string,after:string>>"


def leaf_hash(*values: Column) -> Column:
    """Hex sha256 of a row's values, each `-` if null, else its number of UTF-8 bytes, a colon and the value."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[one(v.cast("string")) for v in values]), 256)


def group_key(group: Column) -> Column:
    """A group's name as a key that is never null: null sorts first, others by their bytes."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


@dataclass
class Forest:
    """Trees over the rows of each group; all tables but `rows` and `inner` hold a few rows a run of consecutive leaves."""

    rows: DataFrame  # key, index within the key and the columns of the leaves
    totals: DataFrame  # key, n
    inner: DataFrame  # key, level, idx, hash: nodes that a run finished, their parent among them
    outer: DataFrame  # key, n, level, idx, hash: all others, leaves at level 0 included
    depth: int  # levels of the largest tree above its leaves

    def tops(self) -> DataFrame:
        """key, n, level and hash of each tree's root."""
        return self.outer.where(F.col("n") <= F.pow(F.lit(float(FANOUT)), "level"))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """`leaves` in the order of key and `order`, in range partitions, with part, pos within part and key, and whether the key is its part's first.

    Rows alike in all of `order` come in the order of `salt`, a number of the row that has to be fixed already.
    """
    by = ["key", *order, "salt"]
    dealt = leaves.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt")
    schema = T.StructType(dealt.schema.fields[:]).add("part", "integer").add("pos", "long").add("first", "boolean")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, n = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy(zero_copy_only=False)
            starts = np.concatenate([[True], key[1:] != key[:-1]])
            if key[0] == last:
                starts[0] = False
            else:
                n = 0
            first = key[0] if first is None else first
            at = np.arange(len(key))
            begun = np.maximum.accumulate(np.where(starts, at, -1))
            pos = np.where(begun < 0, n + at, at - begun)
            last, n = key[-1], int(pos[-1]) + 1
            more = [pa.array(np.full(len(key), part, np.int32)), pa.array(pos.astype(np.int64)), pa.array(key == first, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "pos", "first"])

    return dealt.mapInArrow(number, schema)


def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, index, hash) to nodes (key, level, idx, hash, open): one stack of peaks a run of consecutive rows."""
    stack: list[list[tuple[int, bytes]]] = []
    at: tuple[str, int] | None = None
    made: list[tuple[str, int, int, bytes, bool]] = []

    def leave_open(key: str, level: int) -> None:
        made.extend((key, level, i, h, True) for i, h in stack[level])
        stack[level].clear()

    def push(key: str, level: int, i: int, digest: bytes) -> None:
        while True:
            if level == len(stack):
                stack.append([])
            stack[level].append((i, digest))
            if (i + 1) % FANOUT:
                return
            if len(stack[level]) < FANOUT:  # the others lie in the run before
                leave_open(key, level)
                return
            siblings = stack[level]
            if level:
                made.extend((key, level, j, h, False) for j, h in siblings)
            digest = hashlib.sha256("".join(h.hex() for _, h in siblings).encode()).digest()
            siblings.clear()
            level, i = level + 1, i // FANOUT

    def out() -> pa.RecordBatch:
        columns = list(zip(*made)) if made else [[]] * 5
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()))], names=["key", "level", "idx", "hash", "open"])

    for batch in batches:
        for key, i, digest in zip(batch.column("key").to_pylist(), batch.column("index").to_pylist(), batch.column("hash").to_pylist()):
            if at is not None and at != (key, i - 1):
                for level in range(len(stack)):
                    leave_open(at[0], level)
            push(key, 0, i, digest)
            at = key, i
        yield out()
    if at is not None:
        for level in range(len(stack)):
            leave_open(at[0], level)
        yield out()


def _hex(h: Column) -> Column:
    return F.lower(F.hex(h))


def _parent(siblings: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("", F.transform(siblings, lambda x: _hex(x["hash"]))), 256))


def _siblings() -> Column:
    return F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("siblings")  # FANOUT at most


def grow(leaves: DataFrame, order: list[str]) -> Forest:
    """Trees over `leaves` (key, hash, salt and more; a table made by cut(), deleted here), by key, in the order of `order`."""
    placed = cut(numbered(leaves, order))
    forget(leaves)
    counts = placed.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition at most
    offsets = counts.select("part", "first", before.alias("offset")).where("first").select("part", "offset")  # one row a partition
    totals = cut(counts.groupBy("key").agg(F.sum("n").alias("n")))
    index = F.col("pos") + F.when(F.col("first"), F.col("offset")).otherwise(0)
    rows = placed.join(F.broadcast(offsets), "part").select("key", index.alias("index"), *[c for c in leaves.columns if c not in ("key", "salt")])
    nodes = cut(rows.select("key", "index", "hash").mapInArrow(peaks, "key string, level int, idx long, hash binary, open boolean"))
    most = totals.agg(F.max("n")).first()[0] or 1
    depth = 0
    while FANOUT**depth < most:
        depth += 1
    edges = cut(nodes.where("open").drop("open").join(totals, "key").select("key", "n", "level", "idx", "hash"))
    made, below = [edges], None
    for level in range(depth):
        here = edges.where(F.col("level") == level)
        here = here if below is None else here.unionByName(below)
        up = here.where(F.col("n") > FANOUT**level).groupBy("key", "n", F.expr(f"idx div {FANOUT}").alias("idx")).agg(_siblings())
        below = up.select("key", "n", F.lit(level + 1).alias("level"), "idx", _parent(F.col("siblings")).alias("hash"))
        made.append(below)
    outer = made[0]
    for more in made[1:]:
        outer = outer.unionByName(more)
    outer = cut(outer)
    forget(edges)
    return Forest(rows, totals, nodes.where("NOT open").drop("open"), outer, depth)


def paths(forest: Forest, level: int, above: DataFrame | None = None) -> DataFrame:
    """key, n, idx, path and top of the nodes at `level`: siblings left and right of each node on the way up, then those of `above` (key, path).

    A tree that ends at `level` or below it has one row, at idx 0, with the path from its root.
    """
    tops = forest.tops().select("key", "n", "level", F.lit(0).cast("long").alias("idx"), F.col("hash").alias("top"))
    tops = tops.withColumn("path", F.array().cast(_STEP)) if above is None else tops.join(above, "key")
    every = forest.outer.where("level > 0").select("key", "level", "idx", "hash").unionByName(forest.inner.where(F.col("level") >= level))
    if not level:
        every = every.unionByName(forest.rows.select("key", F.lit(0).alias("level"), F.col("index").alias("idx"), "hash"))
    columns = ["key", "n", "idx", "top", "path"]
    down = None
    for here in range(forest.depth - 1, level - 1, -1):
        parents = tops.where(F.col("level") == here + 1).select(columns)
        parents = parents if down is None else parents.unionByName(down)
        groups = every.where(F.col("level") == here).groupBy("key", F.expr(f"idx div {FANOUT}").alias("idx")).agg(_siblings())
        both = groups.join(parents, ["key", "idx"]).select("key", "n", "top", "path", "siblings", F.explode("siblings").alias("x"))
        side = lambda keep: F.concat_ws("", F.transform(F.filter("siblings", keep), lambda y: _hex(y["hash"])))
        step = F.struct(side(lambda y: y["idx"] < F.col("x.idx")).alias("before"), side(lambda y: y["idx"] > F.col("x.idx")).alias("after"))
        down = both.select("key", "n", F.col("x.idx").alias("idx"), "top", F.concat(F.array(step), "path").alias("path"))
    low = tops.where(F.col("level") <= level).select(columns)
    return low if down is None else low.unionByName(down)


def _prove(rows: pa.Table, block: pa.Table) -> pa.Table:
    """Proofs of the leaves of one block, rebuilt from them, and the root that each received leaf leads to."""
    rows = rows.sort_by("index")
    level = [h.hex() for h in rows.column("hash").to_pylist()]
    about = block.slice(0, 1).to_pylist()[0]
    n, top, root = about["n"], about["top"].hex(), about["root"].hex()
    upper = [(s["before"], s["after"]) for s in about["path"]]
    suffix = "".join(b + a for b, a in upper)
    local = [level]
    for up in range(BLOCK_LEVELS):
        if n <= FANOUT**up:
            break
        level = [_sha("".join(level[i : i + FANOUT])) for i in range(0, len(level), FANOUT)]
        local.append(level)
    ends: dict[str, str] = {}

    def end(node: str) -> str:
        """The root that a node at the block's top leads to."""
        if node not in ends:
            now = node
            for b, a in upper:
                now = _sha(b + now + a)
            ends[node] = now
        return ends[node]

    proofs, folded = [], []
    for i, got in enumerate(rows.column("received").to_pylist()):
        now, parts, at = got.hex(), [], i
        for nodes in local[:-1]:
            lo = at - at % FANOUT
            b, a = "".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + FANOUT])
            parts += b, a
            now, at = _sha(b + now + a), at // FANOUT
        proofs.append(_sha("".join(parts) + suffix))
        folded.append(end(now))
    size = len(proofs)
    return pa.table({"doc_id": rows.column("doc_id"), "leaf": pa.array(local[0]), "subroot": pa.array([top] * size), "root": pa.array([root] * size), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded])})


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _leaves(docs: DataFrame, received: dict[str, Column]) -> DataFrame:
    own = leaf_hash(*[F.col(c) for c in FIELDS])
    changed = [~F.col(c).eqNullSafe(v) for c, v in received.items()]
    other = leaf_hash(*[received.get(c, F.col(c)) for c in FIELDS])
    some = changed[0] if changed else F.lit(False)
    for more in changed[1:]:
        some = some | more
    first = docs.select(group_key(F.col("lang")).alias("key"), "doc_id", own.alias("hash"), F.when(some, other).alias("other"))
    return first.select("key", "doc_id", F.unhex("hash").alias("hash"), F.unhex(F.coalesce("other", "hash")).alias("received"), F.monotonically_increasing_id().alias("salt"))


def _root(groups: Forest) -> Forest:
    """The tree over the groups' roots, in the order of the groups."""
    return grow(cut(groups.tops().select(F.lit("").alias("key"), F.col("key").alias("group"), "hash", F.lit(0).alias("salt"))), ["group"])


def manifest(docs: DataFrame) -> DataFrame:
    """Every node above the leaves: tree (`lang`, or `all` for the tree over the languages' roots), lang, level, idx, and hash in hex."""
    groups = grow(cut(_leaves(docs, {})), ["doc_id", "hash"])
    above = _root(groups)
    nodes = lambda f, kind: f.outer.where("level > 0").select(F.lit(kind).alias("tree"), "key", "level", "idx", "hash").unionByName(f.inner.select(F.lit(kind).alias("tree"), "key", "level", "idx", "hash"))
    both = nodes(groups, "lang").unionByName(nodes(above, "all"))
    return both.select("tree", F.when(F.col("key").startswith("1"), F.expr("substring(key, 2)")).alias("lang"), "level", "idx", _hex(F.col("hash")).alias("hash"))


def prove(docs: DataFrame, received: dict[str, Column] | None = None) -> DataFrame:
    """A proof for every row, and whether what was received of it leads to the root.

    doc_id, leaf, subroot, root, proof_sha256 (of all siblings on the way to the root), folded_root and verified. `received`
    gives columns of FIELDS as they arrived; others arrived unchanged. Null languages are a group of their own, the first;
    null ids come first in their group; rows that share an id come in the order of their hashes, and equal rows have leaves
    of their own. Null and empty texts differ. An empty table has no root and gives no rows. Other columns are not read.

    Texts are hashed once, where they are read; from then on a row is its id and 64 bytes of hashes. These are sorted into
    range partitions, so that one language may hold all rows; the only broadcast is of one number a partition.
    """
    kind = docs.schema["doc_id"].dataType
    groups = grow(cut(_leaves(docs, received or {})), ["doc_id", "hash"])
    above = _root(groups)
    ways = paths(above, 0).select("idx", "path", F.col("top").alias("root"))
    named = above.rows.select("group", F.col("index").alias("idx")).join(ways, "idx").select(F.col("group").alias("key"), "path", "root")
    blocks = paths(groups, BLOCK_LEVELS, named.select("key", "path")).join(named.select("key", "root"), "key")
    dealt = groups.rows.withColumn("block", F.expr(f"index div {FANOUT**BLOCK_LEVELS}"))
    schema = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean".format(kind.simpleString())
    return dealt.groupBy("key", "block").cogroup(blocks.select("key", F.col("idx").alias("block"), "n", "top", "path", "root").groupBy("key", "block")).applyInArrow(_prove, schema)
