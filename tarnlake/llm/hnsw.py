"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, cut

#: Least number of shards, and most vectors in one.
SHARDS, SHARD_ROWS = 8, 500_000
#: Links of a vector per level, and beams for building and for the first search.
LINKS, BUILD_BEAM, BEAM = 12, 32, 32
COSINE = 0.95
#: Share of a block's true links that the audited queries must find, and about how many queries of a shard are audited.
RECALL, AUDITED = 0.995, 2000
#: Queries that a task takes through a shard's graph, about.
SLICE_ROWS = 20_000
#: Numbers in a tile of exact products, and bytes in a row of a written graph.
TILE, ROW_BYTES = 8_000_000, 8_000_000


class Graph:
    """A navigable small-world graph in arrays, built and searched for many vectors in step.

    Level 0 holds all vectors with 2 * LINKS links, each level above about one LINKS-th of those below. Vectors are added in
    blocks: each block is searched in the graph so far and in itself, and links to the nearest vectors that are not nearer
    to one already chosen; links are mutual, and lists that overflow are chosen anew by the same rule.
    """

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(self.x)
        u = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(1 - u) / np.log(LINKS)).astype(int), 8)
        self.order = np.argsort(-level, kind="stable")
        self.levels = [self.order[: int((level >= k).sum())] for k in range(int(level.max(initial=0)) + 1)]
        self.links = [np.full((n if not k else 0, 2 * LINKS), -1, np.int32) if not k else np.full((n, LINKS), -1, np.int32) for k in range(len(self.levels))]
        done, size = 0, 64
        while done < n:
            block = self.order[done : done + size]
            self._add(block, level, done)
            done += len(block)
            size = min(1024, max(64, done // 2))

    def arrays(self) -> dict[str, np.ndarray]:
        """What restored() needs, by name."""
        return {"x": self.x, "order": self.order[:1], **{f"links{k}": v for k, v in enumerate(self.links)}}

    @classmethod
    def restored(cls, arrays: dict[str, np.ndarray]) -> Graph:
        graph = cls.__new__(cls)
        graph.x, graph.order = arrays["x"], arrays["order"]
        graph.links = [arrays[f"links{k}"] for k in range(len(arrays) - 2)]
        return graph

    def _add(self, block: np.ndarray, level: np.ndarray, done: int) -> None:
        start = np.full(len(block), self.order[0]) if done else None
        for k in range(len(self.links) - 1, -1, -1):
            mine = level[block] >= k
            if done:
                beam = BUILD_BEAM if mine.any() else 1
                ids, sims = self._beam(self.x[block], start, k, beam)
                start = ids[:, 0]
            if not mine.any():
                continue
            rows = block[mine]
            inner = self.x[rows] @ self.x[rows].T
            np.fill_diagonal(inner, -2)
            near = min(LINKS, len(rows) - 1)
            top = np.argpartition(-inner, near - 1, axis=1)[:, :near] if near else np.zeros((len(rows), 0), int)
            cand, sim = rows[top].astype(np.int64), np.take_along_axis(inner, top, axis=1)
            if done:
                cand, sim = np.concatenate([ids[mine], cand], axis=1), np.concatenate([sims[mine], sim], axis=1)
            if not cand.shape[1]:
                continue
            chosen = self._choose(cand, sim, LINKS)
            self.links[k][rows, : chosen.shape[1]] = chosen
            self._mutual(k, rows, chosen)

    def _choose(self, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates the nearest that are nearer to the row than to any chosen before; then the nearest left."""
        order = np.argsort(-np.where(cand < 0, -3, sim), axis=1, kind="stable")[:, : 3 * most]
        cand, sim = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sim, order, axis=1)
        again = np.zeros(cand.shape, bool)
        for j in range(1, cand.shape[1]):
            again[:, j] = (cand[:, :j] == cand[:, j : j + 1]).any(axis=1)
        v = self.x[np.maximum(cand, 0)]
        gram = np.einsum("rid,rjd->rij", v, v)
        usable = (cand >= 0) & ~again
        keep = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            crowded = (keep[:, :j] & (gram[:, j, :j] > sim[:, j : j + 1])).any(axis=1)
            keep[:, j] = usable[:, j] & ~crowded & (keep.sum(axis=1) < most)
        rank = np.where(keep, 0, np.where(usable, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        first = np.argsort(rank, axis=1)[:, :most]
        return np.where(np.take_along_axis(usable, first, axis=1), np.take_along_axis(cand, first, axis=1), -1)

    def _mutual(self, k: int, rows: np.ndarray, chosen: np.ndarray) -> None:
        src, dst = np.repeat(rows, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        sim = np.einsum("id,id->i", self.x[src], self.x[dst])
        order = np.lexsort((-sim, dst))
        src, dst = src[order], dst[order]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = self.links[k].shape[1]
        place = np.arange(len(dst)) - np.repeat(first, count)
        ok = place < width
        new = np.full((len(to), width), -1, np.int64)
        new[np.repeat(np.arange(len(to)), count)[ok], place[ok]] = src[ok]
        cand = np.sort(np.concatenate([self.links[k][to], new], axis=1), axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        full = (cand >= 0).sum(axis=1) > width
        packed = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), axis=1)[:, :width]
        if full.any():
            c = cand[full]
            packed[full] = self._choose(c, np.einsum("rid,rd->ri", self.x[np.maximum(c, 0)], self.x[to[full]]), width)
        self.links[k][to] = packed

    def _beam(self, queries: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest found at level k for each query, nearest first; -1 where there are fewer."""
        n, q = len(self.x), len(queries)
        step = max(1, min(512, 64_000_000 // n))
        if q > step:
            parts = [self._beam(queries[i : i + step], start[i : i + step], k, beam) for i in range(0, q, step)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -4, np.float32)
        ids[:, 0], sims[:, 0] = start, np.einsum("qd,qd->q", self.x[start], queries)
        open_ = np.zeros((q, beam), bool)
        open_[:, 0] = True
        seen = np.zeros((q, n), bool)
        seen[np.arange(q), start] = True
        live = np.arange(q)
        while len(live):
            best = np.where(open_[live], sims[live], -9).argmax(axis=1)
            at = ids[live, best]
            open_[live, best] = False
            near = self.links[k][at].astype(np.int64)
            row = np.broadcast_to(live[:, None], near.shape)
            fresh = (near >= 0) & ~seen[row, near]
            seen[row[fresh], near[fresh]] = True
            some = fresh.any(axis=1)
            r = live[some]
            if len(r):
                f, nb = fresh[some], near[some]
                sim = np.where(f, np.einsum("qmd,qd->qm", self.x[np.maximum(nb, 0)], queries[r]), -4).astype(np.float32)
                all_s = np.concatenate([sims[r], sim], axis=1)
                top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
                sims[r] = np.take_along_axis(all_s, top, axis=1)
                ids[r] = np.take_along_axis(np.concatenate([ids[r], np.where(f, nb, -1)], axis=1), top, axis=1)
                open_[r] = np.take_along_axis(np.concatenate([open_[r], f], axis=1), top, axis=1)
            live = live[open_[live].any(axis=1)]
        return ids, sims

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full(len(queries), self.order[0])
        for k in range(len(self.links) - 1, 0, -1):
            start = self._beam(queries, start, k, 1)[0][:, 0]
        return self._beam(queries, start, 0, min(beam, len(self.x)))

    def _exact(self, queries: np.ndarray, floor: float) -> list[np.ndarray]:
        """For each query the vectors at `floor` or above, all compared, a tile at a time."""
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in queries]
        step = max(1, TILE // max(1, len(queries)))
        for at in range(0, len(self.x), step):
            q, v = np.nonzero(queries @ self.x[at : at + step].T >= floor)
            for i, hits in zip(*np.unique(q, return_index=True), strict=True):
                n = np.searchsorted(q, i, side="right")
                parts[i].append(v[hits:n] + at)
        return [np.concatenate(p) for p in parts]

    def links_above(self, queries: np.ndarray, cosine: float, audited: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs whose cosine reaches `cosine`, verified in double precision.

        The beam is doubled for the queries whose beam ended above the threshold, since more links may lie beyond it. It is
        doubled for all queries of the block while the audited ones, compared with every vector, lack more than 1 - RECALL of
        their links; those still to be widened have no say in that, as their beams are too short for their links.
        """
        q64, floor = queries.astype(np.float64), cosine - 1e-5
        exact = self._exact(queries[audited], floor)
        beam, todo = BEAM, np.arange(len(queries))
        short = np.zeros(len(queries), bool)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int))] * len(queries)
        while len(todo):
            ids, sims = self.search(queries[todo], beam)
            ok = (ids >= 0) & (sims >= floor)
            for i, t in enumerate(todo):
                hit = ids[i][ok[i]]
                found[t] = (np.full(len(hit), t), hit)
            if beam >= len(self.x):
                break
            short[todo] = ok.all(axis=1)
            judged = [(j, t) for j, t in enumerate(audited) if not short[t]]
            got, want = (sum(n) for n in ((len(np.intersect1d(exact[j], found[t][1])) for j, t in judged), (len(exact[j]) for j, _ in judged)))
            todo = np.arange(len(queries)) if got < RECALL * want else np.flatnonzero(short)
            beam *= 2
        q, v = (np.concatenate([f[i] for f in found]) for i in range(2))
        return q, v


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


_GRAPH = "n int, shard int, name string, part int, dtype string, shape array<int>, bytes binary"


def build(batches):
    """Rows of one task, sorted by shard: the shard's graph, ids and numbers of copies, in rows of bounded size."""

    def out(key: tuple[int, int], held: list) -> Iterator[pa.RecordBatch]:
        ids, copies, vectors = (np.concatenate([h[i] for h in held]) for i in range(3))
        exact = _unit(vectors)
        arrays = Graph(exact).arrays() | {"ids": ids, "copies": copies, "exact": exact}
        for name, array in arrays.items():
            raw = np.ascontiguousarray(array).tobytes()
            for part, at in enumerate(range(0, max(1, len(raw)), ROW_BYTES)):
                row = {"n": key[0], "shard": key[1], "name": name, "part": part, "dtype": array.dtype.str, "shape": list(array.shape), "bytes": raw[at : at + ROW_BYTES]}
                yield pa.RecordBatch.from_pylist([row], schema=_graph_schema())

    now, held = None, []
    for key, part in _runs(batches, "n", "shard"):
        if held and key != now:
            yield from out(now, held)
            held = []
        now = key
        held.append((part.column("id").to_numpy(), part.column("copies").to_numpy(), _vectors(part)))
    if held:
        yield from out(now, held)


def _graph_schema() -> pa.Schema:
    return pa.schema([("n", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("part", pa.int32()), ("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("bytes", pa.binary())])


def _runs(batches, *keys: str):
    """(key, rows) of the runs of equal keys within each batch."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(k).to_numpy() for k in keys]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _vectors(part: pa.RecordBatch) -> np.ndarray:
    return part.column("vector").flatten().to_numpy().reshape(part.num_rows, -1).astype(np.float64)


def _restored(rows: dict[str, list]) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    arrays = {name: np.frombuffer(b"".join(x[3] for x in sorted(parts, key=lambda x: x[0])), parts[0][1]).reshape(parts[0][2]) for name, parts in rows.items()}
    ids, copies, exact = (arrays.pop(k) for k in ("ids", "copies", "exact"))
    return Graph.restored(arrays), ids, copies, exact


def search(batches, cosine: float):
    """Rows of one task, sorted by shard and slice, a shard's graph before the queries: edges and link counts of the queries."""
    schema = pa.schema([("query", pa.int64()), ("n_links", pa.int64()), ("src", pa.int64()), ("dst", pa.int64())])
    now, rows, graph = None, {}, None
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for (*key, kind), part in _runs(batches, "n", "shard", "slice", "kind"):
        if key != now:
            now, rows, graph, parent = key, {}, None, {}
        if kind == 0:
            for r in part.select(["name", "part", "dtype", "shape", "bytes"]).to_pylist():
                rows.setdefault(r["name"], []).append((r["part"], r["dtype"], r["shape"], r["bytes"]))
            continue
        if graph is None and not rows:  # a shard without vectors
            continue
        if graph is None:
            graph, ids, weights, exact = _restored(rows)
            rows = {}
        mine, unit = part.column("id").to_numpy(), _unit(_vectors(part))
        audited = np.flatnonzero(part.column("audited").to_numpy(zero_copy_only=False))
        q, v = graph.links_above(unit.astype(np.float32), cosine, audited if len(audited) else np.arange(min(4, len(mine))))
        real = (mine[q] != ids[v]) & (np.einsum("id,id->i", unit[q], exact[v]) >= cosine)
        q, v = q[real], v[real]
        counts = np.bincount(q, weights=weights[v], minlength=len(mine)).astype(np.int64)
        src, dst = [], []
        for x, y in zip(mine[q].tolist(), ids[v].tolist(), strict=True):
            s, t = root(x), root(y)
            if s != t:
                parent[t] = s
                src.append(min(x, y))
                dst.append(max(x, y))
        some = np.flatnonzero(counts)
        if len(some):
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(mine[some]), pa.array(counts[some]), none, none], schema=schema)
        if src:
            none = pa.nulls(len(src), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(src, pa.int64()), pa.array(dst, pa.int64())], schema=schema)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, shards: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `embeddings`.

    Vectors link if their cosine, in double precision, is `cosine` or more; vectors of different lengths never do. Equal
    vectors are searched once and counted as often as they stand there. Distinct vectors of a length are dealt to shards by a
    hash. One task for each shard builds its graph, which is written to the shared folder; then each slice of the distinct
    vectors is taken through each shard's graph in a task of its own. A length has `shards` shards, more only once a shard
    would exceed SHARD_ROWS. Tasks give link counts, and spanning forests of links rather than all pairs.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, equal ones included. Repeated rows
    each have a result; a null vec_id never names a component; other columns are not read; an empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    good = F.col("vector").isNotNull() & finite
    key = F.when(good, F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + 0.0).cast("string"))), 256))
    keyed = cut(rows.select("vec_id", "vector", key.alias("key")))
    classes = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("id", F.xxhash64("key")).withColumn("n", F.size("vector")))
    many = F.greatest(F.lit(shards or SHARDS), F.ceil(F.col("rows") / SHARD_ROWS).cast("int"))
    sizes = cut(classes.groupBy("n").agg(F.count("*").alias("rows")).select("n", "rows", many.cast("int").alias("shards"), F.ceil(F.col("rows") / SLICE_ROWS).cast("int").alias("slices")))
    total = sizes.agg(F.sum("shards").alias("shards"), F.sum(F.col("shards") * F.col("slices")).alias("tasks")).first()
    sized = classes.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "n")
    held = sized.select("n", F.pmod(F.xxhash64("id", F.lit(3)), F.col("shards")).cast("int").alias("shard"), "id", "copies", "vector")
    dealt = held.repartitionByRange(max(1, total["shards"] or 1), "n", "shard").sortWithinPartitions("n", "shard", "id")
    graphs = cut(dealt.mapInArrow(build, _GRAPH))
    none = lambda kind: F.lit(None).cast(kind)
    slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    spread = graphs.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "n").select("n", "shard", slices, F.lit(0).alias("kind"), "name", "part", "dtype", "shape", "bytes", none("long").alias("id"), none("array<double>").alias("vector"), F.lit(False).alias("audited"))
    audit = F.pmod(F.xxhash64("id", F.lit(4)), F.col("rows")) < AUDITED
    asked = sized.select("n", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("id", F.lit(5)), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("kind"), *(none(t).alias(c) for c, t in (("name", "string"), ("part", "int"), ("dtype", "string"), ("shape", "array<int>"), ("bytes", "binary"))), "id", "vector", audit.alias("audited"))
    keys = ["n", "shard", "slice"]
    dealt = spread.unionByName(asked).repartitionByRange(max(1, total["tasks"] or 1), *keys).sortWithinPartitions(*keys, "kind", "id")
    found = cut(dealt.mapInArrow(lambda b: search(b, cosine), "query long, n_links long, src long, dst long"))
    member = cut(connected_components(found.where("src IS NOT NULL").select("src", "dst")))
    links = found.where("query IS NOT NULL").groupBy(F.col("query").alias("id")).agg(F.sum("n_links").alias("others"))
    named = classes.join(links, "id", "left").join(member, F.col("id") == F.col("node"), "left")
    named = cut(named.select("key", "first_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "component").select("key", "n_links", "component_id")
    out = keyed.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
