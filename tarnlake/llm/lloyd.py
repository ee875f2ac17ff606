"""Centroid clustering of embeddings: plain Lloyd rounds in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Clusters, rounds, components of a vector, and what a component is multiplied by before it is rounded down.
CLUSTERS, ROUNDS, COMPONENTS, SCALE = 8, 10, 64, 1024
#: Rows of which differences are taken at a time.
SLICE = 4096
#: Bits of the limbs in which sums travel: those of 2**23 partitions add up within 64 bits.
LIMB = 40
_LONG = 1 << 63


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Components times `scale`, rounded down: 64-bit integers where squared distances of such vectors fit, else Python's integers."""
    if np.abs(vectors).max(initial=0) * scale < widest(vectors.shape[1]):
        return np.floor(vectors * scale).astype(np.int64)
    ratios = ([x.as_integer_ratio() for x in row] for row in vectors.tolist())
    return np.array([[a * scale // b for a, b in row] for row in ratios], dtype=object)


def widest(components: int) -> int:
    """Components below this, in size, have squared distances and sums of SLICE rows within 64 bits."""
    return 1 << (61 - max(1, components - 1).bit_length()) // 2 - 1


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equals, and the squared distance to it."""
    apart = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = apart.argmin(axis=1) if apart.dtype != object else np.array([min(range(len(row)), key=row.__getitem__) for row in apart.tolist()], np.int64)
    return best, apart[np.arange(len(x)), best]


def _limbs(total: int) -> list[int]:
    """A sum in limbs of LIMB bits, lowest first; the last one has the sign."""
    out = []
    while not -(1 << LIMB) < total < 1 << LIMB:
        out.append(total & (1 << LIMB) - 1)
        total >>= LIMB
    return [*out, total]


def _slices(frames: Iterator[pd.DataFrame], vectors: str, centroids: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Slices of rows, their whole numbers, and the centroids in integers as wide."""
    wide = centroids.dtype == object
    for frame in frames:
        for at in range(0, len(frame), SLICE):
            part = frame.iloc[at : at + SLICE]
            x = whole_numbers(np.stack(part[vectors].to_numpy()).astype(np.float64))
            yield part, x.astype(object) if wide else x, centroids


def _fitting(centroids: list[list[int]]) -> np.ndarray:
    most = max((abs(x) for c in centroids for x in c), default=0)
    return np.array(centroids, np.int64 if most < widest(len(centroids[0])) else object)


def kept(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id and embedding, in doubles, of the vectors with just so many components, none of them null or non-finite."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", e.alias("embedding")).where((F.size("embedding") == components) & finite.eqNullSafe(True))


def seeds(rows: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """Whole numbers of the rows whose sha256 of `3:<vec_id>` is smallest, in that order; `clusters` rows reach the driver.

    Rows without vec_id come after all others; rows that share a vec_id come in the order of their components.
    """
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "embedding").limit(clusters).collect()
    return [whole_numbers(np.array([r["embedding"]], np.float64))[0].tolist() for r in first]


def sums(rows: DataFrame, centroids: list[list[int]]) -> dict[tuple[int, int], int]:
    """Sum of each component of the rows nearest to each centroid, and at component -1 their number.

    Each partition sums exactly and hands on one row for each cluster, component and limb; these merge by groupBy, and the
    merged ones, which are as few as components of centroids, reach the driver.
    """
    known = rows.sparkSession.sparkContext.broadcast(_fitting(centroids))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], int] = {}
        for _, x, c in _slices(frames, "embedding", known.value):
            cluster, _ = nearest(x, c)
            for k in np.unique(cluster).tolist():
                mine = x[cluster == k]
                for j, value in enumerate([len(mine), *mine.sum(axis=0).tolist()], -1):
                    total[k, j] = total.get((k, j), 0) + value
        made = [(k, j, i, limb) for (k, j), value in total.items() for i, limb in enumerate(_limbs(value))]
        yield pd.DataFrame(made, columns=["cluster", "component", "limb", "total"])

    merged = rows.select("embedding").mapInPandas(partial, "cluster int, component int, limb int, total long").groupBy("cluster", "component", "limb").agg(F.sum("total").alias("total"))
    out: dict[tuple[int, int], int] = {}
    for r in merged.collect():
        at = r["cluster"], r["component"]
        out[at] = out.get(at, 0) + (r["total"] << LIMB * r["limb"])
    known.unpersist()
    return out


def fit(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after so many rounds: each takes the componentwise floor of its rows' mean, those without rows stay."""
    centroids = seeds(rows, clusters)
    for _ in range(rounds if centroids else 0):
        found = sums(rows, centroids)
        centroids = [[found[k, j] // found[k, -1] for j in range(len(c))] if (k, -1) in found else c for k, c in enumerate(centroids)]
    return centroids


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and squared distance of each row; a distance that 64 bits don't hold is null."""
    kind = rows.schema["vec_id"].dataType
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false")
    known = rows.sparkSession.sparkContext.broadcast(_fitting(centroids))

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x, c in _slices(frames, "embedding", known.value):
            cluster, distance = nearest(x, c)
            whole = pd.array([d if d < _LONG else None for d in distance.tolist()], dtype="Int64")
            yield pd.DataFrame({"vec_id": part["vec_id"].array, "cluster": cluster.astype(np.int32), "distance": whole})

    named = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding")  # pandas would turn integers beside nulls into floats
    return named.mapInPandas(near, "vec_id string, cluster int, distance long").withColumn("vec_id", F.col("vec_id").cast(kind))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS) -> DataFrame:
    """Lloyd's clusters of the kept vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Every round reads the table anew, so that no lineage grows and nothing is held; centroids alone travel, by broadcast.
    Vectors of another length, null, or with null or non-finite components have no row. Repeated rows count as often as they
    stand there; fewer vectors than clusters make fewer clusters, none an empty result. Components of any size are exact; a
    distance or inertia beyond 64 bits is null. Other columns are not read.
    """
    rows = kept(vectors, components)
    centroids = fit(rows, clusters, rounds)
    assigned = assign(rows, centroids)
    exact = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()  # a row for each cluster
    of = {r["cluster"]: int(r["total"]) if r["known"] == r["n"] and r["total"] < _LONG else None for r in exact}
    whole = sum(of.values()) if None not in of.values() else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    few = [(k, of[k], whole if whole is not None and whole < _LONG else None, digest[k]) for k in of]
    about = rows.sparkSession.createDataFrame(few, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
