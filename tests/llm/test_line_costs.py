import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarnlake.llm import lines


def _sets(rng, n, shared):
    """Two sets of `n` hashes with `shared` in common."""
    x = [rng.getrandbits(64) for _ in range(2 * n - shared)]
    return np.array(sorted(x[:n]), np.uint64), np.array(sorted(x[n - shared :]), np.uint64)


def test_postings_of_documents_carry_no_sketches(spark, monkeypatch):
    """What the prefix join moves doesn't grow with a text's sketch, and sets that share half of their runs aren't fetched."""
    assert lines._kind(0, False).itemsize == 16
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    long = [[word() for _ in range(3000)] for _ in range(4)]
    texts = [*long, *([*x[:2000], *(word() for _ in range(1000))] for x in long), [*long[0][:2900], *(word() for _ in range(100))]]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    asked, fetched = [], lines._fetched
    monkeypatch.setattr(lines, "_fetched", lambda keyed, firsts, found, words: asked.append(found.select("id").distinct().count()) or fetched(keyed, firsts, found, words))
    assert sorted(r["doc_id"] for r in lines.drop_similar_documents(docs).collect()) == list(range(8))
    assert asked == [2]


def test_thinned_keeps_every_similar_pair(spark):
    rng = random.Random(8)
    sets, similar = [], []
    for n in (1, 5, 9, 40, 60, 130, 700, 1500, 3000, 9000):
        for part in (0.5, 0.85, 0.8889, 0.89, 0.95):
            a, b = _sets(rng, n, round(n * part))
            sets += [a, b]
            similar.append(lines.overlapping(a, b))
    made = lines.sketched(sets)
    rows = spark.createDataFrame([(i, len(x), bytearray(k)) for i, (x, k) in enumerate(zip(sets, made, strict=True))], "id long, n long, sketch binary")
    found = rows.select((F.floor(F.col("id") / 2)).alias("component"), "id")
    left = {}
    for r in lines.thinned(found, rows, 0.8).collect():
        left.setdefault(r["component"], set()).add(r["id"])
    pairs = {min(x) // 2 for x in left.values()}
    assert all(len(x) == 2 for x in left.values()) and {i for i, ok in enumerate(similar) if ok} <= pairs
    assert not any(i % 5 == 0 and len(sets[2 * i]) > 60 for i in pairs)  # half in common


def test_lines_are_verified_by_wide_sketches(monkeypatch):
    """Lines of 50 words that differ in some 15 places pass sketches of 64 bits half of the time, and were compared word by word."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(50)]
    rows = []
    for _ in range(60):
        x = base.copy()
        for i in rng.sample(range(50), 9):
            x[i] = rng.getrandbits(64)
        rows.append(np.array(x, np.uint64))
    calls, similar = [], lines.similar
    near = [(i, j) for i in range(60) for j in range(i + 1, 60) if similar(rows[i], rows[j])]
    monkeypatch.setattr(lines, "similar", lambda a, b, least: calls.append(1) or similar(a, b, least))
    got = lines._links(np.arange(60), pa.array([x.tobytes() for x in rows], pa.binary()), np.array([0]), np.full(60, -1), 0.8, False)
    assert len(calls) < 60 + 2 * len(near) and set(map(tuple, got.tolist())) <= set(near)
