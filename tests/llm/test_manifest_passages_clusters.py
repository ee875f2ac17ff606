"""Merkle manifest, removal of repeated passages and centroid clustering, on awkward rows against brute force, and against their SQL."""

import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import lloyd, merkle, passages, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n_words int, part int, hash string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows, parts=5):
    """(doc_id, text, lang) with other columns beside, some of which clash."""
    return spark.createDataFrame([(i, t, lang, None if i and i % 5 == 0 else "s", 3, "k", 1, 2, "h") for i, t, lang in rows], DOCS).repartition(parts)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_substring_dedup", "op13_centroid_clusters"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).values.tolist()))
    assert rows(got) == rows(want)


# manifest


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, i):
    for nodes in levels[:-1]:
        lo = i - i % 8
        yield "".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 8])
        i //= 8


def proofs(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: sha("".join(map(field, (i, s, lang, n, t))))
    groups = {}
    for i, t, lang, s, n in rows:
        got = t.translate(LOW) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else t
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf(i, t, lang, s, n), leaf(i, got, lang, s, n)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in sorted(groups[g])]) for g in names}
    above = tree([trees[g][-1][0] for g in names]) if names else [[None]]
    for k, g in enumerate(names):
        for place, (known, i, own, got) in enumerate(sorted(groups[g])):
            steps = [*way(trees[g], place), *way(above, k)]
            for before, after in steps:
                got = sha(before + got + after)
            yield (i if known else None, own, trees[g][-1][0], above[-1][0], sha("".join(b + a for b, a in steps)), got, got == above[-1][0])


def manifest_rows(kind):
    rng = random.Random(5)
    if kind == "awkward":
        rows = [(i, rng.choice([None, "", "Ab c", "é Ü 한", "A" * 70_000, "plain"]), rng.choice(["en", None, "", "é", "de"])) for i in range(180)]
        return rows + [(None, "X", "en"), (None, None, None), (7, "Other Text", "en"), *[(9, "Same", "en")] * 20, (1, "Lone", "zz")]
    if kind == "many groups":
        return [(i, f"T{i}", f"l{i % 90}") for i in range(200)]
    return [(i, f"T{i}", "en") for i in range({"one": 1, "eight": 8, "nine": 9, "blocks": 1100}[kind])]


@pytest.mark.parametrize("kind", ["awkward", "many groups", "one", "eight", "nine", "blocks"])
def test_manifest(spark, kind):
    docs = table(spark, manifest_rows(kind))
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle.prove(docs, {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, low).otherwise(F.col("text"))})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = list(proofs([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {r[-1] for r in want} == ({True, False} if kind != "one" else {want[0][-1]})


def test_manifest_without_rows_and_without_changes(spark):
    assert merkle.prove(table(spark, []).limit(0)).count() == 0
    got = merkle.prove(table(spark, manifest_rows("nine"))).collect()
    assert all(r.verified and r.folded_root == r.root for r in got) and len(got) == 9


def test_manifest_nodes(spark):
    rows = manifest_rows("blocks") + [(1, "a", None)]
    got = {(r.tree, r.lang, r.level, r.idx): r.hash for r in merkle.manifest(table(spark, rows)).collect()}
    leaves = [sha("".join("-" if v is None else f"{len(str(v))}:{v}" for v in (i, None if i and i % 5 == 0 else "s", "en", 3, t))) for i, t, _ in rows[:-1]]
    levels = tree(leaves)
    want = {("lang", "en", level, k): h for level, nodes in enumerate(levels) if level for k, h in enumerate(nodes)}
    top = tree([sha("1:11:s-1:31:a"), levels[-1][0]])
    assert got == want | {("all", None, 1, 0): top[-1][0]}


def test_peaks_of_any_runs():
    """However numbered leaves are cut into runs, finished and open nodes are nodes of the whole tree, each once."""
    rng = random.Random(2)
    leaves = [sha(str(i)) for i in range(700)]
    levels = tree(leaves)
    for _ in range(20):
        edges = sorted({0, 700, *[rng.randrange(700) for _ in range(rng.randrange(6))]})
        seen = []
        for a, b in zip(edges, edges[1:]):
            batch = pa.record_batch({"key": ["g"] * (b - a), "index": list(range(a, b)), "hash": [bytes.fromhex(h) for h in leaves[a:b]]})
            for out in merkle.peaks(iter([batch.slice(0, 3), batch.slice(3)])):
                seen += [(r["level"], r["idx"], r["hash"].hex()) for r in out.to_pylist()]
        assert len({(x, i) for x, i, _ in seen}) == len(seen)
        assert all(levels[x][i] == h for x, i, h in seen)


# passages


def without_repeats(rows, window=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (t or "").encode().split()
        gone = set()
        for a in range(len(words) - window + 1):
            run = tuple(words[a : a + window])
            if run in seen:
                gone.update(range(a, a + window))
            seen.add(run)
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


def passage_rows():
    rng = random.Random(8)
    prose = lambda n, of=300: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    shared = [prose(n) for n in (19, 20, 21, 26, 27, 40, 90)]
    rows = [None, "", " \t\n ", "한국어 😀 é"]
    for k in range(120):  # passages at every distance, between other words or none
        rows.append(" ".join([prose(rng.randrange(0, 15)), rng.choice(shared), prose(rng.randrange(0, 9)), rng.choice(shared), prose(rng.randrange(0, 15))]))
    rows += [rows[10], rows[10], rows[11] + " end", "\n".join(rows[12].split()), "a " * 500, "a b " * 60, prose(5000, 2), prose(19), "x\x1cy \x0b\x0cz " * 10]
    rows.append(prose(30_000))
    rows.append(rows[-1][1000:90_000])
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size", [4_000_000, 3_000])
def test_passages(spark, monkeypatch, size):
    monkeypatch.setattr(passages, "CHUNK_BYTES", size)
    rows = passage_rows()
    rows += [(None, rows[40][1]), (None, None)]
    docs = table(spark, [(i, t, "en") for i, t in rows])
    got = passages.drop_repeated_passages(docs)
    assert got.columns == [*docs.columns, "n_words_", "n_removed"]
    assert sorted(map(repr, [(r.doc_id, r.n_words_, r.n_removed, r.text) for r in got.collect()])) == sorted(map(repr, without_repeats(rows)))
    assert {(r.lang, r.n_chars, r.key, r.n_words, r.part, r["hash"]) for r in got.collect()} == {("en", 3, "k", 1, 2, "h")}


def test_passages_of_shared_ids_and_no_rows(spark):
    text = " ".join(f"v{i}" for i in range(30))
    docs = table(spark, [(1, text, "en"), (1, text, "en"), (1, "z " + text, "en"), (0, None, "en")])
    got = sorted((r.doc_id, r.n_removed) for r in passages.drop_repeated_passages(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 30), (1, 30)]  # of rows with one id one keeps the passage
    assert passages.drop_repeated_passages(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        passages.drop_repeated_passages(docs, window=5)


def test_cover_and_window_hashes():
    assert {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER} == set(range(passages.PERIOD))
    words = np.random.default_rng(1).integers(0, 2**63, 200).astype(np.uint64)
    words[100:150] = words[20:70]
    for length in (1, 2, 3, 14, 20, 31):
        h = passages.run_hashes(words, length)
        assert len(h) == 201 - length and (h[100 : 151 - length] == h[20 : 71 - length]).all()
        assert len(np.unique(h)) == len(h) - (51 - length)
    assert len(passages.run_hashes(words[:5], 20)) == 0


def test_passages_of_another_window(spark):
    rows = [(i, t) for i, t in passage_rows() if t and len(t) < 3000]
    got = passages.drop_repeated_passages(table(spark, [(i, t, "en") for i, t in rows]), window=9)
    assert sorted((r.doc_id, r.n_words_, r.n_removed, r.text) for r in got.collect()) == sorted(without_repeats(rows, 9))


# clusters


def clusters(rows, k, rounds):
    """(vec_id, list) by the definition, in Python's integers."""
    whole = [(i, [(lambda a, b: a * 1024 // b)(*x.as_integer_ratio()) for x in v]) for i, v in rows]
    order = sorted(whole, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in whole]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(whole, of) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)) for i, v in whole]
    fits = lambda d: d if d is not None and d < 1 << 63 else None
    total = [sum(d for _, d, o in found if o == j) if all(fits(d) is not None for _, d, o in found if o == j) else None for j in range(len(centroids))]
    used = {o for _, _, o in found}
    every = None if any(fits(total[j]) is None for j in used) else fits(sum(total[j] for j in used))
    return [(i, o, fits(d), fits(total[o]), every, sha(",".join(map(str, centroids[o])))) for i, d, o in found]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "c", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, distance int").repartition(3)


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "SLICE", 16)
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(70)]
    good += [(3, good[3][1]), (3, good[4][1]), (None, good[5][1]), (2**53 + 1, good[6][1]), (80, [0.0] * 64), (81, [-0.0] * 64), *[(i, good[0][1]) for i in range(90, 120)]]
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None]), (205, [float("nan")] + [1.0] * 63), (206, [float("inf")] + [1.0] * 63)]
    got = lloyd.cluster(vectors(spark, good + bad))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, clusters(good, 8, 10)))


@pytest.mark.parametrize("size", [2.0**17, 2.0**40, 1e300])
def test_clusters_of_huge_components(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * (size if i % 3 else 1)).tolist()) for i in range(30)]
    got = lloyd.cluster(vectors(spark, rows, "double"), clusters=4, rounds=3, components=3)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, clusters(rows, 4, 3)))


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted(map(repr, map(tuple, lloyd.cluster(vectors(spark, rows)).collect()))) == sorted(map(repr, clusters(rows, 8, 10)))
    assert lloyd.cluster(vectors(spark, rows).limit(0)).collect() == []
    same = [(i, [0.5] * 64) for i in range(20)]  # ties go to the first centroid, the others keep their place
    assert {r.cluster for r in lloyd.cluster(vectors(spark, same)).collect()} == {0}


def test_limbs():
    for x in (0, 5, -5, 1 << 40, -(1 << 40), (1 << 200) + 7, -(1 << 200) - 7):
        limbs = lloyd._limbs(x)
        assert sum(v << lloyd.LIMB * i for i, v in enumerate(limbs)) == x and all(abs(v) <= 1 << lloyd.LIMB for v in limbs)
