"""Extraction that fails, splits and is tried again."""

import datetime as dt

from pyspark.sql import functions as F

from tarnlake.operators import retry

NOW = dt.datetime(2026, 1, 1)
LABELS = [("a", "alpha"), ("b", "beta")]


def run(spark, rows, path, day=NOW, engine=None, **more):
    asked = []

    def counted(parts):
        asked.append(parts.count())
        return (engine or retry.rule_engine(LABELS, 40, "!!"))(parts)

    parts = retry.chunks(spark.createDataFrame(rows, "candidate string, item_id string, text string, at int"), "at", 8)
    got = retry.extract(parts, counted, str(path), F.lit(day), digits=1, **more)
    return got, asked


def test_every_item_ends_once(spark, tmp_path):
    rows = [("c", f"i{k}", t, k) for k, t in enumerate(["alpha", "beta alpha", None, "", "x" * 30, "alpha " * 10, "y" * 20, "beta"])] + [("c", "i8", "fine", 8), ("d", "j0", "bad !! one", 0), ("d", "j1", "alpha", 1)]
    got, asked = run(spark, rows, tmp_path / "one")
    out = {r.item_id: (r.ok, r.cause) for r in retry.outcomes(got).collect()}
    assert len(out) == len(rows) == retry.outcomes(got).count()
    assert {i: c for i, (ok, c) in out.items() if not ok} == {"i5": "timeout", "j0": "schema", "j1": "schema"}  # a broken answer is not split
    tuples = sorted((t.item_id, t.label) for r in got.collect() for t in r.tuples or [])
    assert tuples == [("i0", "a"), ("i1", "a"), ("i1", "b"), ("i7", "b")]
    assert sorted(map(tuple, retry.failures(got).collect())) == [("schema", 1, 2), ("timeout", 1, 1)]
    assert asked[0] == 3 and len(asked) > 2


def test_a_second_run_asks_for_failures_alone(spark, tmp_path):
    rows = [("c", f"i{k}", "alpha beta word", k) for k in range(8)] + [("e", "k0", "!!", 0)]
    first, asked = run(spark, rows, tmp_path / "run1")
    assert sum(asked) > 2 and {r.item_id for r in retry.outcomes(first).where("ok").collect()} == {f"i{k}" for k in range(8)}
    (tmp_path / "run2").mkdir()
    (tmp_path / "run1" / "store").rename(tmp_path / "run2" / "store")
    second, asked = run(spark, rows, tmp_path / "run2")
    assert asked == [1]  # the whole chunk is known by now, though it was answered in pieces; the broken one is asked again
    whole = [r for r in second.collect() if r.candidate == "c"]
    assert len(whole) == 1 and whole[0].cached and [t.item_id for t in whole[0].tuples] == [f"i{k}" for k in range(8) for _ in LABELS]


def test_rounds_end_and_silence_is_a_failure(spark, tmp_path):
    rows = [("c", f"i{k}", "z" * 50, k) for k in range(8)]
    got, asked = run(spark, rows, tmp_path / "few", rounds=1)
    assert {(r.cause, r.round, len(r["items"])) for r in got.collect()} == {("timeout", 1, 4)} and len(asked) == 2
    silent = lambda parts: parts.where("false").select("chunk_key", F.lit("").alias("cause"), F.lit(None).cast(f"array<{retry.TUPLE}>").alias("tuples"))
    got, _ = run(spark, rows, tmp_path / "none", engine=silent)
    assert {r.cause for r in got.collect()} == {"no answer"}


def test_equal_chunks_and_no_rows(spark, tmp_path):
    rows = [("c", "same", "alpha", 0), ("c", "same", "alpha", 8)]
    got, asked = run(spark, rows, tmp_path / "same")
    assert asked == [1] and got.count() == 2
    got, _ = run(spark, [], tmp_path / "empty")
    assert got.count() == 0


def test_split_by_chars(spark):
    texts = ["aaaa", "bb", "cccccccccc", "d", "", "ee"]
    rows = spark.createDataFrame([([(str(i), t) for i, t in enumerate(texts)],), ([],)], f"items array<{retry.ITEM}>")
    got = [[[i.text for i in p] for p in r.p] for r in rows.select(retry.by_chars(6)(F.col("items")).alias("p")).collect()]
    assert got == [[["aaaa", "bb"], ["cccccccccc"], ["d", "", "ee"]], []]
    assert [[len(p) for p in r.p] for r in rows.select(retry.halves(F.col("items")).alias("p")).collect()] == [[3, 3], [0, 0]]
