"""Result store, landed scans and nested JSON on awkward rows."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from tarnlake.functions import nested
from tarnlake.functions import text as X
from tarnlake.sources import landed, store

DAY = [dt.datetime(2026, 1, d) for d in range(1, 9)]
ROWS = "cache_key string, output string"


def stored(spark, path):
    return {(r.agent, r.cache_key): (r.output, r.created_at.day, r.updated_at.day, r.hit_count) for r in store.entries(spark, path).collect()}


def test_put_is_idempotent_and_touches_its_shards_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.entries(spark, path).count() == 0
    rows = spark.createDataFrame([("aa1", "x"), ("aa1", "y"), ("aa1", None), ("ab1", None), (None, "lost")], ROWS)
    store.put(rows, path, "one", F.lit(DAY[0]))
    first = stored(spark, path)
    assert first == {("one", "aa1"): ("y", 1, 1, 0), ("one", "ab1"): (None, 1, 1, 0)}
    store.put(rows, path, "one", F.lit(DAY[0]))
    assert stored(spark, path) == first
    untouched = {f: os.path.getmtime(f"{path}/agent=one/shard=ab/{f}") for f in os.listdir(f"{path}/agent=one/shard=ab") if f.endswith(".parquet")}
    store.put(spark.createDataFrame([("aa2", "z"), ("aa1", None)], ROWS), path, "one", F.lit(DAY[1]))
    store.put(spark.createDataFrame([("aa1", "other agent")], ROWS), path, "two", F.lit(DAY[1]))
    assert stored(spark, path) == {("one", "aa1"): (None, 1, 2, 0), ("one", "aa2"): ("z", 2, 2, 0), ("one", "ab1"): (None, 1, 1, 0), ("two", "aa1"): ("other agent", 2, 2, 0)}
    assert untouched == {f: os.path.getmtime(f"{path}/agent=one/shard=ab/{f}") for f in os.listdir(f"{path}/agent=one/shard=ab") if f.endswith(".parquet")}
    store.put(rows.limit(0), path, "one", F.lit(DAY[3]))
    assert len(stored(spark, path)) == 4


def test_hits_failures_and_time_to_live(spark, tmp_path):
    path = str(tmp_path / "s")
    ttls = spark.createDataFrame([("a", 24.0)], "agent string, hours double")
    store.put(spark.createDataFrame([("k1", '{"n": 1}'), ("k2", None), ("k3", "no json"), ("k4", '{"n": "?"}')], ROWS), path, "a", F.lit(DAY[0]))
    store.put(spark.createDataFrame([("k1", "b")], ROWS), path, "b", F.lit(DAY[0]))
    inputs = spark.createDataFrame([("k1",), ("k1",), ("k2",), ("k3",), ("k9",), (None,)], "cache_key string")
    see = lambda now, agent="a", **k: sorted(((r.cache_key, r.hit, r.output) for r in store.look_up(inputs, store.entries(spark, path), agent, now, ttls, 72.0, **k).collect()), key=str)
    assert see(F.lit(DAY[1])) == sorted([("k1", True, '{"n": 1}')] * 2 + [("k2", True, None), ("k3", True, "no json"), ("k9", False, None), (None, False, None)], key=str)  # just 24 hours old
    assert {k for k, hit, _ in see(F.lit(DAY[1]), schema="n int") if hit} == {"k1", "k2"}
    assert not any(hit for _, hit, _ in see(F.lit(DAY[2]))) and [k for k, hit, _ in see(F.lit(DAY[2]), "b") if hit] == ["k1", "k1"]  # the fallback holds for b
    store.record_hits(inputs, path, "a", F.lit(DAY[4]))
    assert {k[1]: v[3] for k, v in stored(spark, path).items() if k[0] == "a"} == {"k1": 2, "k2": 1, "k3": 1, "k4": 0}
    assert not any(hit for _, hit, _ in see(F.lit(DAY[4])))  # hits prolong nothing
    store.drop_expired(path, spark, ttls, F.lit(DAY[2]), 72.0)
    assert set(stored(spark, path)) == {("b", "k1")} and os.listdir(f"{path}/agent=b") and not [x for x in os.listdir(f"{path}/agent=a") if x.startswith("shard")]


def test_remember_asks_for_the_missing_alone(spark, tmp_path):
    path, asked = str(tmp_path / "s"), []
    ttls = spark.createDataFrame([], "agent string, hours double")
    inputs = spark.createDataFrame([(1, " A "), (2, "a"), (3, "b"), (4, "c")], "id int, q string")

    def work(missing):
        asked.append(sorted(r.q.strip().lower() for r in missing.collect()))
        return missing.where("q <> 'c'").select("cache_key", F.when(F.col("q") != "b", F.lower(F.trim("q"))).alias("output"))

    for day in (0, 0, 5):
        got = store.remember(inputs, path, "s", store.query_key(F.col("q")), work, F.lit(DAY[day]), ttls, 24.0)
        assert sorted((r.id, r.hit, r.output) for r in got.collect()) == [(1, True, "a"), (2, True, "a"), (3, True, None), (4, False, None)]
    assert asked == [["a", "b", "c"], ["c"], ["a", "b", "c"]]


def test_ttl_table_and_runs(spark, tmp_path):
    (tmp_path / "ttl.yaml").write_text("# hours\ndefaults:\n  http: 24\n  search: 0.5  # short\n  bad: soon\nother: 3\n")
    assert sorted(map(tuple, store.ttl_table(spark, str(tmp_path / "ttl.yaml")).collect())) == [("http", 24.0), ("search", 0.5)]
    assert store.ttl_table(spark, str(tmp_path / "none.yaml")).count() == 0
    path = str(tmp_path / "runs")
    runs = lambda *r: spark.createDataFrame([(*x, "n", "b") for x in r], "run_id string, kind string, name string, body string")
    store.write_run(runs(("r1", "x"), ("r2", "x")), path)
    store.write_run(runs(("r1", "x")), path)
    assert sorted((r.run_id, r.kind) for r in store.read_run(spark, path).collect()) == [("r1", "x"), ("r2", "x")]


def test_landed_files(spark, tmp_path):
    def land(name, at, *entries):
        f = tmp_path / name
        f.write_text("\n".join(e if isinstance(e, str) else json.dumps(e, ensure_ascii=False) for e in entries))
        os.utime(f, (at, at))

    items = lambda *texts: {"items": [{"comment_id": str(i), "text": t, "likes": i} for i, t in enumerate(texts)]}
    land("a.json", 1000, {"input": {"video_id": "v1", "url": "u1"}, "output": items("old", "댓글")}, {"input": {"video_id": "v2"}, "output": None}, '{"input": ')
    land("b.json", 2000, {"input": {"video_id": "v1", "url": "u1"}, "output": items(" new \n", None, "댓글 영역")}, {"input": {"url": "u2"}, "output": items("", "댓글")}, {"output": items("no input")})
    land("b 2.json", 3000, {"input": {"video_id": "v1", "url": "u1"}, "output": items("copy")})
    land("v 2024.json", 500, {"input": {"video_id": "v3"}, "output": items("kept")})
    got = landed.raw_comments(spark, str(tmp_path)).collect()
    assert sorted((r.video_id, r.pos, r.text) for r in got if r.text) == [("v1", 0, " new \n"), ("v1", 2, "댓글 영역"), ("v3", 0, "kept")] and len(got) == 4
    assert {r.video_id for r in landed.raw_comments(spark, str(tmp_path), spark.createDataFrame([("v3",), ("v3",), ("v9",)], "video_id string")).collect()} == {"v3"}
    assert [(r.url, r.lines) for r in landed.community_lines(spark, str(tmp_path)).collect()] == [("u1", ["new"])]


def test_recovered_taxonomy(spark, tmp_path):
    for name, at, rows in (("x_slug.json", 1000, [("1", "one"), ("2", "two")]), ("y_slug.json", 2000, [("2", "two again")]), ("y_slug 2.json", 3000, [("1", "copy")])):
        (tmp_path / name).write_text("\n".join(json.dumps({"domain_id": i, "taxonomy": t}) for i, t in rows))
        os.utime(tmp_path / name, (at, at))
    registry = spark.createDataFrame([("1", "cards"), ("2", "banks"), ("3", "none yet"), ("2", "twice"), ("1", "twice")], "domain_id string, domain_name string")
    wanted = spark.createDataFrame([("cards",), ("banks",), ("none yet",), ("unknown",), (None,), ("twice",)], "domain_name string")
    got = {r.domain_name: (r.taxonomy, r.fallback) for r in landed.recovered_taxonomy(wanted, registry, landed.taxonomy(spark, str(tmp_path))).collect()}
    last = ("two again", True)
    assert got == {"cards": ("one", False), "banks": ("two again", False), "none yet": last, "unknown": last, None: last, "twice": ("one", False)}
    none = landed.recovered_taxonomy(wanted, registry, landed.taxonomy(spark, str(tmp_path)).limit(0)).collect()
    assert len(none) == 6 and all(r.taxonomy is None for r in none)


# nested JSON


def some_json(rng, deep):
    kind = rng.randrange(8 if deep else 5)
    if kind < 5:
        return [None, True, rng.randrange(-5, 10**12), rng.choice(["", 'q"uo\\te', "줄\n바꿈", "[{]}", "é\t\u0001"]), False][kind]
    if kind == 5:
        return [some_json(rng, deep - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["pattern", "a", "b c", 'k"', "x.y", ""]): some_json(rng, deep - 1) for _ in range(rng.randrange(5))}


def test_nested_round_trip_and_strip(spark):
    rng = random.Random(6)
    made = [some_json(rng, 6) for _ in range(150)]
    rows = spark.createDataFrame([(i, json.dumps(x, ensure_ascii=i % 2 == 0)) for i, x in enumerate(made)] + [(900, None), (901, "{bad"), (902, "")], "id int, j string")

    def strip(x):
        return {k: strip(v) for k, v in x.items() if k != "pattern"} if isinstance(x, dict) else [strip(v) for v in x] if isinstance(x, list) else x

    def walk(x, path=""):
        if isinstance(x, str):
            yield path, x
        for k, v in x.items() if isinstance(x, dict) else []:
            yield from walk(v, f"{path}.{k}" if path else k)
        for i, v in enumerate(x) if isinstance(x, list) else []:
            yield from walk(v, f"{path}[{i}]")

    parts = nested.nodes(rows, ["id"], "j")
    assert {r.id: json.loads(r.json) for r in nested.rendered(parts, ["id"]).collect()} == dict(enumerate(made))
    assert {r.id: json.loads(r.j) for r in nested.strip_keys(rows, ["id"], "j", ["pattern"]).collect()} == dict(enumerate(map(strip, made)))
    got = sorted((r.id, r.path.lstrip("."), r.value) for r in nested.strings(rows, ["id"], "j").collect())
    assert got == sorted((i, p.lstrip("."), s) for i, x in enumerate(made) for p, s in walk(x))
    deepest = {r.id: r.d for r in rows.select("id", nested.depth("j").alias("d")).collect()}
    size = lambda x: 1 + max([size(v) for v in (x.values() if isinstance(x, dict) else x)], default=0) if isinstance(x, (dict, list)) else 0
    assert {i: d for i, d in deepest.items() if i < 900} == {i: size(x) for i, x in enumerate(made)} and deepest[900] == 0


def test_nested_names_in_step(spark):
    rows = spark.createDataFrame([(1, json.dumps({"slug": "My Domain!", "r": {"One x": {"features": ["A b", "2nd", "A b"], "labels": {"A b": "L", "2nd": {"A b": 1}}}}})), (2, '{"r": {"t": {"labels": {"A b": 1, "a_b": 2}}}}'), (3, "[]")], "id int, j string")
    parts = nested.renamed(nested.nodes(rows, ["id"], "j"), X.snake_id, ["slug", "r.*.features[]"], ["r.*.labels.*"])
    got = {r.id: json.loads(r.json) for r in nested.rendered(parts, ["id"]).collect()}
    assert got[1] == {"slug": "my_domain", "r": {"One x": {"features": ["a_b", "n_2nd", "a_b"], "labels": {"a_b": "L", "n_2nd": {"A b": 1}}}}}
    assert got[2] == {"r": {"t": {"labels": {"a_b": 2}}}} and got[3] == []
