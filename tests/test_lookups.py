"""Time-limited caches on streams give what the batch form gives."""

import datetime as dt
import random

from tarnlake.streaming import lookups

START = dt.datetime(2026, 1, 1)


def events(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = START + dt.timedelta(minutes=rng.randrange(0, 4000))
        key = rng.choice(["a", "b", "c", "hot", "hot", "hot"])
        out.append((key, "store", at, None, rng.choice(["x", "y", "z", None])) if rng.random() < 0.3 else (key, "lookup", at, i, None))
    return sorted(out, key=lambda e: e[2])


def by_hand(rows, hours):
    out = []
    for key, kind, at, i, _ in rows:
        if kind == "lookup":
            found = [(t, o is not None, o or "") for k, x, t, _, o in rows if x == "store" and k == key and t <= at <= t + dt.timedelta(hours=hours)]
            best = max(found, default=None)
            out.append((key, i, at, best[2] if best and best[1] else None, best is not None))
    return sorted(out, key=repr)


def test_batch_lookups(spark):
    rows = events(400, 1) + [(None, "lookup", START, 9000, None), (None, "store", START, None, "x")]
    got = lookups.as_of(spark.createDataFrame(rows, lookups.EVENTS), 12)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [*by_hand(rows[:-2], 12), (None, 9000, START, None, False)]))


def test_stream_equals_batch(spark, tmp_path):
    rows = events(160, 2)
    rng = random.Random(3)
    shuffled = sorted(rows, key=lambda e: e[2] + dt.timedelta(minutes=rng.randrange(0, 170)))  # up to three hours late
    shuffled.append(("end", "lookup", START + dt.timedelta(days=30), 10**6, None))
    shuffled.append(("end", "lookup", START + dt.timedelta(days=31), 10**6 + 1, None))
    size = -(-len(shuffled) // 4)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = None
        for i in range(4):
            spark.createDataFrame(shuffled[i * size : (i + 1) * size], lookups.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if q is None:
                stream = spark.readStream.schema(lookups.EVENTS).parquet(str(tmp_path / "in"))
                q = lookups.answered(stream, 12, "3 hours").writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
            q.processAllAvailable()
        got = sorted(map(repr, map(tuple, spark.table("answers").where("cache_key <> 'end'").collect())))
        q.stop()
    finally:
        spark.conf.set(name, before)
    assert got == list(map(repr, by_hand(rows, 12)))
    batch = lookups.as_of(spark.createDataFrame(rows, lookups.EVENTS), 12)
    assert got == sorted(map(repr, map(tuple, batch.collect())))
