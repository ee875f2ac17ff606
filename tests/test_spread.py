"""Steps that one task did for a whole input are dealt out, with the same results."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.operators import excerpt, urls
from tarnlake.plans import adapters, landing

SF = "/root/testdata/sf0.001"


def test_rows_without_address_stay_where_they_are(spark):
    rows = spark.range(400).select(F.lit("a").alias("source"), F.col("id").alias("item_id"), F.lit("c").alias("candidate"), F.when(F.col("id") % 40 == 0, "https://x.y/p").alias("url"), F.lit(1).alias("score")).repartition(4)
    out = adapters.collected(rows, [adapters.Source("a")])
    assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"kept": 391, "repeated": 9}
    where = out.where("url IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(where) >= 4 and max(r["count"] for r in where) < 200


def test_sitemaps_are_made_in_many_tasks(spark):
    made = landing.sitemaps(spark, SF)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


@pytest.mark.parametrize("width", (3, 1_000_000))
def test_ranks_by_ranges(spark, width):
    rows = spark.createDataFrame([(g, p, f"u{i % 7}") for i, (g, p) in enumerate((g, p) for g in ("a", None, "b") for p in (None, -5, 0, 1, 1, 2, 3, 9, 40, 10**12))], "g string, pos long, url string")
    want = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("pos", "url")))
    got = urls.ranked(rows, ["g"], ["pos", "url"], width)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_trigrams_are_not_shuffled(spark, capsys):
    texts = spark.createDataFrame([(1, "a b c a B  c"), (1, "[x]"), (2, " a b"), (2, None), (3, "a b c d")], "video_id long, text string")
    out = excerpt.noise_profile(texts)
    out.explain("simple")
    assert "gram" not in " ".join(x for x in capsys.readouterr().out.splitlines() if "Exchange" in x)
    assert sorted(map(tuple, out.collect())) == [(1, 2, 1, 2), (2, 2, 0, 0), (3, 1, 0, 1)]
