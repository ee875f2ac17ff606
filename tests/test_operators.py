"""Operators whose results SQL does not give, or whose edge cases need small tables."""

import pandas as pd
from pyspark.sql import functions as F

from tarnlake.operators import channels, classify, excerpt, matrix, quotes, resolve, sentiment, threads, urls
from tarnlake.plans import programs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_weighted_sentiment(spark):
    units = spark.createDataFrame(
        [("own_x", "fee", "positive", 3, "youtube"), ("own_x", "fee", "negative", 1, "community"), ("comp_a", "fee", "neutral", None, "blog"), (None, "fee", "negative", 2, "blog")],
        "candidate string, aspect string, polarity string, intensity int, channel string",
    )
    got = {r["candidate"]: r for r in sentiment.aspect_matrix(units).collect()}
    assert abs(got["own_x"]["weighted_sentiment"] - (3.0 - 0.9) / (3.0 + 0.9)) < 1e-12 and got["own_x"]["n"] == 2
    assert got["comp_a"]["weighted_sentiment"] == 0 and None not in got
    assert sentiment.aspect_matrix(units.limit(0)).count() == 0


def test_verdicts(spark):
    make = lambda who, pos, neg: [(who, "fee", "positive", 1, "youtube")] * pos + [(who, "fee", "negative", 1, "youtube")] * neg
    schema = "candidate string, aspect string, polarity string, intensity int, channel string"
    for own, rival, want in (((8, 2), (2, 8), "우위"), ((2, 8), (8, 2), "열위"), ((5, 5), (5, 5), "동률"), ((1, 1), (5, 5), "표본 부족"), ((0, 0), (5, 5), "측정 불가"), ((5, 5), (0, 0), "판단 불가")):
        units = spark.createDataFrame(make("own_x", *own) + make("comp_a", *rival), schema)
        assert sentiment.aspect_verdict(units).first()["verdict"] == want


def test_routes(spark):
    c = spark.createDataFrame(
        [(1, 0, False, "the card fee is very low here"), (1, 1, True, "I agree with all of that"), (1, 2, True, "I agree with all of that"), (2, 0, False, "nothing to see in this one"), (2, 1, True, "fee but without a root"), (3, 0, False, "is the fee really low?"), (4, 0, False, None)],
        "thread_id int, pos int, is_reply boolean, text string",
    )
    got = [r["route"] for r in threads.route(c, ["fee"]).orderBy("thread_id", "pos").collect()]
    assert got == ["content", "content", "drop_duplicate", "drop_keyword_miss", "drop_orphan", "question", "drop_short"]
    whole = threads.assemble(threads.route(c, ["fee"])).orderBy("thread_id").collect()
    assert [(r["thread_id"], r["replies"]) for r in whole] == [(1, ["I agree with all of that"]), (3, [])]
    assert threads.route(c.limit(0), ["fee"]).count() == 0


def test_chunks_reset(spark):
    t = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 5, 5, 20, 1, 1])], "channel string, pos int, chars int")
    assert [r["chunk"] for r in threads.chunk(t, 10).orderBy("pos").collect()] == [0, 0, 1, 2, 3, 3]
    assert [r["chunk"] for r in threads.chunk(t, 10, least=20).orderBy("pos").collect()] == [0, 0, 0, 0, 1, 1]


def test_cover(spark):
    t = spark.createDataFrame([("c", "u1", 1, ["a"]), ("c", "u2", 2, ["a", "b", "c"]), ("c", "u3", 0, ["d"]), ("c", "u4", 3, ["e", "b"])], "candidate string, url string, tier int, features array<string>")
    assert [r["url"] for r in urls.cover(t, 2).collect()] == ["u3", "u2"]
    assert urls.cover(t, 9).count() == 4


def test_theta_free_joins(spark):
    u = spark.createDataFrame([("https://x.bad.com/1",), ("https://notbad.com",), ("https://bad.com",)], "url string")
    assert rows(urls.blocked(u, spark.createDataFrame([("bad.com",)], "domain string"))) == [("https://notbad.com",)]
    n = spark.createDataFrame([("abc",), ("abcd",), ("b",)], "name string")
    assert rows(resolve.prefix_dominated(n)) == [("abcd",), ("b",)]


def test_overrides_and_upserts(spark):
    cells = spark.createDataFrame([("f", "a", "1", "x"), ("f", "b", "2", "y")], "feature string, candidate string, value string, unit string")
    new = spark.createDataFrame([("f", "a", "9"), ("g", "a", "7")], "feature string, candidate string, value string")
    assert rows(resolve.overridden(cells, new, ["feature", "candidate"], ["value"]).select("feature", "candidate", "value")) == [("f", "a", "9"), ("f", "b", "2"), ("g", "a", "7")]
    m = spark.range(1).select(resolve.map_merge(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")).first()["m"]
    assert m == {"a": 1, "b": 3}


def test_intervals_and_excerpts(spark):
    i = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (2, 1, 2)], "k int, start int, end int")
    assert rows(excerpt.merged_intervals(i, "k")) == [(1, 0, 7), (1, 9, 10), (2, 1, 2)]
    text = "x" * 3000 + " needle " + "y" * 3000 + " other needle " + "z" * 3000
    got = excerpt.excerpt(text, ["needle", "other"], 1500)
    assert len(got) <= 1500 and "other needle" in got and excerpt.excerpt("short", ["a"], 10) == "short"
    assert excerpt.sentence_chunks("One. Two. " + "w" * 25, 10, 9) == ["One. Two.", "w" * 10, "w" * 10, "w" * 5] and excerpt.sentence_chunks("", 10, 3) == []
    w = excerpt.keyword_windows(spark.createDataFrame([(1, "aa needle bb needle")], "id int, text string"), ["needle"], 2).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in w] == [(1, 11), (11, 19)]


def test_press_lines(spark):
    text = "News\nA new card was launched today\n2024.05.06\nAnother long headline here 2024년 6월 7일\nA new card was launched today\n2024.05.06"
    got = excerpt.press_lines(spark.createDataFrame([("u", text)], "url string, text string")).collect()
    assert [(r["title"], r["published_at"]) for r in got] == [("A new card was launched today", "2024-05-06"), ("Another long headline here", "2024-06-07")]


def test_feeds_merge(spark):
    t = spark.createDataFrame([("c", f, x) for f, xs in (("f1", "abc"), ("f2", "abd"), ("f3", "xyz")) for x in xs], "candidate string, feed string, title string")
    over = channels.feed_overlap(t)
    assert [(r["first"], r["second"]) for r in over.collect()] == [("f1", "f2")]
    assert rows(channels.kept_feeds(t, over).select("feed")) == [("f1",), ("f3",)]


def test_matrix_grid(spark):
    cells = spark.createDataFrame([("f", "own_x", "a", 1.0, "%", "", "explicit", False), ("f", "comp", "b", None, "", "", "requires_manual_check", True), ("g", "own_x", "c", None, "", "", "partial", None)], "feature string, candidate string, value string, value_numeric double, unit string, as_of string, status string, promotional boolean")
    shown = {(r["feature"], r["candidate"]): r["shown"] for r in matrix.display(matrix.dense(cells, cells, cells)).collect()}
    assert shown == {("f", "own_x"): "a", ("f", "comp"): "b (수동 검토 필요) [기간한정]", ("g", "own_x"): "c", ("g", "comp"): "미확인"}


def test_lint_and_rubric(spark):
    lines = spark.createDataFrame([("a", "index is 0.42"), ("b", "fine")], "path string, text string")
    acts = spark.createDataFrame([("s", 1, "x", 3), ("s", 2, "y", 0)], "section string, pos int, action_id string, cost int")
    opp = spark.createDataFrame([("o", "기회", ["a", "", "c"])], "item_id string, kind string, parts array<string>")
    assert rows(quotes.lint(lines, acts, opp)) == [("a", "index literal"), ("o", "missing part"), ("x", "cost order")]
    r = spark.createDataFrame([(1, 1, 1, 0, 0), (1, 1, 1, 0, None), (0, 1, 1, 0, 0)], "opportunities int, actions int, limitations int, lint int, pending int")
    assert [x["score"] for x in quotes.rubric_insight(r).collect()] == [5, 4, 3]


def test_engines_and_programs(spark):
    made = classify.run(spark.range(3), lambda p: pd.DataFrame({"id": p["id"], "twice": p["id"] * 2}), "id long, twice long")
    assert rows(made) == [(0, 0), (1, 2), (2, 4)]
    bad = spark.createDataFrame([('[{"a":1}]',), ('{"features":[{"a":2}]}',), ("junk",)], "output string")
    assert [r["features"] and r["features"][0]["a"] for r in classify.repaired(bad, "a: int").collect()] == [1, 2, None]
    c = spark.createDataFrame([(1, 0, False, "what is the card fee here?", 7), (2, 0, False, "nothing at all to say", 7), (3, 0, False, "the card fee is low there", 8)], "thread_id int, pos int, is_reply boolean, text string, video_id int")
    v = spark.createDataFrame([(7, "card review", ""), (8, "cats", "")], "video_id int, title string, description string")
    assert [(r["thread_id"], r["kind"]) for r in programs.reactions(c, v, ["card"], ["fee"]).orderBy("kind").collect()] == [(1, "question"), (1, "unit")]


def test_long_prefixes_are_dominated(spark):
    n = spark.createDataFrame([("a" * 80,), ("a" * 80 + "b",), ("c" * 70,), (None,)], "name string")
    assert {r["name"] for r in resolve.prefix_dominated(n).collect()} == {"a" * 80 + "b", "c" * 70, None}
