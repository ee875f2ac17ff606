"""Column functions on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import text as X
from tarnlake.functions import urls as U


def values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one(spark, texts, column):
    return values(spark, column, [(t,) for t in texts])


def test_normal_forms(spark):
    assert one(spark, [" a b\tc ", None], X.squeezed("t")) == ["abc", ""]
    assert one(spark, ["Ab-1 가!", None], X.letters_and_digits("t")) == ["ab1가", ""]
    assert one(spark, ["토스 트래블카드", "KB국민카드", "Samsung Pay"], X.slug("t")) == ["토스트래블카드", "kb국민카드", "samsungpay"]
    assert one(spark, ["café", "가"], X.composed_form(F.col("t"))) == ["café", "가"]
    assert one(spark, ["Hello, World", "9 lives", "!!"], X.snake_id("t")) == ["hello_world", "n_9_lives", "unknown"]
    assert one(spark, ["own_a", "b"], X.with_prefix("t", F.lit("own"))) == ["own_a", "own_b"]


def test_comment_predicates(spark):
    texts = ["ㅋㅋㅋㅋ", "굿!!", "해외에서 결제가 안 되는데 이유가 뭔가요?", "환율 우대가 좋아서 계속 쓰고 있습니다", "", None, "시발 ㅋㅋㅋㅋㅋㅋㅋㅋㅋ!"]
    assert one(spark, texts, X.basic_drop("t")) == ["drop_short", "drop_short", None, None, "drop_short", "drop_short", "drop_noise"]
    assert one(spark, ["이거 되나요?", "좋아요. 그런데 되나요?", "되나요? 정말요?"], X.is_pure_question("t")) == [True, False, True]
    assert one(spark, ["환전 수수료", "none"], X.first_keyword("t", ["수수료", "환전 수수료"])) == ["환전 수수료", ""]
    assert one(spark, ["왜 안돼", "수수료 얼마", "어떻게 해", "되나", "음"], X.question_type("t")) == ["troubleshooting", "cost", "method", "feasibility", "other"]
    assert one(spark, ["이거 맞나요", "아니다"], X.confirms("t")) == [True, False]


def test_profanity_and_scores(spark):
    assert one(spark, ["fuck this SHIT", "fine", None], X.masked("t")) == ["f*** this s***", "fine", ""]
    assert one(spark, ["fuck this SHIT", "fine"], X.profanity_hits("t")) == [2, 0]
    rows = [("수수료가 3% 라서 다른 카드보다 싸요", 2, "youtube"), ("문의는 카톡", 3, "youtube"), ("짧다", None, "blog")]
    got = values(spark, X.quote_score("t", "i", "c"), rows, "t string, i int, c string")
    assert got[0] == pytest.approx(2 + 0.5 + 4 + 0.5) and got[1] is None and got[2] == pytest.approx(1 + 0.45 - 0.5)


def test_posts(spark):
    assert one(spark, ["see https://a.b/c and https://d.e f"], X.links_marked("t")) == ["see [링크] and [링크] f"]
    assert one(spark, ["a https://x.y https://z.w b"], X.links_marked("t")) == ["a [링크] b"]
    assert one(spark, ["[링크]\nTitle\nexample.com\nrest"], X.without_embed_cards("t")) == ["[링크]\nrest"]
    assert values(spark, X.clean_body("b", "t"), [("Title<p>x</p>  \n y ", "Title"), (None, None)], "b string, t string") == ["x\ny", ""]
    assert one(spark, ["3\n5\nnick\nhello\nworld\n2024-01-02", "plain text ", "1\nx", None], X.clean_comment("t")) == ["hello world", "plain text", "1\nx", ""]
    assert one(spark, ["\n# Head \nx", None], X.title_of("t")) == ["Head", ""]


def test_dates(spark):
    got = one(spark, ["Mon, 06 May 2024 10:00:00 +0900", "2024-05-06T01:00:00Z", "06 May 2024 01:00:00 GMT", "someday", None], X.iso_time("t"))
    assert got == ["2024-05-06T01:00:00Z"] * 3 + ["someday", ""]
    now = F.lit(dt.datetime(2024, 3, 15))
    assert values(spark, X.month_window(3, now), [(1,)], "x int") == [["2024-01", "2024-02", "2024-03"]]
    assert one(spark, ["2023-01-01", "2024-03-01", "unclear"], X.is_recent("t", now, 6)) == [False, True, True]
    assert values(spark, X.week_start(F.lit(dt.datetime(2024, 3, 11, 4))), [(1,)], "x int") == [dt.datetime(2024, 3, 4, 5)]


def test_fuzzy_match(spark):
    rows = [("Travel Card", "travelcard plus"), ("abcdefgh", "abcdefxy"), ("abc", "xyz"), ("", "a"), (None, "a")]
    assert values(spark, X.fuzzy_match("a", "b"), rows, "a string, b string") == [True, True, False, False, False]


def test_addresses(spark):
    assert one(spark, ["https://www.A.com:8/x", "http://u@b.org?q", "mailto:x", None], U.host("t")) == ["a.com", "b.org", "", ""]
    assert one(spark, ["https://www.a.com/x/?utm_source=1&b=2&c=&ref=z#f", "http://a.com/x"], U.dedup_key("t")) == ["a.com/x?b=2", "a.com/x"]
    assert one(spark, ["https://youtu.be/abcdefghijk", "https://y.com/watch?x=1&v=ABCDEFGHIJK", "none"], U.video_id("t")) == ["abcdefghijk", "ABCDEFGHIJK", ""]
    assert values(spark, U.platform_allowed("u", "p"), [("https://me.tistory.com", "blog_tistory"), ("https://me.tistory.com", "blog_self_hosted"), ("https://own.kr", "blog_self_hosted")], "u string, p string") == [True, False, True]
    assert one(spark, ["https://a.com/my-first%20post/"], U.slug_title("t")) == ["my first post"]
    assert values(spark, U.matches_any(U.host("u"), ["a.com"]), [("https://x.a.com",), ("https://ba.com",)], "u string") == [True, False]
    page = "<html><title> T </title><meta name='description' content='D'><a href='/x'>l</a><a href=\"/x\">m</a></html>"
    assert one(spark, [page], U.meta("t"))[0][:2] == ("T", "D")
    assert one(spark, [page], U.links("t")) == [["/x"]]
