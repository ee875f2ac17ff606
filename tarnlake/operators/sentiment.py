"""Measures of opinions: matrices, indices, verdicts, distributions and selections of aspects.

`units` have candidate, aspect, polarity, intensity, channel and perspective; candidates named own_* are one's own. A null
candidate is an unattributed unit, left out where candidates are compared. Ratios are kept with their integer numerators
and denominators, so that callers may round them as they like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L


def sign(polarity: str = "polarity") -> Column:
    return F.when(F.col(polarity) == "positive", 1).when(F.col(polarity) == "negative", -1).otherwise(0)


def strength(intensity: str = "intensity") -> Column:
    """Intensity; missing and zero count as 1."""
    return F.coalesce(F.nullif(F.col(intensity), F.lit(0)), F.lit(1))


def tenths(channel: str = "channel", weights=L.CHANNEL_WEIGHTS) -> Column:
    """Channel weight in tenths, so that weighted sums stay exact."""
    c = F.col(channel)
    return F.coalesce(*[F.when(c == k, F.lit(round(v * 10))) for k, v in weights.items()], F.lit(10))


def is_own(candidate: str = "candidate") -> Column:
    return F.col(candidate).startswith("own")


def side(candidate: str = "candidate") -> Column:
    """Own, competitor, or excluded for unattributed units."""
    return F.when(F.col(candidate).isNull(), "excluded").when(is_own(candidate), "own").otherwise("competitor")


def counts() -> list[Column]:
    """N, pos, neg and neu."""
    p = F.col("polarity")
    return [F.count("*").alias("n"), F.count_if(p == "positive").alias("pos"), F.count_if(p == "negative").alias("neg"), F.count_if(~p.isin("positive", "negative")).alias("neu")]


def index_parts() -> list[Column]:
    return [F.sum(sign() * strength()).cast("long").alias("num"), F.sum(strength()).cast("long").alias("den")]


def ratio(num: str = "num", den: str = "den") -> Column:
    """num / den, null for an empty denominator."""
    return F.when(F.col(den) != 0, F.col(num) / F.col(den))


def sample_level(n: Column) -> Column:
    """A04."""
    out = F.lit(None).cast("string")
    return F.coalesce(out, *[F.when(n >= least, F.lit(name)) for least, name in L.SAMPLE_LEVELS], F.lit("count_only"))


def aspect_matrix(units: DataFrame, weights=L.CHANNEL_WEIGHTS) -> DataFrame:
    """Counts and channel-weighted sentiment by aspect and candidate; 0 where nothing weighs."""
    w = tenths("channel", weights)
    out = units.where("candidate IS NOT NULL").groupBy("aspect", "candidate").agg(*counts(), F.sum(sign() * strength() * w).cast("long").alias("num"), F.sum(strength() * w).cast("long").alias("den"))
    return out.withColumn("weighted_sentiment", F.coalesce(ratio(), F.lit(0.0)))


def index_by(units: DataFrame, *keys: str) -> DataFrame:
    """Counts, index parts, unrounded index and sample level by keys."""
    return units.groupBy(*keys).agg(*counts(), *index_parts()).withColumn("index", ratio()).withColumn("sample_level", sample_level(F.col("n")))


def channel_split(units: DataFrame) -> DataFrame:
    """Index by candidate over all channels (channel null) and by channel, in one pass with grouping sets."""
    known = units.where("candidate IS NOT NULL")
    out = known.groupingSets([["candidate"], ["candidate", "channel"]], "candidate", "channel").agg(*counts(), *index_parts())
    return out.withColumn("index", ratio())


def hundredths(num: str = "num", den: str = "den") -> Column:
    """The index rounded half up to two places, as an integer of hundredths, from its integer parts."""
    n, d = F.col(num), F.col(den)
    up = F.expr(f"(200 * abs({num}) + {den}) div (2 * {den})")
    return F.when(d > 0, F.when(n < 0, -up).otherwise(up))


def aspect_verdict(units: DataFrame, excluded: tuple[str, ...] = (L.OTHER,), tie: int = 10) -> DataFrame:
    """Own against the best competitor by aspect, and a verdict.

    The best competitor has the highest rounded index, then most units, then the first name; gaps are of rounded indices, in
    hundredths.
    """
    facts = units.where("candidate IS NOT NULL").where(~F.col("aspect").isin(*excluded)).groupBy("aspect", "candidate").agg(F.count("*").alias("n"), *index_parts()).withColumn("idx", hundredths())
    best_first = Window.partitionBy("aspect").orderBy(F.desc("idx"), F.desc("n"), "candidate")
    rivals = facts.where(~is_own() & F.col("idx").isNotNull()).withColumn("rn", F.row_number().over(best_first)).where("rn = 1")
    best = rivals.select("aspect", F.col("candidate").alias("best"), F.col("idx").alias("best_index"))
    own = facts.where(is_own()).groupBy("aspect").agg(F.sum("n").alias("own_n"), F.sum("num").alias("num"), F.sum("den").alias("den")).withColumn("own_index", hundredths()).drop("num", "den")
    out = facts.select("aspect").distinct().join(own, "aspect", "left").join(best, "aspect", "left").withColumn("gap", F.col("own_index") - F.col("best_index"))
    g, n, v = F.col("gap"), F.coalesce("own_n", F.lit(0)), L.VERDICTS
    verdict = F.when(n == 0, v["unmeasured"]).when(n < 5, v["thin"]).when(g.isNull(), v["unknown"]).when(g == 0, v["equal"]).when(F.abs(g) < tie, v["close"]).when(g > 0, v["ahead"]).otherwise(v["behind"])
    return out.select("aspect", n.alias("own_n"), "own_index", "best", "best_index", "gap", verdict.alias("verdict"))


def perspective_rank(units: DataFrame, excluded: str = "other") -> DataFrame:
    """Place of one's own index among all candidates by perspective."""
    known = units.where("candidate IS NOT NULL").where(F.col("perspective") != excluded)
    facts = known.groupBy("perspective", F.when(is_own(), "own").otherwise(F.col("candidate")).alias("who")).agg(*index_parts()).withColumn("idx", hundredths()).where("idx IS NOT NULL")
    by = Window.partitionBy("perspective")
    ranked = facts.select("*", F.rank().over(by.orderBy(F.desc("idx"))).alias("place"), F.count("*").over(by).alias("ranked"), F.count("*").over(Window.partitionBy("perspective", "idx")).alias("same"))
    own = ranked.where("who = 'own'")
    place = F.col("place").cast("string")
    position = (
        F.when(F.col("idx").isNull(), L.VERDICTS["unmeasured"]).when((F.col("place") == 1) & (F.col("same") == 1), "단독 1위").when(F.col("same") > 1, F.concat(place, F.lit("위 동률")))
        .when(F.col("place") == F.col("ranked"), "최하").otherwise(F.concat(place, F.lit("위")))
    )
    return facts.select("perspective").distinct().join(own, "perspective", "left").select("perspective", F.col("idx").alias("own_index"), "place", "ranked", position.alias("position"))


def question_stats(questions: DataFrame) -> DataFrame:
    """Questions by type with their group, in all and attributed, and by side."""
    group = F.coalesce(*[F.when(F.col("question_type").isin(*types), F.lit(g)) for g, types in L.QUESTION_GROUPS.items()], F.lit("other"))
    return questions.groupBy("question_type").agg(
        F.first(group).alias("question_group"), F.count("*").alias("n"), F.count("candidate").alias("attributed"), F.count_if(is_own()).alias("own"), F.count_if(F.col("channel") == "youtube").alias("youtube"),
    )


def adoption_share(questions: DataFrame) -> DataFrame:
    """Own questions that lead to adoption (information or recommendation) among own questions, by candidate."""
    adopting = L.QUESTION_GROUPS["info"] + L.QUESTION_GROUPS["recommendation"]
    return questions.where("candidate IS NOT NULL").groupBy("candidate").agg(F.count_if(F.col("question_type").isin(*adopting)).alias("adopting"), F.count("*").alias("n")).withColumn("share", ratio("adopting", "n"))


def own_negatives(units: DataFrame) -> DataFrame:
    """Own negative units by aspect and perspective."""
    return units.where(is_own() & (F.col("polarity") == "negative")).groupBy("aspect", "perspective").agg(F.count("*").alias("n"))


def strong_opinions(units: DataFrame, least: int = 3) -> DataFrame:
    """A10: counts and index of units of high intensity, by candidate."""
    return index_by(units.where((strength() >= least) & F.col("candidate").isNotNull()), "candidate")


def confirm_questions(questions: DataFrame, pattern: str = L.CONFIRM_REQUEST, examples: int = 5) -> DataFrame:
    """Questions that ask for confirmation, by candidate, and the first examples by id."""
    hit = questions.where(F.col("quote").rlike(pattern))
    some = hit.withColumn("rn", F.row_number().over(Window.partitionBy("candidate").orderBy("question_id"))).where(F.col("rn") <= examples)
    shown = some.groupBy("candidate").agg(F.array_join(F.transform(F.sort_array(F.collect_list("question_id")), lambda x: x.cast("string")), ",").alias("examples"))
    n = hit.groupBy("candidate").agg(F.count("*").alias("n"))
    return n.join(shown, n["candidate"].eqNullSafe(shown["candidate"])).select(n["candidate"], "n", "examples")


def totals(units: DataFrame, questions: DataFrame) -> DataFrame:
    """Units and questions by side and channel."""
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), side().alias("side"), "channel")
    return tag(units, "unit").unionByName(tag(questions, "question")).groupBy("kind", "side", "channel").agg(F.count("*").alias("n"))


def evidence(units: DataFrame, cap: int = L.EVIDENCE_CAP) -> DataFrame:
    """Own negative and positive units, at most `cap` of each, strongest first."""
    w = Window.partitionBy("polarity").orderBy(F.desc(strength()), "unit_id")
    own = units.where(is_own() & F.col("polarity").isin("positive", "negative"))
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("polarity", "rank", "unit_id", "aspect")


def focus_aspect(verdicts: DataFrame) -> DataFrame:
    """The aspect one is behind in with most own units."""
    return verdicts.where(F.col("verdict") == L.VERDICTS["behind"]).orderBy(F.desc("own_n"), "aspect").limit(1).select("aspect", "own_n", "gap")


def heat_map(units: DataFrame) -> DataFrame:
    """Counts by aspect and side, net, with excluded units as a side of their own."""
    return units.groupBy("aspect", side().alias("side")).agg(*counts()).withColumn("net", F.col("pos") - F.col("neg"))


def weakness_rank(units: DataFrame) -> DataFrame:
    """Aspects by own net, weakest first."""
    own = heat_map(units).where("side = 'own'")
    return own.select("aspect", "net", F.row_number().over(Window.orderBy("net", "aspect")).alias("rank"))


def opportunity_rank(units: DataFrame) -> DataFrame:
    """Aspects in which competitors' mean net per unit is below one's own, widest first; compared by cross products."""
    nets = heat_map(units).where("side <> 'excluded'").groupBy("aspect").pivot("side", ["own", "competitor"]).agg(F.sum("net").alias("net"), F.sum("n").alias("n"))
    gap = (F.col("competitor_net") * F.col("own_n") - F.col("own_net") * F.col("competitor_n")) / (F.col("own_n") * F.col("competitor_n"))
    return nets.withColumn("gap", gap).where("gap < 0").select("aspect", "gap", F.row_number().over(Window.orderBy("gap", "aspect")).alias("rank"))


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """Count by keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def perspective_cube(units: DataFrame) -> DataFrame:
    """Aspect by candidate by perspective, counts of each polarity."""
    return units.where("candidate IS NOT NULL").groupBy("aspect", "candidate", "perspective").agg(*counts())


def top_aspects(units: DataFrame, floor: float = 0.5, share: float = 0.5, excluded: tuple[str, ...] = (L.OTHER, L.OVERALL)) -> DataFrame:
    """Aspects by volume until they cover `share`, the one that crosses included, none below `floor` of the mean.

    Volumes are one row per aspect, so the running sum's single window holds aspects only, never units.
    """
    volume = units.where("candidate IS NOT NULL").where(~F.col("aspect").isin(*excluded)).groupBy("aspect").agg(F.count("*").alias("volume"))
    every, down = Window.partitionBy(), Window.orderBy(F.desc("volume"), "aspect").rowsBetween(Window.unboundedPreceding, 0)
    ranked = volume.select("*", F.sum("volume").over(every).alias("total"), F.count("*").over(every).alias("k"), F.sum("volume").over(down).alias("running"))
    return ranked.where((F.col("volume") * F.col("k") >= F.col("total") * floor) & (F.col("running") - F.col("volume") < F.col("total") * share)).select("aspect", "volume", "running")


def own_only_flags(units: DataFrame, rate: float = 0.5, margin: float = 0.3, least: int = 4) -> DataFrame:
    """Aspects where one's own negative (or positive) rate is high and `margin` above every competitor's."""
    facts = units.where("candidate IS NOT NULL").groupBy("aspect", F.when(is_own(), "own").otherwise(F.col("candidate")).alias("who")).agg(*counts()).where(F.col("n") >= least)
    long = facts.select("aspect", "who", "n", F.explode(F.array(F.struct(F.lit("negative").alias("flag"), F.col("neg").alias("k")), F.struct(F.lit("positive").alias("flag"), F.col("pos").alias("k")))).alias("x")).select("aspect", "who", "x.flag", (F.col("x.k") / F.col("n")).alias("rate"))
    rival = long.where("who <> 'own'").groupBy("aspect", "flag").agg(F.max("rate").alias("rival_rate"))
    own = long.where("who = 'own'").select("aspect", "flag", F.col("rate").alias("own_rate"))
    return own.join(rival, ["aspect", "flag"]).where((F.col("own_rate") >= rate) & (F.col("own_rate") - F.col("rival_rate") >= margin))


def card_stats(units: DataFrame) -> DataFrame:
    """By aspect, own counts, the most frequent perspective (ties by name), and competitors' summed negatives."""
    own = units.where(is_own()).groupBy("aspect").agg(*counts())
    tops = units.where(is_own()).groupBy("aspect", "perspective").agg(F.count("*").alias("k"))
    top = tops.withColumn("rn", F.row_number().over(Window.partitionBy("aspect").orderBy(F.desc("k"), "perspective"))).where("rn = 1").select("aspect", F.col("perspective").alias("top_perspective"))
    rival = units.where("candidate IS NOT NULL").where(~is_own()).groupBy("aspect").agg(F.count("*").alias("rival_n"), F.count_if(F.col("polarity") == "negative").alias("rival_neg"))
    return own.join(top, "aspect", "left").join(rival, "aspect", "left")


def channel_detail(units: DataFrame, questions: DataFrame) -> DataFrame:
    """By candidate, distinct sources of each channel, units and questions."""
    u = units.where("candidate IS NOT NULL").groupBy("candidate").agg(F.count_distinct(F.when(F.col("channel") == "youtube", F.col("source_url"))).alias("videos"), F.count_distinct(F.when(F.col("channel") != "youtube", F.col("source_url"))).alias("posts"), F.count("*").alias("units"))
    q = questions.where("candidate IS NOT NULL").groupBy("candidate").agg(F.count("*").alias("questions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return u.join(q, "candidate", "full").select("candidate", *(zero(c) for c in ("videos", "posts", "units", "questions")))


def shares(rows: DataFrame, key: str, *within: str) -> DataFrame:
    """Count and unrounded share of each value of a key."""
    n = rows.groupBy(*within, key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*within))
    return n.withColumn("share", F.col("n") / total)


def top_values(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values, ties by name."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def cross_tab(units: DataFrame, questions: DataFrame) -> DataFrame:
    """By aspect, units of each polarity and questions, aspects of either side."""
    u = units.groupBy("aspect").agg(*counts())
    q = questions.groupBy("aspect").agg(F.count("*").alias("questions"))
    return u.join(q, "aspect", "full").select("aspect", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "pos", "neg", "neu", "questions")))


def timeline(units: DataFrame) -> DataFrame:
    """By candidate and month, count, signed sum and counts of each polarity; rows without a date are left out."""
    month = F.substring("posted_at", 1, 7)
    dated = units.where("candidate IS NOT NULL AND length(posted_at) >= 7")
    return dated.groupBy("candidate", month.alias("month")).agg(*counts(), F.sum(sign()).cast("long").alias("signed")).withColumn("mean_sign", ratio("signed", "n"))


def caption(units: DataFrame, key: str, covering: float = 0.5) -> DataFrame:
    """The most frequent values that together cover half of one's own units, with own and overall counts."""
    own = units.where(is_own()).groupBy(key).agg(F.count("*").alias("own_n"))
    every = units.groupBy(key).agg(F.count("*").alias("all_n"))
    whole, down = Window.partitionBy(), Window.orderBy(F.desc("own_n"), key).rowsBetween(Window.unboundedPreceding, 0)
    joined = own.join(every, key).select("*", F.sum("own_n").over(whole).alias("own_total"), F.sum("own_n").over(down).alias("running"))
    all_total = units.agg(F.count("*").alias("all_total"))
    kept = joined.where(F.col("running") - F.col("own_n") < F.col("own_total") * covering).crossJoin(F.broadcast(all_total))
    return kept.withColumn("bias", F.col("own_n") / F.col("own_total") - F.col("all_n") / F.col("all_total"))


def question_scatter(units: DataFrame, questions: DataFrame, k: int = 6) -> DataFrame:
    """The k aspects with most questions, with the share of negative units."""
    u = units.groupBy("aspect").agg(F.count("*").alias("units"), F.count_if(F.col("polarity") == "negative").alias("neg"))
    return top_values(questions, "aspect", k).withColumnRenamed("n", "questions").join(u, "aspect", "left").withColumn("negative_rate", ratio("neg", "units"))


def takeaways(units: DataFrame, zone: float = 0.15) -> DataFrame:
    """Own index against the mean of competitors' indices by aspect, its zone, and how much it matters."""
    facts = index_by(units.where("candidate IS NOT NULL"), "aspect", "candidate")
    own = facts.where(is_own()).select("aspect", F.col("n").alias("own_n"), F.col("index").alias("own_index"))
    rival = facts.where(~is_own()).groupBy("aspect").agg(F.min("index").alias("low"), F.max("index").alias("high"), (F.sum((F.col("num") * 1_000_000 / F.col("den")).cast("long")) / F.count("*") / 1_000_000).alias("rival_index"))
    gap = F.col("own_index") - F.col("rival_index")
    out = own.join(rival, "aspect").withColumn("gap", gap)
    place = F.when(F.col("gap") > zone, "ahead").when(F.col("gap") < -zone, "behind").otherwise("level")
    return out.select("aspect", "own_n", F.col("gap"), place.alias("zone"), (F.col("own_n") * F.greatest(F.abs("gap"), F.lit(0.01))).alias("importance"))


def perspective_own(units: DataFrame) -> DataFrame:
    """Own units by perspective."""
    return histogram(units.where(is_own()), "perspective")


def rubric_reaction(units: DataFrame, suggestions: DataFrame) -> DataFrame:
    """2 without units, 3 if channels are a proper part of {youtube, community}, 5 if half are dated and there are suggestions, else 4."""
    has = suggestions.limit(1).agg(F.count("*").alias("suggested"))
    facts = units.agg(F.count("*").alias("n"), F.count_if(F.length("posted_at") > 0).alias("dated"), F.array_sort(F.collect_set("channel")).alias("channels")).crossJoin(has)
    two = F.array(F.lit("community"), F.lit("youtube"))
    part = (F.size(F.array_except("channels", two)) == 0) & (F.size("channels") < 2)
    score = F.when(F.col("n") == 0, 2).when(part, 3).when((F.col("dated") * 2 >= F.col("n")) & (F.col("suggested") > 0), 5).otherwise(4)
    return facts.select("n", "dated", score.alias("score"))
