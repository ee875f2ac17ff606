"""Whole programs over tables: gate, prescreen and extraction of reactions, insight statistics, and the reaction report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import classify, quotes, sentiment, threads


def reactions(comments: DataFrame, videos: DataFrame, signals: Iterable[str], keywords: Iterable[str]) -> DataFrame:
    """Comments of relevant videos through routing, assembly, prescreen and extraction, to units and questions."""
    relevant = videos.where(X.relevance_gate("title", "description", signals) != "irrelevant").select("video_id")
    routed = threads.route(comments.join(relevant, "video_id", "left_semi"), keywords)
    whole = threads.assemble(routed).withColumn("text", F.concat_ws(" ", F.array("root_text"), "replies"))
    kept = classify.prescreen(whole, keywords).where("keep")
    return classify.extract_units(kept, keywords)


def insight_stats(units: DataFrame, questions: DataFrame) -> dict[str, DataFrame]:
    """The statistics of an insight report by name, all from the same two facts."""
    verdicts = sentiment.aspect_verdict(units)
    return {
        "channels": sentiment.channel_split(units), "aspects": verdicts, "perspectives": sentiment.perspective_rank(units), "questions": sentiment.question_stats(questions),
        "adoption": sentiment.adoption_share(questions), "own_negatives": sentiment.own_negatives(units), "strong": sentiment.strong_opinions(units), "totals": sentiment.totals(units, questions),
        "evidence": sentiment.evidence(units), "focus": sentiment.focus_aspect(verdicts),
    }


def reaction_report(units: DataFrame, questions: DataFrame) -> dict[str, DataFrame]:
    """The tables of a reaction report by name."""
    return {
        "heat_map": sentiment.heat_map(units), "weaknesses": sentiment.weakness_rank(units), "opportunities": sentiment.opportunity_rank(units), "cube": sentiment.perspective_cube(units),
        "selected": sentiment.top_aspects(units), "own_only": sentiment.own_only_flags(units), "cards": sentiment.card_stats(units), "channels": sentiment.channel_detail(units, questions),
        "question_shares": sentiment.shares(questions.where(sentiment.is_own()), "question_type"), "quotes": quotes.representative_quotes(units), "captions": sentiment.caption(units, "perspective"), "takeaways": sentiment.takeaways(units),
    }


#: Sections of a report by the columns that they group by: what each is of, and whether unattributed units count there.
UNIT_SECTIONS = {
    "total": (), "channel": ("side", "channel"), "candidate": ("candidate",), "candidate_channel": ("candidate", "channel"), "aspect": ("aspect", "candidate"), "perspective": ("perspective", "candidate"),
    "heat_map": ("aspect", "side"), "histogram": ("aspect", "perspective"), "cube": ("aspect", "candidate", "perspective"),
}
QUESTION_SECTIONS = {"questions": (), "question_type": ("question_type", "side"), "question_group": ("question_group", "candidate"), "question_aspect": ("aspect", "side"), "question_channel": ("channel", "side")}
_MEASURES = ("n", "pos", "neg", "neu", "num", "den", "strong", "strong_num", "strong_den")


def _sections(facts: DataFrame, sections: dict[str, tuple[str, ...]], measures: Iterable[str]) -> DataFrame:
    """Sums of `measures` for all sections at once: rows are spread over the sections after they have been summed up by all columns, so the fact is read once and its rows are shuffled as sums."""
    keys = list(dict.fromkeys(k for by in sections.values() for k in by))
    base = facts.groupBy(*keys).agg(*[F.sum(m).cast("long").alias(m) for m in measures])
    sets = [list(by) for by in sections.values()]
    cube = base.groupingSets(sets, *keys).agg(F.grouping_id().alias("_id"), *[F.sum(m).cast("long").alias(m) for m in measures])
    number = {name: sum(1 << len(keys) - 1 - i for i, k in enumerate(keys) if k not in by) for name, by in sections.items()}
    section = F.coalesce(*[F.when(F.col("_id") == n, name) for name, n in number.items()])
    known = ~section.isin(*[name for name, by in sections.items() if "candidate" in by]) | F.col("candidate").isNotNull()
    return cube.withColumn("section", section).where(known & section.isNotNull()).drop("_id")


def unit_sections(units: DataFrame) -> DataFrame:
    """All unit sections, from one pass over the units: section, its keys, and counts and index parts of all and of strong units."""
    p, s, v = F.col("polarity"), sentiment.strength(), sentiment.sign()
    one = F.lit(1).cast("long")
    zero = lambda c: F.when(c, 1).otherwise(0)
    strong = s >= 3
    facts = units.select(
        "aspect", "candidate", "channel", "perspective", sentiment.side().alias("side"), one.alias("n"), zero(p == "positive").alias("pos"), zero(p == "negative").alias("neg"), zero(~p.isin("positive", "negative")).alias("neu"),
        (v * s).alias("num"), s.alias("den"), zero(strong).alias("strong"), F.when(strong, v * s).otherwise(0).alias("strong_num"), F.when(strong, s).otherwise(0).alias("strong_den"),
    )
    return _sections(facts, UNIT_SECTIONS, _MEASURES)


def question_sections(questions: DataFrame) -> DataFrame:
    """All question sections, from one pass over the questions."""
    group = F.coalesce(*[F.when(F.col("question_type").isin(*types), F.lit(g)) for g, types in L.QUESTION_GROUPS.items()], F.lit("other"))
    facts = questions.select("aspect", "candidate", "channel", "question_type", group.alias("question_group"), sentiment.side().alias("side"), F.lit(1).cast("long").alias("n"))
    return _sections(facts, QUESTION_SECTIONS, ("n",))


def statistics(units: DataFrame, questions: DataFrame) -> DataFrame:
    """The whole statistics of an insight report in one table and one plan, each fact read once.

    section, aspect, candidate, channel, perspective, side, question_type, question_group; counts; idx (index in hundredths) and
    strong_idx; level (A04); place, the rank of a candidate's index among all candidates of the same aspect, perspective or channel
    (1 for the highest, equals share a place); share, a row's part of its section's questions in per mille, rounded down.
    Ranks and shares are taken over the sums, which are as few as combinations of keys, never over the facts.
    """
    both = unit_sections(units).unionByName(question_sections(questions), allowMissingColumns=True)
    ranked = both.withColumns({"idx": sentiment.hundredths(), "strong_idx": sentiment.hundredths("strong_num", "strong_den"), "level": sentiment.sample_level(F.col("n"))})
    rivals = Window.partitionBy("section", "aspect", "perspective", "channel").orderBy(F.desc_nulls_last("idx"))
    place = F.when(F.col("candidate").isNotNull() & F.col("idx").isNotNull() & (F.col("section") != "cube"), F.rank().over(rivals))
    asked = F.col("section").startswith("question")
    share = F.when(asked, F.floor(1000 * F.col("n") / F.sum("n").over(Window.partitionBy("section"))).cast("int"))
    return ranked.withColumns({"place": place, "share": share}).drop("strong_num", "strong_den")


def reaction_sections(units: DataFrame) -> DataFrame:
    """Ranks of a reaction report from the same one pass: section (weakness, opportunity, volume), aspect, value and rank.

    weakness ranks aspects by one's own net sentiment, least first; opportunity those where one's own net rate lies above the
    competitors' the most; volume by units, with the running share of all in per mille.
    """
    cube = unit_sections(units)
    heat = cube.where("section = 'heat_map'")
    net = lambda s: F.sum(F.when(F.col("side") == s, F.col("pos") - F.col("neg")))
    n = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")))
    by = heat.groupBy("aspect").agg(net("own").alias("own_net"), n("own").alias("own_n"), net("competitor").alias("comp_net"), n("competitor").alias("comp_n"), F.sum("n").alias("volume"))
    gap = F.floor((F.col("own_net") * F.col("comp_n") - F.col("comp_net") * F.col("own_n")) * 1000 / (F.col("own_n") * F.col("comp_n"))).cast("long")
    rows = by.select("aspect", F.explode(F.array(
        F.struct(F.lit("weakness").alias("section"), F.col("own_net").alias("value"), F.col("own_net").alias("by")),
        F.struct(F.lit("opportunity").alias("section"), F.when(gap > 0, gap).alias("value"), (-gap).alias("by")),
        F.struct(F.lit("volume").alias("section"), F.col("volume").alias("value"), (-F.col("volume")).alias("by")),
    )).alias("x")).select("aspect", "x.*").where("value IS NOT NULL")
    w = Window.partitionBy("section").orderBy("by", F.asc_nulls_first("aspect"))  # a row for each aspect
    upto = F.when(F.col("section") == "volume", F.floor(1000 * F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("value").over(Window.partitionBy("section"))).cast("int"))
    return rows.select("section", "aspect", "value", F.row_number().over(w).alias("rank"), upto.alias("running"))


def report_payload(stats: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """Counts by display name and channel, without index values."""
    return stats["channels"].join(names, "candidate", "left").select(F.coalesce("name", "candidate").alias("name"), "channel", "n", "pos", "neg", "neu")


def steps(results: DataFrame) -> DataFrame:
    """P10: status of each step: error, skipped or completed."""
    return results.withColumn("status", F.when(F.col("error") != "", "error").when(~F.col("active"), "skipped").otherwise("completed"))


def recovered(branch: DataFrame, saved: DataFrame, key: str = "report_type") -> DataFrame:
    """Outputs of a branch, and for keys that it lacks the saved ones."""
    return branch.unionByName(saved.join(branch, key, "left_anti"))


def active_reports(config: DataFrame) -> DataFrame:
    """reports that are active and draw on the first flow."""
    return config.where(F.col("active") & F.col("source_flow").isin("A", "A+B"))


def hints_for(config: DataFrame, source: str) -> DataFrame:
    """search hints of active reports for a source; hints without a source go to all."""
    h = active_reports(config).select("report", F.explode("hints").alias("h"))
    return h.where(F.col("h.source").isNull() | (F.col("h.source") == source)).select("report", F.col("h.template").alias("template"))
