"""Search plans, pools of addresses, and selections from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .bounds import dimension

#: Priority of the source that decides a feature's metadata.
SOURCE_ORDER = ("official", "blog_community", "owned_channels", "macro")
COVERAGE_RANK = {"not_found": 1, "partial": 2, "sufficient": 3}


def _nth(partition: list, *order) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def _rank(column: str, ranks: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in ranks.items()], F.lit(0))


def coverage_union(coverage: DataFrame) -> DataFrame:
    """One row per report, feature and candidate: best coverage, deciding source, distinct addresses."""
    source = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(SOURCE_ORDER)], F.lit(len(SOURCE_ORDER)))
    known = coverage.where("report IS NOT NULL AND feature IS NOT NULL")
    names = F.array(*[F.lit(k) for k in COVERAGE_RANK])
    return known.groupBy("report", "feature", "candidate").agg(
        F.get(names, F.max(_rank("coverage", COVERAGE_RANK)) - 1).alias("coverage"), F.min_by("source", source).alias("source"), F.count_distinct("url").alias("n_urls"), F.min("url").alias("first_url"),
    )


def first_origin(coverage: DataFrame) -> DataFrame:
    """Each address once per feature and candidate, from the source of highest priority."""
    source = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(SOURCE_ORDER)], F.lit(len(SOURCE_ORDER)))
    return coverage.withColumn("_rn", _nth(["report", "feature", "candidate", "url"], source, "pos")).where("_rn = 1").drop("_rn")


def extraction_targets(coverage: DataFrame, per_pair: int = 5) -> DataFrame:
    """Addresses to read per candidate: the best of each feature and candidate by tier, with the features they serve."""
    best = coverage.where("coverage <> 'not_found'").groupBy("feature", "candidate", "url").agg(F.min("tier").alias("tier"))
    kept = best.withColumn("_rn", _nth(["feature", "candidate"], "tier", "url")).where(F.col("_rn") <= per_pair)
    return kept.groupBy("candidate", "url").agg(F.min("tier").alias("tier"), F.array_sort(F.collect_set("feature")).alias("features"))


def cover(targets: DataFrame, cap: int = 25) -> DataFrame:
    """At most `cap` addresses per candidate: greedily those that serve most features not yet served, then by tier and name.

    Each choice depends on all before, so a candidate's targets are chosen in pandas; J24 has bounded them by features times
    addresses per pair.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tier", "url"], ignore_index=True)
        if len(rows) <= cap:
            return rows
        sets, left, served, chosen = [set(f) for f in rows["features"]], list(range(len(rows))), set(), []
        while left and len(chosen) < cap:
            best = min(left, key=lambda i: (-len(sets[i] - served), i))
            if not sets[best] - served:
                break
            chosen.append(best)
            served |= sets[best]
            left.remove(best)
        chosen += left[: cap - len(chosen)]
        return rows.loc[sorted(chosen)]

    return targets.groupBy("candidate").applyInPandas(choose, targets.schema)


def search_plan(candidates: DataFrame, hints: DataFrame) -> DataFrame:
    """Queries of every hint for every candidate, each query once, with what asked for it.

    Both sides are small dimensions (tens of rows), of which the hints are broadcast after a check of their number.
    """
    dimension(hints, "hints", 10_000)
    query = F.trim(F.replace(F.col("template"), F.lit("{candidate}"), F.col("name")))
    plan = candidates.crossJoin(F.broadcast(hints)).withColumn("query", query)
    return plan.groupBy("query").agg(F.min("candidate").alias("candidate"), F.array_join(F.array_sort(F.collect_set("report")), ",").alias("reports"), F.count("*").alias("n"))


def matched_pool(found: DataFrame) -> DataFrame:
    """Search results by normalised address: first by order, and all candidates that found it."""
    return found.groupBy(U.dedup_key("url").alias("key")).agg(F.min_by("url", "pos").alias("url"), F.array_sort(F.collect_set("candidate")).alias("matched"))


def merged_sources(official: DataFrame, search: DataFrame) -> DataFrame:
    """Official and found addresses per candidate, each once, official first."""
    rows = official.withColumn("_o", F.lit(0)).unionByName(search.withColumn("_o", F.lit(1)))
    kept = rows.withColumn("_rn", _nth(["candidate", "url"], "_o", "pos")).where("_rn = 1")
    return kept.select("candidate", "url", F.when(F.col("_o") == 0, "official").otherwise("search").alias("source_type"))


def gated(coverage: DataFrame, domains: DataFrame) -> DataFrame:
    """Addresses on a candidate's official domains (candidate, domain), by the host and its parents."""
    h = F.split(U.host("url"), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_join(F.slice(h, i, F.size(h)), "."))
    keys = coverage.select("*", F.explode(parents).alias("domain"))
    return keys.join(domains.distinct(), ["candidate", "domain"]).drop("domain").distinct()


def blocked(rows: DataFrame, blocklist: DataFrame) -> DataFrame:
    """rows whose host is no blocked domain or subdomain; an equi-join on the host's parents, not a theta join."""
    h = F.split(U.host("url"), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_join(F.slice(h, i, F.size(h)), "."))
    bad = rows.select("url", F.explode(parents).alias("domain")).join(blocklist, "domain", "left_semi").select("url").distinct()
    return rows.join(bad, "url", "left_anti")


def capped(urls: DataFrame, cap: int, group: str = "candidate") -> DataFrame:
    """Carried addresses always, then the first of each category, then the rest in order, up to the cap; category settles ties."""
    w = _nth([group, "carried", "category"], "pos", "url")
    ranked = urls.withColumn("_c", w).withColumn("_class", F.when(F.col("carried"), 0).when(F.col("_c") == 1, 1).otherwise(2))
    placed = ranked.withColumn("rank", _nth([group], "_class", "pos", "url", "category"))
    return placed.where(F.col("carried") | (F.col("rank") <= cap)).drop("_c", "_class")


def round_robin(pool: DataFrame, cap: int, per_site: int = 0, group: str = "candidate") -> DataFrame:
    """One address of each site per round, sites by name, newest first within a site, up to a cap per group (0: all).

    Undated addresses come after dated ones.
    """
    ranked = pool.withColumn("round", _nth([group, "site"], F.desc_nulls_last("published_at"), "url"))
    if per_site:
        ranked = ranked.where(F.col("round") <= per_site)
    placed = ranked.withColumn("rank", _nth([group], "round", "site", "url"))
    return placed.where(F.col("rank") <= cap) if cap else placed


def ranked(rows: DataFrame, keys: list[str], order: list[str], width: int = 1_000_000) -> DataFrame:
    """Rows with their `rank` among those of equal keys, in the order of columns of which the first is an integer.

    Rows are numbered within ranges of `width` values of the first column, whose starts come from counts, so that no task orders a key whole.
    """
    first = F.coalesce(F.floor(F.col(order[0]) / width), F.lit(-(1 << 62)))  # nulls come first
    counts = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], first.alias("_at")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number isn't coalesced to few large tasks
    numbered = rows.withColumn("_range", first).repartition(tasks, *keys, "_range").withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    few = counts.count() <= 100_000  # rows aren't shuffled once more to meet a number a range
    return numbered.join(F.broadcast(starts) if few else starts, same).select(*rows.columns, (F.col("_start") + F.col("_nth")).alias("rank"))


def merged_results(found: DataFrame, cap: int, group: str = "candidate") -> DataFrame:
    """Results of several queries (group, query, rank, url) in turn: first the best of each, each address once, up to a cap."""
    first = found.groupBy(group, "url").agg(F.min(F.struct("rank", "query")).alias("_at"))
    return first.withColumn("rank", _nth([group], "_at")).where(F.col("rank") <= cap).drop("_at")


def newest(pool: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k newest of each key."""
    return pool.withColumn("rank", _nth(list(keys), F.desc_nulls_last("published_at"), "url")).where(F.col("rank") <= k)


def representative(videos: DataFrame, *keys: str) -> DataFrame:
    """The most viewed video of each key, ties to the smaller id, and how many others there are."""
    top = F.max_by("video_id", F.struct("views", -F.col("video_id")))
    return videos.groupBy(*keys).agg(top.alias("video_id"), F.max("views").alias("views"), (F.count("*") - 1).alias("others"))


def best_by(rows: DataFrame, score: str, name: str, *keys: str) -> DataFrame:
    """The row of the highest score of each key, ties to the first name."""
    return rows.withColumn("_rn", _nth(list(keys), F.desc(score), name)).where("_rn = 1").drop("_rn")


def owned_channels(rows: DataFrame) -> DataFrame:
    """Each channel once per candidate, addresses with a handle first."""
    return rows.withColumn("_rn", _nth(["candidate", "channel_id"], ~F.col("url").contains("/@"), "url")).where("_rn = 1").drop("_rn")


def candidate_order(candidates: DataFrame) -> DataFrame:
    """Place of each candidate: own first, then by confidence and name. Candidates are a dimension, ranked in one task."""
    return dimension(candidates, "candidates").withColumn("rank", F.row_number().over(Window.orderBy(~F.col("candidate").startswith("own"), F.desc("confidence"), "candidate")))


def video_thresholds(videos: DataFrame, views: int = 1000, comments: int = 10) -> DataFrame:
    """videos with enough views and comments, each once per candidate."""
    return videos.where((F.col("views") >= views) & (F.col("comments") >= comments)).dropDuplicates(["candidate", "video_id"])


def resolved_source(options: DataFrame) -> DataFrame:
    """Per candidate the reachable option of the best priority, and how many reachable ones remain to fall back on."""
    ok = options.where(U.status_ok(F.col("status")))
    return ok.groupBy("candidate").agg(F.min_by("url", F.struct("priority", "url")).alias("url"), (F.count("*") - 1).alias("fallbacks"))


def failed_sources(sources: DataFrame) -> DataFrame:
    """sources to repair, and the case each is; any own one stops the run."""
    case = F.when(F.col("n_urls") == 0, "case1").when(F.col("n_ok") == 0, "case2_1").when(F.col("n_ok") < F.col("n_urls"), "case2_2").otherwise("none")
    return sources.withColumn("case", case).where("NOT validated").withColumn("critical", F.col("candidate").startswith("own_"))


def repaired(sources: DataFrame, manual: DataFrame, removed: DataFrame) -> DataFrame:
    """Sources without removed candidates, addresses overridden by manual ones."""
    kept = sources.join(removed.select("candidate"), "candidate", "left_anti")
    new = manual.select("candidate", F.col("url").alias("_url"))
    return kept.join(new, "candidate", "left").withColumn("validated", F.col("validated") | F.col("_url").isNotNull()).withColumn("url", F.coalesce("_url", "url")).drop("_url")


def validated(urls: DataFrame, months: int, now: Column) -> DataFrame:
    """validation of each address by where it comes from."""
    from ..functions import text as X

    o, ok = F.col("source_origin"), U.status_ok(F.col("status"))
    good = (
        F.when(o == "blog_community", ok & X.is_recent("published_at", now, months)).when(o == "owned_channel", ok & X.fuzzy_match("brand", "account"))
        .when(o == "macro", ok & F.col("whitelisted")).when(o == "youtube", F.col("video_known")).otherwise(ok)
    )
    return urls.withColumn("validated", F.coalesce(good, F.lit(False)))


def deficit(features: DataFrame, found: DataFrame, least: int = 2) -> DataFrame:
    """Features with fewer than `least` results, for a second search."""
    n = found.groupBy("feature").agg(F.count("*").alias("n"))
    return features.join(n, "feature", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < least)


def coverage_class(rows: DataFrame, *keys: str) -> DataFrame:
    """Coverage by number of addresses (10, 3) and of platforms (3, 1)."""
    cls = lambda n, a, b: F.when(n >= a, "sufficient").when(n >= b, "partial").otherwise("not_found")
    out = rows.groupBy(*keys).agg(F.count_distinct("url").alias("n_urls"), F.count_distinct("platform").alias("n_platforms"))
    return out.withColumn("by_urls", cls(F.col("n_urls"), 10, 3)).withColumn("by_platforms", cls(F.col("n_platforms"), 3, 1))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Rows of each coverage class by report and feature."""
    return coverage.groupBy("report", "feature").pivot("coverage", list(COVERAGE_RANK)).count().na.fill(0)


def baseline(coverage: DataFrame, official: list[str]) -> DataFrame:
    """not_found ratio, external hosts among other addresses, and mean addresses per feature and candidate, as counts."""
    h = U.host("url")
    return coverage.agg(
        F.count_if(F.col("coverage") == "not_found").alias("not_found"), F.count("*").alias("n"), F.count_if(~U.matches_any(h, official)).alias("external"),
        F.count_distinct("url").alias("urls"), F.count_distinct("report", "feature", "candidate").alias("cells"),
    )


def recall_table(found: DataFrame) -> DataFrame:
    """By site, results, distinct addresses, those that several candidates found, and dated ones."""
    per_url = found.groupBy("site", "url").agg(F.count("*").alias("n"), F.count_distinct("candidate").alias("c"), F.count_if(F.col("published_at").isNotNull()).alias("dated"))
    return per_url.groupBy("site").agg(F.sum("n").alias("n"), F.count("*").alias("urls"), F.count_if(F.col("c") > 1).alias("multi"), F.sum("dated").alias("dated"))


def profile(fetched: DataFrame) -> DataFrame:
    """Fetches by host and status with the upper median and maximum of likes."""
    k = F.floor(F.count("*") / 2).cast("int")
    return fetched.groupBy("host", "status").agg(F.count("*").alias("n"), F.max("likes").alias("max_likes"), F.get(F.sort_array(F.collect_list("likes")), k).alias("median_likes"))


def help_articles(found: DataFrame, cap: int) -> DataFrame:
    """Best keyword score of each address, the best `cap`."""
    return found.groupBy("url").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "url").limit(cap)


def expand_links(roots: DataFrame, links: DataFrame, cap: int, most_hops: int = 3) -> DataFrame:
    """Pages within `most_hops` links of the roots, at most `cap` new ones per hop, by name; hop 0 are the roots."""
    seen = roots.select("url", F.lit(0).alias("hop")).distinct()
    last = seen
    for hop in range(1, most_hops + 1):
        new = last.join(links, last["url"] == links["src"]).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        last = new.orderBy("url").limit(cap).withColumn("hop", F.lit(hop))
        seen = seen.unionByName(last)
    return seen


def page_budget(pages: DataFrame, *keys: str, page: int = 6000, total: int = 30_000) -> DataFrame:
    """Characters to read of each page of a group."""
    return pages.withColumn("budget", F.least(F.lit(page), F.floor(F.lit(total) / F.count("*").over(Window.partitionBy(*keys)))).cast("int"))


def injected(targets: DataFrame, extra: DataFrame) -> DataFrame:
    """Extra addresses that a candidate does not have yet, added at the last tier."""
    new = extra.join(targets, ["candidate", "url"], "left_anti").select("candidate", "url", F.lit(3).alias("tier"), "features")
    return targets.unionByName(new)


def restored_selection(selected: DataFrame, carried: DataFrame, search: DataFrame) -> DataFrame:
    """A past selection with where each address came from: carried, then the first query that found it, else unresolved."""
    first = search.groupBy("url").agg(F.min(F.struct("rank", "query"))["query"].alias("query"))
    mark = carried.select("url", F.lit(True).alias("_carried")).distinct()
    out = selected.join(mark, "url", "left").join(first, "url", "left")
    return out.select("url", F.when(F.col("_carried"), "carried").when(F.col("query").isNotNull(), "search").otherwise("unresolved").alias("origin"), "query")
