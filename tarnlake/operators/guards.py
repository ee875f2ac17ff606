"""Pruning, site and domain lookups, validation of selections, and what is shown of them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U


def pruned_for_report(candidates: DataFrame, report: str) -> DataFrame:
    """candidates with the addresses that a report may use: official ones, and those whose `matched` reports hold it.

    `urls` is an array of structs with url, origin and matched; candidates left without an address are dropped.
    """
    kept = F.filter("urls", lambda u: F.coalesce(u["origin"] == "official_source", F.lit(False)) | F.coalesce(F.array_contains(u["matched"], report), F.lit(False)))
    return candidates.withColumn("urls", kept).where(F.size("urls") > 0)


def domain_signals(products: DataFrame, seeds: Iterable[str], generic: str) -> DataFrame:
    """the vocabulary of a domain: seeds, and the tokens of product names (two characters or more) without a generic word."""
    parts = F.split(F.replace(F.lower(F.coalesce("name", F.lit(""))), F.lit(generic), F.lit(" ")), r"\s+")
    found = products.select(F.explode(F.filter(parts, lambda t: F.length(t) >= 2)).alias("signal"))
    fixed = products.sparkSession.createDataFrame([(s.lower(),) for s in seeds], "signal string")
    return found.unionByName(fixed).distinct()


def resolved_sites(fixed: Mapping[str, str], chosen: DataFrame, registry: DataFrame) -> DataFrame:
    """Domain and collection mode: the fixed sites, and chosen ones (domain) that the registry (domain, mode) knows."""
    spark = chosen.sparkSession
    own = spark.createDataFrame(list(fixed.items()), "domain string, mode string")
    modes = registry.where(F.length("domain") > 0).select("domain", F.coalesce("mode", F.lit("snippet_only")).alias("mode")).dropDuplicates(["domain"])
    more = chosen.select("domain").distinct().join(own, "domain", "left_anti").join(modes, "domain")
    return own.unionByName(more.select("domain", "mode"))


def known_domains(items: DataFrame, known: DataFrame) -> DataFrame:
    """Domains of each item (id, brand, product) by any of its keys: brand, product, and their tokens, as slugs.

    `known` has key (a slug), pos and domain; a domain that several keys give counts once.
    """
    names = F.array(F.coalesce("brand", F.lit("")), F.coalesce("product", F.lit("")))
    tokens = F.flatten(F.transform(names, lambda n: X.tokens(n)))
    keys = F.array_distinct(F.transform(F.concat(names, tokens), lambda k: X.slug(k)))
    asked = items.select("id", F.explode(F.filter(keys, lambda k: k != "")).alias("key"))
    return asked.join(known, "key").groupBy("id", "domain").agg(F.min("pos").alias("pos"))


def domain_cluster(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """All domains of the known key to one of whose domains a host belongs; of several keys the first by name."""
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = hosts.where("host <> ''").select("host", F.explode(parents).alias("domain")).join(known.select("domain", "key"), "domain")
    first = met.groupBy("host").agg(F.min("key").alias("key"))
    return first.join(known.groupBy("key").agg(F.array_sort(F.collect_set("domain")).alias("domains")), "key").select("host", "domains")


def host_has_token(url: X.Text, tokens: Column) -> Column:
    """A brand token stands in the host."""
    h = U.host(url)
    return (h != "") & F.exists(tokens, lambda t: (t != "") & h.contains(t))


def title_names_brand(title: X.Text, name: X.Text, brand: X.Text, generic: Iterable[str] = ()) -> Column:
    """A channel's title holds the brand, or a word of the product's name that isn't generic, spaces and case aside."""
    flat = lambda c: F.replace(F.lower(X._c(c)), F.lit(" "), F.lit(""))
    t, b = flat(title), flat(brand)
    tokens = F.filter(F.array_except(F.split(F.lower(X._c(name)), r"\s+"), X.words(generic)), lambda w: F.length(w) >= 2)
    return (t != "") & (((b != "") & t.contains(b)) | F.exists(tokens, lambda w: t.contains(w)))


def selection_errors(selected: DataFrame, offered: DataFrame, least: int = 1, most: int = 10) -> DataFrame:
    """what is wrong with each selection (selection, id): ids that were not offered, and a number of ids out of bounds."""
    n = selected.groupBy("selection").agg(F.count_distinct("id").alias("n"))
    wrong = n.where(~F.col("n").between(least, most)).select("selection", F.lit(None).cast(selected.schema["id"].dataType).alias("id"), F.when(F.col("n") < least, "too few").otherwise("too many").alias("error"))
    unknown = selected.distinct().join(offered.select("id").distinct(), "id", "left_anti")
    return wrong.unionByName(unknown.select("selection", "id", F.lit("not offered").alias("error")))


def selected_reports(selected: DataFrame, features: DataFrame) -> DataFrame:
    """the reports that the selected features belong to."""
    return features.join(selected.select(F.col("id").alias("feature")).distinct(), "feature", "left_semi").select("report").distinct()


def length_profile(posts: DataFrame, candidates: Iterable[str], per_site: int, chunk: int = 3000, seed: int = 42) -> DataFrame:
    """Posts of a sample of each site with their length, the chunks they need and how many candidates they name (3 and more as 3).

    The sample is the feature: the first `per_site` posts of a site in the order of a seeded hash.
    """
    w = Window.partitionBy("site").orderBy(F.xxhash64(F.lit(seed), "post_id"), "post_id")
    n = F.length(F.coalesce("body", F.lit("")))
    named = sum((F.coalesce("body", F.lit("")).contains(c).cast("int") for c in candidates), F.lit(0))
    sample = posts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_site)
    return sample.select("site", "post_id", n.alias("chars"), F.ceil(n / chunk).cast("int").alias("chunks"), F.least(named, F.lit(3)).alias("mentions"))


def display_label(candidate: X.Text, labels: Mapping[str, str]) -> Column:
    """A candidate's label where one is set, else its id."""
    c = X._c(candidate)
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in labels.items()], c)


def rendered(members: DataFrame, most: int = 180) -> DataFrame:
    """The text of each batch: a header when the parent changes, numbered members below it, cut to `most` characters.

    `members` has batch, pos, parent and text. A batch is bounded by the size that W11 gives it.
    """
    before = F.lag("parent").over(Window.partitionBy("batch").orderBy("pos"))
    nth = F.row_number().over(Window.partitionBy("batch").orderBy("pos"))
    line = F.concat(F.when(before.eqNullSafe(F.col("parent")), "").otherwise(F.concat(F.lit("# "), "parent", F.lit("\n"))), F.lit("[t"), nth, F.lit("] "), F.substring("text", 1, most))
    lines = members.select("batch", "pos", line.alias("line"))
    return lines.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("prompt"))


def rekeyed(stored: DataFrame, corrections: Mapping[str, str]) -> DataFrame:
    """Stored rows (cache_key, candidates, agent) with corrected candidate ids, and the key that follows from them."""
    fixed = F.transform("candidates", lambda c: display_label(c, corrections))
    return stored.withColumn("candidates", fixed).withColumn("cache_key", X.canonical_key("agent", F.array_join("candidates", ",")))


def tuples_by_candidate(units: DataFrame, labels: DataFrame) -> DataFrame:
    """By candidate of a unit's label, its number of units and of each channel's; units without a known label are left out."""
    known = units.join(labels, "label").groupBy("candidate", F.coalesce("channel", F.lit("")).alias("channel")).agg(F.count("*").alias("n"))
    return known.groupBy("candidate").agg(F.sum("n").alias("sample_size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "n")))).alias("channel_counts"))


def query_strings(name: X.Text, labels: Column, most: int = 5) -> Column:
    """A query for each of the first distinct labels of a subpage."""
    return F.transform(F.slice(F.array_distinct(labels), 1, most), lambda x: F.concat_ws(" ", X._c(name), x))
