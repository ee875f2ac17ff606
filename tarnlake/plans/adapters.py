"""Collections of several sources put together from a configuration: an adapter, a predicate and limits a source.

A configuration is a table with a row for each source and target column. Plans are composed from it, one branch a source, so
that Catalyst pushes each source's predicate and columns into its scan; only the configuration, a dimension, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.bounds import dimension
from . import views as V
from .collections import _HOST
from .registry import Registry

query = Registry()

#: A configuration: what `name` is by `kind`: column (a target column and its SQL expression), keep (a predicate) or limit (least score, most rows of a candidate).
CONFIG = "source string, kind string, name string, value string"


def free(name: str, rows: DataFrame) -> str:
    """`name`, with underscores until no column of the rows has it."""
    while name.lower() in {c.lower() for c in rows.columns}:
        name += "_"
    return name


@dataclass
class Source:
    """How one source is read: expressions of target columns, rows that count, and limits."""

    name: str
    columns: dict[str, str] = field(default_factory=dict)
    keep: list[str] = field(default_factory=list)
    least: int | None = None
    most: int | None = None


def sources_of(config: DataFrame) -> list[Source]:
    """The sources of a configuration, by name. Kinds that aren't known are an error; of a column that is given twice the greatest expression holds."""
    out: dict[str, Source] = {}
    for r in sorted(dimension(config, "configurations").collect(), key=lambda r: (r["source"], r["kind"], r["name"], r["value"])):
        s = out.setdefault(r["source"], Source(r["source"]))
        if r["kind"] == "column":
            s.columns[r["name"]] = r["value"]
        elif r["kind"] == "keep":
            s.keep.append(r["value"])
        elif r["kind"] == "limit" and r["name"] in ("least", "most"):
            setattr(s, r["name"], int(r["value"]))
        else:
            raise ValueError(f"unknown setting {r['kind']} {r['name']} of {r['source']}")
    return list(out.values())


def adapted(tables: Mapping[str, DataFrame], sources: list[Source]) -> DataFrame:
    """Rows of all sources under the same columns; columns that a source lacks are null. A source without a table is an error."""
    parts = []
    for s in sources:
        rows = tables[s.name]
        for predicate in s.keep:
            rows = rows.where(predicate)
        parts.append(rows.select(F.lit(s.name).alias("source"), *[F.expr(e).alias(c) for c, e in s.columns.items()]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _by_source(sources: list[Source], value: str) -> Column:
    known = [F.when(F.col("source") == s.name, F.lit(getattr(s, value))) for s in sources if getattr(s, value) is not None]
    return F.coalesce(*known, F.lit(None).cast("int"))


def collected(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """Adapted rows with a status: below (under the source's least score), repeated (a later row of the same address), cut (beyond the most of its candidate) or kept.

    Of rows that share an address the one of the highest score stays, then of the first source, then of the smallest item_id; a
    candidate's rows of a source are kept by score, then item_id, which tells the rows of a source apart. Rows without an address
    repeat nothing, a null score is the lowest, a null candidate is one of its own. The best row of an address and the last
    row within a limit come from aggregates that combine before the shuffle, and rows are compared with them: no window holds an
    address, a source or a candidate whole.
    """
    least = _by_source(sources, "least")
    at = lambda *more: F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("by"), *more)
    names = {n: free(n, rows) for n in ("_below", "_key", "_order", "_best", "_last", "_n")}
    below, key, order, best, last, nth = names.values()
    marked = rows.withColumns({below: least.isNotNull() & (F.coalesce(F.col("score"), least - 1) < least), key: F.when(F.col("url") != "", U.dedup_key("url")), order: at("source", "item_id")})
    first = marked.where(~F.col(below) & F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(best))
    # rows without an address meet nothing: left in the join, their null keys would all be dealt to one task
    marked = marked.where(F.col(key).isNotNull()).join(first, key, "left").unionByName(marked.where(F.col(key).isNull()).withColumn(best, F.lit(None).cast(first.schema[best].dataType)))
    marked = marked.withColumn("status", F.when(F.col(below), "below").when(F.col(best).isNotNull() & (F.col(order) != F.col(best)), "repeated"))
    limits = {s.name: s.most for s in sources if s.most is not None}
    if limits:
        w = Window.partitionBy("source", "candidate").orderBy(order)
        within = marked.where(F.col("status").isNull() & F.col("source").isin(*limits)).select("source", "candidate", order, F.row_number().over(w).alias(nth))
        within = within.where(F.col(nth) <= max(limits.values())).where(F.col(nth) <= _by_source(sources, "most"))  # ranks beyond the largest limit end in each task
        ends = within.groupBy(F.col("source").alias("_s"), F.col("candidate").alias("_c")).agg(F.max(order).alias(last))
        marked = marked.join(ends, (F.col("source") == F.col("_s")) & F.col("candidate").eqNullSafe(F.col("_c")), "left").drop("_s", "_c")
        marked = marked.withColumn("status", F.coalesce("status", F.when(F.col("source").isin(*limits) & (F.col(last).isNull() | (F.col(order) > F.col(last))), "cut")))
    return marked.select(*rows.columns, F.coalesce("status", F.lit("kept")).alias("status"))


def funnel(marked: DataFrame) -> DataFrame:
    """Rows of each source by status, and in all."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return marked.groupBy("source").agg(F.count("*").alias("n"), of("below"), of("repeated"), of("cut"), of("kept"))


_CONFIG = {
    "youtube": {"item_id": "conv_id * 100 + turn", "candidate": "concat('c', conv_id % 4)", "url": "concat('https://www.youtube.com/watch?v=', conv_id)", "body_chars": "length(text)", "score": "cast(length(text) % 10 as int)"},
    "community": {"item_id": "doc_id", "candidate": "concat('c', doc_id % 4)", "url": "concat('https://forum.example/', source, '/', doc_id)", "body_chars": "length(text)", "score": "cast(length(text) % 10 as int)", "label": "source"},
    "blog": {"item_id": "page_id", "candidate": "concat('c', page_id % 4)", "url": "url", "body_chars": "length(html)", "score": "cast(length(html) % 10 as int)"},
    "official": {"item_id": "l_orderkey * 10 + l_linenumber", "candidate": "concat('c', l_suppkey % 4)", "url": "concat('https://www.s', l_suppkey % 9, '.example.com/p', l_partkey % 300)", "score": "cast(l_quantity as int)", "label": "l_returnflag"},
    "owned_channels": {"item_id": "o_orderkey", "candidate": "concat('c', o_custkey % 4)", "score": "cast(o_totalprice / 10000 as int)", "label": "o_orderpriority"},
}
_TABLES = {"youtube": "conversations", "community": "documents", "blog": "pages", "official": "lineitem", "owned_channels": "orders"}
_KEEP = {"youtube": "role = 'user'", "community": "length(text) >= 200", "blog": "url is not null", "official": "l_linenumber = 1", "owned_channels": "o_totalprice > 100000"}
_LIMITS = {"youtube": (3, 20), "community": (2, 50), "blog": (1, 30), "official": (10, 60), "owned_channels": (None, 40)}
_COLUMNS = ("item_id", "candidate", "url", "body_chars", "score", "label")


def _sources(spark) -> list[Source]:
    rows = [(s, "column", c, e) for s, columns in _CONFIG.items() for c, e in columns.items()] + [(s, "keep", "", k) for s, k in _KEEP.items()]
    rows += [(s, "limit", n, str(v)) for s, limits in _LIMITS.items() for n, v in zip(("least", "most"), limits) if v is not None]
    return sources_of(spark.createDataFrame(rows, CONFIG))


def _adapted(spark, d):
    return adapted({s: V.read(spark, d, t) for s, t in _TABLES.items()}, _sources(spark))


_KINDS = {"item_id": "BIGINT", "body_chars": "INTEGER", "score": "INTEGER"}
_ADAPTED = "adapted AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS source, " + ", ".join(f"CAST({_CONFIG[s].get(c, 'NULL').replace('l_quantity as', 'trunc(l_quantity) as').replace('o_totalprice / 10000 as', 'trunc(o_totalprice / 10000) as')} AS {_KINDS.get(c, 'VARCHAR')}) AS {c}" for c in _COLUMNS) + f" FROM {t} WHERE {_KEEP[s]}" for s, t in _TABLES.items()
) + ")"
_BASE = f"{_HOST.format('url')} || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
_QUERY = "array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.+') AND NOT regexp_matches(regexp_extract(x, '^([^=]*)', 1), '^(?:utm_.*|fbclid|gclid|igshid|ref)$')), '&')"
_KEY = f"{_BASE} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END"
_MARKED = f"""{_ADAPTED}, limits(source, least, most) AS (VALUES {', '.join(f"('{s}', {'NULL' if a is None else a}, {b})" for s, (a, b) in _LIMITS.items())}),
judged AS (SELECT a.*, most, coalesce(coalesce(score, least - 1) < least, false) AS below, CASE WHEN url <> '' THEN {_KEY} END AS k FROM adapted a JOIN limits USING (source)),
again AS (SELECT *, NOT below AND k IS NOT NULL AND row_number() OVER (PARTITION BY coalesce(k, chr(31) || source || chr(31) || item_id), below ORDER BY score DESC NULLS LAST, source, item_id) > 1 AS repeated FROM judged),
marked AS (
  SELECT *, CASE WHEN below THEN 'below' WHEN repeated THEN 'repeated' WHEN row_number() OVER (PARTITION BY source, candidate, below, repeated ORDER BY score DESC NULLS LAST, item_id) > most THEN 'cut' ELSE 'kept' END AS status FROM again)"""


@query("p13_adapted", f"WITH {_ADAPTED} SELECT source, item_id, candidate, coalesce(url, '') AS url, coalesce(body_chars, -1) AS body_chars, coalesce(score, -1) AS score, coalesce(label, '') AS label FROM adapted")
def p13_adapted(spark, d):
    return _adapted(spark, d).select("source", "item_id", "candidate", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("body_chars", F.lit(-1)).alias("body_chars"), F.coalesce("score", F.lit(-1)).alias("score"), F.coalesce("label", F.lit("")).alias("label"))


@query("p14_collected", f"WITH {_MARKED} SELECT source, item_id, status FROM marked")
def p14_collected(spark, d):
    return collected(_adapted(spark, d), _sources(spark)).select("source", "item_id", "status")


@query("a60_funnel", f"WITH {_MARKED} SELECT source, count(*) AS n, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("below", "repeated", "cut", "kept")) + " FROM marked GROUP BY source")
def a60_funnel(spark, d):
    return funnel(collected(_adapted(spark, d), _sources(spark)))
