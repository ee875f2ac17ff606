"""JSON texts of any depth as rows of nodes, through the VARIANT type, and back to texts.

Work on nodes is work on plain rows: strip keys by filtering, rename by mapping, look strings up by joining. One pass without a
shuffle takes a table apart, however deep its texts are; putting them together is one grouping by the row's key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A step down: a place in an array (i from 0), or a name in an object (i is -1).
STEP = "struct<i:int,k:string>"


def depth(json: str) -> Column:
    """How many arrays and objects lie within each other at the deepest place of a JSON text, counted on the text."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(json, r"\\.", ""), r'"[^"]*+"', ""), r"[^\[\]{}]++", "")
    runs = F.regexp_extract_all(bare, F.lit(r"([\[{]+|[\]}]+)"), F.lit(1))
    step = F.transform(runs, lambda r: F.when(r.substr(1, 1).isin("[", "{"), F.length(r)).otherwise(-F.length(r)))
    walk = F.aggregate(step, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")))
    return F.coalesce(walk["most"], F.lit(0))


def nodes(rows: DataFrame, keys: list[str], json: str, deepest: int | None = None) -> DataFrame:
    """Every node of the texts in column `json`: `keys`, path (steps from the top), kinds (of what lies above), kind and value.

    kind is object, array, string or other; value is the text of a string, the JSON text of any other scalar, null for objects and arrays.
    Null texts and texts that are no JSON give no node. `deepest` bounds the depth; without it the table is asked once.
    """
    if deepest is None:
        deepest = rows.agg(F.max(depth(json))).first()[0] or 0
    now = rows.select(*keys, F.try_parse_json(json).alias("_v")).where("_v IS NOT NULL")
    now = now.select(*keys, "_v", F.expr(f"CAST(array() AS array<{STEP}>)").alias("path"), F.expr("CAST(array() AS array<string>)").alias("kinds"), F.lit(True).alias("_new"))
    kind = F.expr("schema_of_variant(_v)")
    kind = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").otherwise("other")
    now = now.withColumn("kind", kind)
    for _ in range(deepest):
        # a container comes once more as itself, beside its children; all other rows go on as they are
        inside = F.when(F.col("_new") & F.col("kind").isin("object", "array"), F.col("_v"))
        spread = now.withColumn("_inside", inside).lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_inside").outer()), how="left")
        child = F.col("_inside").isNotNull() & (F.col("key").isNotNull() | F.col("pos").isNotNull())
        step = F.when(F.col("kind") == "object", F.struct(F.lit(-1).alias("i"), F.col("key").alias("k"))).otherwise(F.struct(F.col("pos").alias("i"), F.lit(None).cast("string").alias("k")))
        below = F.struct(F.col("value").alias("_v"), F.concat("path", F.array(step)).alias("path"), F.concat("kinds", F.array("kind")).alias("kinds"), F.lit(True).alias("_new"))
        own = F.struct("_v", "path", "kinds", F.lit(False).alias("_new"))
        first = F.coalesce(F.col("pos"), F.lit(0)) == 0
        parts = F.when(child & first, F.array(own, below)).when(child, F.array(below)).otherwise(F.array(F.struct("_v", "path", "kinds", "_new")))
        now = spread.select(*keys, F.explode(parts).alias("_n")).select(*keys, "_n.*").withColumn("kind", kind)
    value = F.when(F.col("kind") == "string", F.expr("variant_get(_v, '$', 'string')")).when(F.col("kind") == "other", F.to_json("_v"))
    return now.select(*keys, "path", "kinds", "kind", value.alias("value"))


def dotted(path: Column | str) -> Column:
    """A path as it is written: names joined by dots, places in brackets."""
    steps = F.transform(path, lambda s: F.when(s["k"].isNull(), F.concat(F.lit("["), s["i"].cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), s["k"])))
    return F.regexp_replace(F.array_join(steps, ""), r"^\.", "")


def strings(rows: DataFrame, keys: list[str], json: str, deepest: int | None = None) -> DataFrame:
    """Every string in the texts: `keys`, path as dotted() writes it, and the string."""
    return nodes(rows, keys, json, deepest).where("kind = 'string'").select(*keys, dotted("path").alias("path"), "value")


def without(parts: DataFrame, names: Iterable[str]) -> DataFrame:
    """Nodes that lie nowhere below an object's entry of one of these names."""
    return parts.where(~F.exists("path", lambda s: F.coalesce(s["k"].isin(*names), F.lit(False))))


def matches(path: Column, pattern: str) -> Column:
    """Whether a path has the form of a pattern such as `reports.*.features[]`: `*` is any name, `[]` any place."""
    steps = [s for part in pattern.split(".") for s in part.replace("[]", "\0[]").split("\0") if s]
    same = F.size(path) == len(steps)
    for i, s in enumerate(steps):
        k = F.get(path, F.lit(i))["k"]
        same = same & F.coalesce(k.isNull() if s == "[]" else k.isNotNull() if s == "*" else k == s, F.lit(False))
    return same


def renamed(parts: DataFrame, fix, values: Iterable[str] = (), names: Iterable[str] = ()) -> DataFrame:
    """Nodes with `fix` (a function of a Column) taken to the strings at some paths and to the names of entries at others."""
    path = F.col("path")
    at = F.lit(False)
    for p in values:
        at = at | matches(path, p)
    upto = lambda i: F.slice(path, F.lit(1), i + 1)

    def name(s, i):
        hit = F.lit(False)
        for p in names:
            hit = hit | matches(upto(i), p)
        return F.struct(s["i"].alias("i"), F.when(hit & s["k"].isNotNull(), fix(s["k"])).otherwise(s["k"]).alias("k"))

    moved = F.transform(path, name) if names else path
    return parts.withColumns({"path": moved, "value": F.when(at & (F.col("kind") == "string"), fix(F.col("value"))).otherwise(F.col("value"))})


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(text.alias("a")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def rendered(parts: DataFrame, keys: list[str], name: str = "json") -> DataFrame:
    """`keys` and the JSON text of their nodes: names in order, no white space.

    Nodes that have come to share a path are one: objects have the entries of both, of scalars the greatest stays. A row all of whose nodes are gone has no text.
    """
    text = F.when(F.col("kind") == "object", "{").when(F.col("kind") == "array", "[").when(F.col("kind") == "string", _quoted(F.col("value"))).otherwise(F.col("value"))
    last = F.element_at("path", -1)["k"]
    label = F.when(F.size("path") == 0, "").when(last.isNull(), "").otherwise(F.concat(_quoted(last), F.lit(":")))
    closing = lambda kinds: F.transform(kinds, lambda k: F.when(k == "object", "}").otherwise("]"))
    open_ = F.when(F.col("kind").isin("object", "array"), F.concat("kinds", F.array("kind"))).otherwise(F.col("kinds"))
    one = parts.select(*keys, "path", F.struct(F.size("path").alias("depth"), F.concat(label, text).alias("text"), closing(open_).alias("open")).alias("node"))
    single = one.groupBy(*keys, "path").agg(F.max("node").alias("node"))
    row = single.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("path", "node"))).alias("_n"))

    def piece(x, i):
        n, before, after = x["node"], F.get(F.col("_n"), i - 1)["node"]["depth"], F.get(F.col("_n"), i + 1)["node"]["depth"]
        comma = F.when((i > 0) & (before >= n["depth"]), ",").otherwise("")
        closed = F.size(n["open"]) - F.coalesce(after, F.lit(0))
        ends = F.when(closed > 0, F.array_join(F.reverse(F.slice(n["open"], F.coalesce(after, F.lit(0)) + 1, F.greatest(closed, F.lit(0)))), "")).otherwise("")
        return F.concat(comma, n["text"], ends)

    return row.select(*keys, F.array_join(F.transform("_n", piece), "").alias(name))


def strip_keys(rows: DataFrame, keys: list[str], json: str, names: Iterable[str], deepest: int | None = None) -> DataFrame:
    """`keys` and the texts without entries of these names at any depth."""
    return rendered(without(nodes(rows, keys, json, deepest), names), keys, json)
