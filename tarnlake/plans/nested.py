"""Registered queries on JSON texts of any depth (H34), built from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as N
from ..functions import text as X
from . import views as V
from .registry import Registry

query = Registry()


def _conversations(spark, d):
    """One text a conversation: its turns in order, with entries named `pattern` at several depths."""
    c = V.read(spark, d, "conversations")
    about = F.struct(F.struct(F.col("role").alias("pattern"), F.length("text").alias("n")).alias("meta"), F.lit("^[a-z]+$").alias("pattern"), "role", "text", "turn")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", about.alias("x")))), lambda t: t["x"])
    return c.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("conv"), F.struct(F.struct(F.lit("x").alias("type")).alias("pattern")).alias("schema"), "turns")).alias("json"))


@query("h34_walked_strings", """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations)
SELECT conv_id, 'schema.pattern.type' AS path, 'x' AS value FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, 'turns[' || i || '].role', role FROM t WHERE role IS NOT NULL
UNION ALL SELECT conv_id, 'turns[' || i || '].meta.pattern', role FROM t WHERE role IS NOT NULL
UNION ALL SELECT conv_id, 'turns[' || i || '].pattern', '^[a-z]+$' FROM t
UNION ALL SELECT conv_id, 'turns[' || i || '].text', text FROM t WHERE text IS NOT NULL""")
def h34_walked_strings(spark, d):
    return N.strings(_conversations(spark, d), ["conv_id"], "json")


@query("h34_without_keys", """SELECT conv_id, '{"conv":' || conv_id || ',"schema":{},"turns":[' || string_agg('{"meta":{' || coalesce('"n":' || length(text), '') || '}' || coalesce(',"role":' || to_json(role), '') || coalesce(',"text":' || to_json(text), '') || ',"turn":' || turn || '}', ',' ORDER BY turn) || ']}' AS json
FROM conversations GROUP BY conv_id""")
def h34_without_keys(spark, d):
    return N.strip_keys(_conversations(spark, d), ["conv_id"], "json", ["pattern"])


@query("h34_snake_ids", r"""WITH e AS (SELECT user_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 5 AS k, count(*) AS n FROM events GROUP BY ALL),
one AS (SELECT user_id, event_type, '"feature_labels":{' || string_agg('"' || lower(event_type) || '_no_' || k || '":' || n, ',' ORDER BY k) || '},"features":[' || string_agg('"' || lower(event_type) || '_no_' || k || '"', ',' ORDER BY k) || ']' AS body FROM e GROUP BY ALL)
SELECT user_id, '{"domain_slug":"user_' || user_id || '","report_config":{' || string_agg('"' || event_type || '":{' || body || '}', ',' ORDER BY event_type) || '}}' AS json FROM one GROUP BY user_id""")
def h34_snake_ids(spark, d):
    """Free names of a taxonomy brought to identifiers, labels beside them kept in step."""
    e = V.read(spark, d, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 5
    name = F.concat(F.initcap("event_type"), F.lit("-No. "), "k")
    counted = e.groupBy("user_id", "event_type", k.alias("k")).agg(F.count("*").alias("n"))
    one = counted.groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(F.struct(name.alias("f"), "n"))).alias("x"))
    entry = F.struct(F.col("x.f").alias("features"), F.map_from_entries("x").alias("feature_labels"))
    user = one.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", entry))).alias("c"))
    texts = user.select("user_id", F.to_json(F.struct(F.concat(F.lit("User "), "user_id").alias("domain_slug"), F.col("c").alias("report_config"))).alias("json"))
    parts = N.renamed(N.nodes(texts, ["user_id"], "json"), X.snake_id, ["domain_slug", "report_config.*.features[]"], ["report_config.*.feature_labels.*"])
    return N.rendered(parts, ["user_id"])
