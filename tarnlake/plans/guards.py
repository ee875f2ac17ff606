"""Registered queries on pruning, lookups of sites and domains, and validation of selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards as G
from . import views as V
from .landing import ADDRESSES, addresses
from .registry import Registry, quoted
from .texts import REMARKS_SQL, remarks

query = Registry()


@query("f26_pruned_urls", f"WITH {V.COVERAGE} SELECT feature AS candidate, count(*) AS n, CAST(sum(pos) AS BIGINT) AS checksum FROM coverage WHERE source = 'official' OR (tier > 0 AND report = 'r1') GROUP BY feature")
def f26(spark, d):
    c = V.coverage(spark, d)
    origin = F.when(F.col("source") == "official", "official_source").otherwise(F.col("source"))
    url = F.struct("url", origin.alias("origin"), F.when(F.col("tier") > 0, F.array("report")).alias("matched"), "pos")
    out = G.pruned_for_report(c.groupBy(F.col("feature").alias("candidate")).agg(F.collect_list(url).alias("urls")), "r1")
    return out.select("candidate", F.size("urls").cast("long").alias("n"), F.aggregate("urls", F.lit(0).cast("long"), lambda a, u: a + u["pos"]).alias("checksum"))


@query("f12_domain_signals", "SELECT DISTINCT signal FROM (SELECT unnest(string_split_regex(replace(lower(p_name), 'green', ' '), '\\s+')) AS signal FROM part UNION ALL SELECT unnest(['환율', 'atm'])) WHERE length(signal) >= 2")
def f12(spark, d):
    return G.domain_signals(V.read(spark, d, "part").select(F.col("p_name").alias("name")), ["환율", "ATM"], "green")


@query("f43_resolved_sites", "SELECT 'clien.net' AS domain, 'full' AS mode UNION ALL SELECT lower(n_name) || '.com', CASE WHEN n_nationkey % 2 = 0 THEN 'full' ELSE 'snippet_only' END FROM nation WHERE n_regionkey < 3")
def f43(spark, d):
    n = V.read(spark, d, "nation")
    site = F.concat(F.lower("n_name"), F.lit(".com"))
    chosen = n.select(site.alias("domain")).unionByName(spark.createDataFrame([("clien.net",), ("unknown.net",)], "domain string"))
    registry = n.where("n_regionkey < 3").select(site.alias("domain"), F.when(F.col("n_nationkey") % 2 == 0, "full").alias("mode"))
    return G.resolved_sites({"clien.net": "full"}, chosen, registry)


_KNOWN = (("brass", 0, "brass.com"), ("brass", 1, "shop.brass.com"), ("steel", 2, "steel.org"), ("smallplatedbrass", 3, "plated.net"), ("tin", 4, "brass.com"))
_KNOWN_SQL = "known(key, pos, domain) AS (VALUES " + ", ".join(f"({quoted(k)}, {p}, {quoted(x)})" for k, p, x in _KNOWN) + ")"


@query("j29_known_domains", f"""WITH {_KNOWN_SQL}, i AS (SELECT p_partkey AS id, unnest(list_concat([lower(p_brand), lower(p_type)], string_split_regex(lower(p_brand || ' ' || p_type), '[\\s·/()\\[\\]{{}}, ~\\-]+'))) AS k FROM part)
SELECT id, domain, CAST(min(pos) AS INTEGER) AS pos FROM i JOIN known ON key = regexp_replace(k, '[^가-힣a-z0-9]', '', 'g') GROUP BY id, domain""")
def j29(spark, d):
    items = V.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("product"))
    return G.known_domains(items, spark.createDataFrame(_KNOWN, "key string, pos int, domain string"))


@query("j29_domain_cluster", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'a.com,b.org' ELSE 'c.net' END AS domains FROM orders WHERE o_orderkey % 3 < 2")
def j29b(spark, d):
    k = F.col("o_orderkey")
    hosts = V.read(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("x"), k, F.lit(".b.org"))).when(k % 3 == 1, F.concat(F.lit("y"), k, F.lit(".c.net"))).otherwise("none.org").alias("host"))
    known = spark.createDataFrame([("one", "a.com"), ("one", "b.org"), ("two", "c.net")], "key string, domain string")
    return hosts.join(G.domain_cluster(hosts.select("host").distinct(), known), "host").select("id", F.array_join("domains", ",").alias("domains"))


@query("h26_host_token", f"WITH {ADDRESSES} SELECT id, contains(host, 'team1') OR contains(host, 'tube') AS value FROM parts")
def h26(spark, d):
    return addresses(spark, d).select("id", G.host_has_token("url", F.array(F.lit("team1"), F.lit("tube"), F.lit(""))).alias("value"))


@query("h26_title_names_brand", f"""WITH {REMARKS_SQL} SELECT id, replace(lower(text), ' ', '') <> '' AND (contains(replace(lower(text), ' ', ''), 'kb국민') OR contains(replace(lower(text), ' ', ''), 'pay')) AS value FROM remarks""")
def h26b(spark, d):
    return remarks(spark, d).select("id", G.title_names_brand("text", F.lit("Pay Card a"), F.lit("KB 국민"), ["card"]).alias("value"))


@query("f50_selection_errors", "SELECT o_custkey AS selection, -1::BIGINT AS id, 'too many' AS error FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 20) > 10 UNION ALL SELECT DISTINCT o_custkey, o_orderkey % 20, 'not offered' FROM orders WHERE o_orderkey % 20 > 15")
def f50(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_custkey").alias("selection"), (F.col("o_orderkey") % 20).alias("id"))
    return G.selection_errors(o, o.where("id <= 15")).na.fill(-1, ["id"])


@query("f51_selection_limits", "SELECT o_custkey AS selection, CASE WHEN count(DISTINCT o_orderkey) < 3 THEN 'too few' ELSE 'too many' END AS error FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) NOT BETWEEN 3 AND 12")
def f51(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_custkey").alias("selection"), F.col("o_orderkey").alias("id"))
    return G.selection_errors(o, o, 3, 12).select("selection", "error")


@query("f50_selected_reports", "SELECT DISTINCT p_brand AS report FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 48)")
def f50b(spark, d):
    p = V.read(spark, d, "part")
    return G.selected_reports(p.where("p_size > 48").select(F.col("p_name").alias("id")), p.select(F.col("p_name").alias("feature"), F.col("p_brand").alias("report")))


@query("a66_length_profile", f"""WITH {V.POSTS} SELECT site, post_id, CAST(length(body) AS INTEGER) AS chars, CAST(ceil(length(body) / 3000.0) AS INTEGER) AS chunks,
  CAST(least(3, contains(body, 'thand')::INTEGER + contains(body, 'ingth')::INTEGER + contains(body, 'queo')::INTEGER + contains(body, 'eaux')::INTEGER) AS INTEGER) AS mentions FROM posts""")
def a66(spark, d):
    return G.length_profile(V.posts(spark, d), ["thand", "ingth", "queo", "eaux"], 10**9)


@query("h37_display_label", f"WITH {V.UNITS} SELECT unit_id, CASE candidate WHEN 'own_0' THEN 'Our card' WHEN 'comp_2' THEN 'Two' ELSE coalesce(candidate, '') END AS label FROM units")
def h37(spark, d):
    return V.units(spark, d).select("unit_id", G.display_label("candidate", {"own_0": "Our card", "comp_2": "Two"}).alias("label"))


@query("h39_rendered_batches", """WITH m AS (SELECT o_orderkey // 40 AS batch, o_orderkey AS pos, o_orderstatus AS parent, o_orderpriority || ' of ' || o_custkey AS text FROM orders),
l AS (SELECT batch, pos, CASE WHEN lag(parent) OVER (PARTITION BY batch ORDER BY pos) IS NOT DISTINCT FROM parent THEN '' ELSE '# ' || parent || chr(10) END || '[t' || row_number() OVER (PARTITION BY batch ORDER BY pos) || '] ' || substring(text, 1, 10) AS line FROM m)
SELECT batch, string_agg(line, chr(10) ORDER BY pos) AS prompt FROM l GROUP BY batch""")
def h39(spark, d):
    m = V.read(spark, d, "orders").select(F.expr("o_orderkey div 40").alias("batch"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("parent"), F.concat("o_orderpriority", F.lit(" of "), "o_custkey").alias("text"))
    return G.rendered(m, 10)


@query("h43_rekeyed", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'own_toss' WHEN 1 THEN 'b' ELSE 'c' END || ',' || p_brand AS candidates, sha256('{"k0":"agent","k1":"' || CASE p_partkey % 3 WHEN 0 THEN 'own_toss' WHEN 1 THEN 'b' ELSE 'c' END || ',' || p_brand || '"}') AS cache_key FROM part""")
def h43(spark, d):
    k = F.col("p_partkey")
    first = F.when(k % 3 == 0, "toss").when(k % 3 == 1, "b").otherwise("c")
    rows = V.read(spark, d, "part").select("p_partkey", F.lit("agent").alias("agent"), F.array(first, F.col("p_brand")).alias("candidates"), F.lit("").alias("cache_key"))
    return G.rekeyed(rows, {"toss": "own_toss"}).select("p_partkey", F.array_join("candidates", ",").alias("candidates"), "cache_key")


@query("j39_tuples_by_candidate", "SELECT 'c' || n_regionkey AS candidate, count(*) AS sample_size, count(*) FILTER (c_mktsegment = 'BUILDING') AS building FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey")
def j39(spark, d):
    labels = V.read(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("label"), F.concat(F.lit("c"), "n_regionkey").alias("candidate"))
    out = G.tuples_by_candidate(V.read(spark, d, "customer").select(F.col("c_nationkey").alias("label"), F.col("c_mktsegment").alias("channel")), labels)
    return out.select("candidate", "sample_size", F.coalesce(F.col("channel_counts")["BUILDING"], F.lit(0)).alias("building"))


@query("h40_query_strings", "SELECT p_partkey, lower(p_name) || ' ' || p_brand || '|' || lower(p_name) || ' ' || p_type AS queries FROM part")
def h40(spark, d):
    return V.read(spark, d, "part").select("p_partkey", F.array_join(G.query_strings(F.lower("p_name"), F.array("p_brand", "p_brand", "p_type", "p_name"), 2), "|").alias("queries"))
