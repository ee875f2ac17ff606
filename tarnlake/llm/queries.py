"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, hnsw, lines, lloyd, merkle, packing, passages, pieces, pii, quality, simhash, urls, weighted
from ._shared import read

#: Rules of the URL filter query.
RULES = [urls.Rule("allow", "org"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summary(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), RULES)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_duplicate_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op8_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_held_out(read(spark, sf_dir, "documents"))


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.edited_fingerprints(read(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered).otherwise(F.col("text"))
    return merkle.prove(read(spark, sf_dir, "documents"), {"text": tampered})


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.drop_repeated_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_quality_classifier, op2_sentencepiece, op3_simhash_dedup, op4_personal_data, op5_best_fit_packing, op6_url_filter, op7_line_dedup,
        op8_brown_scores, op9_weighted_fingerprints, op10_embedding_dedup, op11_merkle_manifest, op12_substring_dedup, op13_centroid_clusters,
    )
    return {f.__name__: f for f in made}


_HOST = "coalesce(translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_URL_SQL = rf"""
WITH RECURSIVE
page AS (
  SELECT DISTINCT url, html, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS canonical,
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?\s*[0-9.]*\s*;\s*url\s*=\s*[''"]?([^"''\s>]+)', 1) AS refresh
  FROM pages WHERE url IS NOT NULL),
declared AS (
  SELECT url, CASE WHEN regexp_matches(canonical, '(?i)^https?://') THEN canonical WHEN regexp_matches(refresh, '(?i)^https?://') THEN refresh END AS target FROM page WHERE contains(html, '<')),
address AS (SELECT url FROM page UNION SELECT target FROM declared WHERE target IS NOT NULL),
plain AS (
  SELECT url, 'https://' || regexp_replace(regexp_replace({_HOST.format('url')}, ':(80|443)$', ''), '^www\.', '') || regexp_replace({_PATH.format('url')}, '/+$', '') ||
    regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '(?i)([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '(?s)^[^?]*(\?.*)?$', 1) AS form
  FROM address WHERE {_HOST.format('url')} <> ''),
edge AS (
  SELECT p.url AS src, form AS dst FROM plain p JOIN page USING (url) UNION SELECT url, target FROM declared UNION SELECT d.url, p.form FROM declared d JOIN plain p ON p.url = d.target),
link AS (SELECT src, dst FROM edge WHERE dst IS NOT NULL AND src <> dst UNION SELECT dst, src FROM edge WHERE dst IS NOT NULL AND src <> dst),
reach(src, dst) AS (SELECT src, dst FROM link UNION SELECT r.src, l.dst FROM reach r JOIN link l ON r.dst = l.src),
node AS (SELECT src AS url FROM link UNION SELECT url FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (SELECT url, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM node),
ruled AS (
  SELECT c.*, r.rhost || r.rpath AS rule, r.verdict AS own
  FROM cut c LEFT JOIN rules r ON (c.host = r.rhost OR ends_with(c.host, '.' || r.rhost)) AND starts_with(c.path, r.rpath)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) = 1),
spread AS (SELECT r.src AS url, bool_or(n.own = 'block') AND NOT coalesce(bool_or(n.own = 'allow'), false) AS blocked FROM reach r JOIN ruled n ON n.url = r.dst GROUP BY r.src)
SELECT p.page_id, r.host, r.path, r.rule, coalesce(r.own, CASE WHEN s.blocked THEN 'block' END, 'allow') AS verdict
FROM pages p JOIN ruled r ON r.url IS NOT DISTINCT FROM p.url LEFT JOIN spread s ON s.url = p.url
"""

_COSINE_SQL = """
WITH RECURSIVE
v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.k <> b.k
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(src, dst) AS (
  SELECT src, dst FROM links UNION SELECT r.src, l.dst FROM reach r JOIN links l ON r.dst = l.src)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(c, vec_id), vec_id) AS component_id, coalesce(least(c, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT src, count(*) AS n FROM links GROUP BY src) ON src = vec_id
LEFT JOIN (SELECT src AS s2, min(dst) AS c FROM reach GROUP BY src) ON s2 = vec_id
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text in SQL: bits of one byte after another."""
    byte = "list_reduce([xor(c, ascii(x)::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, _: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)"
    return f"xor(list_reduce(list_concat(['4294967295'], string_split({text}, '')), lambda c, x: CAST({byte.replace('xor(c,', 'xor(CAST(c AS BIGINT),')} AS VARCHAR))::BIGINT, 4294967295)"


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"


_MERKLE_SQL = f"""
WITH RECURSIVE
leaf AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS key, {_leaf('text')} AS leaf,
    CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf('text')} END AS got
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM leaf),
low(key, level, idx, hash, n) AS (
  SELECT key, 0, idx, leaf, n FROM placed
  UNION ALL SELECT key, level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY key, level, idx // 8, n),
subroot AS (SELECT key, hash, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, idx, hash, n) AS (
  SELECT 0, idx, hash, n FROM subroot
  UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY level, idx // 8, n),
node AS (SELECT key, level, idx, hash, n FROM low UNION ALL SELECT '', level, idx, hash, n FROM high),
side AS (
  SELECT key, level, idx, n, coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM node WINDOW w AS (PARTITION BY key, level, idx // 8 ORDER BY idx)),
way(row, doc_id, leaf, key, level, idx, n, proof, now) AS (
  SELECT row_number() OVER (), doc_id, leaf, key, 0, idx, n, '', got FROM placed
  UNION ALL
  SELECT row, doc_id, leaf, w.key, w.level + 1, w.idx // 8, (w.n + 7) // 8, proof || before || after, sha256(before || now || after)
  FROM way w JOIN side s ON s.key = w.key AND s.level = w.level AND s.idx = w.idx WHERE w.n > 1),
top(row, doc_id, leaf, subroot, level, idx, n, proof, now) AS (
  SELECT w.row, w.doc_id, w.leaf, s.hash, 0, s.idx, s.n, w.proof, w.now FROM way w JOIN subroot s ON s.key = w.key WHERE w.n = 1
  UNION ALL
  SELECT row, doc_id, leaf, subroot, t.level + 1, t.idx // 8, (t.n + 7) // 8, proof || before || after, sha256(before || now || after)
  FROM top t JOIN side s ON s.key = '' AND s.level = t.level AND s.idx = t.idx WHERE t.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
FROM top, (SELECT hash AS root FROM high WHERE n = 1) WHERE n = 1
"""

_PASSAGES_SQL = r"""
WITH word AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
each AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM word),
start AS (
  SELECT r, i, concat_ws(' ', x, {leads}) AS passage FROM each WINDOW along AS (PARTITION BY r ORDER BY i)
  QUALIFY lead(i, 19) OVER along IS NOT NULL),
seen AS (SELECT r, i, row_number() OVER (PARTITION BY passage ORDER BY r, i) > 1 AS again FROM start),
marked AS (
  SELECT e.r, e.i, e.x, coalesce(bool_or(s.again) OVER (PARTITION BY e.r ORDER BY e.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM each e LEFT JOIN seen s ON s.r = e.r AND s.i = e.i),
kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM word LEFT JOIN kept USING (r)
""".replace("{leads}", ", ".join(f"lead(x, {k}) OVER along" for k in range(1, 20)))


def _lloyd_sql(clusters: int = lloyd.CLUSTERS, rounds: int = lloyd.ROUNDS, components: int = lloyd.COMPONENTS) -> str:
    """Every round spelled out; sums below 2**63."""
    near = "SELECT row, vec_id, v, k, d FROM (SELECT row, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{0}) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1"
    parts = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c FROM kept ORDER BY k LIMIT {clusters})"""]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        parts.append(f"m{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(range({components})) AS j, unnest(v) AS x FROM a{i}) GROUP BY k, j)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM m{i} GROUP BY k) USING (k))")
    parts.append(f"a{rounds} AS MATERIALIZED ({near.format(rounds)})")
    return ",\n".join(parts) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_filter": _URL_SQL, "op10_embedding_dedup": _COSINE_SQL, "op11_merkle_manifest": _MERKLE_SQL, "op12_substring_dedup": _PASSAGES_SQL,
        "op13_centroid_clusters": _lloyd_sql(),
    }
