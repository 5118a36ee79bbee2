"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, license_scan, minhash_dedup, mixing, prefix_trie, quality_pu, quality_rules, substring_dedup, suffix_dedup, token_count, toxicity, url_filter, vector_codes
from .tables import read


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, a similarity of 0.85 or more; doc_id, n_shingles, component_id, kept."""
    out = minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes: weights 1, 2, 3 in turn, at most three times a document; doc_id, size, source_size, target, taken."""
    return mixing.mix_sources(read(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3).drop("source")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents covered by 50-byte strings of earlier ones; doc_id, n_bytes, n_removed, n_spans, hash of the rest."""
    out = suffix_dedup.duplicates(read(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside ten-word windows of benchmark items; doc_id, n_words, n_hit, n_items, hash of the items' ids, contaminated."""
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, fitted on labels of 1 and unlabelled rows; doc_id, held_out, score, predicted."""
    out = quality_pu.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)
    return out.select("doc_id", "held_out", "score", "predicted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in all documents; the base's places and labels, all labels and a score."""
    return license_scan.scan(read(spark, sf_dir, "documents")).drop("detections")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls; page_id, host, path, rule, verdict, score."""
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of all documents over a public vocabulary."""
    return token_count.token_counts(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents by rules and by labelled lines."""
    return quality_rules.judged(read(spark, sf_dir, "documents")).drop("line_labels")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents covered by 20-word passages that stand earlier; doc_id, n_words, n_removed, hash of the rest."""
    out = substring_dedup.repeats(read(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, fitted on labels that aren't held out; doc_id, held_out, score, predicted."""
    out = toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)
    return out.select("doc_id", "held_out", "score", "predicted")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors after four rounds, with errors by vector and by label, and the hash of the codebooks."""
    return vector_codes.compress(read(spark, sf_dir, "embeddings"), rounds=4).drop("label")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations, with members, children, leaves, saved bytes and the hash of the ends."""
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality_pu": op3_quality_pu,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontamination": op10_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_ALNUM = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_LOWER = _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def _codes_sql(rounds: int = 4) -> str:
    """Every part against every entry, in rounds; smallest distance first, then the lower index."""
    text = r"""
WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, x[p * (len(x) // 4) + 1:(p + 1) * (len(x) // 4)] AS v FROM x, (SELECT unnest(range(4)) AS p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM x ORDER BY vec_id LIMIT 256),
cb0 AS MATERIALIZED (SELECT p, e, v AS c FROM parts JOIN first USING (vec_id))"""
    for k in range(rounds + 1):
        text += rf""",
near{k} AS MATERIALIZED (SELECT vec_id, p, v, min(256 * list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + e) AS m FROM parts JOIN cb{k} USING (p) GROUP BY vec_id, p, v)"""
        if k < rounds:
            text += rf""",
sum{k} AS (SELECT p, e, i, sum(t)::BIGINT AS s, count(*) AS n FROM (SELECT p, m % 256 AS e, unnest(v) AS t, unnest(range(1, len(v) + 1)) AS i FROM near{k}) GROUP BY p, e, i),
mean{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sum{k} GROUP BY p, e),
cb{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.c, cb{k}.c) AS c FROM cb{k} LEFT JOIN mean{k} USING (p, e))"""
    return text + rf""",
hash AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM cb{rounds}),
codes AS (SELECT vec_id, string_agg(lower(printf('%02x', m % 256)), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM codes JOIN x USING (vec_id), hash"""


ORACLE_SQL = {
    "op1_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.a, x.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS c FROM s JOIN s t ON t.k = s.k AND t.doc_id <> s.doc_id GROUP BY 1, 2) x JOIN n ON n.doc_id = x.a JOIN n m ON m.doc_id = x.b WHERE 100 * x.c >= 85 * (n.n + m.n - x.c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT links.b AS node, reach.root FROM reach JOIN links ON links.a = reach.node WHERE reach.root < links.b),
c AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
    "op9_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, h[2 * i - 1:2 * i + 98] AS k FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE doc_id > m),
runs AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM late),
heads AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i > b + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM runs),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS z FROM heads GROUP BY doc_id, g),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM spans GROUP BY doc_id),
edges AS (SELECT d.doc_id, a, lag(z, 1, 1) OVER (PARTITION BY d.doc_id ORDER BY a) AS p FROM d JOIN (SELECT doc_id, a, z FROM spans UNION ALL SELECT doc_id, length(h) // 2 + 1 AS a, length(h) // 2 + 2 AS z FROM d) x ON x.doc_id = d.doc_id),
kept AS (SELECT d.doc_id, string_agg(h[2 * p - 1:2 * a - 2], '' ORDER BY a) AS t FROM d JOIN edges ON edges.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op10_decontamination": rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT item_id, k, array_to_string(w[i:i+k-1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT k FROM win),
here AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i FROM d, sizes WHERE len(w) >= k)),
met AS (SELECT DISTINCT doc_id, i, a.k, item_id FROM here a JOIN win USING (k, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op6_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) a ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_vector_codes": _codes_sql(),
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, length(role) || ':' || role || text AS said, strlen(text) AS bytes FROM r),
n AS (SELECT c.conv_id, count(depth) AS len FROM c LEFT JOIN turns USING (conv_id) GROUP BY 1),
paths AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS bytes FROM c
          UNION ALL SELECT conv_id, depth, string_agg(sha256(said), '') OVER (PARTITION BY conv_id ORDER BY depth), bytes FROM turns),
m AS (SELECT p.conv_id, p.depth, len, min(p.conv_id) OVER w AS node, count(*) OVER w AS k, bytes FROM paths p JOIN n USING (conv_id) WINDOW w AS (PARTITION BY p.depth, path)),
nodes AS (SELECT node, depth, any_value(k) AS k, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends FROM m GROUP BY node, depth),
up AS (SELECT x.node, x.depth, y.node AS parent FROM nodes x LEFT JOIN m y ON y.conv_id = x.node AND y.depth = x.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM up WHERE depth > 0 GROUP BY 1, 2),
below AS (SELECT a.node, a.depth, nodes.node AS d, nodes.depth AS e, (nodes.k - 1) * nodes.bytes AS saved, (kids.n IS NULL)::BIGINT AS leaf
          FROM nodes JOIN m a ON a.conv_id = nodes.node AND a.depth <= nodes.depth LEFT JOIN kids ON kids.node = nodes.node AND kids.depth = nodes.depth),
sums AS (SELECT node, depth, sum(saved)::BIGINT AS saved, sum(leaf)::BIGINT AS leaves FROM below GROUP BY 1, 2)
SELECT nodes.node AS conv_id, nodes.depth::BIGINT AS depth, parent AS parent_conv_id, k AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, ends AS ends_sha256
FROM nodes JOIN up USING (node, depth) JOIN sums USING (node, depth) LEFT JOIN kids USING (node, depth)""",
}
