"""The training-data queries, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from lintlake.llm import alignment, archives, backoff, bytecnn, decontam, learned, maintext, packing, quotes, secrets, simhash, trie, vafile
from lintlake.llm.common import table

#: A document scored below this counts as of low quality.
KEEP = 0.3


def op1_vafile_topk(spark, sf_dir):
    vectors = vafile.integer_vectors(table(spark, sf_dir, "embeddings"))
    return vafile.top_k(vectors, F.col("id") % 50 == 0)


def op2_secret_forest(spark, sf_dir):
    forest = secrets.Forest.fit(secrets.default_findings(spark))
    return secrets.findings(table(spark, sf_dir, "documents"), forest, path_col="source").withColumnRenamed("id", "doc_id")


def op3_main_text(spark, sf_dir):
    return maintext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_simhash_neardup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_benchmark_windows(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op6_arc_to_warc(spark, sf_dir):
    return archives.round_trip(table(spark, sf_dir, "pages"))


def op7_stupid_backoff(spark, sf_dir):
    return backoff.held_out_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_quote_threads(spark, sf_dir):
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op9_quality_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = bytecnn.train(docs, table(spark, sf_dir, "labels"))
    return bytecnn.score(docs, model).select("doc_id", bytecnn.held_out().alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))


def op10_length_buckets(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_learned_partitions(spark, sf_dir):
    return learned.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_prefix_trie(spark, sf_dir):
    return trie.summary(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark, sf_dir):
    return alignment.summary(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_vafile_topk, op2_secret_forest, op3_main_text, op4_simhash_neardup, op5_benchmark_windows, op6_arc_to_warc, op7_stupid_backoff, op8_quote_threads, op9_quality_cnn, op10_length_buckets, op11_learned_partitions, op12_prefix_trie, op13_token_alignment)} | {"pipeline": corpus_pipeline.run}


TOP_K_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS number, vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, q.number, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.number <> c.number AND len(q.v) = len(c.v)
  WHERE q.id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""


TRIE_SQL = """
WITH m AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY n) AS turns FROM m GROUP BY conv_id
), coded AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda crc, b: list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)),
    CAST(4294967295 AS BIGINT))) % 6 AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE list_slice(b.turns, 1, c.h) END, list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM coded c LEFT JOIN own b ON b.conv_id = c.base
), held AS (
  SELECT conv_id, depth, list_slice(turns, 1, depth) AS prefix, len(turns) = depth AS ends FROM rebuilt, unnest(range(0, len(turns) + 1)) t(depth)
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM held GROUP BY depth, prefix
), children AS (
  SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), told AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(n.prefix[depth].text) ELSE 0 END AS saved FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix
), totals AS (
  SELECT list_slice(prefix, 1, k) AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM told, unnest(range(0, depth + 1)) t(k) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM told n JOIN totals t ON t.prefix = n.prefix LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)
"""


def oracle_sql():
    return {"op1_vafile_topk": TOP_K_SQL, "op6_arc_to_warc": WARC_SQL, "op12_prefix_trie": TRIE_SQL}
