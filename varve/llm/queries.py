"""The operators' queries, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from varve.llm import bpe, chat, decontaminate, mainhtml, negatives, neighbours, prefixtrie, privacy, quality, repeats, simhash, tokenfiles, topk
from varve.llm.common import scratch

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    tokenfiles.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE))
    return tokenfiles.positions(spark, path)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes_hex(_table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op8_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digests(_table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema)
    return chat.digests(rows.unionByName(added))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.main_texts(_table(spark, sf_dir, "pages"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(_table(spark, sf_dir, "embeddings"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.relabelled(_table(spark, sf_dir, "embeddings")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_bpe,
        op3_decontaminate,
        op4_quality,
        op5_repeats,
        op6_simhash,
        op7_neighbours,
        op8_privacy,
        op9_chat,
        op10_main_text,
        op11_topk,
        op12_negatives,
        op13_prefix_trie,
    )
}

# Order is by conv_id -7 last; the digest of what a conversation says and of what is learned
# needs no knowledge of the template, its formatted length does.
ORACLE = {
    "op9_chat": r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT conv_id, turn, role, text,
    CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' END
    || replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '### ', '\h') || '</turn>' || chr(10) AS block,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before
  FROM given
), judged AS (
  SELECT *, (before = '' AND place = 0 AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
    OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user') AS fine
  FROM written
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(block)) AS BIGINT) AS formatted_chars,
  CAST(coalesce(min(place) FILTER (NOT fine), -1) AS INTEGER) AS first_invalid
FROM judged GROUP BY conv_id
""",
    "op11_topk": """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op12_negatives": """
WITH v AS (
  SELECT vec_id, min({'v': list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))),
    'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END}) AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.r.label = c.r.label AS same, CAST(list_dot_product(a.r.v, c.r.v) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), found AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
""",
    # The checksum is written out: bytes are mixed in, -1 stands for one of the eight shifts after each.
    "op13_prefix_trie": """
WITH given AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, coalesce(role, '') AS role, coalesce(text, '') AS text, turn
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(strlen(role) || ':' || role || text)) AS place
  FROM given
), convs AS (
  SELECT DISTINCT conv_id, base, xor(list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 9 AS h
  FROM given
), parts AS (
  SELECT c.conv_id, 0 AS part, p.place, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.place <= c.h
  UNION ALL SELECT c.conv_id, 1, p.place, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h
), turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM parts
), paths AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
    list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node
  FROM turns UNION ALL SELECT conv_id, 0, 0, [] FROM convs
), named AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
    depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM paths
), nodes AS (
  SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
    any_value(bytes) AS bytes, bool_and(last) AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM named GROUP BY node
), sums AS (
  SELECT p.node, sum(CAST(n.leaf AS BIGINT)) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM nodes n JOIN named p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs,
  coalesce(c.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes u ON u.node = n.parent
""",
}
