"""The queries op1 to op10, with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ego_join, langid, lm, mixing, quality, rindex, sentencepiece_scan, sharding, simhash, token_coder
from .common import new_folder, read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.mix(read_table(spark, sf_dir, "documents"))
    rows = placed.select("doc_id", "size", "source_size", "target", "taken", "position")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), new_folder(spark, "shards"))


def op4_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex.repeats(read_table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "ids")
    token_coder.write_ids(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_coder.read_ids(spark, folder)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, bits=64, segment=32, distance=3)
    return out.drop("text_hash")


def quality_base_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 counts, without the trees' verdict: all that SQL can say of it."""
    out = op2_quality_rules(spark, sf_dir)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3's shards hold: rows, sizes and the greatest slot of each."""
    return op3_sharding(spark, sf_dir).groupBy("law").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.countDistinct("shard").alias("shards"), F.max("slot").alias("last_slot"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mixing, op2_quality_rules, op3_sharding, op4_ego_join, op5_lm_scoring, op6_language_id, op7_sentencepiece, op8_suffix_array, op9_token_ids, op10_simhash, quality_base_numbers, shard_sizes)}

OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
component AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN component ON component.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(0, CAST(length(h) // 2 - 49 AS BIGINT)))) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE f.first < w.doc_id),
gap AS (SELECT doc_id, p, p - 50 > lag(p) OVER (PARTITION BY doc_id ORDER BY p) OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL AS new FROM hit),
span AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM gap) GROUP BY doc_id, k),
piece AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM span
  UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY doc_id),
rest AS (
  SELECT doc_id, string_agg(CASE WHEN piece.b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (piece.b - a)) END, '' ORDER BY a) AS h
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n.k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, p, [w[p], w[p + 1], w[p + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1))) AS p FROM d)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(hit.n, 0) > 50 * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN hit USING (doc_id)
"""

SHARDS_SQL = """
SELECT 'rows' AS law, count(*) AS n, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS size,
       CAST(least(count(*), 16) AS BIGINT) AS shards, CAST((count(*) - 1) // 16 AS BIGINT) AS last_slot
FROM documents HAVING count(*) > 0
"""

ORACLE_SQL: dict[str, str] = {"op4_ego_join": OP4_SQL, "op8_suffix_array": OP8_SQL, "quality_base_numbers": BASE_SQL, "shard_sizes": SHARDS_SQL}
