"""The registered queries of the numbered operators, thin over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, language_id, lm_score, near_dedup, pii, piece_encoding, prefix_trie, quality, repeats, structure_repair, token_files, warc
from .shared import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("similarity", 6).alias("similarity"), "first_word")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenize_to_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.scores(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(_table(spark, sf_dir, "documents"), n=2, percent=80)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.sequences(_table(spark, sf_dir, "conversations"))))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure_repair.damage(_table(spark, sf_dir, "conversations"))
    found = structure_repair.report(rows)
    made = structure_repair.digests(structure_repair.repaired(rows, found)).withColumnRenamed("conv_id", "__id")
    none = F.sha2(F.lit(b""), 256)  # a conversation of no rows
    return found.join(made, found["conv_id"].eqNullSafe(made["__id"]), "left").drop("__id").withColumn("repaired_sha256", F.coalesce("repaired_sha256", none))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_nearest": op4_nearest,
    "op5_repeats": op5_repeats,
    "op6_token_files": op6_token_files,
    "op7_quality": op7_quality,
    "op8_piece_encoding": op8_piece_encoding,
    "op9_lm_score": op9_lm_score,
    "op10_near_dedup": op10_near_dedup,
    "op11_warc": op11_warc,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
}

LM_SCORE_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), tokens AS (
    SELECT doc_id, unnest(w) AS w2, unnest(range(1, len(w) + 1)) AS i FROM words
), pairs AS (
    SELECT doc_id, lag(w2) OVER (PARTITION BY doc_id ORDER BY i) AS w1, w2 FROM tokens
), one AS (SELECT w2 AS w, count(*) AS c FROM tokens GROUP BY 1
), two AS (SELECT w1, w2, count(*) AS c FROM pairs WHERE w1 IS NOT NULL GROUP BY 1, 2
), scored AS (
    SELECT p.doc_id, CASE WHEN p.w1 IS NULL THEN ln(o2.c / n.n) WHEN two.c >= 2 THEN ln(two.c / o1.c) ELSE ln(0.4 * o2.c / n.n) END AS s
    FROM pairs p JOIN one o2 ON o2.w = p.w2 LEFT JOIN one o1 ON o1.w = p.w1 LEFT JOIN two ON two.w1 = p.w1 AND two.w2 = p.w2
    CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM tokens) n
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(s.s, 0), 4) AS log_score, round(coalesce(s.s / len(d.w), 0), 6) AS mean_log_score
FROM words d LEFT JOIN (SELECT doc_id, sum(s) AS s FROM scored GROUP BY 1) s USING (doc_id)
"""

ORACLES: dict[str, str] = {"op9_lm_score": LM_SCORE_SQL}
