"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; run() writes
it as Parquet in the shared folder and reads it again for the next. All stages but the last return the columns of
documents. Extra columns of documents stay.

1. language_id: documents in no language (null, or without any letter: ``und``) go; all others stay.
2. near_dedup: of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays.
3. decontaminate: documents that hold a benchmark item (similarity 0.8) go.
4. pii: personal data and terms that disclose it are replaced in the texts; n_chars is that of the new text.
5. piece_encoding: (doc_id, n_tokens, ids_sha256, decoded_sha256) of each text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.llm import decontaminate, language_id, near_dedup, pii, piece_encoding
from terrascore.llm.shared import drop_stored, ship, stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of no language: null texts and texts without any letter. All columns stay."""
    ship(spark)
    train = docs.where(~language_id.held_out(docs["doc_id"]) & docs["lang"].isNotNull()).select(docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    languages, model = language_id.learn(train)
    columns = [docs[c].alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    found = language_id.predict(docs, languages, model, keep=columns).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without near-duplicates: of each group the smallest id stays. Null ids and texts without words stay."""
    ship(spark)
    return near_dedup.drop_near_duplicates(docs, n=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold an item of the benchmark table. Null and empty texts stay."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data, and terms that disclose it, replaced in the texts; n_chars counts the new text. No row goes."""
    ship(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row; a null text is empty."""
    ship(spark)
    return piece_encoding.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", keep_uncontaminated),
    ("pii", replace_personal_data),
    ("piece_encoding", encode),
]

#: SQL can't express language mixtures, SimHash search or piece encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the table between two stages is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
