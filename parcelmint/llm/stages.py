"""The stages of the corpus pipeline: language ID, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
docs needs doc_id, text, lang and source; further columns pass, whatever their names. No stage fails on an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.llm import langid, mixing, ngram_join, packing, secrets
from parcelmint.llm.common import durable, shared_dir, small, table, veiled

#: A document whose best language has a lower mean probability over its bytes is rejected.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents; documents without a language or with none that is likely go.

    Null and empty texts have no language and go; rows that repeat fare alike.
    """
    plain, restored = veiled(docs, "doc_id", "text", "lang")
    found = langid.identify(plain, langid.train(plain), plain.columns)
    return restored(found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: of each group of linked documents the one with the smallest id stays.

    Decisions are made for rows, not ids: rows that share an id are documents of their own, and of rows that
    repeat one stays. A null id is larger than all others. Texts without words, null ones too, all stay.
    """
    plain, restored = veiled(docs, "doc_id", "text")
    unclear = F.col("doc_id").isNull() | (F.col("doc_id") < 0)
    shared = durable(plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | unclear).select(F.col("doc_id").alias("shared")))
    if shared.limit(1).count():
        several = plain.join(shared, F.col("doc_id").eqNullSafe(F.col("shared")), "left_semi")
        several = durable(several.withColumn("key", -1 - F.monotonically_increasing_id()))
        alone = plain.join(shared, F.col("doc_id").eqNullSafe(F.col("shared")), "left_anti").withColumn("key", F.col("doc_id").cast("long"))
        keyed, ids = alone.unionByName(several), several.select("key", "doc_id")
    else:
        keyed, ids = plain.withColumn("key", F.col("doc_id").cast("long")), None
    found = ngram_join.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text"), words=5, percent=80)
    found = found.where("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    if ids is None:
        gone = found.where("key <> group").select("key")
    else:
        found = found.join(ids, "key", "left").withColumn("doc_id", F.coalesce("doc_id", F.when(F.col("key") >= 0, F.col("key"))))
        first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
        gone = found.join(first, "group").where("key <> first.key").select("key")
    return restored(keyed.join(small(durable(gone)), "key", "left_anti"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars, if there, follows the text. Every row stays; null texts stay null."""
    plain, restored = veiled(docs, "doc_id", "text")
    masked = secrets.redact(secrets.scan(plain.withColumn("null__", F.col("text").isNull())))
    text = F.when(~F.col("null__"), F.col("text"))
    return restored(masked, {"text": text, "n_chars": F.length(text).cast("long")})


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard, in the order of each shard's local shuffle.

    The document that ends a source's share is cut. Texts without words add nothing to a mix and go; rows that
    repeat are taken each on its own.
    """
    return mixing.mixed_documents(docs, mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document; null texts are empty, rows that repeat are packed each on its own."""
    return packing.pack(docs.select("doc_id", "text")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scans", secret_scans),
    ("mixing", mixing_sources),
    ("packing", pack),
]

#: SQL cannot express the network of the first stage or the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
