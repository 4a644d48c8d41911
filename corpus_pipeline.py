"""From raw documents to token ids: each stage works on all that the one before kept.

Decisions are made row by row, so rows without a doc_id and repeated rows are treated like all others.
No stage has an SQL form (languages, signatures and tokens come from models and hashes), so ORACLE_SQL is None;
tests/llm/test_pipeline.py holds the result against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bagminhash, bpe, langid, phrase_index, pii
from loomgraph.llm.common import Scratch, crc_mod, small_or_shuffled, with_workers

#: A text whose best language has less than this corrected share of its trigrams is in no known language.
LEAST_SHARE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter or in no known language go."""
    with_workers(spark)
    model = langid.fit(docs.where((crc_mod("doc_id", 4) != 2) & F.col("doc_id").isNotNull()))
    found = langid.identify(docs, model, keep=[F.struct(*docs.columns).alias("doc")])
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("doc", F.col("doc").withField("lang", F.coalesce("doc.lang", "lang_pred"))).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id.

    Rows are numbered first, so that of repeated rows and of rows without an id one stays as well.
    """
    with_workers(spark)
    scratch = Scratch(spark)
    rows = scratch.write(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    classes = scratch.write(bagminhash.near_duplicates(rows, key="row", text="doc.text"))
    several = scratch.write(classes.where(~F.col("representative")).select("class_id").distinct())
    members = scratch.write(classes.join(small_or_shuffled(several, several.count()), "class_id", "left_semi").select("class_id", "row"))
    named = rows.select("row", F.col("doc.doc_id").alias("doc_id")).join(small_or_shuffled(members, members.count()), "row")
    stays = scratch.write(named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("s")).select("s.row"))
    gone = scratch.write(members.join(small_or_shuffled(stays, stays.count()), "row", "left_anti").select("row"))
    return rows.join(small_or_shuffled(gone, gone.count()), "row", "left_anti").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    report = phrase_index.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=[F.struct(*docs.columns).alias("doc")])
    return report.where(~F.col("contaminated")).select("doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    with_workers(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    with_workers(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs, path, pattern), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("byte_bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written and read again for the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
