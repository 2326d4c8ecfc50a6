"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, token ids. Part of subpackage llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; every result is written as Parquet and
read again. Quality rules drop what they reject; of near duplicates the document of least doc_id stays; personal data is
masked; the mix drops and repeats documents; the last stage returns ids of the mixed texts.

Nulls, empty texts and repeated rows: a null or empty text has fewer words than the base rule asks for and goes in the first
stage; later stages by themselves keep such texts (each its own near-duplicate component, nothing to mask, of size 0 in the
mix, no token ids). Documents with a null doc_id, lang or source go through like others; of rows that repeat doc_id and
text one stays, a repeated doc_id on other texts takes nothing with it. The mix repeats rows on purpose. Texts of any length
are processed whole. Empty tables pass every stage and come out empty. Columns other than those of documents are kept by all
stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmeridian.llm import bpe_codec, mixing, ngram_join, pii, quality_rules
from kmeridian.session import saved_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.rejecting(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masking(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each mixed document."""
    return bpe_codec.encode(docs.select("doc_id", "source", "text"), memo=80_000).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("bpe_encoding", encoding_stage)]

#: The stages fit models and encode by merges, which SQL does not express: tests hold each stage and the chain against plain
#: Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{saved_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
