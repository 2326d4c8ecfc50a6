"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmeridian.llm import bpe_codec, chat, embedding_join, mixing, ngram_join, pii, quality, quality_rules, token_counts, toxicity
from kmeridian.llm.text import held_out
from kmeridian.session import saved, table

CUTOFF = 0.3


def _predicted(scored: DataFrame, folds: int, fold: int) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), 4, 2)
    return _predicted(toxicity.score(docs.select("doc_id", "text"), model), 4, 2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), 5, 0)
    return _predicted(quality.score(docs.select("doc_id", "text"), model), 5, 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = saved(quality_rules.measured(table(spark, sf_dir, "documents")))
    cutoffs = quality_rules.fit(counted, table(spark, sf_dir, "labels"))
    return quality_rules.judged(counted, cutoffs).select("doc_id", *(f"_c.{c}" for c in quality_rules.COUNTS[:5]), "base_failed", "kept")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = saved(table(spark, sf_dir, "documents").select("doc_id", pii.candidates(F.col("text")).alias("spans")))
    return pii.listed(found, pii.fit(found))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


#: The conversation that op8's contract adds.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.formatted(chat.records_of(rows), keep=("conv_id",)))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(table(spark, sf_dir, "documents"))


def op10_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.linked(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": corpus_pipeline.run}



SQL = {
    "op6_mixing": """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS key, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS h,
         coalesce(CAST(doc_id AS VARCHAR), '') AS id, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY key),
fill(round, key, source_size, w, remaining, done) AS (
  SELECT 0, key, source_size, w, CAST(sum(source_size) OVER () AS BIGINT), FALSE FROM s
  UNION ALL
  SELECT round + 1, key, source_size, w,
         CAST(remaining - coalesce(sum(3 * source_size) FILTER (full_now) OVER (), 0) AS BIGINT), done OR full_now
  FROM (SELECT *, NOT done AND w * remaining > 3 * source_size * sum(w) FILTER (NOT done) OVER () AS full_now FROM fill) f
  WHERE round < 60),
t AS (
  SELECT key, source_size, CAST(CASE WHEN done THEN 3 * source_size ELSE w * remaining / sum(w) FILTER (NOT done) OVER () END AS DOUBLE) AS target
  FROM fill WHERE round = 60),
q AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.key ORDER BY h, id ROWS UNBOUNDED PRECEDING) AS served, row_number() OVER (PARTITION BY d.key ORDER BY h, id) AS n
  FROM d JOIN t ON d.key = t.key),
e AS (SELECT *, CAST(epoch * source_size + served AS DOUBLE) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS epoch) WHERE target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, key, h, id, n ROWS UNBOUNDED PRECEDING) AS total FROM e),
n AS (SELECT key, n, count(*) FILTER (total <= (SELECT sum(size) FROM d)) AS times FROM o GROUP BY key, n)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(times, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.key = n.key AND q.n = n.n
""",
    "op8_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(role || text, '\', '\\')) + len(regexp_extract_all(role, '<\||</?s>|\[/?INST\]|<</?SYS>>'))
         + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]|<</?SYS>>')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + 25) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
}
