"""The registered queries of this subpackage and the SQL that checks some of them.

Each query applies its operator to a whole table with production parameters and only derives
the digest columns from what the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlscout.llm import (
    alignment,
    archives,
    bpe,
    mixing,
    neighbours,
    ngram_join,
    pieces,
    repeats,
    resharding,
    token_files,
    topk,
    toxicity,
    variants,
)

SHARDS, OLD_SHARDS = 24, 16
QUERY_EVERY = 50


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op3_bm25_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Every 50th document asks with its whole text; all documents are searched."""
    docs = table(spark, folder, "documents")
    return topk.search(docs, docs.filter(F.col("doc_id") % QUERY_EVERY == 0))


def op4_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """The old layout deals ids to 16 shards by checksum, a null id as an empty one; the new one has 24 of equal bytes."""
    docs = table(spark, folder, "documents")
    old = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(OLD_SHARDS))
    files = resharding.rewritten(docs, old, SHARDS)
    return files.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def op5_zip_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = archives.write(table(spark, folder, "pages"))
    return archives.summary(archives.read_records(manifest))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_files.write(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return token_files.read_documents(manifest)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op10_collision_counting(spark: SparkSession, folder: str) -> DataFrame:
    vectors = neighbours.usable(table(spark, folder, "embeddings"))
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))


def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(table(spark, folder, "documents"), *paths)[0]


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(table(spark, folder, "documents"))


def op13_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_ngram_jaccard,
        op3_bm25_top_k,
        op4_resharding,
        op5_zip_warc,
        op6_token_files,
        op7_toxicity,
        op8_repeated_passages,
        op9_source_mixing,
        op10_collision_counting,
        op11_tokenizer_alignment,
        op12_spelling_variants,
        op13_sentencepiece,
    )
}

MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM docs GROUP BY source),
stops AS (
  SELECT *, 3 * source_size AS stop, CAST(3 * source_size AS DOUBLE) / weight AS stop_at FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stop_at, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY stop_at, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM stops),
targets AS (
  SELECT *, least(stop::DOUBLE, coalesce((SELECT level FROM levels WHERE level < stop_at
      ORDER BY stop_at, source NULLS LAST LIMIT 1) * weight, stop::DOUBLE)) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT d.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS part,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
bounds AS (
  SELECT source, min(CASE WHEN size > 0 AND upto > part THEN h END) AS edge FROM running GROUP BY source)
SELECT r.doc_id, r.source, r.size, r.source_size, r.target,
  CAST(epochs + CASE WHEN part > 0 AND (edge IS NULL OR h < edge
      OR (h = edge AND upto - part < part - (upto - size))) THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST(size * (epochs + CASE WHEN part > 0 AND (edge IS NULL OR h < edge
      OR (h = edge AND upto - part < part - (upto - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running r JOIN bounds b ON r.source IS NOT DISTINCT FROM b.source
"""

ORACLES = {"op9_source_mixing": MIX_SQL}
