"""From raw documents to token counts: the stages of a training-data pipeline.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in
the shared folder and read again as the next stage's input. All but the last keep the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlscout.llm import bpe, mixing, ngram_join, repeats, toxicity
from mlscout.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, "_score").filter(F.col("_score") < 0.3).drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document, with the smallest id, stays."""
    return ngram_join.without_near_duplicates(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes that an earlier document holds are cut out."""
    kept = repeats.without_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, as the mix of sources takes them."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    taken = mixing.mix(docs.select("doc_id", "source", "text", whole.alias("_row")), carry=["_row"])
    # each row carries itself, so neither null nor repeated ids can lose or multiply it
    return taken.filter("copies > 0").select(F.explode(F.array_repeat("_row", F.col("copies")))).select("col.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Shingle links, learned scores and token ids have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
