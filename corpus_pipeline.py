"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.

Defined cases, of all stages: no rows give no rows; null and empty texts fail the
quality rules, and further on count as empty, are linked with nothing, are not taken
by the mix (size 0) and are an end id when packed; repeated rows are copies, of which
one stays; a null id or source is one of its own; columns of any name go along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import exact_dedup, minhash_dedup, mixing, packing, quality_rules
from sightline.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail them; n_chars is that of the text left."""
    return quality_rules.keep_good(docs, size_col="n_chars" if "n_chars" in docs.columns else None)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_dedup.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all of them with their places in sequences; with a small cache of words, as the stages before have
    grown the executors."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_words=400_000, chunk=4 << 20)


STAGES = [("quality rules", quality), ("exact dedup", exact_copies), ("MinHash near-dedup", near_copies), ("source mixing", mixture), ("best-fit packing", packed)]

#: The knapsack of the mix and the packing plan have no SQL form; tests/llm compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
