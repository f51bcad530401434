"""A corpus pipeline: five stages over ``documents``, each stored as Parquet and read again by the next.

Toxic documents go; of each class of near duplicates one document stays; words of passages that an earlier document has
go; sources are mixed to tempered weights; what results is packed into sequences of 1024 tokens.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents`` (and any others that came
along). NULLs, empty texts, repeated rows and empty tables are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspark.llm import jaccard, language, mixing, packing, substrings, toxicity
from nearspark.session import cut_lineage, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 by a model of the labelled rows that are not held out."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train(docs, labels.where(~language.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: 5-word shingles, Jaccard similarity of 0.8."""
    ship_package(spark)
    return jaccard.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that an earlier document has; ``n_chars`` follows a changed text."""
    ship_package(spark)
    cleaned = substrings.remove_repeats(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", length)
    return cleaned.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: every document at least once, no source read more than 1.5 times as often."""
    ship_package(spark)
    return mixing.mixed_documents(docs, most_passes=1.5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, each with its sequence and place."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: learned weights, automata and packing have no form in SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
