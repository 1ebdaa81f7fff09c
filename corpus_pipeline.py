"""A training corpus from raw documents, in five stages.

Each stage works on all rows that its predecessor kept, and its decisions take
effect; all but the last return the columns of ``documents``. Stages are written
as Parquet in the cluster's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightframe.llm import bpe, decontaminate, jaccard_join, scratch, substring_dedup, toxicity
from nightframe.llm.queries import table, tokenizer

KEY, TEXT = "doc_id", "text"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the least id; documents without an id stay."""
    groups = jaccard_join.near_duplicates(docs)
    others = groups.filter(F.col(KEY).isNotNull() & (F.col(KEY) != F.col("component_id"))).select(KEY).distinct()
    return docs.join(others, KEY, "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word sequences of smaller documents; documents of which nothing is left go, those without a text stay."""
    left = substring_dedup.dedup(docs.withColumn("__had", F.coalesce(F.col(TEXT) != "", F.lit(False))))
    n_chars = F.coalesce(F.length(TEXT).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return left.filter(~F.col("__had") | (F.col(TEXT) != "")).withColumn("n_chars", n_chars).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checksums of the kept texts, encoded and decoded."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Classifier training, latent search and subsequence checks have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
