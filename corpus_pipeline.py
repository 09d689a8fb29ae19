"""A corpus pipeline: stages that each take the documents the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.decontam import without_leaks
from graphloom.llm.jaccard import one_of_each
from graphloom.llm.pieces import piece_codec
from graphloom.llm.pii import without_personal_data
from graphloom.llm.scratch import cut, remove
from graphloom.llm.toxicity import without_toxic


#: Chunks that a worker of the last stage remembers: fewer than where the operator runs alone, beside what executors still hold of earlier stages.
PIECES = 80_000


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: that with the least doc_id."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced."""
    return without_personal_data(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec(docs, public_tokenizers.path("piece_bpe_32k.model"), table=PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", civil),
    ("jaccard", deduplicate),
    ("decontamination", decontaminate),
    ("pii", sanitize),
    ("sentencepiece", tokenize),
]
#: Fitted models and alignments have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = cut(docs, name)
            if before:
                remove(spark, before)  # the next stage's input is written: nothing reads this one's any more
            before = path
    return docs
