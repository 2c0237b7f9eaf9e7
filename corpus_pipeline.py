"""A training corpus from documents, in stages: classify, deduplicate, pack.

Each stage works on all that the one before kept, which is written as Parquet and read
again between them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geomill.llm import scratch
from geomill.llm.exact_dedup import drop_exact_duplicates
from geomill.llm.jaccard_join import drop_near_duplicates
from geomill.llm.packing import pack_documents
from geomill.llm.quality import keep_good
from geomill.llm.substring_dedup import drop_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents that a Python worker gets at once.
BATCH_ROWS = 2_000
#: Scratch tables of the stage before, by application.
_used: dict[str, list[str]] = {}


def _stage(stage: Stage) -> Stage:
    """The stage, which first gives up the scratch tables of the stage before: that one's result is written by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        application = spark.sparkContext.applicationId
        scratch.release(spark, _used.pop(application, []), docs)
        before = set(scratch.tables())
        out = stage(spark, docs, sf_dir)
        _used[application] = [p for p in scratch.tables() if p not in before]
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts that with the smallest doc_id stays."""
    return drop_exact_duplicates(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of all texts but the first."""
    return drop_repeats(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: Not expressible: the classifier is fitted, and the tokenizer is a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
