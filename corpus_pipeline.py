"""From raw documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor's table, and
returns a DataFrame; all but the last return the columns of ``documents``. ``run`` writes
each stage as Parquet in the shared folder before the next one reads it.

A stage's result reads tables that the stage wrote, so write it before the next stage is called: that one
deletes them, unless its ``docs`` still read them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rolltrace.llm import exact_dedup, jaccard_join, packing, quality_rules, secret_scan
from rolltrace.llm.common import documents, materialise, release, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that stages wrote for themselves, each with the stage's place.
_left: list[tuple[int, str]] = []


def _stage(place: int) -> Callable[[Stage], Stage]:
    """A stage that first deletes what stages before it left on disk, but what ``docs`` read."""

    def wrap(work: Stage) -> Stage:
        @wraps(work)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            kept = release([path for k, path in _left if k < place], docs)
            _left[:] = [(k, path) for k, path in _left if k >= place or path in kept]
            before = set(written())
            out = work(spark, docs, sf_dir)
            _left.extend((place, path) for path in written() if path not in before)
            return out

        return run

    return wrap


@_stage(1)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage(2)
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    return exact_dedup.drop_exact_copies(docs)


@_stage(3)
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays."""
    return jaccard_join.drop_near_copies(docs)


@_stage(4)
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.mask_secrets(docs)


@_stage(5)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("secret scan", secrets),
    ("best-fit packing", packed),
]

#: Tokenization and trained models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
