"""A corpus from documents: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage works on what the one before it kept, and all but the last return the columns of documents. Nulls, empty and very long
texts, repeated rows and clashing names are as the operators' docstrings say: a document without text has the sample's share as its
score, links with nothing, is cut nowhere, meets no item and is packed as the end id; a row without doc_id goes by its quality alone. Ties
go to the smallest doc_id. Empty tables give empty results.

A stage's tables in the shared folder are deleted when the next stage of the same thread and input begins, as its result has been written by
then; those of the last stage are read by whoever reads its result, and stay.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kithlink.llm import decontaminate, near_dups, packing, quality, shared, suffix_dedup

_work = threading.local()


def _stage(k: int, build: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = _work.__dict__.setdefault("folders", {})
        shared.delete(spark, held.pop((sf_dir, k - 1), []))
        with shared.tracking() as folders:
            out = build(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            held[sf_dir, k] = folders
        return out

    return stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dups.drop_near_duplicates(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier in the corpus are cut out. Shards are half as large as the operator's own, beside an executor that earlier stages have filled."""
    return suffix_dedup.cut_documents(docs, home=1 << 19, shrink=0.5)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of 2048."""
    return packing.pack_tokens(docs)


STAGES = [(f.__name__, _stage(k, f)) for k, f in enumerate((good_quality, one_of_each, no_repeats, no_leaks, pack))]
#: No SQL for the classifier; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table. The corpus as a stage left it is deleted when the next one's has been written; the last one is read by the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with shared.tracking() as folders:
            docs = shared.settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        shared.delete(spark, before)
        before = [x for x in folders if f"/pipeline-{name}-" in x]
    return STAGES[-1][1](spark, docs, sf_dir)
