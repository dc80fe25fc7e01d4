"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.llm import shared


def held_out() -> Column:
    """True for a fifth of the documents, by crc32 of the doc_id as text; labels are never learnt from them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents of ``most_bytes`` bytes together that are not held out, chosen by a
    hash of the doc_id and written to the shared folder.

    Documents without text, without a label or with contradicting labels are left out; of several rows of a doc_id the
    smallest text stands for it. Ties of the hash are settled by the doc_id.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "label")  # bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = shared.settle(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")), "labelled")
    sizes = rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # ``most`` rows at most
    total, last = 0, len(sizes)
    for k, r in enumerate(sizes):
        total += r.n
        if total > most_bytes:
            last = k
            break
    if last < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id,) for r in sizes[:last]], "doc_id long")), "doc_id")
    return rows
