"""Concatenate and cut: all documents' ids as one stream, cut into windows of 2048.

First pass: each partition encodes its documents and writes them with their place in the partition. The partitions'
token totals (a row each) get prefix sums. Second pass: a document's place in the stream is its partition's sum plus
its place there; where a window boundary falls inside it, it is cut and the pieces recorded. Only the last sequence
is not full. No row is shuffled.

``pack_tokens`` returns the pieces with their ids. Null or empty texts are the end id alone; very long texts are encoded whole and cut into as many
pieces as windows ask for; repeated rows are packed each, in the order their partition has; a null doc_id stays null; an empty table has no
piece; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm import shared, tokens

ENCODED = "part int, local_start long, doc_id long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """First pass: ids of each document (as 16-bit integers where the vocabulary fits) and their place in the partition."""

    def encode(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        run = tokens.encoder(tokenizer)
        for batch in batches:
            for i, j, texts in tokens.portions(batch.column("text")):
                ids, counts = run.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                blob, size = ids.astype("<u2" if ids.itemsize == 2 else "<u4").tobytes(), ids.itemsize
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(j - i, part, np.int32)), "local_start": pa.array(at + ends - counts), "doc_id": batch.column("doc_id").slice(i, j - i),
                    "doc_tokens": pa.array(counts), "ids": pa.array([blob[size * (e - n) : size * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary()),
                })
                at += int(ends[-1])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, ENCODED)


def pack_tokens(docs: DataFrame, window: int = 2048, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents: ``PIECES`` and, if asked for, ``ids`` (array of int)."""
    spark = docs.sparkSession
    encoded = shared.settle(encode_documents(docs, tokenizer or tokens.default_path(), end_id), "packing-ids")
    bases, before = [], 0
    for r in encoded.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect():  # a row a partition
        bases.append((r.part, before))
        before += r.n
    placed = encoded.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")

    def cut(batches):
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in ("doc_id", "doc_tokens", "ids")}
            first = (batch.column("local_start").to_numpy() + batch.column("base").to_numpy()).tolist()
            rows: list[tuple] = []
            pieces: list[np.ndarray] = []
            for doc, n, blob, g in zip(col["doc_id"], col["doc_tokens"], col["ids"], first, strict=True):
                ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    sequence, offset = divmod(g + at, window)
                    length = min(window - offset, n - at)
                    piece = ids[at : at + length]
                    rows.append((doc, at, length, zlib.crc32(piece.data), n, sequence, offset))
                    if with_ids:
                        pieces.append(piece)
                    at += length
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            if with_ids:
                ends = np.cumsum([0, *map(len, pieces)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(pieces).astype(np.int32) if pieces else np.empty(0, np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids)

    return placed.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048."""
    return pack_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
