"""Directly addressable token files.

Ids are split into 8-bit chunks, low chunk first. Level 0 holds the low chunk of every id, level k the k-th chunk of
those ids that have one. A level's continuation bitmap marks the ids that go on in the next level, and its rank
directory holds the marks before each 512-bit block, so token i is found by a rank per level: no block is decoded,
nothing before it is read.

One file holds a run of documents in ascending doc_id order, those without doc_id first: header, level tables, document directory
(doc_id, first token). All integers are little-endian.

* ``write_token_files`` encodes a table and returns the manifest of its files.
* ``read_token_files`` returns the documents' ids from the files.
* ``TokenFile`` is one file, in memory or in storage: ``token(i)`` reads a byte, a rank and part of a bitmap block for each level, ``document(k)``
  the tokens of one document, ``ids()`` everything.

Null or empty texts are the end id alone; very long texts are one run of ids; a null doc_id sorts first; repeated rows are kept, each with its own run of
ids, and rows of one doc_id are ordered by their text; an empty table makes no file and no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm import shared, tokens

MAGIC = b"KDAC\x02\x00\x00\x00"
BLOCK = 512
HEAD = "<8sQQQI"
MANIFEST = "part int, seq int, path string, first_doc long, n_docs long, n_tokens long, n_bytes long"


def pack(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, without_id: int = 0) -> bytes:
    """The file of ``ids``; document k's ids begin at ``starts[k]``. The first ``without_id`` documents have no doc_id."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while len(rest):
        on = rest > 0xFF
        bits = np.packbits(on, bitorder="little")
        padded = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)))
        ones = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint64)
        rank = np.concatenate(([np.uint64(0)], np.cumsum(ones, dtype=np.uint64)))
        levels.append(((rest & 0xFF).astype(np.uint8), bits, rank))
        rest = rest[on] >> 8
    head = struct.pack(HEAD, MAGIC, len(ids), len(doc_ids), without_id, len(levels))
    table = b"".join(struct.pack("<QQQ", *(x.nbytes for x in level)) for level in levels)
    body = b"".join(x.tobytes() for level in levels for x in level)
    return head + table + np.asarray(doc_ids, "<i8").tobytes() + np.asarray(starts, "<i8").tobytes() + body


class TokenFile:
    """One file, read through ``read(at, size)``; ``of`` takes its bytes, ``open`` a place in storage."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self._read = read
        magic, self.n, self.n_docs, self.without_id, levels = struct.unpack(HEAD, read(0, struct.calcsize(HEAD)))
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEAD)
        sizes = struct.iter_unpack("<QQQ", read(at, 24 * levels))
        self._ids_at = at + 24 * levels
        self._starts_at = self._ids_at + 8 * self.n_docs
        at = self._starts_at + 8 * self.n_docs
        self._levels = []  # (place, size) of a level's chunks, bitmap and rank directory
        for level in sizes:
            parts = []
            for size in level:
                parts.append((at, size))
                at += size
            self._levels.append(parts)

    @classmethod
    def of(cls, blob: bytes) -> TokenFile:
        view = memoryview(blob)
        return cls(lambda at, size: view[at : at + size])

    @classmethod
    def open(cls, uri: str) -> TokenFile:
        """Only what is asked for is read."""
        fs, path = shared.filesystem(uri)
        return cls(_reader(fs.open_input_file(path)))

    def _array(self, place: tuple[int, int], kind) -> np.ndarray:
        return np.frombuffer(self._read(*place), kind)

    @property
    def doc_ids(self) -> np.ndarray:
        """Of the documents from the first with an id on; those before have none."""
        return self._array((self._ids_at, 8 * self.n_docs), "<i8")

    @property
    def starts(self) -> np.ndarray:
        return self._array((self._starts_at, 8 * self.n_docs), "<i8")

    def token(self, i: int) -> int:
        """Id i, by one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for (chunks, _), (bits, _), (rank, _) in self._levels:
            value |= self._read(chunks + i, 1)[0] << shift
            first = i // BLOCK * (BLOCK // 8)
            block = self._read(bits + first, (i >> 3) - first + 1)
            if not block[-1] >> (i & 7) & 1:
                break
            before = int.from_bytes(block[:-1], "little").bit_count() + (block[-1] & (1 << (i & 7)) - 1).bit_count()
            i, shift = int.from_bytes(self._read(rank + i // BLOCK * 8, 8), "little") + before, shift + 8
        return value

    def ids(self) -> np.ndarray:
        """All ids at once."""
        out = np.zeros(self.n, np.uint32)
        where = None
        for k, (chunks, bits, _) in enumerate(self._levels):
            low = self._array(chunks, np.uint8)
            part = low.astype(np.uint32) << np.uint32(8 * k)
            on = np.unpackbits(self._array(bits, np.uint8), count=len(low), bitorder="little").view(bool)
            if where is None:
                out |= part
                where = np.flatnonzero(on)
            else:
                out[where] |= part
                where = where[on]
        return out

    def document(self, k: int) -> list[int]:
        """Document k's ids, token by token."""
        if not 0 <= k < self.n_docs:
            raise IndexError(k)
        more = k + 1 < self.n_docs
        edges = struct.unpack("<qq" if more else "<q", self._read(self._starts_at + 8 * k, 16 if more else 8))
        return [self.token(i) for i in range(edges[0], edges[1] if more else self.n)]


def _reader(file) -> Callable[[int, int], bytes]:
    def read(at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    return read


def _encode_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int):
    """(doc_ids, ids with end ids, their counts, how many have no doc_id) portion by portion."""
    encode = tokens.encoder(path).encode
    for batch in batches:
        null = np.array(batch.column("doc_id").is_null())
        docs = np.array(batch.column("doc_id").fill_null(0)).astype(np.int64)
        for i, j, texts in tokens.portions(batch.column("text")):
            ids, counts = encode(texts)
            yield docs[i:j], np.insert(ids, np.cumsum(counts), end_id), counts + 1, int(null[i:j].sum())


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, most: int = 1 << 23) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files of at most about ``most`` ids; the manifest, one row a file.

    Rows are range-partitioned by doc_id, so files in (part, seq) order hold ascending doc_ids.
    """
    spark = docs.sparkSession
    tokenizer, folder = tokenizer or tokens.default_path(), shared.work_dir(spark, "token-files")

    def write(batches):
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, size
            ids, counts, own = (np.concatenate([h[k] for h in held]) for k in (1, 2, 0))
            path = f"{folder}/{shared.attempt_name('part', seq)}.dac"
            n = shared.write_file(path, [pack(ids, own, np.cumsum(counts) - counts, sum(h[3] for h in held))])
            row = [part, seq, path, int(own[0]), len(own), len(ids), n]
            seq, held, size = seq + 1, [], 0
            return pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in MANIFEST.split(", ")], row, strict=True))], schema)

        for own, ids, counts, without_id in _encode_rows(batches, tokenizer, end_id):
            held.append((own, ids, counts, without_id))
            size += len(ids)
            if size >= most:
                yield flush()
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("first_doc", "n_docs", "n_tokens", "n_bytes"))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return shared.settle(rows.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. The manifest has a row a file, so its prefix sums are taken on the driver."""
    spark = manifest.sparkSession
    rows, before = [], 0
    for r in manifest.orderBy("part", "seq").collect():
        rows.append((r.path, before))
        before += r.n_tokens
    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)), "path")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                f = TokenFile.of(shared.read_file(path))
                ids, starts = f.ids().astype("<u4"), f.starts
                ends = np.append(starts[1:], len(ids))
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(f.doc_ids, mask=np.arange(f.n_docs) < f.without_id), "start": pa.array(starts + base),
                    "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from its token file."""
    return read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))
