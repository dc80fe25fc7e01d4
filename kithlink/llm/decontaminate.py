"""Benchmark decontamination by spaced seeds.

A token is a run of letters, digits and non-ASCII bytes, A-Z lower-cased. Each mask takes some positions of a window of
tokens and ignores the others, so a hash over the taken ones survives substitutions at the ignored ones. The seeds of
the test items meet those of the documents; around each hit the item is laid over the document on that diagonal and the
equal tokens are counted, wherever they stand. A document is contaminated by an item if 12 tokens are equal at least, or
60 % of the item if that is less; items under ten tokens must match whole, however short. In an item of over 30 tokens the 12 must stand
within 30, as equal common words add up by chance in a long overlap; 60 % of any item always does that.

The test items are taken in blocks of at most ``block_tokens`` tokens; one block's seeds are broadcast (their size is
bounded by that parameter) and all documents are scanned for it, so a test set of any size works. Hits are gathered in
portions and reduced to their diagonals, so texts that repeat one word do not fill memory.

Null or empty texts have no tokens and meet nothing; very long texts and items are compared whole; of several places with equally many equal
tokens the last counts; repeated rows give repeated results for documents (a row each), one for repeated items; empty tables give
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm.textvec import PUNCTUATED, U64, Words, mix, slices, utf8

#: Taken (1) and ignored (0) positions. Three taken ones meet every item of which 60 % is equal, however it is spread.
MASKS = ("111", "1101", "1011", "10101", "110011")
#: Items of one or two tokens have no window of three and are their own seed.
TINY = ("1", "11")
#: The least number of equal tokens stands within so many times as many tokens.
SPREAD = 2.5
#: Tokens that are compared at once, at most (a longer overlap stands alone), and hits that are held at once.
COMPARED = HELD = 1 << 20
_token = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
OVERLAPS = "row_doc long, item_id long, hits long, matched long, item_tokens long, overlap double, doc_start long, doc_end long"


def seeds(words: np.ndarray, mask: str, which: int) -> np.ndarray:
    """The seed hash at each token where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, which + 1, U64)
    for i, taken in enumerate(mask):
        if taken == "1":
            out = mix(out + U64(0xD6E8FEB86659FD93) ^ words[i : i + n])
    return out


class Index:
    """Seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = pa.array([t for _, t in items], pa.large_string())
        words = Words(*utf8(texts), PUNCTUATED)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.at, self.words = words.at, words.hash
        keys, item, place = [], [], []
        tokens = np.diff(words.at)
        self.masks = [(k, m) for k, m in enumerate((*MASKS, *TINY)) if m in MASKS or (tokens == len(m)).any()]
        for k, mask in self.masks:
            found = seeds(words.hash, mask, k)
            own = np.searchsorted(words.at, np.arange(len(found)), "right") - 1
            fits = np.arange(len(found)) + len(mask) <= words.at[own + 1]
            if mask in TINY:
                fits &= tokens[own] == len(mask)
            at = np.flatnonzero(fits)
            keys.append(found[at])
            item.append(own[at])
            place.append(at - words.at[own[at]])
        keys, item, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, item, place))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], item[order], place[order]
        self.bits = max(16, min(26, int(64 * len(keys) + 1).bit_length()))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.keys & U64((1 << self.bits) - 1)).astype(np.int64)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, diagonal, seed hits) of the diagonals met, ascending; a diagonal is the place in the slice's words where the item would begin."""
        out: list[tuple] = []
        for k, mask in self.masks:
            found = seeds(words.hash, mask, k)
            maybe = np.flatnonzero(self.filter[(found & U64((1 << self.bits) - 1)).astype(np.int64)])
            low, high = np.searchsorted(self.keys, found[maybe]), np.searchsorted(self.keys, found[maybe], "right")
            row = np.searchsorted(words.at, maybe, "right") - 1
            use = (high > low) & (maybe + len(mask) <= words.at[row + 1])
            maybe, low, n, row = maybe[use], low[use], (high - low)[use], row[use]
            for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // HELD)) + 1):
                if len(some):
                    m = n[some]
                    entry = np.repeat(low[some], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                    out.append(_counted(np.repeat(row[some], m), self.item[entry], np.repeat(maybe[some], m) - self.place[entry]))
            if len(out) > 1:
                out = [_counted(*(np.concatenate(x) for x in zip(*out, strict=True)))]
        return out[0] if out else tuple(np.empty(0, np.int64) for _ in range(4))


def _counted(row: np.ndarray, item: np.ndarray, diagonal: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct (row, item, diagonal), ascending, and the sums of their counts (1 each without)."""
    order = np.lexsort((diagonal, item, row))
    row, item, diagonal = row[order], item[order], diagonal[order]
    new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) != 0))[: len(row)])
    sums = np.diff(np.append(new, len(row))) if counts is None else np.add.reduceat(counts[order], new) if len(new) else counts
    return row[new], item[new], diagonal[new], sums


def equal_tokens(same: np.ndarray, size: np.ndarray, window: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matches, first, end) per overlap; ``same`` holds one overlap after the other, of ``size`` each. They span all windows with
    ``least`` matches, from the first match in one to the last; without such a window all is 0."""
    begin = np.cumsum(size) - size
    before = np.concatenate(([0], np.cumsum(same)))
    at, own = np.arange(len(same)), np.repeat(np.arange(len(size)), size)
    stop = np.minimum(at + window[own], (begin + size)[own])
    found = np.flatnonzero(same & (before[stop] - before[at] >= least[own]))
    which, here = np.unique(own[found], return_index=True)
    places = np.flatnonzero(same)
    low = found[here]
    high = places[before[stop[found[np.append(here[1:], len(found)) - 1]]] - 1] + 1 if len(which) else low
    matches, first, end = (np.zeros(len(size), np.int64) for _ in range(3))
    matches[which], first[which], end[which] = before[high] - before[low], low - begin[which], high - begin[which]
    return matches, first, end


def overlaps(index: Index, words: Words, least: int, share: float) -> list[tuple]:
    """Per contaminated (row, item): row, item id, hits, matched, item tokens, overlap, first and end token in the document."""
    row, item, diagonal, counts = index.hits(words)
    if not len(row):
        return []
    tokens = np.diff(index.at)[item]
    need = np.where(tokens < 10, tokens, np.minimum(least, np.ceil(share * tokens).astype(np.int64)))
    low, high = np.maximum(diagonal, words.at[row]), np.minimum(diagonal + tokens, words.at[row + 1])
    enough = np.flatnonzero(high - low >= need)
    part = np.cumsum((high - low)[enough]) // COMPARED
    met: list[np.ndarray] = []
    for some in np.split(enough, np.flatnonzero(np.diff(part)) + 1):
        size = (high - low)[some]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = words.hash[np.repeat(low[some], size) + at] == index.words[np.repeat((index.at[item] + low - diagonal)[some], size) + at]
        matches, first, end = equal_tokens(same, size, np.full(len(some), math.ceil(SPREAD * least)), need[some])
        k = np.flatnonzero(matches)
        j = some[k]
        start = low[j] - words.at[row[j]] + first[k]
        met.append(np.stack((row[j], item[j], matches[k], counts[j], start, start + end[k] - first[k])))
    found = np.concatenate(met, axis=1)
    found = found[:, np.lexsort(found[::-1])]
    best = np.flatnonzero(np.append((np.diff(found[0]) != 0) | (np.diff(found[1]) != 0), True)[: found.shape[1]])  # the last of a row and item
    tokens = np.diff(index.at)
    return [(r, int(index.ids[i]), h, m, int(tokens[i]), m / int(tokens[i]), a, b) for r, i, m, h, a, b in found[:, best].T.tolist()]


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of about ``most`` tokens, streamed partition by partition."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    for r in rows.toLocalIterator():
        n = len(_token.findall(r.text))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield held


def find_overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 12, share: float = 0.6, block_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, hits, matched, item_tokens, overlap, doc_start, doc_end: a row per contaminated document and item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", *[c.split()[0] for c in OVERLAPS.split(", ")[1:]]]
    schema = OVERLAPS.replace("row_doc", "doc_id")
    out = None
    for block in blocks(benchmark, block_tokens):
        shared_index = spark.sparkContext.broadcast(Index(block))

        def scan(batches, held=shared_index):
            index = held.value
            for batch in batches:
                ids = batch.column("doc_id")
                rows = []
                for i, _, data, at in slices(*utf8(batch.column("text"))):
                    rows += [(i + r[0], *r[1:]) for r in overlaps(index, Words(data, at, PUNCTUATED), least, share)]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0])), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names)

        part = docs.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows of contaminated documents. Rows without a doc_id stay."""
    gone = find_overlaps(docs, benchmark, **options).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
