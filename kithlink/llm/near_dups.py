"""Near-duplicates by circulant MinHash.

A document is its set of distinct five-word shingles. One permutation spreads the shingles over 2**20 places, a second
one orders the places; shifted circularly by k it gives the k-th signature coordinate, so two permutations make all of
them. Signatures are cut into bands; documents that share a band are candidates, and links are confirmed on full sets:
100 * intersection >= 85 * union. The sets that confirm are of hashes with another seed than those that nominate.

Work on hot groups stays bounded and no pair list is made:

* Equal sets are one class from the start, found by a pre-aggregated fingerprint; its smallest doc_id stands for it.
* The smallest member of a band is its hub. Every member is compared with its hubs, in chunks of ``chunk`` members; members of a
  dense group share their hub in most bands, so that costs a comparison or a few for each.
* A band whose members are in one component then is done. In any other, the members outside its largest
  component meet all members, block by block, comparing only across components and a pair only in the first band that it
  shares. No link is lost to a cap, and only documents that share a band ever meet.

Joins that a hot class or band makes uneven are written as they are, so adaptive execution may split them.
With 32 bands of 6, a pair at similarity 0.85 shares no band with probability 3e-7.

Nulls: a document without text or words has an empty set and links with nothing; a row without doc_id has no component
and is kept. Repeated rows of one doc_id are one document (its sets, if they differ, count as linked, and each is compared). Ties: a
component's smallest doc_id names it. Very long texts are read whole. Empty tables give empty results; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm import shared
from kithlink.llm.textvec import U64, Words, mix, shingle_sets, slices, utf8
from kithlink.operators.components import connected_components

SPREAD_BITS = 20
SIGNED = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"


class Circulant:
    """Signatures of ``bands * rows`` coordinates from two permutations with fixed seeds."""

    def __init__(self, bands: int = 32, rows: int = 6, seed: int = 1):
        self.bands, self.rows, size = bands, rows, bands * rows
        order = np.random.default_rng(seed).permutation(1 << SPREAD_BITS).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate((order, order[: size - 1])), size)
        self.salt = U64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The first permutation: a bijection on 64 bits, of which the top bits are the place."""
        return (mix(hashes ^ self.salt) >> U64(64 - SPREAD_BITS)).astype(np.int64)

    def signature(self, places: np.ndarray) -> np.ndarray:
        """Coordinate k is the least of the second permutation's values, shifted by k, over the set."""
        least = None
        for i in range(0, len(places), 1024):
            part = self.shifted[places[i : i + 1024]].min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return least

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """One key per band; coordinates of a band lie far apart in the shifts."""
        by_band = signatures.reshape(len(signatures), self.rows, self.bands).astype(U64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=U64), (len(signatures), self.bands)).copy()
        for r in range(self.rows):
            key = mix(key * U64(0xD6E8FEB86659FD93) + by_band[:, r, :])
        return key.view(np.int64)


_circulants: dict[tuple, Circulant] = {}


def sign_documents(docs: DataFrame, k: int, bands: int, rows: int, seed: int) -> DataFrame:
    """``SIGNED`` of each row: set size, a 128-bit fingerprint of the set from two independent hashes, band keys."""

    def sign(batches):
        c = _circulants.setdefault((bands, rows, seed), Circulant(bands, rows, seed))
        for batch in batches:
            for i, j, data, at in slices(*utf8(batch.column("text"))):
                hashes, cut, others = shingle_sets(Words(data, at), k, Words(data, at, seed=1))
                places = c.places(hashes)
                full = np.flatnonzero(np.diff(cut))
                signatures = [c.signature(places[cut[r] : cut[r + 1]]) for r in full]
                keys = c.band_keys(np.stack(signatures)) if signatures else np.empty((0, bands), np.int64)
                sums = [np.concatenate(([U64(0)], np.cumsum(mix(h ^ U64(0x243F6A8885A308D3)), dtype=U64)))[cut] for h in (hashes, others)]
                counts = np.zeros(j - i + 1, np.int32)
                counts[full + 1] = bands
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(i, j - i), "n_shingles": pa.array(np.diff(cut)), "key_a": pa.array(np.diff(sums[0]).view(np.int64)), "key_b": pa.array(np.diff(sums[1]).view(np.int64)),
                    "bands": pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys.reshape(-1))),
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, SIGNED)


class Sets:
    """The shingle sets of some documents."""

    def __init__(self, texts: list[str], k: int):
        parts, sizes = [np.empty(0, U64)], [np.empty(0, np.int64)]
        for _, _, data, at in slices(*utf8(pa.array(texts, pa.large_string()))):
            hashes, cut, _ = shingle_sets(Words(data, at, seed=2), k)
            parts.append(hashes)
            sizes.append(np.diff(cut))
        self.flat, self.sizes = np.concatenate(parts), np.concatenate(sizes)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.at[i] : self.at[i + 1]]

    def alike_in_size(self, i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
        """Those of ``others`` whose set's size allows a link with set i."""
        sizes, n = self.sizes[others], int(self.sizes[i])
        return others[(den * np.minimum(sizes, n) >= num * np.maximum(sizes, n)) & (sizes > 0)] if n else others[:0]

    def linked(self, i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
        """Those of ``others`` whose set is similar enough to set i."""
        others = self.alike_in_size(i, others, num, den)
        if not len(others):
            return others
        own, n, sizes = self.of(i), int(self.sizes[i]), self.sizes[others]
        where = np.repeat(self.at[others] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        values = self.flat[where]
        place = np.searchsorted(own, values)
        place[place == n] = 0
        common = np.add.reduceat((own[place] == values).astype(np.int64), np.cumsum(sizes) - sizes)
        return others[den * common >= num * (sizes + n - common)]


def _tasks(batches: Iterator[pa.RecordBatch], keys: list[str], k: int, most: int = 1 << 20) -> Iterator[tuple[dict, Sets, list[tuple[int, int]]]]:
    """Rows of a sorted stream as (columns, their sets, (first, end) of each task), some whole tasks at a time."""
    held: dict[str, list] = {}
    bounds: list[int] = []
    current, size = None, 0

    def give():
        edges = [*bounds, len(held["text"])]
        return held, Sets([t or "" for t in held["text"]], k), list(zip(edges, edges[1:], strict=False))

    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for i, mark in enumerate(zip(*(columns[x] for x in keys), strict=True)):
            if mark != current:
                if size >= most:
                    yield give()
                    held, bounds, size = {}, [], 0
                bounds.append(len(held.get("text", ())))
                current = mark
            for n in columns:
                held.setdefault(n, []).append(columns[n][i])
            size += len(columns["text"][i] or "")
    if bounds:
        yield give()


def _links(pairs: list[tuple[int, int]], ids: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"src": pa.array([ids[i] for i, _ in pairs], pa.int64()), "dst": pa.array([ids[j] for _, j in pairs], pa.int64())})


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, k: int = 5, bands: int = 32, rows: int = 6, seed: int = 1, chunk: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row. The similarity must be at least num / den."""
    signed = shared.settle(sign_documents(docs, k, bands, rows, seed), "minhash")
    repeated = shared.repeated_ids(docs)
    key = ["key_a", "key_b", "n_shingles"]
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = shared.settle(some.groupBy(*key).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    own_bands = F.when(F.col("least").isNull() | (F.col("doc_id") == F.col("least")), F.col("bands"))
    placed = shared.settle(signed.join(classes, key, "left").select("doc_id", "n_shingles", rep.alias("rep"), own_bands.alias("bands")), "classed")

    banded = placed.where("rep IS NOT NULL").select("rep", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("most"), F.count("*").alias("n")).where("hub < most").drop("most")
    tied = shared.settle(banded.join(shared.settle(hubs, "hubs"), "band"), "tied")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(tied.select("rep").distinct(), "rep", "left_semi")
    if repeated is not None:
        texts = texts.dropDuplicates(["rep", "text"])
    texts = shared.settle(texts, "tied-texts")

    links = shared.settle(_to_hubs(tied, texts, num, den, k, chunk), "links")
    parts = connected_components(links).select(F.col("id").alias("rep"), F.col("component").alias("part"))
    state = shared.settle(tied.join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep")), "tied-parts")
    more = _across(state, texts, num, den, k, chunk)
    vertices = state.select("rep", "part").distinct()
    if repeated is not None:  # rows of one doc_id in several classes
        own = placed.where("n_shingles > 0 AND rep IS NOT NULL").join(repeated, "doc_id").groupBy("doc_id").agg(F.min("rep").alias("src"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
        own = shared.settle(own.select("src", F.explode("reps").alias("dst")), "own-links")
        more = own if more is None else more.unionByName(own)
        alone = own.select(F.explode(F.array("src", "dst")).alias("rep")).distinct().join(vertices, "rep", "left_anti")
        vertices = vertices.unionByName(alone.select("rep", F.col("rep").alias("part")))
    if more is not None:  # what was found since joins components
        for end in ("src", "dst"):
            more = more.join(vertices.withColumnsRenamed({"rep": end, "part": f"{end}_part"}), end)
        joined = connected_components(more.select("src_part", "dst_part"), "src_part", "dst_part").select(F.col("id").alias("part"), "component")
        vertices = vertices.join(joined, "part", "left").select("rep", F.coalesce("component", "part").alias("part"))
    found = shared.settle(vertices.where("rep <> part"), "components")
    out = placed.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce("part", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _to_hubs(tied: DataFrame, texts: DataFrame, num: int, den: int, k: int, chunk: int) -> DataFrame:
    """Links of the members of bands with their hubs."""
    asked = tied.where("rep <> hub").groupBy("rep", "hub").agg(F.max(F.ceil(F.col("n") / chunk)).cast("long").alias("chunks"))
    asked = shared.settle(asked.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks"))), "asked")
    task = ["hub", "chunks", "chunk"]
    hubs = asked.select(*task).distinct().join(texts.withColumnRenamed("rep", "hub"), "hub").select(*task, F.col("hub").alias("rep"), "text")
    members = asked.join(texts, "rep").select(*task, "rep", "text")

    def compare(batches):
        for columns, sets, tasks in _tasks(batches, task, k):
            pairs = []
            for a, b in tasks:
                at, own = np.arange(a, b), np.array(columns["rep"][a:b]) == columns["hub"][a]
                for i in at[own].tolist():
                    pairs += [(i, int(j)) for j in sets.linked(i, at[~own], num, den)]
            yield _links(pairs, columns["rep"])

    return hubs.unionByName(members).repartition(*task).sortWithinPartitions(*task).mapInArrow(compare, "src long, dst long")


def _across(state: DataFrame, texts: DataFrame, num: int, den: int, k: int, chunk: int) -> DataFrame | None:
    """Links between the components that bands are still in; None if there is no such band."""
    sizes = state.where("n > 2").groupBy("band", "part").agg(F.count("*").alias("n"))
    bands = sizes.groupBy("band").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("top"), F.sum("n").alias("total")).where("top < total")
    blocks = [F.ceil(x / chunk).cast("long").alias(n) for x, n in ((F.col("total") - F.col("top"), "blocks"), (F.col("total"), "sides"))]
    bands = shared.settle(bands.select("band", "main", *blocks), "open-bands")
    if bands.isEmpty():
        return None
    rows = shared.settle(state.join(bands, "band").select("rep", "band", "part", "hub", "blocks", "sides", (F.col("part") != F.col("main")).alias("outside")).distinct(), "open-rows")
    bands_of = rows.groupBy("rep").agg(F.collect_set("band").alias("bands"))
    whole = rows.join(bands_of, "rep").join(texts, "rep")
    kept = ["band", "rep", "part", "hub", "outside", "bands", "text"]
    side, block = F.pmod(F.xxhash64("rep"), F.col("sides")), F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks"))
    every = whole.select(*kept, F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), side.alias("side"))
    asking = whole.where("outside").select(*kept, F.lit(True).alias("query"), block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)).alias("side"))
    task = ["band", "block", "side"]

    def compare(batches):
        for columns, sets, tasks in _tasks(batches, task, k):
            pairs = []
            reps, parts, hubs, outside, query = (np.array(columns[n]) for n in ("rep", "part", "hub", "outside", "query"))
            shares = list(map(frozenset, columns["bands"]))
            for a, b in tasks:
                band, at = columns["band"][a], np.arange(a, b)
                # a hub has met all of its band; two members outside meet twice and are compared once
                for i in at[query[a:b] & (reps[a:b] != hubs[a:b])].tolist():
                    others = at[~query[a:b] & (parts[a:b] != parts[i]) & (reps[a:b] != hubs[a:b]) & (~outside[a:b] | (reps[a:b] > reps[i]))]
                    others = [j for j in sets.alike_in_size(i, others, num, den).tolist() if min(shares[i] & shares[j]) == band]
                    pairs += [(i, int(j)) for j in sets.linked(i, np.array(others, np.int64), num, den)]
            yield _links(pairs, columns["rep"])

    dealt = every.unionByName(asking).repartition(*task).sortWithinPartitions(*task)
    return shared.settle(dealt.mapInArrow(compare, "src long, dst long"), "links-across")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component."""
    gone = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
