"""Removal of repeated byte strings by suffix arrays.

Every byte that lies in a ``length``-byte string which also starts earlier (smaller doc_id, or the same document and an
earlier start) is removed; strings are judged on the input.

1. Each window of ``length`` bytes has an anchor, the 32-byte gram in it with the least hash, so equal windows have equal
   anchors. Windows in a row with one anchor make a segment. Anchors that occur once cannot hold a repeat and drop out; any
   other has a home, the smallest doc_id that it occurs in. Hashes serve for this routing only; none decides a match.
2. A document's windows in a row with one home make a string of its bytes, which goes to the home's shard; so a copy
   travels as one string, and equal windows always meet.
3. A shard keeps the first of strings that are equal byte for byte (whole copies), sorts the suffixes of its strings by
   recursive induced sorting and takes the permuted common prefixes: neighbours with a common prefix of ``length`` bytes are equal
   windows. The earliest stays.
4. A home with more than ``HOME`` bytes of strings, as a common passage or thousands of copies have, is dealt over several
   shards. What is not repeated within its shard is dealt again, over fewer, until a home fits one shard. Where
   that no longer shrinks them (passages in very many surroundings), homes are parted: each anchor becomes a home of its own,
   and these are sorted and dealt as before. Where that no longer shrinks one (a single anchor in very many surroundings), the
   windows that are left are grouped by a 128-bit digest each. No string is longer than ``PIECE`` windows; a longer one is cut
   with the overlap that windows need.
5. Repeated windows are joined to runs per document and cut out.

Text is UTF-8 bytes. Nulls: a null text is empty; a row without doc_id is left whole and no source. Rows of one doc_id
are one document; if their texts differ, the smallest text stands for it and rows with other texts are left whole. Ties: of equal
strings in one document the first start stays. Texts shorter than ``length`` stay whole; very long texts are read in one piece and sorted in
strings of ``PIECE`` windows; empty tables give empty results; other columns, whatever their names, are ignored.
``repeated_runs`` gives the runs, ``cut_texts`` the texts without them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kithlink.llm import shared
from kithlink.llm.suffixes import permuted_prefixes, suffix_array
from kithlink.llm.textvec import U64, mix, powers, slices, utf8

GRAM = 32
#: Bytes that a shard gathers before it sorts, bytes of one home in a shard, windows of one string.
SHARD, HOME, PIECE = 1 << 18, 1 << 20, 1 << 18
SEGMENTS = "anchor long, doc_id long, meta long"
PARTS = "home long, doc_id long, start long, bytes binary"
#: A shard's rows: runs (no bytes), and what is left of homes in several shards (no size).
SHARDED = "home long, doc_id long, start long, size long, bytes binary"


def few_rows(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches' rows, ``most`` at a time, as strings may be long."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)


def pack_run(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return start << 31 | size


def unpack_run(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return meta >> 31, meta & (1 << 31) - 1


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, windows after it) of a slice; places within the row."""
    n, span = len(data), length - GRAM + 1
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - length + 1, 0)
    if not counts.any():
        return tuple(np.empty(0, np.int64) for _ in range(4))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    # least hash over ``span`` grams, the leftmost of equals, by doubling: hash and place in one number
    least, width = grams >> U64(32) << U64(32) | np.arange(len(grams), dtype=U64), 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[step:], least[:-step])
        width += step
    place = least & U64(0xFFFFFFFF)
    row = np.repeat(np.arange(len(sizes)), counts)
    window = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    anchor = place[window].astype(np.int64)
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    last = np.append(first[1:], len(row)) - 1
    return row[first], grams[anchor[first]].view(np.int64), window[first] - offsets[row[first]], last - first


def merge_runs(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs joined where they overlap or touch."""
    if not len(doc):
        return doc, start, size
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]
    row = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    lift = np.int64(1) << 40
    reach = np.maximum.accumulate(end + row * lift) - row * lift
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
    at = np.flatnonzero(fresh)
    ends = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[ends] - start[at]


def _first_stage(length: int):
    @shared.lean
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for i, _, data, at in slices(*utf8(batch.column("text"))):
                row, anchor, first, more = segments(data, at, length)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor), "doc_id": pa.array(ids[i + row]), "meta": pa.array(first << 8 | more)})

    return work


def _slice_stage(length: int):
    """A document's asked-for windows as strings: windows in a row with one home, ``PIECE`` at most."""

    @shared.lean
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            held = 0
            for i in range(batch.num_rows):  # a text at a time
                raw, doc, asked = batch.column("text")[i].as_py().encode(), batch.column("doc_id")[i].as_py(), batch.column("asked")[i].values
                home, meta = (asked.field(k).to_numpy() for k in ("home", "meta"))
                order = np.argsort(meta)
                home, first, last = home[order], meta[order] >> 8, (meta[order] >> 8) + (meta[order] & 0xFF)
                new = np.append(True, (home[1:] != home[:-1]) | (first[1:] != last[:-1] + 1))
                begin = np.flatnonzero(new)
                for h, a, b in zip(home[begin].tolist(), first[begin].tolist(), last[np.append(begin[1:], len(home)) - 1].tolist(), strict=True):
                    for x in range(a, b + 1, PIECE):
                        part = raw[x : min(b, x + PIECE - 1) + length]
                        for column, value in zip(out, (h, doc, x, part), strict=True):
                            column.append(value)
                        held += len(part)
                if held >= 2 << 20:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["home", "doc_id", "start", "bytes"])
                    out, held = ([], [], [], []), 0
            if held:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["home", "doc_id", "start", "bytes"])

    return work


def shard_repeats(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place in the strings, which come in (doc_id, start) order and have an end each: its string, its place there, and 2 where a window starts, 3 where that is not the first of its kind."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0  # a string's end is below all bytes
    array = suffix_array(text)
    prefix = permuted_prefixes(text, array, length)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    within = np.arange(len(text)) - (ends - sizes)[owner]
    window = (sizes + 1)[owner] - within > length
    array = array[window[array]]
    mark = np.where(window, 2, 0).astype(np.int8)
    if len(array):
        kinds = np.flatnonzero(np.append(True, prefix[array[1:]] < length))
        mark[array] = 3
        mark[np.minimum.reduceat(array, kinds)] = 2
    return owner, within, mark


def _stretches(mask: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the stretches of marked places of one owner."""
    at = np.flatnonzero(mask)
    new = np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))[: len(at)]
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1] if len(at) else at


def _shard_stage(length: int):
    """Over rows sorted by home and shard: the strings of whole groups, joined to about ``SHARD`` bytes, sorted, and what they repeat."""

    @shared.lean
    def work(batches: Iterator[pa.RecordBatch]):
        group: list[tuple] = []
        ready: list[tuple] = []  # home, whether it is dealt over several shards, doc, start, bytes
        copies: list[tuple[int, int, int]] = []  # doc, start, size of strings that repeat another
        size = {"group": 0, "ready": 0}
        current = None

        def flush():
            ready.sort(key=lambda x: x[2:4])
            home, several, doc, start, strings = zip(*ready, strict=True)
            home, several, doc, start = np.array(home, np.int64), np.array(several, bool), np.array(doc, np.int64), np.array(start, np.int64)
            owner, within, mark = shard_repeats(strings, length)
            first, last = _stretches(mark == 3, owner)
            own = owner[first]
            more = np.array(copies, np.int64).reshape(-1, 3).T
            d, a, n = merge_runs(*(np.concatenate(x) for x in zip((doc[own], start[own] + within[first], last - first + length), more, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(d), pa.int64()), pa.array(d), pa.array(a), pa.array(n), pa.nulls(len(d), pa.binary())], ["home", "doc_id", "start", "size", "bytes"])
            if several.any():
                first, last = _stretches((mark == 2) & several[owner], owner)
                own = owner[first]
                parts = [strings[k][x : x + n + length] for k, x, n in zip(own.tolist(), within[first].tolist(), (last - first).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(home[own]), pa.array(doc[own]), pa.array(start[own] + within[first]), pa.nulls(len(own), pa.int64()), pa.array(parts, pa.binary())], ["home", "doc_id", "start", "size", "bytes"])
            ready.clear()
            copies.clear()
            size["ready"] = 0

        def close():
            if len(group) > 1:  # of equal strings the first is sorted, the others repeat it
                group.sort(key=lambda x: x[2:4])
                first: dict[bytes, int] = {}
                for k, x in enumerate(group):
                    if first.setdefault(x[4], k) != k:
                        copies.append((x[2], x[3], len(x[4])))
                group[:] = [group[k] for k in first.values()]
                size["group"] = sum(len(x[4]) + 1 for x in group)
            ready.extend(group)
            size["ready"] += size["group"]
            group.clear()
            size["group"] = 0

        for batch in few_rows(batches):
            for home, shards, shard, *rest in zip(*(batch.column(c).to_pylist() for c in ("home", "shards", "shard", "doc_id", "start", "bytes")), strict=True):
                if (home, shard) != current:
                    close()
                    current = home, shard
                    if size["ready"] >= SHARD:
                        yield from flush()
                group.append((home, shards > 1, *rest))
                size["group"] += len(rest[-1]) + 1
        close()
        if ready:
            yield from flush()

    return work


def _anchor_stage(length: int):
    """Strings as strings of their windows in a row with one anchor, which is the home of each."""

    @shared.lean
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in few_rows(batches):
            docs, starts = (batch.column(c).to_numpy() for c in ("doc_id", "start"))
            for i, _, data, at in slices(*utf8(batch.column("bytes").cast(pa.large_binary()).view(pa.large_string()))):
                row, anchor, first, more = segments(data, at, length)
                begin = at[row] + first
                parts = [data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + more + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(docs[i + row]), pa.array(starts[i + row] + first), pa.array(parts, pa.binary())], ["home", "doc_id", "start", "bytes"])

    return work


def _digests(left: DataFrame, length: int) -> DataFrame:
    """(doc_id, meta) of the windows that an earlier equal one stands for, window by window."""

    @shared.lean
    def work(batches: Iterator[pa.RecordBatch]):
        digests: list[bytes] = []
        places: list[tuple[np.ndarray, np.ndarray]] = []

        def give():
            docs, starts = (np.concatenate(x) for x in zip(*places, strict=True))
            out = pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "doc_id": pa.array(docs), "start": pa.array(starts)})
            digests.clear()
            places.clear()
            return out

        for batch in few_rows(batches):
            for doc, start, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "bytes")), strict=True):
                n = len(part) - length + 1
                digests.extend(hashlib.blake2b(part[i : i + length], digest_size=16).digest() for i in range(n))
                places.append((np.full(n, doc), start + np.arange(n)))
                if len(digests) >= 1 << 14:
                    yield give()
        if digests:
            yield give()

    windows = shared.settle(left.select("doc_id", "start", "bytes").mapInArrow(work, "digest binary, doc_id long, start long"), "windows")
    at = F.struct("doc_id", "start")
    first = shared.settle(windows.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "first-windows")
    return windows.join(first, "digest").where(at != F.col("first")).select("doc_id", (F.shiftleft("start", 31) + length).alias("meta"))


def named(column: str) -> Column:
    """A column whose name may hold anything."""
    return F.col("`" + column.replace("`", "``") + "`")


def _one_text_each(docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(doc_id, text) with one text for a doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    if repeated is None:
        return docs
    single = docs.join(repeated, "doc_id", "left_anti")
    return single.unionByName(docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def repeated_runs(docs: DataFrame, length: int = 100, repeated: DataFrame | None = None, home: int | None = None, shrink: float = 0.9) -> DataFrame:
    """(doc_id, meta) with a packed run each; runs of a document may overlap. ``repeated`` are the doc_ids of several rows, ``home`` the bytes of one home in a shard (``HOME``). Homes are dealt again while that leaves ``shrink`` of their bytes at most, then parted by their anchors and dealt once more."""
    home = home or HOME
    if not GRAM + 8 <= length < 256:
        raise ValueError("length must lie between 40 and 255")
    texts = _one_text_each(docs, repeated)
    found = shared.settle(texts.mapInArrow(_first_stage(length), SEGMENTS), "segments", compression="zstd")
    homes = found.groupBy("anchor").agg(F.min("doc_id").alias("home"), F.count("*").alias("n")).where("n > 1").select("anchor", "home")
    homes = shared.settle(homes, "homes", compression="zstd")
    asked = found.join(homes.hint("merge"), "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("home", "meta")).alias("asked"))  # bounded by the document's own length
    left = shared.settle(texts.join(asked.hint("merge"), "doc_id").mapInArrow(_slice_stage(length), PARTS), "strings", compression="zstd")
    runs = None
    before, parted = None, False
    while True:
        sizes = left.groupBy("home").agg(F.sum(F.octet_length("bytes")).alias("size")).where(F.col("size") > home)
        large = shared.settle(sizes.select("home", "size", F.ceil(F.col("size") / home).cast("long").alias("shards")), "large-homes")
        total = large.agg(F.sum("size")).first()[0] or 0
        if before is not None and total > shrink * before:
            stuck, left = left.join(large, "home", "left_semi"), left.join(large, "home", "left_anti")
            if not parted:  # equal windows have equal anchors
                left = shared.settle(left.unionByName(stuck.mapInArrow(_anchor_stage(length), PARTS)), "parted", compression="zstd")
                before, parted = None, True
                continue
            runs = runs.unionByName(_digests(stuck, length))
            large, total = large.limit(0), 0
        before = total
        shards = F.coalesce("shards", F.lit(1).cast("long"))
        dealt = left.join(large, "home", "left").select("home", shards.alias("shards"), F.pmod(F.xxhash64("doc_id", "start"), shards).alias("shard"), "doc_id", "start", "bytes")
        done = dealt.repartition("home", "shard").sortWithinPartitions("home", "shard").mapInArrow(_shard_stage(length), SHARDED)
        done = shared.settle(done, "suffix-runs", compression="zstd")
        some = done.where("bytes IS NULL").select("doc_id", (F.shiftleft("start", 31) + F.col("size")).alias("meta"))
        runs = some if runs is None else runs.unionByName(some)
        if not total:
            return runs
        left = done.where("bytes IS NOT NULL").select("home", "doc_id", "start", "bytes")


CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def cut_texts(docs: DataFrame, length: int = 100, with_text: bool = True, carry: tuple[str, ...] = (), home: int | None = None, shrink: float = 0.9) -> DataFrame:
    """doc_id and ``CUT`` of every row; ``text`` (if asked for) is what is left, without characters that lost a byte.

    Columns named in ``carry`` come along as a struct ``row``.
    """
    repeated = shared.repeated_ids(docs)
    runs = repeated_runs(docs, length, repeated, home, shrink).groupBy("doc_id").agg(F.collect_list("meta").alias("metas"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*map(named, carry)).alias("row") if carry else F.lit(0).alias("row"))
    joined = rows.join(runs.hint("merge"), "doc_id", "left")
    if repeated is not None:  # rows whose text is not the one that stands for the doc_id stay whole
        least = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("stands"))
        joined = joined.join(least, "doc_id", "left").withColumn("metas", F.when(F.col("stands").isNull() | (F.col("stands") == F.col("text")), F.col("metas"))).drop("stands")

    @shared.lean
    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                out = []
                for t, metas in zip(part.column("text").to_pylist(), part.column("metas").to_pylist(), strict=True):
                    raw = t.encode()
                    if not metas:
                        out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), t))
                        continue
                    start, size = unpack_run(np.array(metas, np.int64))
                    _, start, size = merge_runs(np.zeros(len(start), np.int64), start, size)
                    edges = [0, *np.stack((start, start + size), 1).reshape(-1).tolist(), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
                keep = 5 if with_text else 4
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays[:keep], part.column("row")], ["doc_id", *names[:keep], "row"])

    schema = StructType.fromDDL("doc_id long, " + (CUT if with_text else CUT.removesuffix(", text string"))).add(rows.schema["row"])
    out = joined.select("doc_id", "text", "metas", "row").mapInArrow(cut, schema)
    return out if carry else out.drop("row")


def cut_documents(docs: DataFrame, length: int = 100, home: int | None = None, shrink: float = 0.9) -> DataFrame:
    """``docs`` with its columns as they are, but for ``text`` and ``n_chars``, which are of what is left. Rows whose text is used up stay, empty."""
    other = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    cut = cut_texts(docs, length, True, other, home, shrink)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings."""
    return cut_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
