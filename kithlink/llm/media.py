"""ISO base media columns: write, walk and describe containers without decoding their payloads.

``mux`` stores bytes as 8-bit samples of one track: ``ftyp``, ``moov`` (the sample tables) and ``mdat``. ``describe``
walks the nested boxes of any such container, decodes its sample tables (stts, stsc, stsz, stco or co64, stss) and
gives codec, duration and the byte ranges of the key frames; a range is arithmetic on the tables, so no payload byte
is looked at. ``payload`` joins the sample ranges.

``store_texts`` and ``media_features`` are the column forms. Null text is empty text; equal texts give equal bytes
(no clock, no identifier inside); repeated rows stay; very long texts are one container each. Bytes that are no container, boxes
nested however deep and tables that state more than the file holds give an error text in ``feature`` and null elsewhere; an empty
table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm import shared

SAMPLE = 64
RATE = 8000
KEY_EVERY = 16
PER_CHUNK = 64
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < (1 << 32) - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(data: bytes) -> bytes:
    """``data`` (a multiple of 64 bytes) as samples of 64 bytes; every 16th sample is a sync sample."""
    n = len(data) // SAMPLE
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks = -(-n // PER_CHUNK)
    groups = [(1, PER_CHUNK, 1)] if n >= PER_CHUNK else []
    if n % PER_CHUNK:
        groups.append((chunks, n % PER_CHUNK, 1))
    sync = np.arange(1, n + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * PER_CHUNK * SAMPLE
        wide = len(offsets) and int(offsets[-1]) >= 1 << 32
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(groups)), *(struct.pack(">III", *g) for g in groups)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * SAMPLE & 0xFFFFFFFF, 0x55C4, 0))
        mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * SAMPLE & 0xFFFFFFFF), bytes(8), struct.pack(">hhHH", 0, 0, 0x100, 0), unity, bytes(8), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n * SAMPLE & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    head = len(ftyp) + len(moov(0)) + (8 if len(data) < (1 << 32) - 8 else 16)
    return ftyp + moov(head) + box(b"mdat", data)


@dataclass
class Track:
    codec: str = ""
    kind: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict = field(default_factory=dict)

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """(offset, size) of every sample."""
        sizes, chunks, groups = self.tables.get("sizes", np.empty(0, np.int64)), self.tables.get("chunks", np.empty(0, np.int64)), self.tables.get("groups", np.empty((0, 3), np.int64))
        if not len(sizes) or not len(chunks) or not len(groups):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        spans = np.diff(np.append(groups[:, 0], len(chunks) + 1))
        if (spans < 0).any() or groups[0, 0] != 1:
            raise ValueError("the chunk groups are out of order")
        per = np.minimum(np.repeat(groups[:, 1], spans), len(sizes))
        upto = np.minimum(np.cumsum(per), len(sizes))  # no chunk holds samples beyond the last
        per = np.diff(np.append(0, upto))
        chunk = np.repeat(np.arange(len(chunks)), per)
        sizes = sizes[: len(chunk)]
        if not len(sizes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        upto = np.cumsum(sizes) - sizes
        first = np.searchsorted(chunk, np.arange(len(chunks)))
        return chunks[chunk] + upto - upto[np.minimum(first, len(sizes) - 1)][chunk], sizes

    def key_ranges(self) -> list[tuple[int, int]]:
        offsets, sizes = self.ranges()
        sync = self.tables.get("sync")
        if sync is not None:  # no table: every sample is a sync sample
            sync = sync[(sync >= 1) & (sync <= len(sizes))] - 1
            offsets, sizes = offsets[sync], sizes[sync]
        return list(zip(offsets.tolist(), sizes.tolist(), strict=True))


def boxes(blob: bytes, at: int, end: int):
    """(kind, body start, body end) of the boxes in a range."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", blob, at)
        body = at + 8
        if size == 1:
            (size,), body = struct.unpack_from(">Q", blob, at + 8), at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} does not fit")
        yield kind, body, at + size
        at += size
    if at != end:
        raise ValueError(f"{end - at} bytes after the last box")


def walk(blob: bytes) -> list[Track]:
    """The tracks of a container. Open containers wait on a stack of their own, so depth costs no recursion."""
    tracks: list[Track] = []

    def table(at: int, end: int, kind: str, width: int = 1) -> np.ndarray:
        (n,) = struct.unpack_from(">I", blob, at + 4)
        if n * width * np.dtype(kind).itemsize > end - at - 8:
            raise ValueError("a table states more entries than its box holds")
        return np.frombuffer(blob, kind, n * width, at + 8).astype(np.int64)

    open_boxes = [boxes(blob, 0, len(blob))]
    while open_boxes:
        found = next(open_boxes[-1], None)
        if found is None:
            open_boxes.pop()
            continue
        kind, a, b = found
        if kind == b"trak":
            tracks.append(Track())
        if kind in CONTAINERS:
            open_boxes.append(boxes(blob, a, b))
        elif not tracks:
            continue
        elif kind == b"mdhd":
            form = ">IIII" if blob[a] == 0 else ">QQIQ"
            _, _, tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(form, blob, a + 4)
        elif kind == b"hdlr":
            tracks[-1].kind = blob[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd":
            tracks[-1].codec = blob[a + 12 : a + 16].decode("latin-1")
        elif kind == b"stts":
            tracks[-1].tables["times"] = table(a, b, ">u4", 2).reshape(-1, 2)
        elif kind == b"stss":
            tracks[-1].tables["sync"] = table(a, b, ">u4")
        elif kind == b"stsc":
            tracks[-1].tables["groups"] = table(a, b, ">u4", 3).reshape(-1, 3)
        elif kind == b"stsz":
            each, n = struct.unpack_from(">II", blob, a + 4)
            if each and n * each > len(blob) or not each and 4 * n > b - a - 12:
                raise ValueError("more samples are stated than the file holds")
            tracks[-1].tables["sizes"] = np.full(n, each, np.int64) if each else np.frombuffer(blob, ">u4", n, a + 12).astype(np.int64)
        elif kind in (b"stco", b"co64"):
            tracks[-1].tables["chunks"] = table(a, b, ">u4" if kind == b"stco" else ">u8")
    return tracks


def payload(blob: bytes, track: Track) -> bytes:
    """The track's sample bytes in order."""
    offsets, sizes = track.ranges()
    if not len(sizes):
        return b""
    if offsets.min() < 0 or (offsets + sizes).max() > len(blob):
        raise ValueError("a sample lies outside of the file")
    fresh = np.append(True, offsets[1:] != offsets[:-1] + sizes[:-1])
    first = np.flatnonzero(fresh)
    ends = np.append(first[1:], len(sizes)) - 1
    return b"".join(blob[a:b] for a, b in zip(offsets[first].tolist(), (offsets[ends] + sizes[ends]).tolist(), strict=True))


def describe(blob: bytes) -> dict:
    """Codec, duration and key frame ranges of the first track."""
    tracks = walk(blob)
    if not tracks:
        raise ValueError("no track")
    t = tracks[0]
    times = t.tables.get("times", np.empty((0, 2), np.int64))
    keys = t.key_ranges()
    return {"codec": t.codec.strip(), "kind": t.kind, "duration_s": t.duration / t.timescale if t.timescale else 0.0, "n_samples": int(times[:, 0].sum()), "keyframes": keys, "track": t}


def feature(d: dict) -> str:
    """One line: codec, handler, seconds, samples, key frames, their first and last range, and a checksum of all ranges."""
    keys = d["keyframes"]
    ranges = ",".join(f"{a}+{n}" for a, n in keys)
    shown = "" if not keys else f"{keys[0][0]}+{keys[0][1]}..{keys[-1][0]}+{keys[-1][1]}"
    return f"{d['codec']}/{d['kind']} {d['duration_s']:.6f}s samples={d['n_samples']} keys={len(keys)} {shown} ranges={zlib.crc32(ranges.encode()):08x}"


def padded(data: bytes) -> bytes:
    """Zeros appended up to a positive multiple of 64."""
    return data + bytes(max(SAMPLE, -(-len(data) // SAMPLE) * SAMPLE) - len(data))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text in a container of its own, written to the shared folder."""

    def write(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                data = [(t or "").encode() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array([len(x) for x in data], pa.int64()), "media": pa.array([mux(padded(x)) for x in data], pa.binary())})

    return shared.settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset: long, size: long>>"


def media_features(media: DataFrame) -> DataFrame:
    """``FEATURES`` of a table (doc_id, n_bytes, media)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))]
    names = [c.strip().split()[0] for c in FEATURES.split("keyframes")[0].split(",")[:-1]] + ["keyframes"]

    def row(doc, n, blob):
        if blob is None:
            return (doc, n, *[None] * 5, "error: no bytes", None, None, None)
        try:
            d = describe(blob)
            data = payload(blob, d["track"])
        except (ValueError, IndexError, struct.error) as e:
            return (doc, n, None, None, None, len(blob), hashlib.sha256(blob).hexdigest(), f"error: {e}", None, None, None)
        keys = [{"offset": a, "size": s} for a, s in d["keyframes"]]
        return (doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-SAMPLE:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(d), d["codec"], d["duration_s"], keys)

    def read(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = [row(*x) for x in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text through a container in storage and back."""
    kept = [c.split()[0] for c in FEATURES.split(", codec")[0].split(", ")]
    return media_features(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select(*kept, "codec", "duration_s", "keyframes")
