"""WARC archives: write whole-stream gzip, normalise to a member per record, index, read back.

``write_archives`` writes pages as archives that are one gzip stream each, as crawlers that compress a finished file
leave them. ``normalise`` inflates such a stream once, front to back, gives every record a gzip member of its own and
writes a sidecar index (offset, length, type, record id), so a record is one ranged read. It reads, inflates and writes piece by
piece, so a task holds one record and one piece however large the archive or its ratio is; files of several gzip members are
one stream. Of an archive that is cut off or damaged, the records before that place are kept and ``error`` says so.
``read_archives`` reads records through the index; records of other writers and kinds have no page_id, and one whose payload is not
what its header states has an ``error``.

Payloads of at least ``least`` bytes that occur more than once are stored once: by the page with the largest page_id;
the others are ``revisit`` records that name it. Nulls: a null html is an empty payload, a null url an empty target;
a page with a null page_id is never the one that others refer to. Rows that repeat that page_id are all responses.
Ties of the digest are settled by the largest page_id. Very long pages are records like others. An empty table makes no archive and
no row. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm import shared

DATE = "2024-01-01T00:00:00Z"
#: Bytes read, inflated or written at once, and the longest record header.
PIECE = 1 << 20
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, record_offset long, record_length long, error string"


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str):
    """The page_id of a record that this module wrote."""
    inner = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if urn.startswith("<urn:page:") and inner.lstrip("-").isdigit() else None


def record(kind: str, page_id, url: str, payload: bytes, digest: str, n: int, refers_to=None) -> bytes:
    """One WARC/1.1 record."""
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: {sha1}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("a record's end is missing")
    return headers, rest[:n]


def split_stream(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, holding no more than one record and one chunk."""
    held = bytearray()
    need = -1
    for chunk in chunks:
        held += chunk
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n", 0, PIECE)
                if end < 0:
                    if len(held) >= PIECE:
                        raise ValueError("a record's header does not end")
                    break
                length = [x for x in bytes(held[:end]).lower().split(b"\r\n") if x.startswith(b"content-length:")]
                if not length or not length[0].split(b":")[1].strip().isdigit():
                    raise ValueError("a record has no length")
                need = end + 4 + int(length[0].split(b":")[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise ValueError("the stream ends inside a record")


def inflate(chunks: Iterator[bytes], most: int = PIECE) -> Iterator[bytes]:
    """The stream's bytes, inflated once from front to back, at most ``most`` at a time; members follow each other."""
    z = None
    for data in chunks:
        while True:
            if z is None:
                data = data.lstrip(b"\0")  # zeros may pad a member
                if not data:
                    break
                z = zlib.decompressobj(31)
            try:
                part = z.decompress(data, most)
            except zlib.error as e:
                raise ValueError(f"the gzip stream is damaged: {e}") from e
            if part:
                yield part
            if z.eof:
                data, z = z.unused_data, None
            else:
                data = z.unconsumed_tail
                if not data and len(part) < most:
                    break
    if z is not None:
        raise ValueError("the gzip stream is cut off")


def rewrite(chunks: Iterator[bytes], level: int = 2) -> Iterator[tuple[bytes, dict]]:
    """(member, index entry) of each record of a monolithic archive, one after the other."""
    at = 0
    for raw in split_stream(inflate(chunks)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        headers, _ = parse(raw)
        yield member, {"offset": at, "length": len(member), "type": headers.get("warc-type", ""), "id": headers.get("warc-record-id", "")}
        at += len(member)


def mark_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages with payload_digest, payload_bytes, record_type, refers_to.

    The repeated digests are found by a pre-aggregated count and written, so the join with them is a broadcast while they are few and
    else one that adaptive execution splits at a hot digest.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"payload_digest": F.sha1(F.encode("html", "UTF-8")), "payload_bytes": F.octet_length("html").cast("long")})
    large = F.col("payload_bytes") >= least
    holders = p.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 AND holder IS NOT NULL")
    p = p.join(shared.settle(holders.drop("n"), "warc-holders"), "payload_digest", "left")
    again = large & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return p.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("holder")).alias("refers_to"))


def write_archives(marked: DataFrame, most: int = 1 << 26, level: int = 1) -> DataFrame:
    """Monolithic archives of at most about ``most`` inflated bytes: (path, n_records). Written as they are deflated."""
    folder = shared.work_dir(marked.sparkSession, "warc")

    def write(batches):
        seq, size, n, z, out, path = 0, 0, 0, None, None, ""

        def close():
            nonlocal seq, size, n, z
            out.write(z.flush())
            out.close()
            row = pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})
            seq, size, n, z = seq + 1, 0, 0, None
            return row

        for batch in batches:
            for page, url, html, digest, count, kind, refers in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                raw = record(kind, page, url.replace("\r", "").replace("\n", ""), html.encode(), digest, count, refers)
                if z is None:
                    path = f"{folder}/{shared.attempt_name('crawl', seq)}.warc.gz"
                    z, out = zlib.compressobj(level, zlib.DEFLATED, 31), shared.create_file(path)
                out.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= most:
                    yield close()
        if n:
            yield close()

    return shared.settle(marked.select(*COLUMNS).mapInArrow(write, "path string, n_records long"), "warc-manifest")


COLUMNS = ("page_id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite each monolithic archive (``path``) into the shared folder with a member per record and a sidecar index: (path, index, n_records, error)."""
    folder = shared.work_dir(archives.sparkSession, "warc-members")

    def work(batches):
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                stem, n, error = f"{folder}/{shared.attempt_name('n', k)}", 0, None
                with shared.create_file(f"{stem}.warc.gz") as members, shared.create_file(f"{stem}.index.jsonl") as index:
                    try:
                        for member, entry in rewrite(shared.pieces(path, PIECE)):
                            members.write(member)
                            index.write((json.dumps(entry) + "\n").encode())
                            n += 1
                    except ValueError as e:
                        error = f"{path}: {e}"
                yield pa.RecordBatch.from_pydict({"path": [f"{stem}.warc.gz"], "index": [f"{stem}.index.jsonl"], "n_records": pa.array([n], pa.int64()), "error": pa.array([error], pa.string())})

    spread = archives.repartition(max(1, archives.count()), "path")
    return shared.settle(spread.select("path").mapInArrow(work, "path string, index string, n_records long, error string"), "warc-normal")


def read_record(uri: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    fs, path = shared.filesystem(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return parse(zlib.decompress(f.read(length), 31))


def read_archives(archives: DataFrame) -> DataFrame:
    """``RECORDS`` of every record, read member by member through the sidecar indexes; digests are those of the payloads read."""

    def describe(path, x, headers, block):
        kind, error = headers.get("warc-type", ""), None
        http = headers.get("content-type", "").startswith("application/http")
        head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        label, _, code = headers.get("warc-payload-digest", "").partition(":")
        stated = base64.b32decode(code).hex() if label == "sha1" and len(code) == 32 else None
        n, found = len(body), hashlib.sha1(body).hexdigest()
        if kind == "revisit":  # the payload is elsewhere
            lengths = [h.split(b":")[1].strip() for h in head.split(b"\r\n") if h.lower().startswith(b"content-length:")]
            n, found = int(lengths[0]) if lengths and lengths[0].isdigit() else None, stated
        elif stated and stated != found:
            error = "the payload's digest differs"
        refers = page_of(headers.get("warc-refers-to", ""))
        return (page_of(headers.get("warc-record-id", "")), n, found, kind, refers, headers.get("warc-target-uri"), path, x["offset"], x["length"], error)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def read(batches):
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                fs, place = shared.filesystem(path)
                entries = [json.loads(x) for x in shared.read_file(index).splitlines()]
                rows = []
                with fs.open_input_file(place) as f:
                    for x in entries:
                        f.seek(x["offset"])
                        rows.append(describe(path, x, *parse(zlib.decompress(f.read(x["length"]), 31))))
                        if len(rows) == 5000 or x is entries[-1]:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []

    return archives.repartition(max(1, archives.count()), "path").select("path", "index").mapInArrow(read, RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record, normalised, and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = read_archives(normalise(write_archives(mark_revisits(pages))))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
SELECT p.page_id, octet_length(encode(coalesce(p.html, ''))) AS payload_bytes, sha1(coalesce(p.html, '')) AS payload_digest,
       CASE WHEN h.holder IS NOT NULL AND p.page_id <> h.holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN h.holder IS NOT NULL AND p.page_id <> h.holder THEN h.holder END AS refers_to
FROM pages p LEFT JOIN (
    SELECT coalesce(html, '') AS html, max(page_id) AS holder FROM pages
    WHERE octet_length(encode(coalesce(html, ''))) >= 1000 GROUP BY 1 HAVING count(*) > 1
) h ON coalesce(p.html, '') = h.html
"""
