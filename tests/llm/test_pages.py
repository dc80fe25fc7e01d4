from __future__ import annotations

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter
from html import unescape

import pyarrow.parquet as pq
import pytest

from kithlink.llm import html_text, media, warc
from tests.llm.helpers import frame, nasty_rows

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1><nav>a b</nav></header>
<div class="cookie-notice">We use cookies on this site and you should accept them all right now please</div><article><h1>Title</h1><p>First &amp; foremost <b>bold</b>
text that goes on   for a while &lt;here&gt;.<br><p>Short.</p><div class="advert">Buy now</div><ul><li>one<li>two</ul><section id="comments"><p>I loved this one so much indeed.</p></section></article>
<aside>side text</aside><form>Sign up</form><footer>&copy; foot"""


def test_main_text():
    assert html_text.extract(PAGE) == "Title\n\nFirst & foremost bold text that goes on for a while <here>.\n\nShort.\n\none\n\ntwo"
    assert [html_text.extract(x) for x in (None, "", "<div>", "plain", "<p>just text")] == ["", "", "", "plain", "just text"]
    plain = "<body><div class=nav>a b</div><div><p>" + "long text here. " * 20 + "</p><p>" + "more words " * 30 + "</p></div><div class=footer>x</div>"
    assert html_text.extract(plain).count("long text") == 20 and "a b" not in html_text.extract(plain)
    bare = "<body><ul><li><a href=x>a</a><li><a href=y>b</a></ul><div id=x1><h1>Head</h1><p>" + "long text here. " * 20 + "</p><p>Short.</p><p>" + "more words " * 30 + "</p></div><div>&copy; 2020</div></body>"
    assert html_text.extract(bare).startswith("Head\n\nlong") and "Short." in html_text.extract(bare) and "2020" not in html_text.extract(bare)


def article(page):
    """The article's blocks, read by the page's own mark of it."""
    inner = re.search(r"<article>(.*?)(</article>|<footer|$)", page, re.DOTALL).group(1)
    blocks = re.split(r"</?(?:h1|p|article)>", inner.replace("<br>", " "))
    texts = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def overlap(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_region_comes_from_ratios():
    """All pages of sf0.1: exact with and without the article's tag; with no telling tag or class at all, ratios and smoothing still find it."""
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    truth = [article(p) for p in pages]
    renamed = [re.sub(r"<(/?)article>", r"<\1div>", p) for p in pages]
    bare = [re.sub(r"<(/?)(article|nav|footer|ul)>", r"<\1div>", p.replace(' class="ad"', "")).replace("<li>", "<p>").replace("</li>", "</p>") for p in pages]
    assert [html_text.extract(p) for p in pages] == truth
    assert [html_text.extract(p) for p in renamed] == truth

    def found(**how):
        return sum(overlap(html_text.extract(p, **how), t) for p, t in zip(bare, truth, strict=True)) / len(truth)

    whole, raw, unclustered = found(), found(sigma=0), found(clustered=False)
    assert whole > 0.975 and whole > raw + 0.003 and whole > unclustered + 0.03
    assert sum(html_text.extract(p) == t for p, t in zip(bare, truth, strict=True)) > 0.85 * len(truth)
    assert not any(html_text.extract(p, clustered=False) == t for p, t in zip(bare, truth, strict=True))


@pytest.mark.parametrize("broken", ["<p>a<![foo[ b</p>", "<div>x y" * 100_000, "<!-- " * 100_000, "<a " * 100_000, "<" * 100_000, "<!-- a>" * 50_000, "<![CDATA[" * 50_000, "<td><table>" + "<div>" * 50_000 + "<td></td>" * 50_000, "</section>" * 50_000 + "<div>" * 50_000 + "</p>" * 50_000, "word " * 400_000])
def test_broken_and_long_pages_end_soon(broken):
    began = time.time()
    html_text.extract(broken)
    assert time.time() - began < 10


def test_clutter_words_beside_article_words():
    body = "<p>" + "long text here. " * 20 + "</p><p>" + "more words " * 30 + "</p>"
    for mark in ("entry-content no-sidebar", "post has-comments", "content with-share"):
        assert "long text" in html_text.extract(f"<body><nav>a b</nav><div class='{mark}'>{body}</div></body>"), mark
    assert html_text.extract(f"<body><div class='comments'>{body}</div></body>") == ""
    rng = random.Random(5)
    pieces = ["<", ">", "!", "[", "-", "--", "p", "div", " ", "=", '"', "'", "/", "&", "#", "x", "CDATA[", "]]>", "script", "?", "a", "li", "table", "tr", "td"]
    for _ in range(3000):
        html_text.extract("".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))))


def test_pages_column(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "", 5)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: (r.n_chars, len(r.text)) for r in html_text.extract_pages(pages).collect()}
    assert got[2] == (0, 0) and got[None] == (0, 0) and got[1][0] == got[1][1] > 50
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_normaliser_keeps_records():
    records = [warc.record("response", i, f"http://x/{i}", p, hashlib.sha1(p).hexdigest(), len(p)) for i, p in enumerate([b"", b"abc" * 1000, "é".encode()])]
    blob = packed(b"".join(records))
    members, index = zip(*warc.rewrite(iter([blob])), strict=True)
    joined = b"".join(members)
    assert [zlib.decompress(joined[x["offset"] : x["offset"] + x["length"]], 31) for x in index] == records
    assert list(warc.split_stream(iter([b"".join(records)[i : i + 7] for i in range(0, sum(map(len, records)), 7)]))) == records
    for broken in (blob[:-9], packed(b"".join(records)[:-5]), packed(b"WARC/1.1\r\nno length\r\n\r\n"), packed(b"x" * (3 << 20)), blob[:40] + b"\0\1\2" + blob[43:]):
        with pytest.raises(ValueError):
            list(warc.rewrite(iter([broken])))


def packed(raw):
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def test_streams_of_several_members_and_high_ratio():
    records = [warc.record("response", i, f"http://x/{i}", p, hashlib.sha1(p).hexdigest(), len(p)) for i, p in enumerate([b"", b"abc" * 1000, bytes(40 << 20)])]
    whole = packed(records[0]) + packed(records[1]) + b"\0" * 512 + packed(records[2])
    for size in (1000, 1 << 20):
        chunks = [whole[i : i + size] for i in range(0, len(whole), size)]
        assert sum(map(len, warc.inflate(iter(chunks)))) == sum(map(len, records))
        assert max(map(len, warc.inflate(iter(chunks)))) <= warc.PIECE
        assert [zlib.decompress(m, 31) for m, _ in warc.rewrite(iter(chunks))] == records
    assert list(warc.inflate(iter([]))) == [] == list(warc.rewrite(iter([b""])))


def test_foreign_and_damaged_archives(spark, tmp_path):
    """Records of other writers are kept without a page_id; of a cut-off archive what stands before the cut is kept."""
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    page = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(packed(info) + packed(page))
    (tmp_path / "b.warc.gz").write_bytes((packed(info) + packed(page))[:-4])
    made = warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz",) for n in "ab"], "path string"))
    assert sorted((r.n_records, r.error is None) for r in made.collect()) == [(1, False), (2, True)] or sorted((r.n_records, r.error is None) for r in made.collect()) == [(2, False), (2, True)]
    got = [r for r in warc.read_archives(made).collect() if r.record_type == "response"]
    assert got[0].page_id is None and got[0].payload_bytes == 2 and got[0].payload_digest == hashlib.sha1(b"hi").hexdigest() and got[0].error


def test_archives(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "u", big), (2, "v", big), (3, "w", "small"), (4, "w", "small"), (5, None, None), (None, "n", big), (2, "v", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int")
    got = warc.read_archives(warc.normalise(warc.write_archives(warc.mark_revisits(pages), most=3000))).collect()
    kinds = sorted((g.page_id or -1, g.payload_bytes, g.record_type, g.refers_to) for g in got)
    n = len(big)
    assert kinds == [(-1, n, "revisit", 2), (1, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None)]
    assert {g.payload_digest for g in got if g.payload_bytes == n} == {hashlib.sha1(big.encode()).hexdigest()}
    assert warc.read_archives(warc.normalise(warc.write_archives(warc.mark_revisits(pages.limit(0))))).count() == 0


def test_containers_round_trip():
    for size in (0, 1, 64, 65, 4096, 5000, 100_000):
        data = bytes(i * 7 % 256 for i in range(size))
        blob = media.mux(media.padded(data))
        d = media.describe(blob)
        assert media.payload(blob, d["track"]) == media.padded(data)
        assert d["codec"] == "raw" and d["duration_s"] == len(media.padded(data)) / 8000
        keys = d["keyframes"]
        assert len(keys) == -(-len(media.padded(data)) // 64 // 16) or len(keys) == -(-(len(media.padded(data)) // 64) // 16)
        assert all(blob[a : a + n] == media.padded(data)[i * 1024 : i * 1024 + 64] for i, (a, n) in enumerate(keys))
    for bad in (b"", b"abc", media.mux(bytes(64))[:-5]):
        with pytest.raises(ValueError):
            media.describe(bad)


def nested(depth):
    out = b""
    for _ in range(depth):
        out = media.box(b"moov", out)
    return out


def test_containers_that_state_too_much(spark):
    good = media.mux(bytes(64 * 200))
    huge = good[: good.index(b"stsz") + 12] + b"\xff\xff\xff\xff" + good[good.index(b"stsz") + 16 :]
    groups = good.index(b"stsc") + 12
    many = good[: groups + 4] + b"\xff\xff\xff\xff" + good[groups + 8 :]
    chunk = good.index(b"stco") + 12
    outside = good[:chunk] + b"\xff\xff\xff\xff" + good[chunk + 4 :]
    short = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"mdhd"))))
    bad = [nested(3000), huge, outside, short, good[:chunk] + good[chunk + 4 :], b"\0\0\0\1mdat" + b"\xff" * 8]
    rows = spark.createDataFrame([(i, 0, bytearray(b)) for i, b in enumerate([*bad, many])], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.media_features(rows).collect()}
    assert all(got[i].feature.startswith("error") and got[i].payload_bytes is None for i in range(len(bad)))
    assert not got[len(bad)].feature.startswith("error") or got[len(bad)].payload_bytes is None  # ends, whatever it says
    rng = random.Random(7)
    for _ in range(2000):
        torn = bytearray(good[:2000])
        for _ in range(rng.randint(1, 6)):
            torn[rng.randrange(len(torn))] = rng.randrange(256)
        try:
            media.payload(bytes(torn), media.describe(bytes(torn))["track"])
        except (ValueError, IndexError, struct.error):
            pass


def test_media_query_gives_key_ranges(spark):
    got = media.op9_media(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for g in got:
        blob = media.mux(media.padded(texts[g.doc_id]))
        assert hashlib.sha256(blob).hexdigest() == g.media_sha256 and len(blob) == g.media_bytes
        assert [blob[k.offset : k.offset + k.size] for k in g.keyframes] == [media.padded(texts[g.doc_id])[i : i + 64] for i in range(0, g.payload_bytes, 1024)]


def test_media_columns(spark):
    rows = nasty_rows()
    got = media.media_features(media.store_texts(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: (r[1] or "").encode() for r in rows if r[0] is not None}
    for g in got:
        if g.doc_id is not None:
            data = media.padded(by_id[g.doc_id])
            assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(by_id[g.doc_id]), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert len({g.media_sha256 for g in got if g.doc_id in (0, 1)}) == 1
    broken = spark.createDataFrame([(1, 3, bytearray(b"abc")), (2, None, None)], "doc_id long, n_bytes long, media binary")
    assert all(r.feature.startswith("error") for r in media.media_features(broken).collect())
