"""Very long texts, with a copy of each, through every operator on documents; columns have the names that the operators work with."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from tokenizers import Tokenizer

from kithlink.llm import decontaminate, html_text, media, near_dups, packing, quality, suffix_dedup, token_files, tokens, toxicity, warc
from tests.llm.helpers import words

CLASHING = "doc_id long, text string, rep long, hub long, part long, band long, home long, score double, media binary, row string, metas string, ids string, label int, start long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    long = words(rng, 250_000)
    return {1: long, 2: long, 3: "same word " * 150_000, 4: "x" * 1_200_000, 5: "short text", 6: None, 7: long[600_000:601_000] + " tail"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, *[None] * 12) for d, t in texts.items()], CLASHING)


def test_tokens(docs, texts):
    library = Tokenizer.from_file(tokens.default_path())
    want = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in texts.items() if d != 4}
    found: dict = {}
    for p in sorted(packing.pack_tokens(docs).collect(), key=lambda p: (p.doc_id, p.start)):
        found.setdefault(p.doc_id, []).extend(p.ids)
    assert all(found[d] == [*ids, 1] for d, ids in want.items()) and len(found[4]) > 1000
    crc = {r.doc_id: r.ids_crc32 for r in token_files.read_token_files(token_files.write_token_files(docs)).collect()}
    assert all(crc[d] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*found[d][:-1], 2])) for d in texts)


def test_repeats(docs, texts):
    got = {r.doc_id: r for r in suffix_dedup.cut_texts(docs, with_text=False).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == got[2].n_bytes and got[7].n_removed >= 1000
    assert got[4].n_bytes - got[4].n_removed <= 1
    assert got[3].n_bytes - got[3].n_removed <= 10
    assert {d: r.n_bytes for d, r in got.items()} == {d: len((t or "").encode()) for d, t in texts.items()}


def test_near_copies(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
    assert got[2][1] == 1 and got[3] == (2, 3) and got[4] == (1, 4) and got[6] == (0, 6)


def test_classifiers(docs, spark):
    labels = spark.createDataFrame([(d, d % 2, d % 2) for d in range(1, 8)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels)).collect()}
        assert len(got) == 7 and all(0 <= s <= 1 for s in got.values())


def test_leaks(docs, spark, texts):
    inside = " ".join(texts[1].split()[200_000:200_040])
    bench = spark.createDataFrame([(1, inside), (2, "same word " * 30), (3, "x" * 1_200_000), (4, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 3), (5, 4)}


def test_containers(docs, texts):
    for r in media.media_features(media.store_texts(docs)).collect():
        data = media.padded((texts[r.doc_id] or "").encode())
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and len(r.keyframes) == -(-len(data) // 1024)


def test_pages(spark, texts):
    pages = spark.createDataFrame([(d, f"u{d}", t and f"<body><nav>a</nav><div><h1>T</h1><p>{t}</p><p>{t[:300]}</p></div></body>", 1, "x", 2) for d, t in texts.items()], "page_id long, url string, html string, holder int, error string, n int")
    kept = {r.page_id: r for r in warc.read_archives(warc.normalise(warc.write_archives(warc.mark_revisits(pages)))).collect()}
    assert kept[1].refers_to == 2 and kept[4].payload_bytes > 1_200_000 and not any(r.error for r in kept.values())
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert got[1] == got[2] and len(got[1]) > len(texts[1]) and got[6] == ""
