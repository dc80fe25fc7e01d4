from __future__ import annotations

import random
import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from kithlink.llm import packing, token_files, tokens
from tests.llm.helpers import frame, nasty_rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def want(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def thue_morse(n):
    """Two words of n letters whose polynomial hashes agree for any odd base modulo a power of two."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def test_ids_are_the_library_s(library):
    rng = random.Random(1)
    texts = ["", " ", "  x", " \n x", "it's don't we'll'd x'sy 's", "''s", "x\n\n\ny", "½ ² x²y __a_b", "　 y", "'S", "<|endoftext|>", "\0a\0", "😀 😀x"]
    texts += ["".join(rng.choice("ab 's\n\t' .,1²é日  llred") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> x", *thue_morse(1024), *thue_morse(2048), "ab" * 500_000]
    encoder = tokens.Encoder(tokens.default_path(), memo=300)  # forgets on the way
    found = [encoder.encode(texts[i : i + 500]) for i in range(0, len(texts), 500)]
    ids, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    ends = np.cumsum(counts)
    for t, e, n in zip(texts, ends.tolist(), counts.tolist(), strict=True):
        assert ids[e - n : e].tolist() == want(library, t), t


def test_hashes_only_propose(library, monkeypatch):
    """With a hash that most pre-tokens share, ids stay the library's."""
    monkeypatch.setattr(tokens, "chained", lambda data, start, end, seed=0: ((end - start) % 3).astype(np.uint64))
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(40)) for _ in range(30)]
    encoder = tokens.Encoder(tokens.default_path())
    for some in (texts[:15], texts[15:], texts):
        ids, counts = encoder.encode(some)
        assert ids.tolist() == [i for t in some for i in want(library, t)] and counts.tolist() == [len(want(library, t)) for t in some]


def test_added_tokens_as_text():
    plain = Tokenizer.from_file(tokens.default_path())
    plain.encode_special_tokens = True
    ids, counts = tokens.Encoder(tokens.default_path(), special_as_text=True).encode(["a<|endoftext|>b", "c"])
    assert ids.tolist() == plain.encode("a<|endoftext|>b", add_special_tokens=False).ids + plain.encode("c", add_special_tokens=False).ids and counts.sum() == len(ids)


def test_any_token_can_be_addressed():
    rng = np.random.default_rng(2)
    ids = np.concatenate((rng.integers(0, 300, 3000), rng.integers(0, 1 << 24, 3000), [0, 255, 256, 65535, 65536])).astype(np.uint32)
    f = token_files.TokenFile.of(token_files.pack(ids, np.array([4, 9]), np.array([0, 2500])))
    assert f.ids().tolist() == ids.tolist()
    assert [f.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    assert f.document(0) == ids[:2500].tolist() and f.document(1) == ids[2500:].tolist()
    empty = token_files.TokenFile.of(token_files.pack(np.empty(0, np.uint32), np.empty(0), np.empty(0)))
    assert empty.ids().tolist() == []
    with pytest.raises(IndexError):
        empty.token(0)


def test_a_token_costs_a_few_bytes(tmp_path):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_257, 200_000).astype(np.uint32)
    (tmp_path / "f.dac").write_bytes(token_files.pack(ids, np.arange(2), np.array([0, 150_000])))
    f = token_files.TokenFile.open(f"file://{tmp_path}/f.dac")
    read, sizes = f._read, []
    f._read = lambda at, size: sizes.append(size) or read(at, size)
    for i in (0, 77, 149_999, 199_999):
        assert f.token(i) == ids[i]
    assert sum(sizes) < 4 * 2 * (1 + 64 + 8)
    assert f.document(1)[-3:] == ids[-3:].tolist()


def test_extreme_ids_are_not_null(spark):
    rows = [(-(1 << 63), "least", None, None, None, None), (None, "none", None, None, None, None), ((1 << 63) - 1, "most", None, None, None, None), (0, "zero", None, None, None, None)]
    got = token_files.read_token_files(token_files.write_token_files(frame(spark, rows))).orderBy("start").collect()
    assert [g.doc_id for g in got] == [None, -(1 << 63), 0, (1 << 63) - 1]


def test_token_files(spark, library):
    rows = [*nasty_rows(), *((500 + i, w, None, None, None, None) for i, w in enumerate(thue_morse(1024)))]
    got = token_files.read_token_files(token_files.write_token_files(frame(spark, rows), most=1000)).orderBy("start").collect()
    assert len(got) == len(rows)
    at, keyed = 0, sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in rows)
    assert [(-1 if g.doc_id is None else g.doc_id) for g in got] == [k for k, _ in keyed]
    for g in got:
        assert g.start == at
        at += g.n_tokens
    expected = sorted((k, len(want(library, t)) + 1, crc([*want(library, t), 2])) for k, t in keyed)
    assert sorted(((-1 if g.doc_id is None else g.doc_id), g.n_tokens, g.ids_crc32) for g in got) == expected
    assert token_files.read_token_files(token_files.write_token_files(frame(spark, []))).count() == 0


def test_packing(spark, library):
    rows = [r for r in nasty_rows() if r[0] is not None]
    rows = [*{r[0]: r for r in rows}.values(), *((500 + i, w, None, None, None, None) for i, w in enumerate(thue_morse(1024)))]
    pieces = packing.pack_tokens(frame(spark, rows).repartition(3), window=64).collect()
    by_sequence: dict = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert crc(p.ids) == p.ids_crc32 and len(p.ids) == p.length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, ps in by_sequence.items():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(x.length for x in ps[:i]) for i in range(len(ps))]
        assert sum(p.length for p in ps) == 64 or k == max(by_sequence)
    for r in rows:
        own = sorted((p for p in pieces if p.doc_id == r[0]), key=lambda p: p.start)
        ids = [*want(library, r[1]), 1]
        assert [i for p in own for i in p.ids] == ids and {p.doc_tokens for p in own} == {len(ids)}
        assert [p.start for p in own] == [sum(p.length for p in own[:i]) for i in range(len(own))]
    assert packing.pack_tokens(frame(spark, [])).count() == 0
