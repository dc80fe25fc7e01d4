from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from kithlink.llm import near_dups, shared, suffix_dedup, suffixes, tokens
from kithlink.llm.suffixes import permuted_prefixes, suffix_array
from tests.llm.helpers import frame, nasty_rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


@pytest.mark.parametrize("chunk", [512, 8])
def test_near_duplicates(spark, chunk):
    rng = random.Random(9)
    rows = [r for r in nasty_rows() if r[0] is not None]
    # a family in which links form chains, larger than a chunk
    text = words(rng, 150).split()
    for i in range(40):
        text[(7 * i) % 150] = f"new{i}"
        rows.append((200 + i, " ".join(text), None, None, None, None))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(frame(spark, rows), chunk=chunk).collect()}
    assert got == components(rows)


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_near_duplicates_of_adversarial_words(spark):
    """Words that a polynomial hash cannot tell apart share nothing; each set of a repeated doc_id is compared."""
    (a, b), text = thue_morse(4096), words(random.Random(1), 60)
    other = text.split()
    other[3] = "changed"
    rows = [(1, a), (2, b), (3, a + " x"), (4, b + " x"), (5, "quite another text"), (5, text), (8, " ".join(other))]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rep int, band int")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dups.near_duplicates(docs).collect()}
    assert got == {(1, 1): 1, (2, 1): 2, (3, 1): 3, (4, 1): 4, (5, 1): 5, (5, 56): 5, (8, 56): 5}


def test_near_duplicates_of_all_documents(spark):
    """All of sf0.01 against every pair of texts whose sizes allow a link; so no link was lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = {d: shingles(t) for d, t in rows}
    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    common = Counter(pair for ds in holders.values() if len(ds) > 1 for pair in combinations(sorted(ds), 2))
    linked = {p for p, n in common.items() if 100 * n >= 85 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in sorted(linked):
        a, b = root(x), root(y)
        parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs).collect()}
    assert got == {d: (len(s), root(d), root(d) == d) for d, s in sets.items()} and len(linked) > 50


def test_near_duplicates_of_nothing(spark):
    assert near_dups.near_duplicates(frame(spark, [])).count() == 0
    kept = near_dups.drop_near_duplicates(frame(spark, nasty_rows()))
    assert sum(r.doc_id is None for r in kept.collect()) == 2


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for trial in range(300):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 50))
        t = np.tile(t, 1 + trial % 4)
        array, s = suffix_array(t), t.tolist()
        assert array.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        prefix = permuted_prefixes(t, array, 6)
        for i, j in zip(array[1:].tolist(), array[:-1].tolist(), strict=True):
            k = next((k for k in range(len(s)) if s[i + k : i + k + 1] != s[j + k : j + k + 1] or i + k >= len(s) or j + k >= len(s)), 0)
            assert min(int(prefix[i]), 6) == min(k, 6)


def test_each_level_induces_once(monkeypatch):
    """Substrings of any length, of few and many symbols, are named by keys and not by inducing them as well."""
    rng, sizes, induce = np.random.default_rng(4), [], suffixes.induce
    monkeypatch.setattr(suffixes, "induce", lambda s, *rest: sizes.append(len(s)) or induce(s, *rest))
    for trial in range(120):
        t = np.tile(np.repeat(rng.integers(0, [2, 4, 300][trial % 3], 30), rng.integers(1, 25, 30)), 1 + trial % 4)
        sizes.clear()
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert len(sizes) == len(set(sizes))


def cut(rows, length=100, kept=None):
    """Per document: bytes, removed ones, runs, digest of the rest; the rest itself goes to ``kept``."""
    seen, out = set(), {}
    for d, text in sorted({(r[0], r[1] or "") for r in rows}):
        b = text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        if kept is not None:
            kept[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark):
    rows = nasty_rows()
    got = suffix_dedup.cut_texts(frame(spark, rows).repartition(3), with_text=False).collect()
    assert len(got) == len(rows)
    expected = cut([r for r in rows if r[0] is not None])
    for g in got:
        if g.doc_id is None:
            assert g.n_removed == 0
        else:
            assert tuple(g)[1:5] == expected[g.doc_id], g.doc_id
    assert suffix_dedup.cut_texts(frame(spark, [])).count() == 0


@pytest.mark.parametrize("home", [1 << 20, 20_000])
def test_suffix_dedup_of_all_documents(spark, monkeypatch, home):
    """All of sf0.01 by brute force, with whole homes and with homes dealt over shards."""
    monkeypatch.setattr(suffix_dedup, "HOME", home)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = cut([(r.doc_id, r.text) for r in docs.collect()])
    got = {g.doc_id: tuple(g)[1:5] for g in suffix_dedup.cut_texts(docs, with_text=False).collect()}
    assert got == expected


def test_one_passage_in_many_surroundings(spark, monkeypatch):
    """A home that dealing does not make smaller is settled window by window; names that clash or have dots do no harm."""
    monkeypatch.setattr(suffix_dedup, "HOME", 3000)
    rng = random.Random(8)
    passage = words(rng, 25)
    rows = [(i, words(rng, 9) + passage + words(rng, 9), "m") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").withColumnRenamed("mark", "me.ta`s")
    expected = cut([r[:2] for r in rows])
    out = suffix_dedup.cut_texts(docs.repartition(4), carry=("me.ta`s",)).collect()
    assert {g.doc_id: tuple(g)[1:5] for g in out} == expected and {g.row[0] for g in out} == {"m"}


def test_passages_that_first_stand_in_one_document(spark, monkeypatch):
    """Their home is large and dealing does not make it smaller, but that of each passage is small: none is settled window by window."""
    monkeypatch.setattr(suffix_dedup, "HOME", 12_000)
    monkeypatch.setattr(suffix_dedup, "_digests", lambda *_: pytest.fail("windows were grouped by digests"))
    rng = random.Random(12)
    passages = [words(rng, 25) for _ in range(40)]
    rows = [(0, " / ".join(passages))] + [(i, words(rng, 9) + passages[i % 40] + words(rng, 9)) for i in range(1, 400)]
    expected = cut(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {g.doc_id: tuple(g)[1:5] for g in suffix_dedup.cut_texts(docs, with_text=False).collect()} == expected


def test_workers_let_go_of_what_other_stages_left():
    """A stage begins without the token encoder of an earlier one, and neither then nor at its end holds memory that is free."""

    def held():
        return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) >> 10

    def litter():
        found = [bytearray(60_000) for _ in range(3000)]  # 180 MB, freed but for some that keep the rest from the system
        return found[::100]

    tokens.encoder(tokens.default_path())
    shared.let_go()
    before, scraps = held(), litter()
    assert held() > before + 100
    tokens.encoder(tokens.default_path())
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array(["some text " * 30])})
    rest = iter(suffix_dedup._first_stage(100)(iter([batch])))
    assert next(rest).num_rows and not tokens._encoders and held() < before + 60
    scraps += litter()
    assert not list(rest) and held() < before + 60 and len(scraps) == 60


def test_rows_of_one_doc_id_with_other_texts(spark):
    a, b = "same words again and again " * 10, "zz other words " * 20
    got = suffix_dedup.cut_texts(frame(spark, [(1, b, None, None, None, None), (1, a, None, None, None, None), (2, a, None, None, None, None)])).collect()
    assert sorted((g.doc_id, g.n_removed > 0) for g in got) == [(1, False), (1, True), (2, True)]
    out = suffix_dedup.cut_documents(frame(spark, nasty_rows()))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"] and out.count() == len(nasty_rows())
