from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest

from kithlink.llm import decontaminate
from kithlink.llm.textvec import PUNCTUATED, Words, utf8
from tests.llm.helpers import leaked


def leaks(items, docs):
    """Every item laid over every document on every diagonal."""
    out = set()
    for i, item in enumerate(items):
        need = min(12, math.ceil(0.6 * len(item))) if len(item) >= 10 else len(item)
        for d, doc in enumerate(docs):
            for at in range(1 - len(item), len(doc)):
                if sum(doc[at + k] == w for k, w in enumerate(item) if 0 <= at + k < len(doc)) >= need:
                    out.add((d, i))
                    break
    return out


def found(items, docs):
    index = decontaminate.Index([(i, " ".join(x)) for i, x in enumerate(items)])
    words = Words(*utf8(pa.array([" ".join(x) for x in docs], pa.large_string())), PUNCTUATED)
    return {x[:2] for x in decontaminate.overlaps(index, words, 12, 0.6)}


@pytest.mark.parametrize(("size", "substituted"), [(10, 4), (15, 2), (15, 3), (15, 6), (15, 7), (20, 4), (20, 8), (25, 5), (25, 10), (30, 6), (30, 12)])
def test_random_substitutions(size, substituted):
    rng = random.Random(size * 100 + substituted)
    items = [[f"i{i}w{k}" for k in range(size)] for i in range(40)]
    docs = []
    for item in items:
        item = list(item)
        for k in rng.sample(range(size), substituted):
            item[k] = "other"
        docs.append([f"a{k}" for k in range(rng.randint(0, 9))] + item + [f"b{k}" for k in range(rng.randint(0, 9))])
    expected = leaks(items, docs)
    assert found(items, docs) == expected
    assert len(expected) == (40 if substituted <= 0.4 * size else 0)


def test_long_items():
    item = [f"w{k}" for k in range(60)]
    fourth = ["other" if k % 4 == 3 else w for k, w in enumerate(item)]
    far = [w if k % 4 == 0 or k < 3 else "other" for k, w in enumerate([f"w{k}" for k in range(60)])]  # 17 equal, at most 10 of 30
    assert found([item], [["x", *fourth], far, fourth[:16], fourth[:12]]) == {(0, 0), (2, 0)}


@pytest.mark.parametrize("size", range(1, 10))
def test_short_items_match_whole(size):
    rng = random.Random(size)
    items = [[f"i{i}w{k}" for k in range(size)] for i in range(8)]
    docs = [[*(f"a{k}" for k in range(rng.randint(0, 3))), *items[i], "end"] for i in range(8)]
    docs += [[*item[: size // 2], "other", *item[size // 2 + 1 :]] for item in items]
    assert found(items, docs) == leaks(items, docs) == {(i, i) for i in range(8)}


def test_repeated_words_stay_bounded(monkeypatch):
    """One word, many times, in item and document: hits are as many as pairs of places, diagonals only as places."""
    monkeypatch.setattr(decontaminate, "HELD", 5000)
    assert found([["a"] * 300], [["a"] * 20_000, ["b"] * 50]) == {(0, 0)}
    items, docs = [["a", "b"] * 20, ["a"] * 15], [["a", "b"] * 500, ["a"] * 11 + ["c"] * 9, ["b", "a"] * 4]
    assert found(items, docs) == leaks(items, docs)


def test_all_documents_by_brute_force(spark):
    """op1 on sf0.001 against every item laid over every document on every diagonal."""
    sf = "/root/testdata/sf0.001"
    items, docs = ({r[0]: r.text for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()} for t, c in (("benchmark", "item_id"), ("documents", "doc_id")))
    expected = leaked(docs, items)
    got = decontaminate.op1_decontamination(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and expected
