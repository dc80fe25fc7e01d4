from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kithlink.functions import text


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach, taken, ours = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == c and j not in taken), None)
        if j is not None:
            taken.add(j)
            ours.append(i)
    k = len(ours)
    if not k:
        return 0.0
    half = sum(a[i] != b[j] for i, j in zip(ours, sorted(taken), strict=True)) // 2
    return (k / len(a) + k / len(b) + (k - half) / k) / 3


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    rows = [tuple("".join(rng.choice("abcd e") for _ in range(rng.randint(0, 9))) for _ in "ab") for _ in range(600)]
    rows += [("MARTHA", "MARHTA"), ("DWAYNE", "DUANE"), ("DIXON", "DICKSONX"), ("", ""), ("a", "")]
    return spark.createDataFrame(rows, "a string, b string")


def test_jaro_winkler(pairs):
    a, b = F.col("a"), F.col("b")
    for r in pairs.select("a", "b", text.jaro(a, b).alias("j"), text.jaro_winkler(a, b).alias("w")).collect():
        j = jaro(r.a, r.b)
        prefix = next((k for k in range(min(4, len(r.a), len(r.b)), 0, -1) if r.a[:k] == r.b[:k]), 0)
        assert r.j == pytest.approx(j, abs=1e-12)
        assert r.w == pytest.approx(j + prefix * 0.1 * (1 - j) if j >= 0.7 else j, abs=1e-12)
        if (r.a, r.b) == ("MARTHA", "MARHTA"):
            assert (round(r.j, 4), round(r.w, 4)) == (0.9444, 0.9611)


def test_bounds_never_undercut(pairs):
    a, b = F.col("a"), F.col("b")
    args = (text.char_mask(a), text.char_mask(b), F.length(a), F.length(b))
    bad = pairs.where((text.jaro_winkler_upper_bound(*args) < text.jaro_winkler(a, b) - 1e-12) | (text.levenshtein_lower_bound(*args) > F.levenshtein(a, b)))
    assert bad.count() == 0


def test_transforms(spark):
    rows = [("Ab--c  d!", "Ashcraft", "a@b@c.d"), ("...", "123", "plain"), (None, "Mac-Kenzie", "@x"), ("ÉA b", "123abc", "x@")]
    df = spark.createDataFrame(rows, "x string, s string, e string")
    got = df.select(text.normalize(F.col("x")), text.sorted_tokens(F.col("x")), text.soundex(F.col("s")), text.email_username(F.col("e")), text.email_domain(F.col("e"))).collect()
    assert [tuple(r) for r in got] == [("ab c d", "Ab--c d!", "A261", "a", "c.d"), (None, "...", None, "plain", None), (None, None, "M252", None, "x"), ("Éa b", "b ÉA", "A120", "x", None)]


def test_haversine(spark):
    r = spark.range(1).select(text.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)).alias("k")).first()
    assert r.k == pytest.approx(343.556, abs=0.01)
