from __future__ import annotations

import math
import random
import re

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def nasty_rows() -> list[tuple]:
    """Nulls, empty texts, ties, repeated rows, a long text, copies, shared passages."""
    rng = random.Random(3)
    base, passage, long = words(rng, 120), words(rng, 60), words(rng, 6000)
    near = base.split()
    near[40] = "changed"
    texts = [base, base, " ".join(near), None, "", " \n\t ", "one two", "one two", "Ünïcode é 日本語 text", words(rng, 30) + " " + passage + " " + words(rng, 30), passage + " tail", long, long[:2000] + words(rng, 20), "x" * 400, "ab " * 300, base.upper()]
    rows = [(i, t, "en", "s", None, "e") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, None, None, None, None), (None, None, None, None, None, None), (99, passage + passage, None, "s", 1, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaked(docs: dict, items: dict) -> set:
    """(document, item) of every item that is in a document, with each item laid over each document on every diagonal."""
    number: dict[str, int] = {}

    def coded(text):
        return np.array([number.setdefault(w, len(number)) for w in re.findall("[0-9a-z\\x80-\U0010ffff]+", (text or "").translate(LOWER))], np.int64)

    items, out = {i: coded(t) for i, t in items.items()}, set()
    for d, text in docs.items():
        doc = coded(text)
        for i, item in items.items():
            need = len(item) if len(item) < 10 else min(12, math.ceil(0.6 * len(item)))
            if not len(item) or np.isin(item, doc).sum() < need:
                continue
            for at in range(1 - len(item), len(doc)):
                a, b = max(at, 0), min(at + len(item), len(doc))
                run = np.concatenate(([0], np.cumsum(doc[a:b] == item[a - at : b - at])))
                wide = min(30, len(run) - 1) if len(item) > 30 else len(run) - 1
                if (run[wide:] - run[: len(run) - wide]).max() >= need:
                    out.add((d, i))
                    break
    return out
