from __future__ import annotations

import math
import random
import zlib

from kithlink.llm import decontaminate, labelled, quality, toxicity
from tests.llm.helpers import frame, nasty_rows, words

SF = "/root/testdata/sf0.01"


def _held_out(spark, op, label, threshold):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op(spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    return [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]


def test_quality_on_held_out_documents(spark):
    pairs = _held_out(spark, quality.op4_quality, "quality", 0.3)
    assert all(p for p, y in pairs if y == 1)
    assert sum(p == y for p, y in pairs) / len(pairs) > 0.9


def test_toxicity_on_held_out_documents(spark):
    pairs = _held_out(spark, toxicity.op8_toxicity, "toxic", 0.5)
    assert sum(p == y for p, y in pairs) / len(pairs) > 0.95


def test_classifiers_take_anything(spark):
    docs = frame(spark, nasty_rows())
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(16)] + [(None, 1, 1), (3, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for module in (quality, toxicity):
        for y in (labels, none):
            got = module.score(docs, module.fit(docs, y)).collect()
            assert len(got) == len(nasty_rows()) and all(0 <= r.score <= 1 for r in got)
        assert module.score(docs.limit(0), module.fit(docs, none)).count() == 0
    kept = quality.keep_good(docs, quality.fit(docs, none))
    assert kept.count() == len(nasty_rows()) and kept.columns == docs.columns


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, words(rng, n)) for i, n in enumerate([40, 25, 12, 5])] + [(8, None), (9, ""), (None, "x y z")]
    swapped = items[0][1].split()
    swapped[9] = swapped[21] = swapped[33] = "other"
    texts = [words(rng, 50) + " " + items[0][1].upper() + " " + words(rng, 5), words(rng, 20) + " " + " ".join(swapped) + " " + words(rng, 9), words(rng, 400), items[2][1] + ".", "a " + items[3][1], items[1][1][: len(items[1][1]) // 5], None, ""]
    docs = frame(spark, [(i, t, None, None, None, None) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    for block in (1_000_000, 30):
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, bench, block_tokens=block).collect()}
        assert got == {(0, 0), (1, 0), (3, 2), (4, 3)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 5, 6, 7]
    assert decontaminate.find_overlaps(docs, bench.limit(0)).count() == 0 and decontaminate.find_overlaps(docs.limit(0), bench).count() == 0


def test_scores_by_brute_force(spark):
    """op4 and op8 on sf0.001, document by document: every neighbour compared, every n-gram looked up."""
    from tests.llm.test_pipeline import voted

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    space = quality.fit(docs, labels)
    known = {r.doc_id for r in labels.collect()}
    assert set(space.ids.tolist()) <= known and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in space.ids.tolist())
    for r in quality.score(docs, space).collect():
        assert abs(r.score - voted(space, r.doc_id, texts[r.doc_id])) < 1e-4
    model = toxicity.fit(docs, labels)
    z = {d: score_of(model, t) for d, t in texts.items()}
    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - z[r.doc_id]) < 1e-6


def score_of(model, text):
    """The intercept and the weights of the distinct n-grams, each hashed by itself in plain integers."""
    text, low = (text or "").lower(), (1 << 32) - 1
    found = set()
    for n in toxicity.LENGTHS:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 0x9E3779B1 + ord(c) + 1) & low
            f = h ^ h >> 15
            found.add(((f * 0x85EBCA77 + n) & low) >> 32 - toxicity.BITS)
    z = model.intercept + float(sum(model.weight[f] for f in found))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def test_copies_of_labelled_documents_vote(spark):
    """A held-out copy of a labelled document takes its label; a labelled document does not vote on itself; ties are scored alike."""
    rng = random.Random(6)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    out = [i for i in range(400) if not zlib.crc32(str(i).encode()) % 5]
    odd = words(rng, 80).upper()
    rows = [(i, words(rng, 60)) for i in ids[:60]] + [(ids[60], odd), (out[0], odd), (out[1], odd), (ids[61], None), (out[2], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in ids[:60]] + [(ids[60], 0, 1), (out[0], 1, 0)], "doc_id long, quality int, toxic int")
    space = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, space, k=1).collect()}
    assert got[out[0]] == got[out[1]] == 0.0 and got[ids[60]] == 1.0 and got[out[2]] == got[ids[61]] == space.share


def test_sample_is_bounded_by_rows_and_bytes(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5][:100]
    docs = spark.createDataFrame([(i, "x" * 1000) for i in ids for _ in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    assert labelled.sample(docs, labels, "quality", 40).count() == 40
    assert labelled.sample(docs, labels, "quality", 1000).count() == 100
    assert labelled.sample(docs, labels, "quality", 1000, most_bytes=20_500).count() == 20
