from __future__ import annotations

import threading

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from kithlink.llm import quality, shared, tokens
from kithlink.llm.textvec import utf8
from tests.llm.helpers import frame, leaked, nasty_rows
from tests.llm.test_dedup import components, cut

SF = "/root/testdata/sf0.001"


def voted(space, doc_id, text, k=25, power=8.0):
    """A document's score, neighbour by neighbour."""
    counts = quality.features(*utf8(pa.array([text], pa.string())))
    if not counts.any() or not len(space.labels):
        return space.share
    own = space.embed(counts)[0].astype(float)
    near = sorted(((float(own @ v.astype(float)), y) for i, v, y in zip(space.ids.tolist(), space.vectors, space.labels, strict=True) if i != doc_id), reverse=True)[:k]
    weights = [(max(c, 0.0) ** power, y) for c, y in near]
    total = sum(w for w, _ in weights)
    return sum(w * y for w, y in weights) / total if total else space.share


def test_stages_by_brute_force(spark, tmp_path):
    """Every stage's rows, each judged on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    space = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    text, chars = columns.index("text"), columns.index("n_chars")
    library = Tokenizer.from_file(tokens.default_path())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
        got = [tuple(r) for r in docs.collect()]
        by_id = {r[0]: r[text] for r in before}
        if name == "good_quality":
            scores = {r[0]: voted(space, r[0], r[text]) for r in before}
            assert all(abs(s - 0.3) > 1e-4 for s in scores.values())
            expected = [r for r in before if scores[r[0]] >= 0.3]
        elif name == "one_of_each":
            labels = components(before_texts(before, text))
            expected = [r for r in before if labels[r[0]][2]]
        elif name == "no_repeats":
            left: dict = {}
            cut(before_texts(before, text), kept=left)
            left = {d: b.decode("utf-8", "ignore") for d, b in left.items()}
            expected = [tuple(left[r[0]] if i == text else len(left[r[0]]) if i == chars else x for i, x in enumerate(r)) for r in before]
        elif name == "no_leaks":
            gone = {d for d, _ in leaked(by_id, items)}
            expected = [r for r in before if r[0] not in gone]
        else:
            assert packed(docs) == {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in by_id.items()}
            break
        assert len(expected) <= len(before) and sorted(got, key=str) == sorted(expected, key=str), name
        before = got
    assert len(before) > 100


def before_texts(rows, text):
    return [(r[0], r[text]) for r in rows]


def packed(pieces):
    """Each document's ids from its pieces; sequences are gapless, and full but for the last."""
    rows = pieces.collect()
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert sorted(ends) == list(range(len(ends))) and all(n == 2048 for s, n in ends.items() if s < len(ends) - 1)
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert len(out.get(r.doc_id, [])) == r.start and r.length == len(r.ids)
        out.setdefault(r.doc_id, []).extend(r.ids)
    return out


def test_nasty_documents_go_through(spark, tmp_path):
    """Nulls, empty texts, ties, repeated rows and clashing names end in a defined result; so does an empty table."""
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, int(i % 3 > 0), 0) for i in range(16)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = frame(spark, nasty_rows()).withColumnsRenamed({"extra": "rep", "source": "a.row"})
    for docs in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = shared.settle(stage(spark, docs, str(tmp_path)), "nasty")
            assert docs.columns == rows.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_leaves_only_what_its_result_reads(spark, tmp_path):
    folder = f"file://{tmp_path}"
    held = shared.base_dir
    shared.base_dir = lambda _: folder
    try:
        outs: dict = {}
        threads = [threading.Thread(target=lambda i=i: outs.__setitem__(i, sorted(map(str, corpus_pipeline.run(spark, SF).drop("ids").collect())))) for i in range(2)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    finally:
        shared.base_dir = held
    assert outs[0] == outs[1] and outs[0]
    left = sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "kithlink").iterdir())
    assert left == ["packing-ids"] * 2 + ["pipeline-no_leaks"] * 2
    assert np.all([len(o) > 100 for o in outs.values()])
