from __future__ import annotations

import datetime
import math
from collections import Counter
from itertools import combinations
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kithlink import queries
from kithlink.diagnostics import coverage
from kithlink.functions.levels import level_index
from kithlink.linker import Linker, gen_sample, gen_two, init
from kithlink.operators import blocking as blocking_module
from kithlink.operators.blocking import Blocking
from kithlink.operators.components import connected_components
from kithlink.operators.estimate import EstimateOptions, estimate, random_pairs
from kithlink.operators.predict import predict
from kithlink.operators.search import query_record, search
from kithlink.plans.model import Model
from kithlink.plans.numerics import banding_recall, chi_square_tail, fit_to_margins, initial_m
from kithlink.plans.schema import Schema, SchemaError
from kithlink.sources.store import dataset_names, load


def test_components(spark):
    rows = [(i, i + 1) for i in range(100, 140)] + [(7, 1), (7, 9), (5, 5), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 1, 1: 1, 9: 1, 5: 5}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_nulls_are_normalised(spark):
    df = spark.createDataFrame([(1, float("nan"), [], "a"), (None, 2.0, ["b", None, "a", "b"], None)], "id long, x double, l array<string>, s string")
    store = load(spark, df, Schema.parse({"unique_id": "id", "columns": [{"name": "x"}, {"name": "l"}, {"name": "s"}]}))
    assert [tuple(r) for r in store.frame.orderBy("__row").select("__id", "x", "l", "s").collect()] == [("1", None, None, "a"), ("", 2.0, ["a", "b"], None)]
    with pytest.raises(SchemaError):
        load(spark, df, Schema.parse({"columns": [{"name": "x", "type": "string"}]}))


def test_share_of_the_larger_value(spark):
    """The difference over the larger of the two; where the larger is negative the quotient is, and lies below any threshold."""
    values = [(1, 8.0), (2, 7.5), (3, 6.0), (4, 0.0), (5, -4.0), (6, -6.0)]
    schema = Schema.parse({"unique_id": "i", "columns": [{"name": "v"}], "blocking": [{"type": "all_pairs"}], "comparisons": [{"columns": ["v"], "levels": [{"type": "null"}, {"type": "exact"}, {"type": "percentage_within", "threshold": 0.07}, {"type": "percentage_within", "threshold": 0.3}, {"type": "else"}]}]})
    store = load(spark, spark.createDataFrame(values, "i int, v double"), schema)
    pairs = Blocking(store, store.schema.blocking).pairs(["v"])
    got = {(r.a_v, r.b_v): r.level for r in pairs.select("a_v", "b_v", level_index(store.schema, store.schema.comparisons[0]).alias("level")).collect()}
    for (x, y), level in got.items():
        larger = max(x, y)
        ratio = abs(x - y) / larger if larger else None
        assert level == (1 if x == y else 4 if ratio is None else 2 if ratio < 0.07 else 3 if ratio < 0.3 else 4), (x, y)
    assert set(got.values()) == {2, 3, 4}


def made_records(n=18):
    """Numbered records with a shared street, a day and a crew each; some values are missing and some are alone."""
    streets = ["elm row", "oak end", "ash hill", "fir lane", None]
    return [(k, streets[k * k % 5], None if k % 6 == 5 else datetime.date(2001, 2, 1 + k % 4), f"crew {k // 7}") for k in range(n)]


@pytest.mark.parametrize("ends", [(18,), (5, 18), (3, 4, 18)])
def test_every_pair_once_and_counts_match(spark, ends):
    records = made_records()
    begins = (0, *ends[:-1])
    frames = [spark.createDataFrame(records[a:b], "k int, street string, day date, crew string") for a, b in zip(begins, ends, strict=True)]
    sources = [{"type": "rare_value", "column": "street", "max_frequency": 5}, {"type": "exact_value", "column": "day"}, {"type": "minhash", "column": "crew", "bands": 3, "rows_per_band": 2}, {"type": "sorted_neighbourhood", "column": "day", "window": 3}, {"type": "all_pairs"}]
    store = load(spark, frames, Schema.parse({"unique_id": "k", "columns": [{"name": n} for n in ("street", "day", "crew")], "blocking": sources}))
    blocking = Blocking(store, store.schema.blocking)
    source_of = [sum(k >= e for e in ends) for k in range(len(records))]
    wanted = {(x, y) for y in range(len(records)) for x in range(y) if len(ends) == 1 or source_of[x] != source_of[y]}
    found = [(r.x, r.y, r.source) for r in blocking.pairs([]).select(F.col("a___row").alias("x"), F.col("b___row").alias("y"), "source").collect()]
    assert sorted(f[:2] for f in found) == sorted(wanted) and store.pair_space == len(wanted)
    uses = Counter(r[1] for r in records if r[1])
    assert {f[:2] for f in found if f[2] == 0} == {(x, y) for x, y in wanted if records[x][1] and records[x][1] == records[y][1] and uses[records[x][1]] <= 5}
    for k in range(len(blocking.bound)):
        assert blocking.counts(k)["pairs"] == blocking.pairs_of(k, []).count(), blocking.bound[k].name


def test_large_groups_are_dealt(spark, monkeypatch):
    """A key that most records share makes every pair once, over many cells."""
    monkeypatch.setattr(blocking_module, "CELL", 7)
    rows = [(i, "hot" if i % 9 else f"k{i % 4}") for i in range(200)] + [(i, None) for i in range(200, 210)]
    store = load(spark, spark.createDataFrame(rows, "i int, x string"), Schema.parse({"unique_id": "i", "columns": [{"name": "x"}], "blocking": [{"type": "exact_value", "column": "x"}]}))
    pairs = Blocking(store, store.schema.blocking).pairs([])
    found = [(r["a___row"], r["b___row"]) for r in pairs.select("a___row", "b___row").collect()]
    assert sorted(found) == sorted((x, y) for y in range(200) for x in range(y) if rows[x][1] == rows[y][1])
    widest = pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert widest < len(found) / 2


def shingle_bands(value, bands, rows, ngram, seed):
    """Band keys of a text, from the hash function's definition."""

    def chain(parts):
        h = 42
        for part in parts:
            data = part.encode() if isinstance(part, str) else part
            h = xxhash.xxh64(data, seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    number = lambda n: n.to_bytes(4, "little", signed=True)
    grams = {value[i : i + ngram] for i in range(max(len(value) - ngram + 1, 1))}
    signature = [min(chain((g, number(k + seed * 1_000_003))) for g in grams) for k in range(bands * rows)]
    return [chain((number(b), ",".join(map(str, signature[b * rows : (b + 1) * rows])))) for b in range(bands)]


def test_minhash_by_force(spark):
    names = [r.p_name for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_name").distinct().collect()]
    schema = Schema.parse({"unique_id": "n", "columns": [{"name": "n2"}], "blocking": [{"type": "minhash", "column": "n2", "bands": 4, "rows_per_band": 3}]})
    store = load(spark, spark.createDataFrame([(n, n) for n in names], "n string, n2 string"), schema)
    source = schema.blocking[0]
    keys = {n: shingle_bands(n, 4, 3, source.ngram, source.seed) for n in names}
    rows = {r["__row"]: r["__id"] for r in store.frame.select("__row", "__id").collect()}
    found = {(rows[r["a___row"]], rows[r["b___row"]]): r.source for r in Blocking(store, schema.blocking).pairs([]).select("a___row", "b___row", "source").collect()}
    expected = {}
    for x, y in combinations(sorted(rows), 2):
        shared = [b for b in range(4) if keys[rows[x]][b] == keys[rows[y]][b]]
        if shared:
            expected[rows[x], rows[y]] = shared[0]
    assert found == expected and expected


def test_banding_recall():
    """Against the sum over which bands agree."""
    for s, bands, rows in ((0.5, 4, 3), (0.9, 20, 5), (0.0, 3, 2), (1.0, 3, 2)):
        one = s**rows
        summed = sum(math.comb(bands, k) * one**k * (1 - one) ** (bands - k) for k in range(1, bands + 1))
        assert banding_recall(s, bands, rows) == pytest.approx(summed)


def plain_em(counted, u, m, start, free, rounds=500):
    """Expectation-maximisation in plain Python: counts of patterns, fixed u."""
    share = start
    for _ in range(rounds):
        heavy = {}
        for pattern, n in counted.items():
            yes, no = share, 1 - share
            for k in free:
                yes *= m[k][pattern[k]]
                no *= u[k][pattern[k]]
            heavy[pattern] = n * yes / (yes + no)
        total = sum(heavy.values())
        for k in free:
            m[k] = [max(sum(x for p, x in heavy.items() if p[k] == i) / total, 1e-12) for i in range(len(m[k]))]
        before, share = share, total / sum(counted.values())
        if abs(before - share) < 1e-10:
            break
    return m, share


def test_estimation_follows_plain_em(spark):
    """The engine's m against plain EM on pattern counts that another database made from the tables."""
    sf = "/root/testdata/sf0.001"
    store = queries.part_store(spark, sf, blocking=[{"type": "exact_value", "column": "p_brand"}])
    model, report = estimate(store, EstimateOptions(u_sample=20_000, tolerance=1e-10, iterations=2000, tie_holdout=False))
    session = report.sessions[0]
    base = duckdb.connect()
    base.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    counted = {r[:3]: r[3] for r in base.execute(f"SELECT l1, l2, l3, count(*) FROM ({queries._CODED}) GROUP BY 1, 2, 3").fetchall()}
    assert session.pairs == sum(counted.values()) and session.merged
    u = [[v.u for v in c.levels] for c in model.comparisons]
    start = [list(x) for x in initial_m([np.array(x) for x in u], [True] * 3)]
    m, share = plain_em(counted, u, start, 0.01, [0, 1, 2], 5000)
    assert session.lambda_ == pytest.approx(share, rel=1e-3)
    for c, own in zip(model.comparisons, m, strict=True):  # no reachable level is held to be rarer than half a match
        raised = [max(x, 0.5 / session.matches) for x in own[1:]]
        for v, x in zip(c.levels[1:], raised, strict=True):
            assert v.m == pytest.approx(x / sum(raised), rel=0.01)


def test_random_pairs_between_unequal_inputs(spark):
    big, small = spark.range(0, 900).selectExpr("id AS k", "'x' AS v"), spark.range(900, 1000).selectExpr("id AS k", "'x' AS v")
    store = load(spark, [big, small, spark.range(1000, 1050).selectExpr("id AS k", "'x' AS v")], Schema.parse({"unique_id": "k", "columns": [{"name": "v"}]}))
    drawn = random_pairs(store, 20_000, 5, ["v"]).select(F.col("a___ds").alias("a"), F.col("b___ds").alias("b"))
    got = {(r.a, r.b): r["count"] for r in drawn.groupBy("a", "b").count().collect()}
    assert sum(got.values()) == 20_000
    for pair, weight in {(0, 1): 900 * 100, (0, 2): 900 * 50, (1, 2): 100 * 50}.items():
        assert got[pair] / 20_000 == pytest.approx(weight / 140_000, abs=0.02)


def test_unseen_query_values_are_weighed(spark):
    """Under fuzzy term frequencies a value that no record holds is weighed by the records around it, one at least."""
    names = ["karlson"] * 30 + ["karlsen"] * 3 + ["berg"] * 7
    schema = Schema.parse({"unique_id": "i", "columns": [{"name": "n"}], "comparisons": [{"columns": ["n"], "term_frequency": True, "levels": [{"type": "null"}, {"type": "exact"}, {"type": "levenshtein", "threshold": 1}, {"type": "else"}]}]})
    store = load(spark, spark.createDataFrame(list(enumerate(names)), "i int, n string"), schema)
    model = Model.given(schema, 0.1, [[0.01, 0.8, 0.1, 0.09]], [[0.01, 0.3, 0.2, 0.49]])
    plain = {r.unique_id: r.match_weight for r in search(store, {"n": "karlsan"}, model, k=40).collect()}
    fuzzy = {r.unique_id: r.match_weight for r in search(store, {"n": "karlsan"}, model, k=40, fuzzy_tf=True).collect()}
    # karlsan lies one edit from 33 records; karlson from karlsen's 3, karlsen from karlson's 30
    for who, mass in (("0", 3), ("30", 30)):
        assert fuzzy[who] - plain[who] == pytest.approx(math.log2(0.2) - (math.log2(mass / 40) + math.log2(33 / 40)) / 2)
    assert fuzzy["33"] == plain["33"]


def test_query_fields(spark):
    store = load(spark, spark.createDataFrame([(1, True, datetime.date(2020, 1, 1))], "i int, ok boolean, day date"), Schema.parse({"unique_id": "i", "columns": [{"name": "ok"}, {"name": "day"}]}))
    for said, meant in (("yes", True), ("Y", True), ("t", True), ("1", True), ("no", False), ("F", False), ("n", False), ("0", False)):
        assert query_record(store, [f"ok={said}"]) == {"ok": meant}
    assert query_record(store, ["day=2020-02-29"]) == {"day": datetime.date(2020, 2, 29)}
    for bad in ("ok=maybe", "day=20200101", "day=2020-W01-1", "day=2020-02-30", "day"):
        with pytest.raises(ValueError):
            query_record(store, [bad])


def test_frames_of_other_kinds(spark):
    import pandas as pd
    import pyarrow as pa

    schema = Schema.parse({"unique_id": "i", "columns": [{"name": "s"}]})
    rows = {"i": [1, 2], "s": ["a", None]}
    for frame in (pd.DataFrame(rows), pa.table(rows), pa.RecordBatchReader.from_batches(pa.table(rows).schema, pa.table(rows).to_batches())):
        assert [tuple(r) for r in load(spark, frame, schema).frame.orderBy("__row").select("__id", "s").collect()] == [("1", "a"), ("2", None)]


def test_truncation_and_forms(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    linker = Linker(spark, queries.PART, f"{sf}/part.parquet")
    model = queries.part_model(linker.store)
    whole = linker.predict(model, threshold=-8.0).count()
    assert whole > 3 and not linker.last_truncated
    assert linker.predict(model, threshold=-8.0, limit=3).count() == 3 and linker.last_truncated
    assert linker.predict(model, threshold=-8.0, limit=whole).count() == whole and not linker.last_truncated
    with pytest.raises(ValueError):
        linker.predict(model, str(tmp_path / "x.csv"), form="csv")
    linker.predict(model, str(tmp_path / "x"), threshold=-8.0, form="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == whole
    plan = linker.plan(model, threshold=4.0)
    assert plan.records == 200 and plan.codes == 60 and 0 < plan.reachable < 60 and plan.value_tables == ["p_name"] and plan.term_frequencies == ["p_name"]
    assert {r.zone: r.pairs for r in linker.zones(model, threshold=4.0).collect()}["drop"] <= plan.sources[0][1]


def test_agreement_tables_find_what_depends():
    """The unseen cell of a table made from known chances: independent ones need no term, a tied pair needs its own and is found."""
    rng = np.random.default_rng(5)

    def table(chance):
        p = np.array([chance(cell) for cell in np.ndindex((2,) * 4)]).reshape((2,) * 4)
        return rng.poisson(p / p.sum() * 200_000).astype(float)

    free = table(lambda c: math.prod(q if y else 1 - q for q, y in zip((0.7, 0.6, 0.5, 0.8), c, strict=True)))
    tied = table(lambda c: (0.55 if c[0] and c[1] else 0.25 if not c[0] and not c[1] else 0.1) * math.prod(q if y else 1 - q for q, y in zip((0.5, 0.6), c[2:], strict=True)))
    for whole, expected in ((free, []), (tied, [(0, 1)])):
        seen = whole.copy()
        seen[0, 0, 0, 0] = 0
        plain, bic = coverage._log_linear(seen, [])
        term, with_term = coverage._log_linear(seen, [(0, 1)])
        assert (with_term < bic) == bool(expected)
        best = term if expected else plain
        assert best[0, 0, 0, 0] == pytest.approx(whole[0, 0, 0, 0], rel=0.05)
        schema = Schema.parse({"columns": [{"name": f"c{k}", "type": "string"} for k in range(4)], "comparisons": [{"columns": [f"c{k}"], "levels": [{"type": "exact"}, {"type": "else"}]} for k in range(4)]})
        rows = [SimpleNamespace(gamma=schema.pack([1 - y for y in cell])) for cell in np.ndindex((2,) * 4)]
        recall, terms = coverage._by_table(schema, rows, np.array([whole[c] for c in np.ndindex((2,) * 4)]), [(k, 0, 1.0) for k in range(4)], 0.0)
        assert terms == [(f"c{a}", f"c{b}") for a, b in expected]
        assert recall == pytest.approx(1 - whole[0, 0, 0, 0] / whole.sum(), abs=0.01)


def test_recall_says_what_would_help(spark):
    rows = [(i, f"v{i % 3}" if i < 30 else f"w{i}", f"z{i // 2:03d}") for i in range(40)]
    schema = Schema.parse({"unique_id": "i", "columns": [{"name": "v"}, {"name": "z"}], "blocking": [{"type": "rare_value", "column": "v", "max_frequency": 4}]})
    linker = Linker(spark, schema, spark.createDataFrame(rows, "i int, v string, z string"))
    truth = spark.createDataFrame([("0", "3"), ("1", "4"), ("30", "31"), ("0", "nobody")], "id_a string, id_b string")
    found = linker.recall(truth, why=True, misses=2)
    assert (found.truth, found.found) == (3, 0) and found.cap_gains == {"v rare_value": 2}
    assert [(r.id_a, r.id_b) for r in found.listed.collect()] == [("0", "3"), ("1", "4")]
    assert (linker.last_truth.listed, linker.last_truth.resolved, linker.last_truth.missing) == (4, 3, 1)


def test_bounds_change_nothing(spark):
    names = ["anna", "anne", "hanna", "johan", "john", "jon", "maria", "marie", "mario", "otto"]
    rows = [(i, names[(i * i) % 10], f"c{i % 3}") for i in range(60)]
    schema = Schema.parse({
        "unique_id": "i", "columns": [{"name": "n"}, {"name": "c"}], "blocking": [{"type": "exact_value", "column": "c"}],
        "comparisons": [{"columns": ["n"], "term_frequency": True, "levels": [{"type": "null"}, {"type": "exact"}, {"type": "levenshtein", "threshold": 1}, {"type": "jaro_winkler", "threshold": 0.85}, {"type": "else"}]}],
    })
    store = load(spark, spark.createDataFrame(rows, "i int, n string, c string"), schema)
    model = Model.given(schema, 0.05, [[0.01, 0.7, 0.1, 0.1, 0.09]], [[0.01, 0.1, 0.05, 0.05, 0.79]])
    pick = lambda **o: sorted((r.row_a, r.row_b, r.gamma, round(r.match_weight, 9)) for r in predict(store, model, threshold=-6.0, **o).collect())
    exact = pick(ceiling=False, bounds=False)
    assert exact and pick() == exact == pick(ceiling=False) == pick(signatures=False) == pick(ladders=False) == pick(signatures=False, ladders=False, bounds=False)
    assert pick(fuzzy_tf=True) == pick(fuzzy_tf=True, ceiling=False, bounds=False)


def test_dataset_names():
    assert dataset_names(["/x/a.parquet", "/y/a.parquet", "b:c.pq"]) == ["a", "a#2", "b_c"]
    assert dataset_names(["/x/a.parquet"]) == [""]


def test_numerics():
    assert chi_square_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert chi_square_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    t = fit_to_margins(np.array([[4.0, 1], [2, 3]]), np.array([0.3, 0.7]), np.array([0.6, 0.4]))
    assert t.sum(axis=1) == pytest.approx([0.3, 0.7]) and t.sum(axis=0) == pytest.approx([0.6, 0.4])


def test_people_over_two_inputs(spark):
    first, second, truth = gen_two(spark, 600, 0.2)
    here, there = ({r.id for r in df.select("id").collect()} for df in (first, second))
    pairs = [(r.id_a, r.id_b) for r in truth.collect()]
    assert len(here) + len(there) == 600 and not here & there and len(pairs) == 120
    assert all(a in here and b in there for a, b in pairs)


def test_people_end_to_end(spark):
    records, truth = gen_sample(spark, 1_500, 0.2)
    schema, roles, _ = init(records)
    assert (roles["dob"], roles["last_name"], roles["latitude"]) == ("birth_date", "surname", "latitude")
    wanted = {"unique_id": "id", "columns": [{"name": n} for n in ("first_name", "last_name", "dob", "phone", "postcode")], "blocking": [{"type": "exact_value", "column": "dob"}, {"type": "rare_value", "column": "phone"}, {"type": "rare_value", "column": "postcode"}]}
    wanted["comparisons"] = [{"columns": [n], "levels": [{"type": "null"}, {"type": "exact"}, {"type": "levenshtein", "threshold": 2}, {"type": "else"}]} for n in ("first_name", "last_name", "phone", "postcode")]
    linker = Linker(spark, wanted, records)
    model, report = linker.estimate(u_sample=20_000, tie_holdout=False)
    assert any(s.merged for s in report.sessions)
    found = linker.predict(model, threshold=6.0).checkpoint()
    linker.cluster(found, truth=truth)
    assert linker.last_quality.f1 > 0.9
    r = linker.recall(truth, why=True)
    assert r.truth == 300 and r.completeness > 0.9
    best = found.orderBy(F.desc("match_weight"), "row_a").first()
    told = linker.explain(best.id_a, best.id_b, model)
    assert told["match_weight"] == pytest.approx(best.match_weight)
    own = records.where(F.col("id") == best.id_a).first()
    assert linker.search({"last_name": own.last_name, "phone": own.phone, "first_name": own.first_name, "postcode": own.postcode}, model, k=2).first().unique_id in (best.id_a, best.id_b)
