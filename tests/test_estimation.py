"""Sessions and their limits, advice on ladders, merged levels, drafted schemas."""

from __future__ import annotations

import datetime
import math

import duckdb
import numpy as np
import pytest

from kithlink import queries
from kithlink.diagnostics import draft, ladders
from kithlink.linker import Linker
from kithlink.operators.estimate import EstimateOptions, estimate
from kithlink.plans.model import Model
from kithlink.plans.numerics import em
from kithlink.plans.schema import Schema
from kithlink.sources.store import load

SF = "/root/testdata/sf0.001"


def fitted(spark, blocking, **options):
    store = queries.part_store(spark, SF, blocking=blocking)
    return estimate(store, EstimateOptions(u_sample=5_000, **options))


def test_a_session_holds_out_what_it_blocks_on(spark):
    model, report = fitted(spark, [{"type": "exact_value", "column": "p_type"}, {"type": "exact_value", "column": "p_brand"}, {"type": "exact_value", "column": "p_name"}])
    by_type, by_brand, by_name = report.sessions
    assert by_type.excluded == ["p_type"] and by_brand.excluded == [] and by_name.excluded == ["p_name"]
    assert "fewer pattern cells" in by_name.skipped and not by_name.merged  # two and three levels cannot carry a mixture
    counted = {c.name: c.sessions for c in model.comparisons}
    assert counted["p_name"] == sum(s.merged and "p_name" not in s.excluded for s in report.sessions)
    assert all(sum(v.m for v in c.levels) == pytest.approx(1, abs=1e-6) for c in model.comparisons)


def test_limits_and_given_values(spark):
    blocking = [{"type": "exact_value", "column": "p_brand"}]
    whole = fitted(spark, blocking)[1].sessions[0].pairs
    model, report = fitted(spark, blocking, session_pairs=whole // 3, lambda_=0.02)
    assert 0.6 * whole / 3 < report.sessions[0].pairs < 1.5 * whole / 3
    assert model.lambda_ == 0.02
    model, report = fitted(spark, [{"type": "exact_value", "column": "p_name"}])
    assert {w.split("'")[1] for w in report.warnings if "held out" in w} == {"p_name", "p_type", "p_retailprice"} and all(c.sessions == 0 for c in model.comparisons)


def test_all_pairs_is_no_lower_bound(spark):
    store = queries.part_store(spark, SF, blocking=[{"type": "exact_value", "column": "p_brand"}])
    _, bounded = estimate(store, EstimateOptions(u_sample=5_000))
    _, exact = estimate(store, EstimateOptions(u_sample=5_000), all_pairs=True)
    assert any("lower bound" in w for w in bounded.warnings) and not any("lower bound" in w for w in exact.warnings)


def test_em_recovers_a_mixture():
    """Patterns drawn from known classes give these back."""
    rng = np.random.default_rng(2)
    m, u = [np.array([0.8, 0.15, 0.05]), np.array([0.9, 0.1]), np.array([0.7, 0.2, 0.1])], [np.array([0.02, 0.08, 0.9]), np.array([0.1, 0.9]), np.array([0.05, 0.15, 0.8])]
    is_match = rng.random(300_000) < 0.05
    levels = np.stack([np.where(is_match, rng.choice(len(a), 300_000, p=a), rng.choice(len(b), 300_000, p=b)) for a, b in zip(m, u, strict=True)], 1)
    patterns, counts = np.unique(levels, axis=0, return_counts=True)
    start = [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]), np.array([0.5, 0.3, 0.2])]
    got = em(patterns, counts.astype(float), start, u, [0, 1, 2], 0.01)
    assert got.converged and got.lambda_ == pytest.approx(0.05, abs=0.003)
    for a, b in zip(got.m, m, strict=True):
        assert a == pytest.approx(b, abs=0.02)


def test_merged_levels_follow_their_counts(spark):
    """Against the test worked out from another database's pattern counts: level by level, the least different first."""
    store = queries.part_store(spark, SF)
    model = queries.part_model(store)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    counts = base.execute(f"SELECT l1, l2, l3, count(*) FROM ({queries._CODED}) GROUP BY 1, 2, 3").fetchall()
    heavy = sum(n / (1 + 2 ** -(math.log2(queries.LAMBDA / (1 - queries.LAMBDA)) + sum(math.log2(queries.M[k][v] / queries.U[k][v]) for k, v in enumerate(levels)))) for *levels, n in counts)
    light = sum(r[3] for r in counts) - heavy

    def p_value(x, y):
        seen = np.array([[heavy * x[0], light * x[1]], [heavy * y[0], light * y[1]]])
        expected = seen.sum(1, keepdims=True) * seen.sum(0, keepdims=True) / seen.sum()
        return math.erfc(math.sqrt(max(float((seen * np.log(seen / expected)).sum()), 0.0)))

    for alpha, gap in ((0.01, 0.0), (0.01, 2.0), (0.5, 5.0)):
        expected = []
        for k, c in enumerate(store.schema.comparisons):
            groups = [(v.describe(), queries.M[k][i], queries.U[k][i]) for i, v in enumerate(c.levels)]
            while len(groups) > 2:
                ways = []
                for i in range(1, len(groups) - 1):
                    (_, *x), (_, *y) = groups[i], groups[i + 1]
                    apart = abs(math.log2(x[0] / x[1]) - math.log2(y[0] / y[1]))
                    related = groups[i][0] == "exact" or groups[i + 1][0] == "else"
                    if related and (p_value(x, y) >= alpha or gap and apart < gap):
                        ways.append((p_value(x, y), -i, apart))
                if not ways:
                    break
                p, i, apart = max(ways)
                expected.append((c.name, groups[-i][0], groups[1 - i][0], round(apart, 9), round(p, 6)))
                groups[-i : 2 - i] = [(groups[1 - i][0], groups[-i][1] + groups[1 - i][1], groups[-i][2] + groups[1 - i][2])]
        merges, smaller = ladders.simplify(store, model, alpha=alpha, min_gap=gap)
        assert [(x.comparison, x.upper, x.lower, round(x.gap, 9), round(x.p, 6)) for x in merges] == expected
        assert (smaller is None) == (not expected)
    assert expected


def test_advice_puts_thresholds_where_matches_end(spark):
    """Known pairs that differ by one edit at most: the ladder should break after one."""
    rows = []
    for i in range(700):
        name = "".join("abcdefghij"[int(x)] for x in f"{i * 7919 % 100_000_007:09d}")
        rows += [(f"a{i}", name), (f"b{i}", name if i % 4 else "z" + name[1:])]
    schema = Schema.parse({"unique_id": "id", "columns": [{"name": "n"}], "comparisons": [{"columns": ["n"], "levels": [{"type": "null"}, {"type": "exact"}, {"type": "levenshtein", "threshold": 4}, {"type": "else"}]}]})
    linker = Linker(spark, schema, spark.createDataFrame(rows, "id string, n string"))
    truth = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(700)], "id_a string, id_b string")
    advice, better = linker.levels(truth)
    assert advice[0].now == [4] and advice[0].proposed == [1] and advice[0].bits_proposed >= advice[0].bits_now
    assert [v.type for v in better.comparisons[0].levels] == ["null", "exact", "levenshtein", "else"] and better.comparisons[0].levels[2].threshold == 1
    assert linker.levels(truth.limit(20))[0][0].refused


def test_drafts_follow_names_and_types(spark):
    rows = [("r1", "ann", "oak", datetime.date(1990, 1, 2), "a@x.org", "1000", 1.5, 50.0, 4.0, ["p", "q"], True, "blue")]
    frame = spark.createDataFrame(rows, "record_id string, firstName string, `Last Name` string, date_of_birth date, email_address string, ZIP string, score double, lat double, lng double, tags array<string>, active boolean, colour string")
    schema, roles, notes = draft.draft(frame)
    assert roles == {"record_id": "id", "firstName": "first_name", "Last Name": "surname", "date_of_birth": "birth_date", "email_address": "email", "ZIP": "postcode", "score": "number", "lat": "latitude", "lng": "longitude", "tags": "list", "active": "boolean", "colour": "text"}
    assert schema.unique_id == "record_id" and ("lat", "lng") in [c.columns for c in schema.comparisons]
    assert Schema.parse(schema.to_json()).to_dict() == schema.to_dict() and schema.blocking
    load(spark, frame, schema)
    again, other, _ = draft.draft(frame, roles={"colour": "ignore"})
    assert other["colour"] == "ignore" and "colour" not in [c.name for c in again.columns]
    with pytest.raises(ValueError):
        draft.draft(frame, roles={"colour": "shade"})


def test_models_from_text(spark, tmp_path):
    store = queries.part_store(spark, SF)
    model = queries.part_model(store)
    model.save(str(tmp_path / "m.json"))
    assert Model.load(str(tmp_path / "m.json")).to_dict() == model.to_dict()
