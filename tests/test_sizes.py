"""Registered queries against their SQL on tables that small copies do not resemble: several files, odd values, many equal rows."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from kithlink import queries
from kithlink.operators import blocking as blocking_module
from kithlink.operators.classes import Classes

DOCUMENTS = "doc_id long, text string"
PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def in_files(spark, folder, name, rows, schema, ends=()):
    """A table written as one file per stretch of its rows; Spark reads the larger files first."""
    for a, b in zip((0, *ends), (*ends, len(rows)), strict=True):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def by_both(spark, folder, name, *tables):
    """The query's rows and its SQL's, sorted."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in df.columns)} FROM ({queries.SQL[name]})").fetchall()
    return sorted((tuple(r) for r in df.collect()), key=str), sorted(want, key=str)


@pytest.mark.parametrize("name", ["cluster_documents", "cluster_sizes", "viewer_list", "viewer_summary"])
def test_copies_are_named_by_their_least_id(spark, tmp_path, name):
    """The file with the larger ids is the larger one, and two documents have no text."""
    rows = [(i, None if i in (3, 41) else f"text {i % 17}" if i % 3 else f"long text {i} " * (50 if i > 20 else 1)) for i in range(120)]
    in_files(spark, tmp_path, "documents", rows, DOCUMENTS, (20,))
    got, want = by_both(spark, tmp_path, name, "documents")
    assert got == want and got


@pytest.mark.parametrize("copies", [1, 120])
def test_prices_where_no_group_is_left(spark, tmp_path, copies):
    """One name each, so no exact value is shared; one size for all, so none is rare."""
    rows = [(i, f"name {i if copies == 1 else i % 9}", "b", "t", i if copies == 1 else 1, 1.0) for i in range(120)]
    in_files(spark, tmp_path, "part", rows, PARTS)
    got, want = by_both(spark, tmp_path, "price_blocking", "part")
    assert got == want and None in [r[2] for r in got]


def test_halves_are_rounded_to_even(spark, tmp_path):
    """As the SQL's cast does; the window then holds other pairs than with halves rounded up."""
    in_files(spark, tmp_path, "customer", [(i, i + 0.5) for i in range(60)], "c_custkey long, c_acctbal double")
    in_files(spark, tmp_path, "supplier", [(i, i * 2 - 20.5) for i in range(40)], "s_suppkey long, s_acctbal double")
    got, want = by_both(spark, tmp_path, "price_window_link", "customer", "supplier")
    assert got == want


def repeated(spark, folder, monkeypatch):
    """Tables whose rows repeat with other keys, so classes are far fewer than records; chunks are small."""
    monkeypatch.setattr(blocking_module, "CELL", 3)
    monkeypatch.setattr(blocking_module, "LARGE_CELL", 5)
    names, types = ["blue ring", "blue rings", "old bolt", "old bolts", "hot plate"], ["SMALL", "LARGE", "ECONOMY", "SMALLER"]
    parts = [(i, names[i * i % 5], f"Brand#{i % 3}", types[i % 12 // 4], (i * 5) % 15 + 1, 900.0 + 30 * (i % 3)) for i in range(240)]
    in_files(spark, folder, "part", parts, PARTS, (60,))
    in_files(spark, folder, "supplier", [(i, f"S{i}", i % 4, float(i % 6) * 700) for i in range(90)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", (30,))
    in_files(spark, folder, "customer", [(i, f"C{i}", i % 5, float(i % 7) * 690) for i in range(70)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double", (20,))


PAIRED = ["block_exact_value", "block_union", "block_all_pairs", "block_link", "levels_number", "levels_geo", "pattern_histogram", "level_marginals", "levels_with_holes", "zones_part", "union_count", "predict_part", "rescore_part", "predictions_round_trip", "waterfall_part"]


@pytest.mark.parametrize("name", PAIRED)
def test_classes_make_the_pairs_of_their_records(spark, tmp_path, monkeypatch, name):
    repeated(spark, tmp_path, monkeypatch)
    used = []
    made = Classes.pairs
    monkeypatch.setattr(Classes, "pairs", lambda self, *a, **k: used.append(self.count) or made(self, *a, **k))
    got, want = by_both(spark, tmp_path, name, "part", "supplier", "customer")
    assert got == want and got
    assert used and max(used) <= 120  # classes meet, not 240 parts


@pytest.mark.parametrize("name", ["block_minhash", "estimate_model", "estimate_interactions", "simplify_part"])
def test_classes_change_no_result(spark, tmp_path, monkeypatch, name):
    """Where there is no SQL: as with every record alone."""
    repeated(spark, tmp_path, monkeypatch)
    rounded = lambda: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
    got = rounded()
    monkeypatch.setattr(Classes, "of", staticmethod(lambda *a, **k: None))
    assert got == rounded() and got


@pytest.mark.parametrize("name", ["viewer_rejected", "waterfall_part"])
def test_copies_of_parts(spark, tmp_path, name):
    """Each part three times, with other keys."""
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    for i in range(3):
        parts.withColumn("p_partkey", F.col("p_partkey") + 1000 * i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/part.parquet")
    got, want = by_both(spark, tmp_path, name, "part")
    assert got == want and got


def test_components_need_no_pairs(spark, tmp_path, monkeypatch):
    """As many edges as records at most, and the SQL's components: gaps at the limit and beyond, equal values, nulls and single records."""
    values = [0.0, 2500.0, 5000.5, 5000.5, 7600.0, -3000.0, None, 12000.0]
    in_files(spark, tmp_path, "supplier", [(i * 7 % 64, f"S{i}", i % 5 if i % 9 else None, values[i * i % 8]) for i in range(64)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", (20,))
    edges = []
    made = queries.connected_components
    monkeypatch.setattr(queries, "connected_components", lambda e, *ends: edges.append(e.count()) or made(e, *ends))
    got, want = by_both(spark, tmp_path, "components", "supplier")
    assert got == want and got and edges[0] < 64
