"""Command line: ``python -m kithlink COMMAND ...``. Inputs are parquet; reports are printed as JSON, tables are written where ``--out`` says."""

from __future__ import annotations

import argparse
import dataclasses
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.functions.levels import level_of
from kithlink.linker import Linker, cluster_file, gen_sample, gen_two, init, merge_predictions
from kithlink.operators.estimate import EstimateOptions
from kithlink.operators.explain import code_layout
from kithlink.operators.predict import _single, read_edges
from kithlink.plans.schema import Schema


def plain(x):
    """Reports as JSON values."""
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        out = {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
        return out | {n: getattr(x, n) for n in dir(type(x)) if isinstance(getattr(type(x), n, None), property)}
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, DataFrame):
        return [r.asDict() for r in x.collect()]
    return x


def show(x) -> None:
    print(json.dumps(plain(x), indent=2, default=str))


def write(df: DataFrame, out: str | None) -> None:
    if out is None:
        df.show(50, False)
    elif out.endswith((".csv", ".parquet", ".pq")):
        _single(df, out, "csv" if out.endswith(".csv") else "parquet")
    else:
        df.write.mode("overwrite").parquet(out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kithlink", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, data: bool = True, schema: bool = True, **typed):
        p = commands.add_parser(name)
        if schema:
            p.add_argument("--schema", required=True)
            p.add_argument("--mode", choices=("dedup", "link", "link-and-dedup"))
            p.add_argument("--all-pairs", action="store_true")
        if data:
            p.add_argument("data", nargs="+")
        for f in flags:
            p.add_argument(f"--{f}", action="store_true")
        for n, kind in typed.items():
            p.add_argument(f"--{n.replace('_', '-')}", dest=n, type=kind)
        return p

    cut = {"threshold": float, "probability": float}
    p = command("init", schema=False, out=str, id=str)
    p.add_argument("--role", action="append", default=[], metavar="COLUMN=ROLE")
    command("inspect")
    command("profile", "no-pairs", "no-anchors", truth=str, sample_rows=int, expected_matches=int, anchor_rows=int, anchor_pair_budget=int, anchor_margin=float, seed=int)
    command("levels", truth=str, out=str, levels=int, most=int, floor=float, step=float, edits=int, min_pairs=int)
    command("simplify", model=str, out=str, alpha=float, min_gap=float, pair_cap=int, seed=int)
    p = command("explain", "rows", "fuzzy-tf", "no-interactions", model=str, pairs=str, out=str, tf_damping=float, **cut)
    p.add_argument("--pair", nargs=2)
    p.add_argument("--row-pairs", dest="row_pairs")
    p.add_argument("--predictions")
    p.add_argument("--json", action="store_true")
    command("explain-blocking", "count")
    p = command("recall", "why", "count", truth=str)
    p.add_argument("--show-misses", dest="misses", type=int, default=0)
    command("completeness", "bound-only", "pair-weighting", model=str, sample=float, min_observed=int, seed=int)
    command("estimate", "no-tie-holdout", "interactions", "fuzzy-u", out=str, u_sample=int, session_pairs=int, iterations=int, lambda_=float, seed=int, tied_bits=float, tie_sample_rows=int, max_interactions=int, interaction_bits=float, interaction_clamp=float, min_interaction_sessions=int, ball_budget=float)
    command("predict", "no-bounds", "no-ceiling", "no-signatures", "no-ladders", "no-interactions", "fuzzy-tf", "plan", "zones", model=str, out=str, limit=int, tf_damping=float, ball_budget=float, spill=str, spill_sample=float, **cut).add_argument("--format", choices=("csv", "parquet"))
    command("cluster", predictions=str, out=str, truth=str, min_size=int, **cut)
    command("merge-predictions", data=False, schema=False, shards=str, out=str, **cut)
    command("rescore", "no-bounds", "no-interactions", "fuzzy-tf", model=str, spill=str, out=str, limit=int, tf_damping=float, **cut)
    command("gen-sample", data=False, schema=False, out=str, out_b=str, truth=str, rows=int, seed=int, duplicate_rate=float)
    p = command("search", "json", "explain", "fuzzy-tf", "no-interactions", model=str, k=int, clusters=str, expected_matches=float, prior_weight=float, tf_damping=float, **cut)
    p.add_argument("--field", action="append", default=[], metavar="COLUMN=VALUE")
    return top


def given(a: argparse.Namespace, *names: str, **renamed: str) -> dict:
    """Options that were stated, under the names the functions use."""
    found = {n: getattr(a, n) for n in names} | {new: getattr(a, old) for old, new in renamed.items()}
    out = {n: v for n, v in found.items() if v is not None}
    for flag in ("bounds", "ceiling", "interactions", "signatures", "ladders"):
        if getattr(a, f"no_{flag}", False):
            out[flag] = False
    if getattr(a, "fuzzy_tf", False):
        out["fuzzy_tf"] = True
    return out


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kithlink").getOrCreate()
    if a.command == "gen-sample":
        if a.out_b:
            first, second, truth = gen_two(spark, **given(a, "rows", "duplicate_rate", "seed"))
            write(second, a.out_b)
        else:
            first, truth = gen_sample(spark, **given(a, "rows", "duplicate_rate", "seed"))
        write(first, a.out)
        return write(truth, a.truth) if a.truth else None
    if a.command == "merge-predictions":
        return show({"rows": merge_predictions(spark, a.shards, a.out, **given(a, "threshold", "probability"))})
    if a.command == "init":
        schema, roles, notes = init([spark.read.parquet(p) for p in a.data], a.id, dict(r.split("=", 1) for r in a.role))
        Path(a.out).write_text(schema.to_json()) if a.out else print(schema.to_json())
        return show({"roles": roles, "notes": notes})
    data = a.data if len(a.data) > 1 else a.data[0]
    if a.command == "cluster" and not a.truth:
        return write(cluster_file(spark, Schema.load(a.schema), data, a.predictions, **given(a, "threshold", "probability", "min_size")).drop("row"), a.out)
    linker = Linker(spark, Schema.load(a.schema), data, a.mode, a.all_pairs)
    if a.command == "inspect":
        return linker.inspect().show(1000, False)
    if a.command == "profile":
        return show(linker.profile(pairs=not a.no_pairs, anchors=not a.no_anchors, **given(a, "truth", "sample_rows", "expected_matches", "anchor_rows", "anchor_pair_budget", "anchor_margin", "seed")))
    if a.command in ("levels", "simplify"):
        call = linker.levels if a.command == "levels" else lambda **o: linker.simplify(a.model, **o)
        report, schema = call(**given(a, *(("truth", "levels", "most", "floor", "step", "edits", "min_pairs") if a.command == "levels" else ("alpha", "min_gap", "pair_cap", "seed"))))
        if a.out and schema:
            Path(a.out).write_text(schema.to_json())
        return show(report)
    if a.command == "explain":
        options = given(a, tf_damping="damping")
        if a.pairs or a.row_pairs or a.predictions:
            table = read_edges(spark, a.predictions) if a.predictions else spark.read.option("header", True).csv(a.pairs or a.row_pairs)
            table = table.select(*(F.col(c).cast("long").alias(c) for c in ("row_a", "row_b"))) if a.row_pairs else table
            found = linker.waterfalls(a.model, table, **options)
            return show(found) if a.json else write(found, a.out)
        return show({"layout": code_layout(linker.store), "pair": linker.explain(*a.pair, a.model, a.rows, **(options if a.model else {}))})
    if a.command == "explain-blocking":
        return show(linker.explain_blocking(a.count))
    if a.command == "recall":
        return show(linker.recall(a.truth, why=a.why, count=a.count, misses=a.misses))
    if a.command == "completeness":
        return show(linker.completeness(a.model, bound_only=a.bound_only, pair_weighting=a.pair_weighting, **given(a, "sample", "min_observed", "seed")))
    if a.command == "estimate":
        names = {f.name for f in dataclasses.fields(EstimateOptions)} - {"tie_holdout", "start_lambda", "tolerance"}
        model, report = linker.estimate(a.out, EstimateOptions(tie_holdout=not a.no_tie_holdout, **{n: getattr(a, n) for n in names if getattr(a, n, None) is not None}))
        return show({"model": model.to_dict(), "report": report})
    if a.command == "predict":
        if a.plan:
            return show(linker.plan(a.model, **given(a, "threshold", "probability", tf_damping="damping")))
        if a.zones:
            return show(linker.zones(a.model, **given(a, "threshold", "probability", "ball_budget", tf_damping="damping")))
        found = linker.predict(a.model, a.out, **given(a, "threshold", "probability", "limit", "ball_budget", "spill", "spill_sample", tf_damping="damping", format="form"))
        if linker.last_truncated:
            print(f"more than {a.limit} predictions; the rest is left out")
        return write_if(found, a.out)
    if a.command == "rescore":
        return write_if(linker.rescore(a.model, a.spill, a.out, **given(a, "threshold", "probability", "limit", tf_damping="damping")), a.out)
    if a.command == "cluster":
        found = linker.cluster(a.predictions, a.out, a.truth, **given(a, "threshold", "probability", "min_size"))
        show(linker.last_quality)
        return write_if(found.drop("row"), a.out)
    clusters = None
    if a.clusters:
        clusters = spark.read.option("header", True).csv(a.clusters) if a.clusters.endswith(".csv") else spark.read.parquet(a.clusters)
    found = linker.search(a.field, a.model, clusters=clusters, **given(a, "k", "threshold", "probability", "expected_matches", "prior_weight", tf_damping="damping"))
    if a.explain:
        found = found.select("*", *(level_of(linker.schema, k).alias(f"{c.name}_level") for k, c in enumerate(linker.schema.comparisons)))
    return show(found) if a.json else found.show(1000, False)


def write_if(df: DataFrame, out: str | None) -> None:
    if out is None:
        df.show(50, False)


if __name__ == "__main__":
    main()
