"""Scoring candidate pairs: bounds first, similarities next, term frequencies last, then the threshold.

Everything is one lazy plan. A code's base weight, and the range that term frequencies can move it in, come from a
table with a row per reachable code. Codes that cannot reach the threshold are dropped before any dictionary join.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.functions import text
from kithlink.functions.levels import agreement, best_possible, bound_columns, level_index, level_of, read_column
from kithlink.operators.blocking import Blocking
from kithlink.operators.classes import Classes, pair_count, weighted_pairs
from kithlink.operators.estimate import ball_masses, compared_columns, hash_share
from kithlink.operators.grades import graded, value_table
from kithlink.plans.model import Model
from kithlink.plans.schema import Schema
from kithlink.sources.store import Store

#: Up to so many codes get a table; beyond, the base weight is a sum of level weights.
TABLE_CODES = 1 << 18


@dataclass
class Adjustment:
    """A level whose weight depends on how common the value is."""

    comparison: int
    level: int
    column: str
    fuzzy: bool
    low: float
    high: float


class Scorer:
    """A model bound to a store."""

    def __init__(self, store: Store, model: Model, damping: float = 1.0, fuzzy: bool = False, interactions: bool = True, ball_budget: float = 4e10):
        model.check(store.schema)
        self.store, self.model, self.damping, self.with_interactions = store, model, damping, interactions
        self.classes: Classes | None = None
        self.balls: dict[int, DataFrame] = {}
        self.adjustments: list[Adjustment] = []
        for k, c in enumerate(store.schema.comparisons):
            if not c.term_frequency or store.schema.scalar_and_list(c) or damping == 0:
                continue
            for i, v in enumerate(c.levels):
                u = model.comparisons[k].levels[i].u
                if v.type == "exact" and u > 0:
                    name = read_column(store.schema, c, v)
                    if store.schema.type_of(name) in ("string", "date", "boolean"):
                        r = store.dictionary(name).agg(F.min("tf").alias("a"), F.max("tf").alias("b")).first()
                        if r.a:
                            n = store.records
                            self.adjustments.append(Adjustment(k, i, name, False, *sorted(damping * math.log2(u * n / x) for x in (r.a, r.b))))
                elif fuzzy and u > 0 and v.type in ("levenshtein", "jaro_winkler"):
                    if k not in self.balls:
                        found = ball_masses(store, k, ball_budget)
                        if found is None:
                            continue
                        self.balls[k] = found.checkpoint()
                    r = self.balls[k].where(F.col("level") == i).agg(F.min("records").alias("a"), F.max("records").alias("b")).first()
                    if r.a:
                        n = store.records
                        self.adjustments.append(Adjustment(k, i, c.columns[0], True, *sorted(damping * (math.log2(u) - math.log2(x / n)) for x in (r.a, r.b))))

    # -- per code

    def add_unseen(self, k: int, value: str) -> None:
        """Give a value that no record holds its ball: the records whose value lies on each fuzzy level from it, one at least."""
        schema, c = self.store.schema, self.store.schema.comparisons[k]
        if k not in self.balls or not self.store.dictionary(c.columns[0]).where(F.col("value") == value).isEmpty():
            return
        name = c.columns[0]
        words = self.store.dictionary(name).select(F.col("value").alias(f"a_{name}"), F.lit(value).alias(f"b_{name}"), "tf")
        found = {r.level: r.n for r in words.groupBy(level_index(replace(schema, comparisons=(c,), _by_name={}), c).alias("level")).agg(F.sum("tf").alias("n")).collect()}  # a row a level
        rows = [(value, i, max(int(found.get(i, 0)), 1)) for i, v in enumerate(c.levels) if v.type in ("levenshtein", "jaro_winkler")]
        self.balls[k] = self.balls[k].select("value", "level", "records").unionByName(self.store.spark.createDataFrame(rows, "value string, level int, records long"))

    def codes(self) -> list[tuple[int, float, float, float]] | None:
        """(code, base weight, least move, greatest move) of every reachable code; None if there are too many."""
        schema = self.store.schema
        if math.prod(len(c.levels) for c in schema.comparisons) > TABLE_CODES:
            return None
        moves = {(a.comparison, a.level): a for a in self.adjustments}
        out = []
        for levels in itertools.product(*(range(len(c.levels)) for c in schema.comparisons)):
            own = [moves[k, v] for k, v in enumerate(levels) if (k, v) in moves]
            out.append((schema.pack(list(levels)), self.model.base_weight(list(levels), self.with_interactions), float(sum(min(a.low, 0.0) for a in own)), float(sum(max(a.high, 0.0) for a in own))))
        return out

    def base_expression(self) -> Column:
        """Base weight from a code, without a table."""
        schema, w = self.store.schema, F.lit(self.model.prior)
        at = {c.name: level_of(schema, k) for k, c in enumerate(schema.comparisons)}
        for k, c in enumerate(self.model.comparisons):
            w = w + F.element_at(F.array(*(F.lit(v.weight) for v in c.levels)), level_of(schema, k) + 1)
        for t in self.model.interactions if self.with_interactions else []:
            w = w + F.element_at(F.array(*map(F.lit, t.bits)), at[t.left] * t.right_levels + at[t.right] + 1)
        return w

    def ceiling(self, graded: frozenset = frozenset()) -> Column:
        """No pair of a's and b's values can weigh more."""
        moves: dict[tuple[int, int], float] = {(a.comparison, a.level): max(a.high, 0.0) for a in self.adjustments}
        top = F.lit(self.model.prior + sum(max([0.0, *t.bits]) for t in self.model.interactions if self.with_interactions))
        for k, c in enumerate(self.store.schema.comparisons):
            top = top + best_possible(self.store.schema, c, [v.weight + moves.get((k, i), 0.0) for i, v in enumerate(self.model.comparisons[k].levels)], graded)
        return top

    # -- frames

    def based(self, coded: DataFrame, threshold: float | None, bounds: bool) -> DataFrame:
        """``base`` joined to codes; with bounds, codes that cannot reach the threshold go before any further join."""
        table = self.codes()
        if table is None:
            return coded.withColumn("base", self.base_expression())
        if bounds and threshold is not None:
            table = [r for r in table if r[1] + r[3] >= threshold - 1e-9]
        spark = self.store.spark
        frame = spark.createDataFrame(table or [(-1, 0.0, 0.0, 0.0)], "gamma long, base double, least double, greatest double")
        return coded.join(F.broadcast(frame.drop("least", "greatest")), "gamma")  # a row a code, at most TABLE_CODES

    def weighed(self, based: DataFrame) -> DataFrame:
        """``match_weight``: base and the term-frequency moves, by left joins of dictionaries on the values that need them."""
        out, n = based.withColumn("match_weight", F.col("base")), self.store.records
        for j, a in enumerate(self.adjustments):
            u = self.model.comparisons[a.comparison].levels[a.level].u
            here = level_of(self.store.schema, a.comparison) == a.level
            if a.fuzzy:
                masses = self.balls[a.comparison].where(F.col("level") == a.level).select("value", "records")
                for s in "ab":
                    out = out.withColumn(f"__f{j}{s}", F.when(here, F.col(f"{s}_{a.column}")))
                    out = out.join(masses.select(F.col("value").alias(f"__f{j}{s}"), F.col("records").alias(f"__m{j}{s}")), f"__f{j}{s}", "left")
                both = (F.log2(F.col(f"__m{j}a") / n) + F.log2(F.col(f"__m{j}b") / n)) / 2
                move = F.coalesce(F.lit(self.damping) * (math.log2(u) - both), F.lit(0.0))
                out = out.withColumn("match_weight", F.col("match_weight") + F.when(here, move).otherwise(0.0)).drop(*(f"__{x}{j}{s}" for x in "fm" for s in "ab"))
            else:
                counts = self.store.dictionary(a.column).select(F.col("value").alias(f"__v{j}"), F.col("tf").alias(f"__t{j}"))
                out = out.withColumn(f"__v{j}", F.when(here, F.col(f"a_{a.column}"))).join(counts, f"__v{j}", "left")
                move = F.coalesce(F.lit(self.damping) * F.log2(F.lit(u * n) / F.col(f"__t{j}")), F.lit(0.0))
                out = out.withColumn("match_weight", F.col("match_weight") + F.when(here, move).otherwise(0.0)).drop(f"__v{j}", f"__t{j}")
        return out.withColumn("match_probability", text.probability_of(F.col("match_weight")))


def in_bits(threshold: float | None, probability: float | None) -> float | None:
    return text.weight_of(probability) if probability is not None else threshold


def scored_pairs(store: Store, model: Model, threshold: float | None = None, all_pairs: bool = False, ceiling: bool = True, bounds: bool = True, signatures: bool = True, ladders: bool = True, damping: float = 1.0, fuzzy_tf: bool = False, interactions: bool = True, ball_budget: float = 4e10, extra: list[str] | None = None, by_class: bool = False) -> tuple[DataFrame, Scorer]:
    """Candidate pairs (``by_class``: of classes, if the scorer then has ``classes``) with ``gamma``, ``match_weight`` and ``match_probability``; no threshold is applied beyond what the bounds may drop.

    Results are the same without any of: ``signatures`` (masks and lengths before similarities), ``ladders`` (fuzzy levels from tables of value
    pairs), ``ceiling`` (pairs that cannot reach the threshold go before they are coded; it needs the signatures), ``bounds`` (the same for codes).
    """
    schema = store.schema.for_purpose("predict", all_pairs)
    scorer = Scorer(store, model, damping, fuzzy_tf, interactions, ball_budget)
    blocking = Blocking(store, schema.blocking)
    masks = bound_columns(schema) if signatures else {}
    columns, known = [*compared_columns(schema), *(extra or [])], frozenset()
    scorer.classes = Classes.of(blocking, columns) if by_class else None
    if scorer.classes is not None:
        pairs = scorer.classes.pairs(columns, masks)
    else:
        pairs = blocking.pairs([*columns, *masks], frame=blocking.frame.withColumns(masks) if masks else None)
    if ladders:
        pairs, known = graded(store, pairs, schema)
    if ceiling and signatures and threshold is not None:
        pairs = pairs.where(scorer.ceiling(known) >= threshold - 1e-9)
    coded = pairs.withColumn("gamma", agreement(schema, bool(masks), known))
    return scorer.weighed(scorer.based(coded, threshold, bounds)), scorer


def zones(store: Store, model: Model, threshold: float | None = None, probability: float | None = None, all_pairs: bool = False, damping: float = 1.0, fuzzy_tf: bool = False, interactions: bool = True, ball_budget: float = 4e10) -> DataFrame:
    """(zone, codes, pairs) of the candidates: by base weight and the range that term frequencies can move it in, a code's pairs are
    certainly below the threshold (drop), certainly at it or above (certain), or in need of their term frequencies (check).

    Beyond ``TABLE_CODES`` reachable codes every pair is in need of checking.
    """
    least = in_bits(threshold, probability)
    least = 0.0 if least is None else least
    schema = store.schema.for_purpose("predict", all_pairs)
    scorer = Scorer(store, model, damping, fuzzy_tf, interactions, ball_budget)
    blocking, masks = Blocking(store, schema.blocking), bound_columns(schema)
    pairs, known = graded(store, weighted_pairs(blocking, compared_columns(schema), masks), schema)
    counted = pairs.groupBy(agreement(schema, True, known).alias("gamma")).agg(pair_count(pairs).alias("n"))
    table = scorer.codes()
    if table is None:
        return counted.agg(F.lit("check").alias("zone"), F.count("*").alias("codes"), F.sum("n").alias("pairs"))
    rows = [(g, "drop" if base + high < least - 1e-9 else "certain" if base + low >= least else "check") for g, base, low, high in table]
    named = F.broadcast(store.spark.createDataFrame(rows, "gamma long, zone string"))  # a row a code, at most TABLE_CODES
    return counted.join(named, "gamma").groupBy("zone").agg(F.count("*").alias("codes"), F.sum("n").alias("pairs"))


@dataclass
class PlanReport:
    """What a prediction will do, from key counts and the model alone: no pair is made."""

    records: int
    mode: str
    pair_space: int
    threshold: float
    sources: list[tuple[str, int, int]]
    codes: int | None
    reachable: int | None
    term_frequencies: list[str]
    value_tables: list[str]


def plan(store: Store, model: Model, threshold: float | None = None, probability: float | None = None, all_pairs: bool = False, damping: float = 1.0, fuzzy_tf: bool = False, interactions: bool = True) -> PlanReport:
    """Sources with their pairs and largest groups, codes and those that can reach the threshold, columns with term frequencies, and columns whose fuzzy levels come from a table."""
    least = in_bits(threshold, probability)
    least = 0.0 if least is None else least
    schema = store.schema.for_purpose("predict", all_pairs)
    scorer, blocking = Scorer(store, model, damping, fuzzy_tf, interactions), Blocking(store, schema.blocking)
    prices = [(b.name, c["pairs"], c["largest"]) for b, c in ((b, blocking.counts(k)) for k, b in enumerate(blocking.bound))]
    table = scorer.codes()
    tables = [c.columns[0] for c in schema.comparisons if value_table(store, c) is not None]
    reach = None if table is None else sum(base + high >= least - 1e-9 for _, base, _, high in table)
    return PlanReport(store.records, store.mode, store.pair_space, least, prices, None if table is None else len(table), reach, [a.column for a in scorer.adjustments], tables)


def edges(store: Store, scored: DataFrame) -> DataFrame:
    """The prediction table's columns; data set names beside ids over several inputs."""
    ids = [F.col("a___id").alias("id_a"), F.col("b___id").alias("id_b")]
    if len(store.names) > 1:
        names = F.array(*map(F.lit, store.names))
        ids = [names[F.col("a___ds")].alias("dataset_a"), ids[0], names[F.col("b___ds")].alias("dataset_b"), ids[1]]
    return scored.select(*ids, "gamma", "match_weight", "match_probability", F.col("a___row").alias("row_a"), F.col("b___row").alias("row_b"))


def predict(store: Store, model: Model, threshold: float | None = None, probability: float | None = None, limit: int = 0, spill: str | None = None, spill_sample: float = 0.0, seed: int = 20260903, **options) -> DataFrame:
    """The predictions at or above the threshold (0 bits if none is given).

    With ``spill``, the rows above it and a hash sample of all candidates are also written, with a manifest, for ``rescore``.
    """
    least = in_bits(threshold, probability)
    least = 0.0 if least is None else least
    if spill and spill_sample > 0:
        options |= {"ceiling": False, "bounds": False}
    scored, scorer = scored_pairs(store, model, least, by_class=not (spill and spill_sample > 0), **options)  # a sample is of record pairs
    above = scored.where(F.col("match_weight") >= least)
    if scorer.classes is not None:
        held = {n: F.col(n) for n in ("__id", *(["__ds"] if len(store.names) > 1 else []))}
        above = scorer.classes.expand(above, ["gamma", "match_weight", "match_probability"], held)
    if spill:
        kept = scored.where((F.col("match_weight") >= least) | hash_share(spill_sample, seed, "a___row", "b___row")) if spill_sample else above
        kept.select(F.col("a___row").alias("row_a"), F.col("b___row").alias("row_b"), "gamma").write.mode("overwrite").parquet(f"{spill}/pairs")
        manifest = {"layout": layout(store.schema), "records": store.records, "threshold": least, "sample": spill_sample}
        store.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{spill}/manifest")
    out = edges(store, above)
    return out.limit(limit) if limit else out


def predict_classes(store: Store, model: Model, threshold: float) -> tuple[DataFrame, Classes] | None:
    """Predictions between classes, ``row_a`` and ``row_b`` being classes (one and the same for records that are equal); None where records have to meet."""
    scored, scorer = scored_pairs(store, model, threshold, by_class=True)
    if scorer.classes is None:
        return None
    names = [F.col("a___row").alias("row_a"), F.col("b___row").alias("row_b"), F.col("a___n").alias("n_a"), F.col("b___n").alias("n_b")]
    return scored.where(F.col("match_weight") >= threshold).select(*names, "gamma", "match_weight", "match_probability"), scorer.classes


def layout(schema: Schema) -> str:
    """What a code means; two schemas with one layout can share codes."""
    return ";".join(f"{c.name}:{s}:{','.join(v.describe() for v in c.levels)}" for c, s in zip(schema.comparisons, schema.shifts, strict=True))


def rescore(store: Store, model: Model, spill: str, threshold: float | None = None, probability: float | None = None, limit: int = 0, damping: float = 1.0, bounds: bool = True, fuzzy_tf: bool = False, interactions: bool = True) -> tuple[DataFrame, list[str]]:
    """A spill's pairs under a new model, without comparing again: (predictions, warnings)."""
    manifest = json.loads(store.spark.read.text(f"{spill}/manifest").first().value)
    if manifest["layout"] != layout(store.schema):
        raise ValueError("the spill was written under other comparisons")
    if manifest["records"] != store.records:
        raise ValueError(f"the spill is of {manifest['records']} records, the data has {store.records}")
    least = in_bits(threshold, probability)
    least = 0.0 if least is None else least
    warnings = [f"pairs below {manifest['threshold']} bits were not all spilled"] if least < manifest["threshold"] and manifest["sample"] < 1 else []
    scorer = Scorer(store, model, damping, fuzzy_tf, interactions)
    columns = [a.column for a in scorer.adjustments]
    frame = store.frame.select("__row", "__ds", "__id", *dict.fromkeys(columns))
    a, b = (frame.select(*(F.col(c).alias(f"{s}_{c}") for c in frame.columns)) for s in "ab")
    coded = store.spark.read.parquet(f"{spill}/pairs").withColumnsRenamed({"row_a": "a___row", "row_b": "b___row"}).join(a, "a___row").join(b, "b___row")
    out = edges(store, scorer.weighed(scorer.based(coded, least, bounds)).where(F.col("match_weight") >= least))
    return (out.limit(limit) if limit else out), warnings


def write_edges(df: DataFrame, out: str, form: str | None = None) -> None:
    """A directory of parquet (or of ``form``), or one file where the name ends in .csv, .parquet or .pq; a file's name says its form, so stating one beside it is refused."""
    if form and out.endswith((".csv", ".parquet", ".pq")):
        raise ValueError(f"{out!r} is a file, whose name states its form; a form may be stated for a directory only")
    if form not in (None, "csv", "parquet"):
        raise ValueError(f"a form is csv or parquet, not {form!r}")
    wanted = df.drop("row_a", "row_b")
    if out.endswith(".csv"):
        _single(wanted.withColumns({"match_weight": F.format_string("%.6f", "match_weight"), "match_probability": F.format_string("%.9f", "match_probability")}), out, "csv")
    elif out.endswith((".parquet", ".pq")):
        _single(wanted, out, "parquet")
    elif form == "csv":
        wanted.write.mode("overwrite").option("header", True).csv(out)
    else:
        wanted.write.mode("overwrite").parquet(out)


def _single(df: DataFrame, out: str, form: str) -> None:
    """One file under a stated name, on any file system Spark writes to."""
    spark, folder = df.sparkSession, f"{out}.parts"
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(folder) if form == "csv" else writer.parquet(folder)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-"))
    fs.delete(path(out), False)
    fs.rename(part, path(out))
    fs.delete(path(folder), True)


def truncated(found: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """At most ``limit`` predictions, in no order, and whether there were more."""
    held = found.limit(limit + 1).checkpoint()
    return held.limit(limit), held.count() > limit


def merge_predictions(spark, shards: str, out: str, threshold: float | None = None, probability: float | None = None) -> int:
    """A directory of predictions as one file; rows written."""
    df = read_edges(spark, shards)
    least = in_bits(threshold, probability)
    df = df if least is None else df.where(F.col("match_weight") >= least)
    n = df.count()
    write_edges(df, out)
    return n


def read_edges(spark, source) -> DataFrame:
    """Predictions from a frame, a parquet file or directory, or csv; the columns are checked."""
    df = source if isinstance(source, DataFrame) else spark.read.option("header", True).option("inferSchema", False).csv(source) if str(source).endswith(".csv") else spark.read.parquet(source)
    lacking = [c for c in ("id_a", "id_b", "match_weight") if c not in df.columns]
    if lacking:
        raise ValueError(f"the predictions have no column {lacking[0]!r}")
    kinds = {"gamma": "long", "match_weight": "double", "match_probability": "double"}
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items() if c in df.columns})
