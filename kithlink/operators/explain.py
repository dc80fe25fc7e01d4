"""Why a pair scores what it scores: levels, and the waterfall of bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.functions.levels import agreement, level_of
from kithlink.operators.estimate import compared_columns
from kithlink.operators.predict import Scorer
from kithlink.plans.model import Model
from kithlink.sources.store import Store


def pair_frame(store: Store, pairs: DataFrame) -> DataFrame:
    """The records of (row_a, row_b) side by side, the smaller row first."""
    rows = pairs.select(F.least("row_a", "row_b").alias("a___row"), F.greatest("row_a", "row_b").alias("b___row"))
    frame = store.frame.select("__row", "__ds", "__id", *compared_columns(store.schema))
    for s in "ab":
        rows = rows.join(frame.select(*(F.col(c).alias(f"{s}_{c}") for c in frame.columns)), f"{s}___row")
    return rows


def _said(x):
    return x if isinstance(x, str) else x.cast("string")


def waterfalls(store: Store, model: Model, pairs: DataFrame, threshold: float = 0.0, damping: float = 1.0, fuzzy_tf: bool = False, interactions: bool = True) -> DataFrame:
    """A wide row per pair: ids, code, prior, weights and, per comparison, level, label, level bits and term-frequency bits; per two-way term its bits; and running totals."""
    scorer = Scorer(store, model, damping, fuzzy_tf, interactions)
    schema = store.schema
    coded = pair_frame(store, pairs).withColumn("gamma", agreement(schema))
    scored = scorer.weighed(scorer.based(coded, None, False))
    out = {
        "id_a": F.col("a___id"), "id_b": F.col("b___id"), "row_a": F.col("a___row"), "row_b": F.col("b___row"), "gamma": F.col("gamma"), "prior_bits": F.lit(model.prior), "base_bits": F.col("base"),
        "match_weight": F.col("match_weight"), "match_probability": F.col("match_probability"), "threshold": F.lit(float(threshold)), "is_match": F.col("match_weight") >= threshold,
    }
    running = F.lit(model.prior)
    # the moves of single comparisons, by scoring with one adjustment at a time
    n = store.records
    for k, (c, fit) in enumerate(zip(schema.comparisons, model.comparisons, strict=True)):
        level = level_of(schema, k)
        weight = F.element_at(F.array(*(F.lit(v.weight) for v in fit.levels)), level + 1)
        tf = F.lit(0.0)
        for j, a in enumerate(scorer.adjustments):
            if a.comparison == k and not a.fuzzy:
                counts = store.dictionary(a.column).select(F.col("value").alias(f"__w{j}"), F.col("tf").alias(f"__c{j}"))
                scored = scored.withColumn(f"__w{j}", F.when(level == a.level, F.col(f"a_{a.column}"))).join(counts, f"__w{j}", "left")
                tf = tf + F.coalesce(F.lit(damping) * F.log2(F.lit(fit.levels[a.level].u * n) / F.col(f"__c{j}")), F.lit(0.0))
        running = running + weight + tf
        out |= {f"{c.name}_level": level, f"{c.name}_label": F.element_at(F.array(*(F.lit(v.describe()) for v in c.levels)), level + 1), f"{c.name}_bits": weight, f"{c.name}_tf_bits": tf, f"{c.name}_total": running}
    at = {c.name: level_of(schema, k) for k, c in enumerate(schema.comparisons)}
    for t in model.interactions if interactions else []:
        out[f"{t.left}_x_{t.right}_bits"] = F.element_at(F.array(*map(F.lit, t.bits)), at[t.left] * t.right_levels + at[t.right] + 1)
    if fuzzy_tf:  # what fuzzy masses moved is the rest
        out["fuzzy_tf_bits"] = F.col("match_weight") - running
    return scored.select(*(x.alias(name) for name, x in out.items()))


def explain_rows(store: Store, row_a: int, row_b: int, model: Model | None = None, **options) -> dict:
    """One pair as a dict: the level of each comparison, and with a model the waterfall."""
    pairs = store.spark.createDataFrame([(row_a, row_b)], "row_a long, row_b long")
    if model is not None:
        return waterfalls(store, model, pairs, **options).first().asDict()
    schema = store.schema
    r = pair_frame(store, pairs).select(agreement(schema).alias("gamma")).first()
    return {"gamma": r.gamma, **{c.name: c.levels[v].describe() for c, v in zip(schema.comparisons, schema.unpack(r.gamma), strict=True)}}


def code_layout(store: Store) -> list[dict]:
    """Where each comparison sits in a code."""
    schema = store.schema
    return [{"comparison": c.name, "shift": s, "bits": c.bits, "levels": [v.describe() for v in c.levels]} for c, s in zip(schema.comparisons, schema.shifts, strict=True)]
