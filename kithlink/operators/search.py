"""Top-k search: one described record, or a frame of them (``search_many``), against all stored ones.

The query is a one-row frame of side b; the stored rows are side a, so term frequencies are those of the stored value.
No blocking and no join of rows: the query's values are broadcast (a single row), each distinct value of a column is compared with the
query's once, a bound drops rows that cannot enter, and the best k come from a bounded heap per task.
"""

from __future__ import annotations

import datetime
import math
import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.functions import text
from kithlink.functions.levels import agreement, bound_columns
from kithlink.operators.estimate import compared_columns
from kithlink.operators.grades import blocked, graded, graded_against
from kithlink.operators.predict import Scorer, in_bits
from kithlink.plans.model import Model
from kithlink.sources.store import Store

SPARK_TYPES = {"string": "string", "string_list": "array<string>", "date": "date", "double": "double", "boolean": "boolean"}


def parse_field(stated: str) -> tuple[str, str]:
    """``column=value``."""
    name, mark, value = stated.partition("=")
    if not mark or not name:
        raise ValueError(f"a query field is column=value, not {stated!r}")
    return name, value


def query_record(store: Store, fields) -> dict:
    """Typed values by column from a mapping or from ``column=value`` texts; a repeated column is a list's elements."""
    if not isinstance(fields, dict):
        gathered: dict = {}
        for name, value in map(parse_field, fields):
            gathered.setdefault(name, []).append(value)
        fields = {n: v if store.schema.type_of(n) == "string_list" else v[-1] for n, v in gathered.items()}
    out = {}
    for name, value in fields.items():
        c, kind = store.schema.column(name), store.schema.type_of(name)
        if c.source:
            raise ValueError(f"{name!r} is derived; give {c.source!r}")
        if value is None:
            continue
        if kind == "date":
            if not isinstance(value, datetime.date) and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(value)):
                raise ValueError(f"{name!r} is a date such as 2020-12-31, not {value!r}")
            out[name] = value if isinstance(value, datetime.date) else datetime.date.fromisoformat(value)
        elif kind == "double":
            x = float(value)
            if not math.isnan(x):
                out[name] = x
        elif kind == "boolean":
            known = dict.fromkeys(("true", "t", "yes", "y", "1"), True) | dict.fromkeys(("false", "f", "no", "n", "0"), False)
            if not isinstance(value, bool) and str(value).lower() not in known:
                raise ValueError(f"{name!r} is true or false, not {value!r}")
            out[name] = value if isinstance(value, bool) else known[str(value).lower()]
        elif kind == "string_list":
            values = sorted({str(x) for x in ([value] if isinstance(value, str) else value) if x is not None})
            if values:
                out[name] = values
        else:
            out[name] = str(value)
    if not out:
        raise ValueError("the query names no column")
    return out


def query_frame(store: Store, record: dict) -> DataFrame:
    """The record as one row with all columns; what is not named is null, and derived columns are computed."""
    schema = store.schema
    plain = [c.name for c in schema.columns if not c.source]
    kinds = ", ".join(f"`{n}` {SPARK_TYPES[schema.type_of(n)]}" for n in plain)
    one = store.spark.createDataFrame([tuple(record.get(n) for n in plain)], kinds)
    return one.withColumns({c.name: text.transformed(F.col(c.source), c.transforms) for c in schema.columns if c.source})


def with_prior(model: Model, records: int, expected_matches: float | None = None, prior_weight: float | None = None) -> Model:
    """The model with the search's own prior; it shifts all hits alike."""
    if expected_matches is not None:
        if not 0 < expected_matches < records:
            raise ValueError("expected matches lie between 0 and the number of records")
        return replace(model, lambda_=expected_matches / records)
    if prior_weight is not None:
        return replace(model, lambda_=1 / (1 + 2.0**-prior_weight))
    return model


def search_many(store: Store, queries: DataFrame, model: Model, k: int = 10, damping: float = 1.0, fuzzy_tf: bool = False, interactions: bool = True) -> DataFrame:
    """``query, rank, unique_id, gamma, match_weight, match_probability, row`` of the k best of each query, ties to the lower row.

    ``queries`` has ``query`` and the plain columns of the schema that are asked for, typed as in the store; others count as null.
    Weights follow from values, so distinct values of the queries meet distinct values of the store, block by block, and of
    a value only its k lowest rows can be among the best.
    """
    if len(store.names) > 1:
        raise ValueError("search reads one input")
    schema = store.schema
    scorer = Scorer(store, model, damping, fuzzy_tf, interactions)
    columns = compared_columns(schema)
    masks = bound_columns(schema)
    asked = {c.name for c in schema.columns if (c.source or c.name) in queries.columns}
    idle = set(columns) - {n for c in schema.comparisons if asked & set(c.columns) for n in c.columns}
    kinds = {c.name: SPARK_TYPES[schema.type_of(c.name)] for c in schema.columns}
    plain = [F.col(c.name) if c.name in queries.columns else F.lit(None).cast(kinds[c.name]).alias(c.name) for c in schema.columns if not c.source]
    derived = {c.name: text.transformed(F.col(c.source), c.transforms) for c in schema.columns if c.source}
    given = queries.select("query", *plain).withColumns(derived).select("query", F.struct(*columns).alias("__values"))
    # what no query asks for is null on both sides, so it does not tell values apart
    values = F.struct(*(F.lit(None).cast(kinds[c]).alias(c) if c in idle else F.col(c) for c in columns))
    stored = store.frame.select("__row", "__ds", "__id", values.alias("__values"))
    first = stored.groupBy("__values").agg(F.min("__row").alias("a___row"), F.min("__ds").alias("a___ds"))

    def side(df: DataFrame, s: str, *more: str) -> DataFrame:
        flat = df.select("__values", *more, *(F.col(f"__values.`{c}`").alias(c) for c in columns)).withColumns(masks)
        return flat.select(F.col("__values").alias(f"{s}__values"), *more, *(F.col(c).alias(f"{s}_{c}") for c in [*columns, *masks]))

    def best(by: str, row: str):
        return Window.partitionBy(by).orderBy(F.desc("match_weight"), row)

    a = side(first, "a", "a___row", "a___ds")
    b = side(given.select("__values").distinct(), "b").withColumn("b___ds", F.lit(0))
    # every value of the store meets every value asked for, block by block
    a, b = a.checkpoint(), b.checkpoint()
    met = blocked(a, b, max(a.count(), b.count()), "a___row", "b__values")
    met, known = graded(store, met)
    scored = scorer.weighed(scorer.based(met.withColumn("gamma", agreement(schema, bool(masks), known)), None, True))
    top = scored.withColumn("__n", F.row_number().over(best("b__values", "a___row"))).where(F.col("__n") <= k)
    top = top.select("a__values", "b__values", "gamma", "match_weight", "match_probability")
    lowest = stored.withColumn("__n", F.row_number().over(Window.partitionBy("__values").orderBy("__row"))).where(F.col("__n") <= k)
    lowest = lowest.select(F.col("__values").alias("l__values"), F.col("__row").alias("row"), F.col("__id").alias("unique_id"))
    found = top.join(lowest, F.col("a__values").eqNullSafe(F.col("l__values")))
    found = found.withColumn("rank", F.row_number().over(best("b__values", "row"))).where(F.col("rank") <= k)
    return given.join(found, F.col("__values").eqNullSafe(F.col("b__values"))).select("query", "rank", "unique_id", "gamma", "match_weight", "match_probability", "row")


def search(store: Store, fields, model: Model, k: int = 10, threshold: float | None = None, probability: float | None = None, expected_matches: float | None = None, prior_weight: float | None = None, clusters: DataFrame | None = None, damping: float = 1.0, fuzzy_tf: bool = False, interactions: bool = True) -> DataFrame:
    """``rank, unique_id, gamma, match_weight, match_probability, row`` of the k best, ties to the lower row; with clusters, ``cluster_id`` and ``best_of_cluster``."""
    if len(store.names) > 1:
        raise ValueError("search reads one input")
    model = with_prior(model, store.records, expected_matches, prior_weight)
    record = query_record(store, fields)
    scorer = Scorer(store, model, damping, fuzzy_tf, interactions)
    columns = compared_columns(store.schema)
    masks = bound_columns(store.schema)
    least = in_bits(threshold, probability)
    one = query_frame(store, record)
    told = one.first()  # one row
    for place in list(scorer.balls):
        value = told[store.schema.comparisons[place].columns[0]]
        if value is not None:
            scorer.add_unseen(place, value)
    one = one.withColumns(masks).select(F.lit(0).alias("b___ds"), *(F.col(c).alias(f"b_{c}") for c in [*columns, *masks]))
    rows = store.frame.withColumns(masks).select(*(F.col(c).alias(f"a_{c}") for c in ["__row", "__ds", "__id", *columns, *masks]))
    met, known = graded_against(store, rows.join(F.broadcast(one)), told.asDict())  # one row
    if least is not None:
        met = met.where(scorer.ceiling(known) >= least - 1e-9)
    scored = scorer.weighed(scorer.based(met.withColumn("gamma", agreement(store.schema, bool(masks), known)), least, True))
    if least is not None:
        scored = scored.where(F.col("match_weight") >= least)
    best = scored.orderBy(F.desc("match_weight"), "a___row").limit(k)
    order = Window.orderBy(F.desc("match_weight"), "row")
    out = best.select(F.col("a___id").alias("unique_id"), "gamma", "match_weight", "match_probability", F.col("a___row").alias("row")).withColumn("rank", F.row_number().over(order))  # k rows
    if clusters is not None:
        out = out.join(clusters.select("unique_id", "cluster_id"), "unique_id", "left")
        own = Window.partitionBy(F.coalesce("cluster_id", F.concat(F.lit("row "), F.col("row")))).orderBy("rank")
        out = out.withColumn("best_of_cluster", F.row_number().over(own) == 1)
    return out.orderBy("rank")
