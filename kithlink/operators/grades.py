"""Fuzzy levels over distinct value pairs: each pair of values is compared once, and candidate pairs look the level up.

A comparison whose fuzzy levels read one text column gets a table (value, value, level) with a row for every ordered pair of its
values that reaches a fuzzy level: a blocked join of the column's dictionary with itself, where masks and lengths drop most pairs before
a similarity is computed. The table is broadcast, so both its making and its size are checked first: the dictionary holds
at most ``VALUES`` values and the table at most ``ROWS`` rows. Beyond that the similarity is computed per candidate pair, after the
same bounds; the levels are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.functions.levels import FUZZY, bound_columns, fuzzy_column, graded_column, level_holds, read_column
from kithlink.plans.schema import Comparison, Schema
from kithlink.sources.store import Store

VALUES, ROWS = 4096, 1 << 18
#: Values a side of a block, when a dictionary meets itself.
SIDE = 1024


def blocked(left: DataFrame, right: DataFrame, count: int, key_a: str, key_b: str, side: int = SIDE) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, block by block: as many blocks a side as ``count`` rows need, each pair of blocks one key."""
    n = max(1, -(-count // side))
    if n == 1:
        parallel = left.sparkSession.sparkContext.defaultParallelism
        n = max(1, min(parallel, count // 64))  # a small dictionary still spreads over the cores
    own = lambda x: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("__x", own(key_a)).withColumn("__y", every)
    b = right.withColumn("__y", own(key_b)).withColumn("__x", every)
    cells = min(n * n, 20_000)
    return a.repartition(cells, "__x", "__y").join(b.repartition(cells, "__x", "__y").hint("shuffle_hash"), ["__x", "__y"]).drop("__x", "__y")


def value_table(store: Store, c: Comparison) -> DataFrame | None:
    """(__va, __vb, __lv) of a comparison; None if it has no fuzzy level or its table may not be broadcast."""
    schema = store.schema
    name = fuzzy_column(schema, c)
    if name is None:
        return None
    key = (name, tuple((i, v.describe()) for i, v in enumerate(c.levels) if v.type in FUZZY))
    if key not in store._tables:
        store._tables[key] = _table(store, schema, c, name)
    return store._tables[key]


def _table(store: Store, schema: Schema, c: Comparison, name: str) -> DataFrame | None:
    words = store.dictionary(name).select(F.col("value").alias(name)).limit(VALUES + 1).checkpoint()
    size = words.count()
    if size > VALUES:
        return None
    masks = {n: x for n, x in bound_columns(schema).items() if n.startswith(f"{name}__")}
    words = words.withColumns(masks)
    a, b = (words.select(*(F.col(n).alias(f"{s}_{n}") for n in words.columns)) for s in "ab")
    both = blocked(a, b, size, f"a_{name}", f"b_{name}").where(F.col(f"a_{name}") != F.col(f"b_{name}"))
    level = None
    for i, v in enumerate(c.levels):
        if v.type in FUZZY and read_column(schema, c, v) == name:
            test = level_holds(schema, c, v, True)
            level = F.when(test, F.lit(i)) if level is None else level.when(test, F.lit(i))
    found = both.select(F.col(f"a_{name}").alias("__va"), F.col(f"b_{name}").alias("__vb"), level.alias("__lv")).where("__lv IS NOT NULL").checkpoint()
    return found if found.limit(ROWS + 1).count() <= ROWS else None


def graded(store: Store, pairs: DataFrame, schema: Schema | None = None) -> tuple[DataFrame, frozenset]:
    """The pair frame with the graded columns that tables can give, and their names."""
    schema = schema or store.schema
    names = []
    for c in schema.comparisons:
        table, column = value_table(store, c), fuzzy_column(schema, c)
        if table is None:
            continue
        out = graded_column(schema, c)
        first = next(i for i, v in enumerate(c.levels) if v.type in FUZZY)
        a, b = F.col(f"a_{column}"), F.col(f"b_{column}")
        pairs = pairs.join(F.broadcast(table), (a == F.col("__va")) & (b == F.col("__vb")), "left").drop("__va", "__vb")  # at most ROWS rows
        pairs = pairs.withColumn(out, F.when(a == b, F.lit(first)).otherwise(F.col("__lv"))).drop("__lv")
        names.append(out)
    return pairs, frozenset(names)


def graded_against(store: Store, pairs: DataFrame, record: dict) -> tuple[DataFrame, frozenset]:
    """As ``graded`` for a frame whose side b is one record: each distinct value of a column is compared with the record's once."""
    schema, names = store.schema, []
    for c in schema.comparisons:
        column = fuzzy_column(schema, c)
        value = record.get(column) if column else None
        if value is None:
            continue
        masks = {n: x for n, x in bound_columns(schema).items() if n.startswith(f"{column}__")}
        words = store.dictionary(column).select(F.col("value").alias(column), F.lit(value).alias("__asked"))
        a = words.withColumns(masks).select(*(F.col(n).alias(f"a_{n}") for n in (column, *masks)), F.col("__asked").alias(column))
        both = a.withColumns(masks).select(*(f"a_{n}" for n in (column, *masks)), *(F.col(n).alias(f"b_{n}") for n in (column, *masks)))
        level = None
        for i, v in enumerate(c.levels):
            if v.type in FUZZY:
                test = level_holds(schema, c, v, True)
                level = F.when(test, F.lit(i)) if level is None else level.when(test, F.lit(i))
        found = both.select(F.col(f"a_{column}").alias("__va"), level.alias("__lv")).where("__lv IS NOT NULL").checkpoint()
        if found.limit(ROWS + 1).count() > ROWS:
            continue
        pairs = pairs.join(F.broadcast(found), F.col(f"a_{column}") == F.col("__va"), "left").drop("__va")  # at most ROWS rows
        pairs = pairs.withColumnRenamed("__lv", graded_column(schema, c))
        names.append(graded_column(schema, c))
    return pairs, frozenset(names)
