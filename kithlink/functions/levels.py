"""Comparison ladders as column expressions over a pair frame (columns ``a_x``, ``b_x``, ``a___ds``, ``b___ds``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kithlink.functions import text
from kithlink.plans.schema import Comparison, Level, Schema

CHEAP = {"null", "exact", "date_within", "numeric_within", "percentage_within", "geo_within", "list_overlap", "list_jaccard", "list_contains", "else"}


def _false(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _some_close(elements: Column, value: Column, close) -> Column:
    return F.exists(elements, lambda e: close(value, e))


def missing(schema: Schema, c: Comparison, side: str) -> Column:
    """Whether the comparison has nothing to read on a side."""
    nulls = [F.col(f"{side}_{n}").isNull() for n in c.columns]
    return reduce(Column.__and__ if schema.scalar_and_list(c) else Column.__or__, nulls)


def read_column(schema: Schema, c: Comparison, v: Level) -> str:
    """The column that a one-column level reads."""
    if v.column:
        return v.column
    if schema.scalar_and_list(c):
        return c.columns[1] if v.type.startswith("list_") else c.columns[0]
    return c.columns[0]


def similarity_bound(name: str) -> Column:
    """What the masks and lengths of both sides allow Jaro-Winkler to be."""
    args = [F.col(f"{s}_{name}__{k}") for k in "mn" for s in "ab"]
    return text.jaro_winkler_upper_bound(*args, text.common_prefix(F.col(f"a_{name}"), F.col(f"b_{name}")))


def bound_columns(schema: Schema) -> dict[str, Column]:
    """Masks and lengths of the text columns that fuzzy levels read, for bounds on pairs."""
    names = {read_column(schema, c, v) for c in schema.comparisons for v in c.levels if v.type in ("levenshtein", "jaro_winkler")}
    return {f"{n}__m": text.char_mask(F.col(n)) for n in sorted(names)} | {f"{n}__n": F.length(n) for n in sorted(names)}


FUZZY = ("levenshtein", "jaro_winkler")


def fuzzy_column(schema: Schema, c: Comparison) -> str | None:
    """The text column that all fuzzy levels of a comparison read; None if there is none or several."""
    names = {read_column(schema, c, v) for v in c.levels if v.type in FUZZY}
    return names.pop() if len(names) == 1 else None


def graded_column(schema: Schema, c: Comparison) -> str:
    """A pair frame may have, under this name, the first fuzzy level of the comparison that the two values reach (null: none), from a table of value pairs."""
    return f"__f{schema.comparisons.index(c)}"


def level_holds(schema: Schema, c: Comparison, v: Level, masked: bool = False) -> Column:
    """True where the level fires; never null. With ``masked`` the pair has the bound columns, and the similarity is computed only where they allow it."""
    t = v.threshold
    if v.type == "else":
        return F.lit(True)
    if v.type == "null":
        return missing(schema, c, "a") | missing(schema, c, "b")
    name = read_column(schema, c, v)
    a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
    if v.type == "exact":
        return _false(a == b)
    if v.type == "levenshtein":
        return _false(F.levenshtein(a, b, int(t)) >= 0)
    if v.type == "jaro_winkler":
        fires = text.jaro_winkler(a, b) >= t
        return _false(F.when(similarity_bound(name) >= t - 1e-9, fires) if masked else fires)
    if v.type == "date_within":
        if v.direction == "forward":
            ahead = F.when(F.col("a___ds") < F.col("b___ds"), F.datediff(b, a)).when(F.col("a___ds") > F.col("b___ds"), F.datediff(a, b)).otherwise(F.abs(F.datediff(a, b)))
            return _false((ahead >= 0) & (ahead <= t))
        return _false(F.abs(F.datediff(a, b)) <= t)
    if v.type == "numeric_within":
        return _false(F.abs(a - b) <= t)
    if v.type == "percentage_within":
        larger = F.greatest(a, b)
        return _false((a == b) | F.when(larger != 0, F.abs(a - b) / larger < t))
    if v.type == "geo_within":
        lat, lon = c.columns[:2]
        # parallels that lie apart by more (and a metre, for rounding) need no arc
        apart = text.meridian_km(F.col(f"a_{lat}"), F.col(f"b_{lat}")) > t + 0.001
        return _false(F.when(apart, F.lit(False)).otherwise(text.haversine_km(*(F.col(f"{s}_{n}") for s in "ab" for n in (lat, lon))) <= t))
    if v.type == "list_overlap":
        return _false(F.when(F.least(F.size(a), F.size(b)) >= t, F.size(F.array_intersect(a, b)) >= t))
    if v.type == "list_jaccard":
        smaller, larger = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
        common = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: n / (F.size(a) + F.size(b) - n) >= t)[0]  # lists are sets
        return _false(F.when((larger > 0) & (smaller >= t * larger - 1e-9), common))
    close = (lambda p, q: F.levenshtein(p, q, int(t)) >= 0) if v.type.endswith("levenshtein") else (lambda p, q: text.jaro_winkler(p, q) >= t)
    if v.type in ("list_levenshtein", "list_jaro_winkler"):
        return _false(F.arrays_overlap(a, b)) | _false(F.exists(a, lambda p: F.exists(b, lambda q: close(p, q))))
    scalar, listed = c.columns
    sides = [(F.col(f"{s}_{scalar}"), F.col(f"{o}_{listed}")) for s, o in ("ab", "ba")]
    if v.type == "list_contains":
        tests = [F.array_contains(x, s) for s, x in sides]
    else:
        tests = [_some_close(x, s, close) for s, x in sides]
    return reduce(Column.__or__, map(_false, tests))


def level_index(schema: Schema, c: Comparison, masked: bool = False, graded: frozenset | set = frozenset()) -> Column:
    """The first level that fires. Ladders of one similarity compute it once, and with ``masked`` only where a rung is within the bound;
    comparisons whose graded column is among ``graded`` look their fuzzy levels up."""
    if graded_column(schema, c) in graded:
        found = F.col(graded_column(schema, c))
        return _case(schema, c, c.levels, 0, {id(v): _false(found == i) for i, v in enumerate(c.levels) if v.type in FUZZY})
    jaro = [v for v in c.levels if v.type == "jaro_winkler"]
    if len(jaro) > 1 and len({read_column(schema, c, v) for v in jaro}) == 1:
        name = read_column(schema, c, jaro[0])
        a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
        first = next(i for i, v in enumerate(c.levels) if v.type == "jaro_winkler")
        # levels before the first rung decide without it; then one similarity serves all rungs
        value = text.jaro_winkler(a, b)
        if masked:
            value = F.when(similarity_bound(name) >= min(v.threshold for v in jaro) - 1e-9, value).otherwise(0.0)
        ladder = F.transform(F.array(value), lambda s: _case(schema, c, c.levels[first:], first, {id(v): _false(s >= v.threshold) for v in jaro}))[0]
        return _case(schema, c, c.levels[:first], 0, {}, ladder, masked)
    return _case(schema, c, c.levels, 0, {}, None, masked)


def _case(schema: Schema, c: Comparison, levels, start: int, known: dict, last: Column | None = None, masked: bool = False) -> Column:
    out = None
    for i, v in enumerate(levels, start):
        test = known.get(id(v))
        test = level_holds(schema, c, v, masked) if test is None else test
        if v.type == "else":
            return F.lit(i) if out is None else out.otherwise(F.lit(i))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return last if out is None else out.otherwise(last)


def best_possible(schema: Schema, c: Comparison, weights: list[float], graded: frozenset | set = frozenset()) -> Column:
    """The largest weight the pair can reach in this comparison, by bounds that cost little.

    A level that a bound rules out is passed over; the cheap levels are decided exactly. Needs the columns ``a_x__m``, ``a_x__n`` (mask and
    length) of text columns; without fuzzy levels it is the weight itself.
    """

    if graded_column(schema, c) in graded and all(v.type in CHEAP or v.type in FUZZY for v in c.levels):
        return F.element_at(F.array(*map(F.lit, weights)), level_index(schema, c, False, graded) + 1)

    def possible(v: Level) -> Column:
        if v.type in CHEAP:
            return level_holds(schema, c, v)
        if v.type in ("levenshtein", "jaro_winkler"):
            name = read_column(schema, c, v)
            if v.type == "levenshtein":
                return _false(text.levenshtein_lower_bound(*(F.col(f"{s}_{name}__{k}") for k in "mn" for s in "ab")) <= int(v.threshold))
            return _false(similarity_bound(name) >= v.threshold - 1e-9)
        return F.lit(True)

    # from the ladder's end: a cheap level that holds ends it, a fuzzy one that is possible may or may not
    best = F.lit(weights[-1])
    for v, w in reversed(list(zip(c.levels[:-1], weights[:-1], strict=True))):
        best = F.when(possible(v), F.lit(w)).otherwise(best) if v.type in CHEAP else F.when(possible(v), F.greatest(F.lit(w), best)).otherwise(best)
    return best


def code(schema: Schema, indexes: list[Column]) -> Column:
    """Level indexes packed into one number."""
    parts = [F.call_function("shiftleft", i.cast("long"), F.lit(s)) for i, s in zip(indexes, schema.shifts, strict=True)]
    return reduce(lambda x, y: x + y, parts) if parts else F.lit(0).cast("long")


def agreement(schema: Schema, masked: bool = False, graded: frozenset | set = frozenset()) -> Column:
    """A pair's code."""
    return code(schema, [level_index(schema, c, masked, graded) for c in schema.comparisons])


def level_of(schema: Schema, k: int, gamma: Column | str = "gamma") -> Column:
    """Comparison k's level in a packed code."""
    g = F.col(gamma) if isinstance(gamma, str) else gamma
    return F.call_function("shiftright", g, F.lit(schema.shifts[k])).bitwiseAND((1 << schema.comparisons[k].bits) - 1).cast("int")
