"""Estimation: u from closed forms, dictionary masses or random pairs; m and lambda by EM over blocked pattern counts.

Only histograms (patterns and counts) come to the driver; pairs are joined, coded and counted in one plan.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.functions.levels import agreement, bound_columns, read_column
from kithlink.operators.blocking import Blocking
from kithlink.operators.classes import Classes, pair_count
from kithlink.operators.grades import blocked, graded
from kithlink.plans.model import ComparisonFit, Interaction, LevelFit, Model
from kithlink.plans.numerics import FLOOR, Fit, em, initial_m, interaction_bits, match_posterior, measure_fit
from kithlink.plans.schema import Schema
from kithlink.sources.store import Store


@dataclass
class EstimateOptions:
    u_sample: int = 1_000_000
    session_pairs: int = 10_000_000
    iterations: int = 500
    tolerance: float = 1e-6
    start_lambda: float = 0.01
    lambda_: float | None = None
    seed: int = 20260903
    tie_holdout: bool = True
    tied_bits: float = 0.25
    tie_sample_rows: int = 500_000
    fuzzy_u: bool = False
    ball_budget: float = 4e10
    interactions: bool = False
    max_interactions: int = 2
    interaction_bits: float = 0.25
    interaction_clamp: float = 6.0
    min_interaction_sessions: int = 2
    pairs_per_parameter: float = 5.0


@dataclass
class Session:
    column: str
    sources: list[str]
    pairs: int
    excluded: list[str]
    lambda_: float = 0.0
    iterations: int = 0
    converged: bool = False
    merged: bool = False
    skipped: str = ""
    matches: float = 0.0
    fit: Fit | None = None


@dataclass
class EstimateReport:
    sessions: list[Session] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    ties: list[tuple[str, str, str]] = field(default_factory=list)
    u_pairs: int = 0


def hash_share(rate: float, seed: int, *columns: str) -> Column:
    """True for about ``rate`` of the rows, by a hash of the columns: the same rows under any partitioning."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40)) < int(rate * (1 << 40))


def random_pairs(store: Store, count: int, seed: int, columns: list[str]) -> DataFrame:
    """About ``count`` ordered random pairs that the mode admits: two hashed row numbers, two joins."""
    draws = store.spark.range(count)
    drawn = lambda s, size: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(s)), size)
    if store.cross:  # two inputs by how many pairs lie between them, then a row of each
        starts = [sum(store.sizes[:i]) for i in range(len(store.sizes))]
        between = [(i, j) for i in range(len(starts)) for j in range(i + 1, len(starts)) if store.sizes[i] and store.sizes[j]]
        if not between:
            between = [(0, 0)]
        upto = list(itertools.accumulate(store.sizes[i] * store.sizes[j] for i, j in between))
        place, first = drawn(3, F.lit(max(upto[-1], 1)).cast("long")), None
        for (i, j), end in zip(between, upto, strict=True):
            sides = F.struct(*(F.lit(x).cast("long").alias(n) for n, x in (("i", starts[i]), ("m", max(store.sizes[i], 1)), ("j", starts[j]), ("n", max(store.sizes[j], 1)))))
            first = F.when(place < end, sides) if first is None else first.when(place < end, sides)
        draws = draws.withColumn("__s", first)
        draws = draws.select((F.col("__s.i") + drawn(1, F.col("__s.m"))).alias("x"), (F.col("__s.j") + drawn(2, F.col("__s.n"))).alias("y")).where("x <> y")
    else:
        n = F.lit(store.records)
        draws = draws.select(drawn(1, n).alias("x"), drawn(2, n).alias("y")).where("x <> y")
    draws = draws.select(F.least("x", "y").alias("a___row"), F.greatest("x", "y").alias("b___row"))
    frame = store.frame.withColumns(bound_columns(store.schema)).select("__row", "__ds", *columns, *bound_columns(store.schema))
    left, right = (frame.select(*(F.col(c).alias(f"{s}_{c}") for c in frame.columns)) for s in "ab")
    out = draws.join(left, "a___row").join(right, "b___row")
    return out.where("a___ds <> b___ds") if store.cross else out


def compared_columns(schema: Schema) -> list[str]:
    return list(dict.fromkeys(n for c in schema.comparisons for n in c.columns))


def histogram(pairs: DataFrame, schema: Schema, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(levels of each pattern, count): partial counts in the join's own stage, one small shuffle. With the store, fuzzy levels come from tables of value pairs."""
    masked = all(f"a_{n}" in pairs.columns for n in bound_columns(schema))
    pairs, known = graded(store, pairs, schema) if store else (pairs, frozenset())
    rows = pairs.groupBy(agreement(schema, masked, known).alias("gamma")).agg(pair_count(pairs).alias("n")).orderBy(F.desc("n"), "gamma").collect()
    levels = np.array([schema.unpack(r.gamma) for r in rows], np.int64).reshape(len(rows), len(schema.comparisons))
    return levels, np.array([r.n for r in rows], np.float64)


def exact_u(store: Store) -> dict[tuple[int, int], float]:
    """(comparison, level) -> u where a closed form over value counts gives it."""
    schema, n, out = store.schema, store.records, {}
    sizes = store.sizes
    draws = n * n - sum(k * k for k in sizes) if store.cross else n * (n - 1)
    if draws <= 0:
        return out

    def rate(groups: DataFrame) -> float:
        """Ordered pairs that share a group; groups has n per key and input."""
        total = groups.groupBy("key").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.col("n")).alias("own"))
        same = F.col("c") * F.col("c") - F.col("own") if store.cross else F.col("c") * (F.col("c") - 1)
        return (total.agg(F.sum(same.cast("double"))).first()[0] or 0.0) / draws

    for k, c in enumerate(schema.comparisons):
        lacking = [F.col(x).isNull() for x in c.columns]
        test = lacking[0]
        for x in lacking[1:]:
            test = test & x if schema.scalar_and_list(c) else test | x
        present = store.frame.where(~test)
        if c.levels[0].type == "null":
            p = {r["__ds"]: r["n"] for r in present.groupBy("__ds").agg(F.count("*").alias("n")).collect()}
            both = sum(p.values()) ** 2 - sum(x * x for x in p.values()) if store.cross else sum(p.values()) * (sum(p.values()) - 1)
            out[k, 0] = 1 - both / draws
        first = 1 if c.levels[0].type == "null" else 0
        v = c.levels[first]
        if v.type == "exact":
            name = read_column(schema, c, v)
            if schema.type_of(name) in ("string", "date", "boolean"):
                out[k, first] = rate(present.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("key"), "__ds").agg(F.count("*").alias("n")))
    return out


def ball_masses(store: Store, k: int, budget: float = 4e10) -> DataFrame | None:
    """(value, level, records): for each value of comparison k's text column, the records whose value lies on each fuzzy level from it.

    A join of the dictionary with itself; None if the comparison has no such level or the dictionary is too large for the budget.
    """
    schema, c = store.schema, store.schema.comparisons[k]
    fuzzy = [i for i, v in enumerate(c.levels) if v.type in ("levenshtein", "jaro_winkler")]
    if not fuzzy or len(c.columns) != 1:
        return None
    name = c.columns[0]
    words = store.dictionary(name)
    size = words.count()
    if size * (size - 1) / 2 > budget:
        return None
    one = replace(schema, comparisons=(c,), _by_name={})
    left = words.select(F.col("value").alias(f"a_{name}"), F.col("tf").alias("ta"))
    right = words.select(F.col("value").alias(f"b_{name}"), F.col("tf").alias("tb"))
    both = blocked(left, right, size, f"a_{name}", f"b_{name}").where(F.col(f"a_{name}") < F.col(f"b_{name}"))
    near = both.where(F.abs(F.length(f"a_{name}") - F.length(f"b_{name}")) <= max([int(c.levels[i].threshold) for i in fuzzy if c.levels[i].type == "levenshtein"], default=0)) if all(c.levels[i].type == "levenshtein" for i in fuzzy) else both
    coded = near.withColumn("level", agreement(one)).where(F.col("level").isin(fuzzy))
    ends = F.explode(F.array(F.struct(F.col(f"a_{name}").alias("value"), F.col("tb").alias("n")), F.struct(F.col(f"b_{name}").alias("value"), F.col("ta").alias("n"))))
    return coded.select("level", ends.alias("e")).groupBy(F.col("e.value").alias("value"), "level").agg(F.sum("e.n").alias("records"))


def fuzzy_u(store: Store, budget: float) -> dict[tuple[int, int], float]:
    """Exact u of fuzzy levels: each value's records times the records in its ball, over the ordered draws."""
    if store.cross:
        raise ValueError("fuzzy u is for one input or link-and-dedup")
    out, n = {}, store.records
    for k, c in enumerate(store.schema.comparisons):
        balls = ball_masses(store, k, budget)
        if balls is None:
            continue
        sums = balls.join(store.dictionary(c.columns[0]), "value").groupBy("level").agg(F.sum(F.col("tf").cast("double") * F.col("records")).alias("s")).collect()
        found = {r.level: r.s for r in sums}
        for i, v in enumerate(c.levels):
            if v.type in ("levenshtein", "jaro_winkler"):
                out[k, i] = found.get(i, 0.0) / (n * (n - 1))
    return out


def random_u(store: Store, options: EstimateOptions) -> tuple[list[np.ndarray], dict, np.ndarray, np.ndarray]:
    """(u, exact levels, patterns, counts) : closed forms where there are any, the random pairs' shares scaled to the rest elsewhere."""
    schema = store.schema
    levels, counts = histogram(random_pairs(store, options.u_sample, options.seed, compared_columns(schema)), schema, store)
    exact = exact_u(store)
    if options.fuzzy_u:
        exact |= fuzzy_u(store, options.ball_budget)
    out = []
    for k, c in enumerate(schema.comparisons):
        seen = np.bincount(levels[:, k], counts, len(c.levels)) if len(counts) else np.zeros(len(c.levels))
        known = {i: u for (kk, i), u in exact.items() if kk == k}
        free = [i for i in range(len(c.levels)) if i not in known]
        u = np.zeros(len(c.levels))
        for i, x in known.items():
            u[i] = x
        rest = max(1 - sum(known.values()), 0.0)
        share = np.maximum(seen[free], 0.5)
        u[free] = rest * share / share.sum() if free else 0
        out.append(u)
    return out, exact, levels, counts


def identifiable(reachable: list[int]) -> bool:
    """Whether the free comparisons' pattern cells outnumber the mixture's parameters."""
    return math.prod(reachable) - 1 >= 1 + sum(2 * (x - 1) for x in reachable)


def estimate(store: Store, options: EstimateOptions | None = None, all_pairs: bool = False, ties: list[tuple[str, str, str]] | None = None) -> tuple[Model, EstimateReport]:
    """Fit a model. ``ties`` are further pairs of columns that must not vouch for each other (left, right, reason)."""
    options = options or EstimateOptions()
    schema, report = store.schema.for_purpose("estimate", all_pairs), EstimateReport()
    store = replace(store, schema=schema)
    report.ties = list(ties or [])
    u, exact, u_levels, u_counts = random_u(store, options)
    report.u_pairs = int(u_counts.sum())
    names = [c.name for c in schema.comparisons]
    null_first = [c.levels[0].type == "null" for c in schema.comparisons]
    # a level that no pair can reach has an exact u of zero
    reachable = [[not (exact.get((k, i), 1.0) <= 0) for i in range(len(c.levels))] for k, c in enumerate(schema.comparisons)]
    start = initial_m(u, null_first)
    blocking = Blocking(store, schema.blocking)
    by_column: dict[str, list[int]] = {}
    for i, b in enumerate(blocking.bound):
        by_column.setdefault(b.source.column if b.source.em_safe else "(all pairs)", []).append(i)
    masks = bound_columns(schema)
    needed, masked = [*compared_columns(schema), *masks], blocking.frame.withColumns(masks)
    tied = {frozenset((a, b)) for a, b, _ in report.ties}
    merged: list[tuple[Session, list[int], list[np.ndarray], np.ndarray, np.ndarray, float]] = []
    basis: tuple[float, str] | None = None
    for column, selected in by_column.items():
        excluded = [] if column == "(all pairs)" else [k for k, c in enumerate(schema.comparisons) if any(schema.same_source(column, x) or frozenset((column, x)) in tied for x in c.columns)]
        free = [k for k in range(len(names)) if k not in excluded]
        session = Session(column, [blocking.bound[i].name for i in selected], 0, [names[k] for k in excluded])
        report.sessions.append(session)
        if not identifiable([sum(reachable[k]) for k in free]):
            session.skipped = "its free comparisons have fewer pattern cells than parameters"
            continue
        total = sum(blocking.counts(i)["pairs"] for i in selected)
        classes = Classes.of(blocking, compared_columns(schema), selected)
        # classes are counted whole; only where records hardly repeat are pairs of a large session sampled
        rate = min(1.0, options.session_pairs / total) if total and classes is None else 1.0
        pairs = blocking.pairs(needed, selected, masked) if classes is None else classes.pairs(compared_columns(schema), masks, selected)
        if rate < 1:
            pairs = pairs.where(hash_share(rate, options.seed, "a___row", "b___row"))
        levels, counts = histogram(pairs, schema, store)
        session.pairs = int(counts.sum())
        if not session.pairs:
            session.skipped = "it has no pairs"
            continue
        result = em(levels, counts, start, u, free, options.start_lambda, options.iterations, options.tolerance)
        session.lambda_, session.iterations, session.converged, session.matches = result.lambda_, result.iterations, result.converged, result.matches
        session.fit = measure_fit(levels, counts, result.m, u, result.lambda_, free)
        if sum(result.m[k][-1] > u[k][-1] for k in free) * 2 > len(free):
            session.skipped = "most of its comparisons disagree more among matches: the classes are swapped"
            continue
        session.merged = True
        merged.append((session, free, result.m, levels, counts, result.lambda_))
        value = result.lambda_ * session.pairs / rate / max(store.pair_space, 1)
        if basis is None or value > basis[0]:
            basis = (value, f"session {column}" if column == "(all pairs)" else f"lower bound: session {column}")
    for a, b, reason in report.ties:  # columns that vouch for each other in every session that was merged
        both = [[k for k, c in enumerate(schema.comparisons) if any(schema.same_source(x, n) for n in c.columns)] for x in (a, b)]
        if all(both) and merged and all(set(both[0]) & set(free) and set(both[1]) & set(free) for _, free, *_ in merged):
            report.warnings.append(f"{a!r} and {b!r} are tied ({reason}) and no session holds one of them out")
    fits = []
    for k, c in enumerate(schema.comparisons):
        own = [(m[k], s.matches) for s, free, m, *_ in merged if k in free]
        support = sum(x for _, x in own)
        m = np.mean([x for x, _ in own], axis=0) if own else start[k]
        if own:
            live = np.array(reachable[k])
            m = np.maximum(m, 0.5 / max(support, 1.0))
            m = np.where(live, m, u[k])
            m[live] *= (1 - m[~live].sum()) / m[live].sum()
        else:
            report.warnings.append(f"comparison {c.name!r} was held out of every session: its m is the starting value")
        m = np.clip(m, FLOOR, 1)
        seen = np.bincount(u_levels[:, k], u_counts, len(c.levels)) if len(u_counts) else np.zeros(len(c.levels))
        fits.append(ComparisonFit(c.name, list(c.columns), [
            LevelFit(v.describe(), float(m[i]), float(max(u[k][i], FLOOR)), (k, i) in exact, bool(own), bool(seen[i] > 0 or (k, i) in exact), support) for i, v in enumerate(c.levels)
        ], c.term_frequency, len(own)))
    if options.lambda_ is not None:
        lambda_, why = options.lambda_, "given"
    elif basis is not None:
        lambda_, why = basis
        if why.startswith("lower bound"):
            report.warnings.append(f"lambda is a {why}")
    else:
        lambda_, why = 1 / max(store.pair_space, 2), "one match"
    model = Model(min(max(lambda_, FLOOR), 1 - FLOOR), fits, why, store.records)
    if options.interactions:
        model.interactions = fit_interactions(schema, merged, model, (u_levels, u_counts), store.pair_space, options)
    return model, report


def fit_interactions(schema: Schema, merged: list, model: Model, random: tuple[np.ndarray, np.ndarray], space: int, options: EstimateOptions) -> list[Interaction]:
    """The two-way terms worth their place: by effect, agreed in sign by enough sessions."""
    u_levels, u_counts = random
    draws = float(u_counts.sum())
    m = [np.array([v.m for v in c.levels]) for c in model.comparisons]
    u = [np.array([v.u for v in c.levels]) for c in model.comparisons]
    found: list[Interaction] = []
    for a in range(len(m)):
        for b in range(a + 1, len(m)):
            shape = (len(m[a]), len(m[b]))
            drawn = np.zeros(shape)
            np.add.at(drawn, (u_levels[:, a], u_levels[:, b]), u_counts)
            joints: list[tuple[np.ndarray, float]] = []
            for session, free, sm, levels, counts, lambda_ in merged:
                if a in free and b in free:
                    own = np.zeros(shape)
                    np.add.at(own, (levels[:, a], levels[:, b]), match_posterior(levels, sm, u, lambda_, free) * counts)
                    joints.append((own, session.matches))
            mass = sum(x for _, x in joints)
            if len(joints) < options.min_interaction_sessions or not mass:
                continue
            if min(mass, draws) < options.pairs_per_parameter * (shape[0] - 1) * (shape[1] - 1):
                continue  # too few pairs for the term's free cells
            share = sum(j for j, _ in joints) / mass
            matches = model.lambda_ * draws * share  # what the random pairs hold of matches, cell by cell
            if float((share * matches / np.maximum(drawn, 0.5)).sum()) > 0.5:
                continue
            clean = np.maximum(drawn - matches, 0)
            leans = {np.sign(interaction_bits(j, clean, m[a], m[b], u[a], u[b], x, options.interaction_clamp)[2]) for j, x in joints} - {0.0}
            if len(leans) > 1:
                continue
            bits, effect, _ = interaction_bits(share * mass, clean, m[a], m[b], u[a], u[b], mass, options.interaction_clamp)
            if effect >= options.interaction_bits:
                left, right = model.comparisons[a], model.comparisons[b]
                found.append(Interaction(left.name, right.name, *shape, bits.ravel().tolist(), [], effect, len(joints)))
    return sorted(found, key=lambda t: -t.effect)[: options.max_interactions]


def level_shares(pairs: DataFrame, schema: Schema, store: Store | None = None) -> DataFrame:
    """(comparison, level, pairs) of a pair frame, without leaving the cluster."""
    pairs, known = graded(store, pairs, schema) if store else (pairs, frozenset())
    coded = pairs.groupBy(agreement(schema, False, known).alias("gamma")).agg(pair_count(pairs).alias("n"))
    entries = [F.struct(F.lit(c.name).alias("comparison"), F.call_function("shiftright", F.col("gamma"), F.lit(s)).bitwiseAND((1 << c.bits) - 1).cast("int").alias("level")) for c, s in zip(schema.comparisons, schema.shifts, strict=True)]
    return coded.select(F.explode(F.array(*entries)).alias("e"), "n").groupBy("e.comparison", "e.level").agg(F.sum("n").alias("pairs"))
