"""What blocking reaches: prices, recall against known pairs, and completeness without any."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.functions.levels import agreement, level_holds
from kithlink.operators.blocking import Blocking
from kithlink.operators.classes import pair_count, weighted_pairs
from kithlink.operators.grades import graded
from kithlink.operators.estimate import compared_columns, hash_share
from kithlink.plans.model import Model
from kithlink.sources.store import Store


#: Blocked comparisons that an agreement table may have.
MOST_TABLE = 10


@dataclass
class SourcePrice:
    source: str
    pairs: int
    largest_group: int
    em_safe: bool


@dataclass
class BlockingReport:
    pair_space: int
    sources: list[SourcePrice]
    union: int | None = None

    @property
    def total(self) -> int:
        return sum(s.pairs for s in self.sources)

    @property
    def reduction(self) -> float:
        return 1 - (self.total if self.union is None else self.union) / self.pair_space if self.pair_space else 0.0


def explain_blocking(store: Store, all_pairs: bool = False, count: bool = False) -> BlockingReport:
    """Exact pairs and largest group of every source, from key counts; with ``count`` also the union."""
    blocking = Blocking(store, store.schema.for_purpose("predict", all_pairs).blocking)
    prices = []
    for k, b in enumerate(blocking.bound):
        c = blocking.counts(k)
        prices.append(SourcePrice(b.name, c["pairs"], c["largest"], b.source.em_safe))
    return BlockingReport(store.pair_space, prices, union_count(blocking) if count else None)


def union_count(blocking: Blocking) -> int:
    """How many pairs the sources make together, by pairs of classes."""
    pairs = weighted_pairs(blocking, [])
    return pairs.agg(pair_count(pairs)).first()[0] or 0


@dataclass
class Recall:
    truth: int
    found: int
    candidates: int
    pair_space: int
    per_source: list[dict]
    misses: dict[str, int] = field(default_factory=dict)
    window_gains: dict[int, int] = field(default_factory=dict)
    still_agree: dict[str, int] = field(default_factory=dict)
    cap_gains: dict[str, int] = field(default_factory=dict)
    listed: DataFrame | None = None

    @property
    def completeness(self) -> float:
        return self.found / self.truth if self.truth else 0.0

    @property
    def quality(self) -> float:
        return self.found / self.candidates if self.candidates else 0.0

    @property
    def reduction(self) -> float:
        return 1 - self.candidates / self.pair_space if self.pair_space else 0.0


def truth_frame(store: Store, blocking: Blocking, truth: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Known pairs (row_a, row_b) with both sides' keys; in linking, pairs of one input are left out."""
    rows = truth.select(F.least("row_a", "row_b").alias("a___row"), F.greatest("row_a", "row_b").alias("b___row")).where("a___row <> b___row").distinct()
    for s in "ab":
        rows = rows.join(blocking.side(s, extra or []), f"{s}___row")
    return rows.where("a___ds <> b___ds") if store.cross else rows


def recall(store: Store, truth: DataFrame, all_pairs: bool = False, count: bool = False, why: bool = False, misses: int = 0) -> Recall:
    """How many known pairs each source produces, produces first, and alone; with ``why``, what stood in the way of the others.

    ``misses`` of the pairs that no source produces are listed, by row, with their ids.
    """
    blocking = Blocking(store, store.schema.for_purpose("predict", all_pairs).blocking)
    names = list(dict.fromkeys([*compared_columns(store.schema), *(b.source.column for b in blocking.bound if b.source.column)]))
    pairs = truth_frame(store, blocking, truth, names if why else []).checkpoint()
    tests = [b.produces() for b in blocking.bound]
    any_of = lambda xs: reduce(Column.__or__, xs, F.lit(False))
    columns = [F.count("*").alias("truth"), F.count_if(any_of(tests)).alias("found")]
    for k, t in enumerate(tests):
        columns += [F.count_if(t).alias(f"all{k}"), F.count_if(t & ~any_of(tests[:k])).alias(f"first{k}"), F.count_if(t & ~any_of([x for j, x in enumerate(tests) if j != k])).alias(f"only{k}")]
    r = pairs.agg(*columns).first()
    prices = [blocking.counts(k)["pairs"] for k in range(len(tests))]
    per = [{"source": b.name, "pairs": prices[k], "found": r[f"all{k}"], "first": r[f"first{k}"], "only": r[f"only{k}"], "marginal_quality": r[f"first{k}"] / prices[k] if prices[k] else 0.0} for k, b in enumerate(blocking.bound)]
    out = Recall(r.truth, r.found, union_count(blocking) if count else sum(prices), store.pair_space, per)
    missed = pairs.where(~any_of(tests))
    if why:
        _why(store, blocking, missed, out)
    if misses:
        out.listed = missed.select(F.col("a___row").alias("row_a"), F.col("b___row").alias("row_b"), F.col("a___id").alias("id_a"), F.col("b___id").alias("id_b")).orderBy("row_a", "row_b").limit(misses)
    return out


def _cap_gains(store: Store, blocking: Blocking, missed: DataFrame) -> dict[str, int]:
    """Of the missed pairs, how many each capped source would produce with a cap of at most ten times its own."""
    out = {}
    for b in blocking.bound:
        s = b.source
        if s.type != "rare_value" or not s.max_frequency:
            continue
        agreed = missed.where(F.col(f"a_{s.column}") == F.col(f"b_{s.column}")).select(F.col(f"a_{s.column}").alias("value"))
        within = agreed.join(store.dictionary(s.column), "value").where(F.col("tf").between(s.max_frequency + 1, 10 * s.max_frequency))
        out[b.name] = within.count()
    return out


def _why(store: Store, blocking: Blocking, missed: DataFrame, out: Recall) -> None:
    reasons: list[Column] = []
    for b in blocking.bound:
        s = b.source
        if not s.column:
            continue
        a, c = F.col(f"a_{s.column}"), F.col(f"b_{s.column}")
        reasons.append(F.count_if(a.isNull() | c.isNull()).alias(f"{b.name}: null"))
        if b.rank:
            reasons.append(F.count_if(a.isNotNull() & c.isNotNull()).alias(f"{b.name}: outside the window"))
        else:
            reasons.append(F.count_if(F.coalesce(a != c, F.lit(False))).alias(f"{b.name}: disagreed"))
            if s.type == "rare_value":
                reasons.append(F.count_if(F.coalesce(a == c, F.lit(False))).alias(f"{b.name}: too common"))
    gains = {}
    for b in blocking.bound:
        if b.rank:
            gap = F.abs(F.col(f"a_{b.rank}") - F.col(f"b_{b.rank}"))
            for times in (2, 5, 10, 100, 1000):
                gains.setdefault(times, []).append(F.coalesce(gap <= times * b.source.window, F.lit(False)))
    out.cap_gains = _cap_gains(store, blocking, missed)
    agree = {c.name: level_holds(store.schema, c, v) for c in store.schema.comparisons for v in c.levels if v.type == "exact"}
    columns = [*reasons, *(F.count_if(reduce(Column.__or__, x)).alias(f"w{t}") for t, x in gains.items()), *(F.count_if(x).alias(f"still {n}") for n, x in agree.items())]
    if not columns:
        return
    r = missed.agg(*columns).first().asDict()
    out.window_gains = {t: r[f"w{t}"] for t in gains}
    out.still_agree = {n: r[f"still {n}"] for n in agree}
    out.misses = {k: v for k, v in r.items() if ": " in k}


@dataclass
class Completeness:
    bound: float
    estimate: float
    product: float
    fires: dict[str, float]
    pooled: float
    by_table: float | None = None
    refused: str = ""
    two_way: list[tuple[str, str]] = field(default_factory=list)


def firing_rates(store: Store, blocking: Blocking, pair_weighting: bool = False) -> dict[str, float]:
    """Of pairs that agree on a blocked column, the share its sources produce."""
    out: dict[str, float] = {}
    for b in blocking.bound:
        s = b.source
        if not s.column or b.rank:
            continue
        cap = s.max_frequency if s.type == "rare_value" and s.max_frequency else (1 << 62)
        w = F.col("tf") * (F.col("tf") - 1) / 2 if pair_weighting else F.col("tf").cast("double")
        r = store.dictionary(s.column).where("tf >= 2").agg(F.sum(F.when(F.col("tf") <= cap, w).otherwise(0.0)).alias("in"), F.sum(w).alias("all")).first()
        out[s.column] = max(out.get(s.column, 0.0), (r["in"] / r["all"]) if r["all"] else 0.0)
    return out


def completeness(store: Store, model: Model, all_pairs: bool = False, sample: float = 1.0, min_observed: int = 64, pair_weighting: bool = False, bound_only: bool = False, seed: int = 20260903) -> Completeness:
    """Blocking recall from the model's m and the sources' firing rates, corrected by how often other sources also catch what one catches."""
    schema = store.schema
    sources = schema.for_purpose("predict", all_pairs).blocking
    if any(s.type == "all_pairs" for s in sources):
        return Completeness(1.0, 1.0, 1.0, {}, 1.0)
    blocking = Blocking(store, sources)
    fires = firing_rates(store, blocking, pair_weighting)
    blocked = []
    for k, c in enumerate(schema.comparisons):
        rates = [fires[x] for x in fires if any(schema.same_source(x, n) for n in c.columns)]
        exact = [i for i, v in enumerate(c.levels) if v.type == "exact"]
        if rates and exact:
            blocked.append((k, exact[0], max(rates)))
    if not blocked:
        return Completeness(0.0, 0.0, 0.0, fires, 0.0, refused="no comparison has an exact level on a blocked column")
    m = [np.array([v.m for v in c.levels]) for c in model.comparisons]
    # independent comparisons: a pair escapes if no blocked one agrees and fires
    escape = math.prod(1 - float(m[k][i]) * f for k, i, f in blocked)
    bound = max(float(m[k][i]) * f for k, i, f in blocked)
    product = 1 - escape
    if bound_only:
        return Completeness(bound, product, product, fires, 0.0)
    # analytic sources also meet through windows and minhash: how often, among pairs caught by a key
    analytic = [b for b in blocking.bound if b.key and b.source.type in ("exact_value", "rare_value")]
    # a source on the same column fires for the same reason and is no second look
    others = [b for b in blocking.bound if b not in analytic and not any(schema.same_source(b.source.column, x.source.column) for x in analytic)]
    pooled = 0.0
    keyed = [i for i, b in enumerate(blocking.bound) if b in analytic]
    pairs = blocking.pairs(compared_columns(schema), keyed)
    if sample < 1:
        pairs = pairs.where(hash_share(sample, seed, "a___row", "b___row"))
    also = reduce(Column.__or__, [b.produces() for b in others], F.lit(False))
    pairs, known = graded(store, pairs, schema)
    rows = pairs.select(agreement(schema, False, known).alias("gamma"), also.cast("int").alias("also")).groupBy("gamma").agg(F.count("*").alias("n"), F.sum("also").alias("also")).collect()
    posterior = np.array([1 / (1 + 2.0 ** -model.base_weight(schema.unpack(r.gamma))) for r in rows])
    n, caught = np.array([r.n for r in rows], float), np.array([r.also for r in rows], float)
    matches = posterior * n
    if n.sum() >= min_observed and matches.sum() > 0:
        pooled = float((posterior * caught).sum() / matches.sum())
    corrected = 1 - escape * (1 - pooled)
    table, two_way = _by_table(schema, rows, matches, blocked, pooled)
    unlearnt = [c.name for k, c in enumerate(model.comparisons) if k in {k for k, _, _ in blocked} and not c.sessions]
    refused = f"no session could learn {', '.join(unlearnt)}, on which the estimate rests" if unlearnt and any(c.sessions for c in model.comparisons) else ""
    return Completeness(bound, corrected, product, fires, pooled, table, refused, two_way)


def _by_table(schema, rows, matches: np.ndarray, blocked: list, pooled: float) -> tuple[float | None, list[tuple[str, str]]]:
    """Recall from a log-linear fit of the blocked comparisons' agreement table, whose all-disagree cell no key reaches, and the pairs of
    comparisons that the fit lets depend on each other: independence first, then pair by pair, as long as BIC falls."""
    d = len(blocked)
    if d > MOST_TABLE:
        return None, []
    caught, seen = np.zeros((2,) * d), np.zeros((2,) * d)
    for r, x in zip(rows, matches, strict=True):
        levels = schema.unpack(r.gamma)
        caught[tuple(int(levels[k] == i) for k, i, _ in blocked)] += float(x)
    caught[(0,) * d] = 0.0
    for cell in np.ndindex(caught.shape):  # a cell's pairs, had every source of its agreeing columns fired
        seen[cell] = caught[cell] / max(1 - math.prod(1 - f for (_, _, f), y in zip(blocked, cell, strict=True) if y), 1e-6)
    if np.count_nonzero(seen) <= d + 1:
        return None, []
    chosen, (fitted, best) = [], _log_linear(seen, [])
    while True:
        trials = [(p, _log_linear(seen, [*chosen, p])) for p in itertools.combinations(range(d), 2) if p not in chosen and 1 + d + len(chosen) + 1 < np.count_nonzero(seen)]
        if not trials or min(x[1][1] for x in trials) >= best:
            break
        pair, (fitted, best) = min(trials, key=lambda x: x[1][1])
        chosen.append(pair)
    total = float(seen.sum() + fitted[(0,) * d])
    names = [(schema.comparisons[blocked[i][0]].name, schema.comparisons[blocked[j][0]].name) for i, j in chosen]
    return ((float(caught.sum()) + (total - float(caught.sum())) * pooled) / total if total else None), names


def _log_linear(seen: np.ndarray, pairs: list[tuple[int, int]], rounds: int = 200, passes: int = 5) -> tuple[np.ndarray, float]:
    """(fitted table, BIC) of main effects and the stated two-way margins. The first cell is not observed: it is filled with what the fit says and fitted again."""
    d, dark = seen.ndim, (0,) * seen.ndim
    covered = {i for p in pairs for i in p}
    margins = [*pairs, *((i,) for i in range(d) if i not in covered)]
    fitted, whole = np.full(seen.shape, max(seen.sum(), 1e-12) / seen.size), seen.copy()
    for _ in range(rounds):
        before = whole[dark]
        whole[dark] = fitted[dark]
        for _ in range(passes):
            for margin in margins:
                rest = tuple(i for i in range(d) if i not in margin)
                have = fitted.sum(axis=rest, keepdims=True)
                fitted = fitted * np.divide(whole.sum(axis=rest, keepdims=True), have, out=np.zeros_like(have), where=have > 0)
        if abs(fitted[dark] - before) < 1e-9 * max(1.0, before):
            break
    told = (seen > 0) & (fitted > 0)
    told[dark] = False
    misfit = 2 * float((seen[told] * np.log(seen[told] / fitted[told])).sum())
    return fitted, misfit + (1 + d + len(pairs)) * math.log(max(float(seen.sum()), 2.0))
