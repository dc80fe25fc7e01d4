"""Better ladders: thresholds proposed from similarity curves, and levels merged that scores cannot tell apart."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.diagnostics.columns import anchor_pairs, profile
from kithlink.functions import text
from kithlink.functions.levels import agreement
from kithlink.operators.blocking import Blocking
from kithlink.operators.classes import pair_count, weighted_pairs
from kithlink.operators.estimate import compared_columns, hash_share
from kithlink.operators.grades import blocked, graded
from kithlink.plans.model import LevelFit, Model
from kithlink.plans.schema import Comparison, Level, Schema
from kithlink.sources.store import Store

FLOOR, STEP, EDITS, MOST, MIN_PAIRS = 0.75, 0.01, 4, 8, 500


# -- curves


@dataclass
class Curve:
    """Shares of random (u) and matching (m) pairs in each bin of a similarity; bin 0 is equality, the last is the rest."""

    comparison: str
    metric: str
    edges: list[float]
    u: list[float]
    m: list[float]
    draws: float
    pairs: int


def axis(c: Comparison, floor: float = FLOOR, step: float = STEP, edits: int = EDITS) -> tuple[str, list[float]]:
    """(metric, lower edges) of a comparison's similarity bins, its own thresholds among them."""
    jaro = [v.threshold for v in c.levels if v.type == "jaro_winkler"]
    if jaro:
        low = min(floor, *jaro)
        grid = [round(1 - step * i, 10) for i in range(1, int(round((1 - low) / step)) + 1)]
        return "jaro_winkler", sorted({*grid, *jaro}, reverse=True)
    lev = [int(v.threshold) for v in c.levels if v.type == "levenshtein"]
    return "levenshtein", [float(d) for d in range(1, max([edits, *lev]) + 1)]


def bin_of(metric: str, edges: list[float], a, b):
    """The bin of two texts: 0 equal, then one per edge, then the rest."""
    if metric == "levenshtein":
        d = F.levenshtein(a, b, int(edges[-1]))
        return F.when(a == b, 0).when(d < 0, len(edges) + 1).otherwise(d)
    pick = lambda s: F.coalesce(*(F.when(s >= e, F.lit(i + 1)) for i, e in enumerate(edges)), F.lit(len(edges) + 1))
    return F.when(a == b, 0).otherwise(F.transform(F.array(text.jaro_winkler(a, b)), pick)[0])


def u_curve(store: Store, column: str, metric: str, edges: list[float], budget: float = 4e10) -> tuple[np.ndarray, float]:
    """Exact shares of random pairs of records by bin, from a join of the dictionary with itself; and the number of draws."""
    words = store.dictionary(column)
    size = words.count()
    if size * (size - 1) / 2 > budget:
        raise ValueError(f"the {size} values of {column!r} make more pairs than the budget of {budget:g}")
    left, right = words.select(F.col("value").alias("a"), F.col("tf").alias("ta")), words.select(F.col("value").alias("b"), F.col("tf").alias("tb"))
    met = blocked(left, right, size, "a", "b").where("a < b")
    rows = met.groupBy(bin_of(metric, edges, F.col("a"), F.col("b")).alias("bin")).agg(F.sum(F.col("ta").cast("double") * F.col("tb") * 2).alias("n")).collect()
    r = words.agg(F.sum("tf").alias("p"), F.sum(F.col("tf").cast("double") * (F.col("tf") - 1)).alias("same")).first()
    draws = float((r.p or 0) * ((r.p or 0) - 1))
    out = np.zeros(len(edges) + 2)
    out[0] = r.same or 0.0
    for x in rows:
        out[x.bin] += x.n
    return out / max(draws, 1.0), draws


def m_curve(pairs: DataFrame, column: str, metric: str, edges: list[float]) -> tuple[np.ndarray, int]:
    a, b = F.col(f"a_{column}"), F.col(f"b_{column}")
    rows = pairs.where(a.isNotNull() & b.isNotNull()).groupBy(bin_of(metric, edges, a, b).alias("bin")).agg(F.count("*").alias("n")).collect()
    out = np.zeros(len(edges) + 2)
    for x in rows:
        out[x.bin] += x.n
    return out / max(out.sum(), 1), int(out.sum())


# -- partition of bins


def group_bits(m: float, u: float, pairs: int, draws: float) -> float:
    """Information of a group of bins; an empty match share has none."""
    if m <= 0:
        return 0.0
    return m * math.log2(max(m, 0.5 / max(pairs, 1)) / max(u, 0.5 / max(draws, 1.0)))


def best_partition(u: np.ndarray, m: np.ndarray, pairs: int, draws: float, most: int = MOST) -> dict[int, tuple[float, list[int]]]:
    """For each number of groups: (bits, first bins of the groups), by dynamic programming over runs of bins; equality stays alone."""
    n = len(u)
    cu, cm = np.concatenate(([0], np.cumsum(u))), np.concatenate(([0], np.cumsum(m)))
    gain = lambda i, j: group_bits(cm[j] - cm[i], cu[j] - cu[i], pairs, draws)
    best = {(1, 1): (gain(0, 1), [0])}
    for count in range(2, min(most, n) + 1):
        for end in range(count, n + 1):
            options = [(best[count - 1, i][0] + gain(i, end), [*best[count - 1, i][1], i]) for i in range(1, end) if (count - 1, i) in best]
            if options:
                best[count, end] = max(options)
    return {count: best[count, n] for count in range(1, min(most, n) + 1) if (count, n) in best}


@dataclass
class LadderAdvice:
    comparison: str
    metric: str
    now: list[float]
    proposed: list[float]
    bits_now: float
    bits_proposed: float
    bic: dict[int, float]
    refused: str = ""


def advise_levels(store: Store, truth: DataFrame | None = None, levels: int | None = None, most: int = MOST, floor: float = FLOOR, step: float = STEP, edits: int = EDITS, min_pairs: int = MIN_PAIRS, **anchoring) -> tuple[list[LadderAdvice], Schema]:
    """For each fuzzy one-column comparison: the thresholds that carry most bits, and the schema with them."""
    schema, out, comparisons = store.schema, [], list(store.schema.comparisons)
    wanted = [k for k, c in enumerate(schema.comparisons) if len(c.columns) == 1 and len({v.type for v in c.levels if v.type in ("jaro_winkler", "levenshtein")}) == 1]
    found = profile(store, pairs=True, anchors=True, **anchoring) if truth is None and wanted else None
    for k in wanted:
        c = schema.comparisons[k]
        name = c.columns[0]
        metric, edges = axis(c, floor, step, edits)
        own = [v.threshold for v in c.levels if v.type == metric]
        if truth is not None:
            a, b = (store.frame.select(F.col("__row").alias(f"row_{s}"), F.col(name).alias(f"{s}_{name}")) for s in "ab")
            pairs = truth.select("row_a", "row_b").join(a, "row_a").join(b, "row_b")
        else:
            session = next((s for s in found.anchors if name in s.learned and s.pairs >= min_pairs), None)
            if session is None:
                out.append(LadderAdvice(c.name, metric, own, own, 0.0, 0.0, {}, "no anchor ties enough pairs without it"))
                continue
            pairs = anchor_pairs(store, list(session.anchor))
        m, n = m_curve(pairs, name, metric, edges)
        if n < min_pairs:
            out.append(LadderAdvice(c.name, metric, own, own, 0.0, 0.0, {}, f"{n} matching pairs are too few"))
            continue
        u, draws = u_curve(store, name, metric, edges)
        table = best_partition(u, m, n, draws, most)
        count = min(levels or len([v for v in c.levels if v.type != "null"]), max(table))
        bits, firsts = table[count]
        ends = [*firsts[1:], len(u)]
        proposed = [edges[e - 2] for e in ends[1:-1]]  # the edge of a group's last bin
        cuts = [0, 1, *[edges.index(t) + 2 for t in sorted(own, reverse=metric == "jaro_winkler")], len(u)]
        now = sum(group_bits(m[a:b].sum(), u[a:b].sum(), n, draws) for a, b in zip(cuts, cuts[1:], strict=False))
        out.append(LadderAdvice(c.name, metric, own, proposed, now, bits, {q: n * v[0] - 0.5 * (q - 1) * math.log2(n) for q, v in table.items()}))
        kept = [v for v in c.levels if v.type in ("null", "exact")]
        comparisons[k] = replace(c, levels=(*kept, *(Level(metric, t) for t in proposed), Level("else")))
    return out, replace(schema, comparisons=tuple(comparisons), _by_name={})


# -- merging


def implies(upper: Level, lower: Level) -> bool:
    """Whether a pair on the upper level would also fire the lower one."""
    if lower.type == "else":
        return upper.type != "null"
    if upper.column != lower.column:
        return False
    if upper.type == "exact":
        return lower.type in ("levenshtein", "jaro_winkler", "date_within", "numeric_within", "percentage_within", "list_jaccard") or lower.type == "list_overlap" and lower.threshold <= 1
    if upper.type != lower.type:
        return False
    falling = upper.type in ("jaro_winkler", "list_overlap", "list_jaccard", "list_jaro_winkler", "contains_jaro_winkler")
    return upper.threshold >= lower.threshold if falling else upper.threshold <= lower.threshold


@dataclass
class Merge:
    comparison: str
    upper: str
    lower: str
    gap: float
    p: float


def two_by_two(a: tuple[float, float], b: tuple[float, float]) -> float:
    """p of independence in a 2 x 2 table, by G-square with one degree."""
    total = [x + y for x, y in zip(a, b, strict=True)]
    n = sum(total)
    g = 0.0
    for row in (a, b):
        for x, t in zip(row, total, strict=True):
            e = sum(row) * t / n if n else 0.0
            if x > 0 and e > 0:
                g += 2 * x * math.log(x / e)
    return math.erfc(math.sqrt(max(g, 0.0) / 2))


def simplify(store: Store, model: Model, alpha: float = 0.01, min_gap: float = 0.0, pair_cap: int | None = None, all_pairs: bool = False, seed: int = 20260903) -> tuple[list[Merge], Schema | None]:
    """Merge neighbouring levels whose weights the scored pairs cannot tell apart, the least different first."""
    model.check(store.schema)
    schema = store.schema
    blocking = Blocking(store, schema.for_purpose("predict", all_pairs).blocking)
    total = sum(blocking.counts(k)["pairs"] for k in range(len(blocking.bound))) if pair_cap else 0
    rate = min(1.0, pair_cap / total) if pair_cap and total else 1.0
    if rate < 1:
        pairs = blocking.pairs(compared_columns(schema)).where(hash_share(rate, seed, "a___row", "b___row"))
    else:
        pairs = weighted_pairs(blocking, compared_columns(schema))
    pairs, known = graded(store, pairs, schema)
    rows = pairs.groupBy(agreement(schema, False, known).alias("gamma")).agg(pair_count(pairs).alias("n")).collect()
    n = sum(r.n for r in rows) / rate
    scale_m = sum(r.n / (1 + 2.0 ** -model.base_weight(schema.unpack(r.gamma))) for r in rows) / rate
    scale_u = max(n - scale_m, 0.0)
    merges, comparisons = [], []
    for c, fit in zip(schema.comparisons, model.comparisons, strict=True):
        groups: list[tuple[Level, LevelFit]] = [(v, replace(f)) for v, f in zip(c.levels, fit.levels, strict=True)]
        while True:
            options = []
            for i in range(len(groups) - 1):
                (upper, x), (lower, y) = groups[i], groups[i + 1]
                if upper.type == "null" or not implies(upper, lower):
                    continue
                gap = abs(x.weight - y.weight)
                p = two_by_two((scale_m * x.m, scale_u * x.u), (scale_m * y.m, scale_u * y.u))
                if p >= alpha or min_gap and gap < min_gap:
                    options.append((p, -i, gap))
            if not options or len(groups) <= 2:
                break
            p, i, gap = max(options)
            (upper, x), (lower, y) = groups[-i], groups[-i + 1]
            merges.append(Merge(c.name, upper.describe(), lower.describe(), gap, p))
            groups[-i : -i + 2] = [(lower, replace(y, m=x.m + y.m, u=x.u + y.u))]
        comparisons.append(replace(c, levels=tuple(v for v, _ in groups)))
    return merges, replace(schema, comparisons=tuple(comparisons), _by_name={}) if merges else None
