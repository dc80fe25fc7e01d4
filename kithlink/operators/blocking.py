"""Blocking: candidate pairs as equi-joins, each pair from the first source that produces it.

A source gives every record a key (or, for a sorted neighbourhood, a rank); a pair is produced where the keys agree (the ranks
lie within the window). Pairs are never collected, cached or made distinct: source k carries the keys of the
earlier sources along and drops what they produce.

A group of n records makes n * n / 2 pairs, so a group over ``CELL`` records is dealt over cells of about ``CELL`` by ``CELL`` records;
a very large one over cells of ``LARGE_CELL`` a side, as every record goes to as many cells as there are a side.
The joins that make pairs keep their number of tasks: their input is small and their output is not, which adaptive execution cannot know.
"""

from __future__ import annotations

import copy
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.functions import text
from kithlink.plans.schema import Source
from kithlink.sources.store import Store

#: Records a side of a cell, in a group of a key and when all records meet all.
CELL, ALL_CELL = 512, 2048
#: And in groups of over 16 cells a side.
LARGE_CELL = 4096


def cells_of(n: Column) -> Column:
    """Cells a side of a group of n records."""
    small, large = F.ceil(n / CELL), F.ceil(n / LARGE_CELL)
    return F.greatest(F.least(small, F.lit(16)), large, F.lit(1)).cast("int")


class Bound:
    """A source (or one band of a minhash source) on a store."""

    def __init__(self, source: Source, name: str, key: str | None = None, rank: str | None = None):
        self.source, self.name, self.key, self.rank = source, name, key, rank

    def produces(self) -> Column:
        """Whether it produces a pair; never null. The pair's mode is tested elsewhere."""
        if self.rank:
            return F.coalesce(F.abs(F.col(f"a_{self.rank}") - F.col(f"b_{self.rank}")) <= self.source.window, F.lit(False))
        if self.key:
            return F.coalesce(F.col(f"a_{self.key}") == F.col(f"b_{self.key}"), F.lit(False))
        return F.lit(True)


def ranks(store: Store, column: str, name: str) -> DataFrame:
    """(__row, name): the record's place by (value, row). Only distinct values are ordered in one pass; ties are numbered within their value."""
    dictionary = store.dictionary(column)
    # running totals over range partitions: inside each, then over the partitions' totals
    parts = dictionary.repartitionByRange("value").sortWithinPartitions("value").withColumns({"__p": F.spark_partition_id()}).checkpoint()
    inside = Window.partitionBy("__p").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    totals = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("__p").agg(F.sum("tf").alias("t")).select("__p", F.coalesce(F.sum("t").over(totals), F.lit(0)).alias("__before"))  # a row a partition
    offsets = parts.withColumn("__in", F.coalesce(F.sum("tf").over(inside), F.lit(0))).join(F.broadcast(before), "__p").select("value", (F.col("__before") + F.col("__in")).alias("__o"))
    own = store.frame.where(F.col(column).isNotNull()).select("__row", F.col(column).alias("value"))
    within = F.row_number().over(Window.partitionBy("value").orderBy("__row")) - 1
    return own.withColumn("__w", within).join(offsets, "value").select("__row", (F.col("__o") + F.col("__w")).alias(name))


class Blocking:
    """The bound sources of a schema, in order."""

    def __init__(self, store: Store, sources: tuple[Source, ...]):
        self.store, self.sources = store, sources
        self.bound: list[Bound] = []
        frame = store.frame
        for i, s in enumerate(sources):
            if s.type == "all_pairs":
                self.bound.append(Bound(s, s.name))
            elif s.type == "exact_value":
                frame = frame.withColumn(f"__k{i}", F.col(s.column))
                self.bound.append(Bound(s, s.name, f"__k{i}"))
            elif s.type == "rare_value":
                cap = s.max_frequency or (1 << 62)
                rare = store.dictionary(s.column).where(F.col("tf").between(2, cap)).select(F.col("value").alias(f"__k{i}"))
                frame = frame.join(rare, F.col(s.column) == F.col(f"__k{i}"), "left")
                self.bound.append(Bound(s, s.name, f"__k{i}"))
            elif s.type == "minhash":
                bands = store.dictionary(s.column).select(F.col("value").alias(f"__v{i}"), text.minhash_bands(F.col("value"), s.bands, s.rows_per_band, s.ngram, s.seed).alias(f"__h{i}"))
                frame = frame.join(bands, F.col(s.column) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
                for b in range(s.bands):
                    frame = frame.withColumn(f"__k{i}_{b}", F.col(f"__h{i}")[b])
                    self.bound.append(Bound(s, f"{s.name} band {b + 1}", f"__k{i}_{b}"))
                frame = frame.drop(f"__h{i}")
            else:
                frame = frame.join(ranks(store, s.column, f"__r{i}"), "__row", "left")
                self.bound.append(Bound(s, s.name, rank=f"__r{i}"))
        self.frame, self.size = frame, store.records
        self._large: dict[str, DataFrame | None] = {}

    def on(self, frame: DataFrame, size: int) -> Blocking:
        """The same sources over other rows that have their keys."""
        out = copy.copy(self)
        out.frame, out.size, out._large = frame, size, {}
        return out

    # -- pairs

    def tasks(self) -> int:
        """Tasks of a join that makes pairs: as many as the session shuffles to, and two a core at least."""
        return max(int(self.store.spark.conf.get("spark.sql.shuffle.partitions")), 2 * self.store.spark.sparkContext.defaultParallelism)

    def large_groups(self, b: Bound) -> DataFrame | None:
        """(key, cells a side) of the groups that are dealt over several cells; None if the source cannot have any."""
        if b.key not in self._large:
            found = None
            if b.source.type != "rare_value" or not b.source.max_frequency or b.source.max_frequency > CELL:
                sizes = self.frame.where(F.col(b.key).isNotNull()).groupBy(F.col(b.key).alias("__key")).agg(F.count("*").alias("n")).where(F.col("n") > CELL)
                found = sizes.select("__key", cells_of(F.col("n")).alias("__cells")).checkpoint()
                found = None if found.isEmpty() else found
            self._large[b.key] = found
        return self._large[b.key]

    def _key_pairs(self, left: DataFrame, right: DataFrame, b: Bound) -> DataFrame:
        """Rows with equal keys; those of large groups meet cell by cell."""
        left, right = left.where(F.col(f"a_{b.key}").isNotNull()), right.where(F.col(f"b_{b.key}").isNotNull())
        large, on = self.large_groups(b), F.col(f"a_{b.key}") == F.col(f"b_{b.key}")
        if large is None:
            left, right = left.repartition(self.tasks(), f"a_{b.key}"), right.repartition(self.tasks(), f"b_{b.key}")
            return left.join(right, on)
        cells = F.coalesce("__cells", F.lit(1))
        every = F.explode(F.sequence(F.lit(0), cells - 1))
        sides = []
        for s, df, own, other in (("a", left, "x", "y"), ("b", right, "y", "x")):
            df = df.join(large, F.col(f"{s}_{b.key}") == F.col("__key"), "left")
            df = df.withColumn(f"{s}__{own}", F.pmod(f"{s}___row", cells).cast("int")).withColumn(f"{s}__{other}", every).drop("__key", "__cells")
            sides.append(df.repartition(self.tasks(), f"{s}_{b.key}", f"{s}__x", f"{s}__y"))
        on = on & (F.col("a__x") == F.col("b__x")) & (F.col("a__y") == F.col("b__y"))
        return sides[0].join(sides[1], on).drop("a__x", "a__y", "b__x", "b__y")

    def side(self, prefix: str, columns: list[str], frame: DataFrame | None = None) -> DataFrame:
        keys = [x for b in self.bound for x in (b.key, b.rank) if x]
        frame = self.frame if frame is None else frame
        return frame.select(*(F.col(c).alias(f"{prefix}_{c}") for c in dict.fromkeys(["__row", "__ds", "__id", *keys, *columns]) if c in frame.columns))

    def pair_ok(self) -> Column:
        """In dedup the smaller row first; in linking the earlier input first."""
        return F.col("a___ds") < F.col("b___ds") if self.store.cross else F.col("a___row") < F.col("b___row")

    def produced(self, selected: list[int]) -> Column:
        return reduce(Column.__or__, [self.bound[j].produces() for j in selected], F.lit(False))

    def pairs_of(self, k: int, columns: list[str], earlier: list[int] | None = None, frame: DataFrame | None = None) -> DataFrame:
        """Pairs of one source that the ``earlier`` ones do not produce."""
        b = self.bound[k]
        left, right = self.side("a", columns, frame), self.side("b", columns, frame)
        if b.key:
            joined = self._key_pairs(left, right, b).where(self.pair_ok())
        elif b.rank:
            joined = self._window_pairs(left, right, b)
        else:
            joined = self._all_pairs(left, right)
        return joined.where(~self.produced(earlier)) if earlier else joined

    def _window_pairs(self, left: DataFrame, right: DataFrame, b: Bound) -> DataFrame:
        """Ranks within the window, as an equi-join on the rank's stretch and the next; each pair from its lower rank, then put in order."""
        w = b.source.window
        a_rank, b_rank = F.col(f"a_{b.rank}"), F.col(f"b_{b.rank}")
        lower = left.where(a_rank.isNotNull()).withColumn("__z", F.explode(F.array(F.floor(a_rank / w), F.floor(a_rank / w) + 1)))
        upper = right.where(b_rank.isNotNull()).withColumn("__z", F.floor(b_rank / w))
        near = lower.join(upper, "__z").where((b_rank - a_rank).between(1, w)).drop("__z")
        if self.store.cross:
            near = near.where(F.col("a___ds") != F.col("b___ds"))
        turn = ~self.pair_ok()
        names = [c[2:] for c in left.columns]
        return near.select(*(F.when(turn, F.col(f"b_{n}")).otherwise(F.col(f"a_{n}")).alias(f"a_{n}") for n in names), *(F.when(turn, F.col(f"a_{n}")).otherwise(F.col(f"b_{n}")).alias(f"b_{n}") for n in names))

    def _all_pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        n = max(1, -(-self.size // ALL_CELL))
        if n == 1:  # few records still spread over the cores
            n = max(1, min(self.store.spark.sparkContext.defaultParallelism, self.size // 64))
        every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        a = left.withColumn("__x", F.pmod("a___row", F.lit(n)).cast("int")).withColumn("__y", every)
        b = right.withColumn("__y", F.pmod("b___row", F.lit(n)).cast("int")).withColumn("__x", every)
        cells = min(n * n, 20_000)
        return a.repartition(cells, "__x", "__y").join(b.repartition(cells, "__x", "__y"), ["__x", "__y"]).drop("__x", "__y").where(self.pair_ok())

    def pairs(self, columns: list[str] | None = None, selected: list[int] | None = None, frame: DataFrame | None = None) -> DataFrame:
        """The union of the selected sources, without duplicates; ``source`` is the place of the one that produced the pair."""
        selected = list(range(len(self.bound))) if selected is None else selected
        if not selected:
            raise ValueError("there is no blocking source")
        out = None
        for n, k in enumerate(selected):
            part = self.pairs_of(k, columns or [], selected[:n], frame).withColumn("source", F.lit(k))
            out = part if out is None else out.unionByName(part)
        return out

    # -- counts without pairs

    def counts(self, k: int) -> dict:
        """Exact pairs, largest group and the pooled count of one source, from its keys alone."""
        b = self.bound[k]
        if b.rank:
            return self._window_counts(b)
        if not b.key:
            return {"pairs": self.store.pair_space, "largest": self.store.records}
        per = self.frame.where(F.col(b.key).isNotNull()).groupBy(b.key, "__ds").agg(F.count("*").alias("n"))
        per = per.groupBy(b.key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        pooled = F.col("n") * (F.col("n") - 1) / 2
        cross = (F.col("n") * F.col("n") - F.col("squares")) / 2
        r = per.agg(F.sum((cross if self.store.cross else pooled).cast("long")).alias("p"), F.max(F.when(F.col("n") > 1, F.col("n"))).alias("m")).first()
        return {"pairs": r.p or 0, "largest": r.m or 0}

    def _window_counts(self, b: Bound) -> dict:
        ranked = self.frame.where(F.col(b.rank).isNotNull())
        n = ranked.count()
        w = min(b.source.window, max(n - 1, 0))
        pairs = (n - w) * w + w * (w - 1) // 2 if n > 1 else 0
        if self.store.cross:  # take off the pairs of one input: for each record, those of its own input among the w before it
            pairs -= self._own_window_pairs(ranked, b, w)
        return {"pairs": pairs, "largest": w + 1 if n else 0}

    def approximate_cross(self, k: int) -> float:
        """Pairs of one source between inputs, as its pooled pairs times the share of all pairs that lie between inputs; no key is counted by input."""
        b, n = self.bound[k], self.store.records
        if not b.key:
            return float(self.counts(k)["pairs"])
        per = self.frame.where(F.col(b.key).isNotNull()).groupBy(b.key).agg(F.count("*").alias("n"))
        pooled = per.agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("double"))).first()[0] or 0.0
        return pooled * self.store.pair_space / max(n * (n - 1) / 2, 1)

    def _own_window_pairs(self, ranked: DataFrame, b: Bound, w: int) -> int:
        """Pairs within the window whose records are of one input, by running counts of the inputs over stretches of ranks; no pair is made."""
        stretch = F.floor(F.col(b.rank) / F.lit(max(w, 4096)))
        rows = ranked.select("__ds", F.col(b.rank).alias("r"), stretch.alias("z"))
        # a stretch is counted with the one before it, which holds all that lies in the window
        both = rows.select("__ds", "r", F.lit(True).alias("own"), "z").unionByName(rows.select("__ds", "r", F.lit(False).alias("own"), (F.col("z") + 1).alias("z")))
        before = Window.partitionBy("z", "__ds").orderBy("r").rangeBetween(-w, -1)
        counted = both.withColumn("n", F.count("*").over(before)).where("own")
        return int(counted.agg(F.sum("n")).first()[0] or 0)
