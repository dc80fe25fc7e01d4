"""Classes of records: records that agree on the blocking keys and on every compared column make the same pairs on the same levels.

Classes meet instead of records. Counts weigh each pair of classes by its pairs of records; where the pairs themselves are wanted, what
is left of the class pairs is spread over their records at the very end, chunk by chunk, so only codes and weights of classes are computed
and no pair of records is shuffled. A levels' reading is the same from both sides, so the order of two classes does not matter.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.operators.blocking import Blocking, cells_of
from kithlink.sources.store import Store, with_row_numbers


#: Copies of a chunk of records when class pairs are spread.
DEALT = 4


class Classes:
    """The classes of a blocking: ``frame`` has ``__row`` (the class), ``__n`` (its records), ``__ds`` over several inputs, keys and columns."""

    def __init__(self, blocking: Blocking, by: list[str], frame: DataFrame, count: int):
        self.blocking, self.by, self.frame, self.count = blocking, by, frame, count
        self._members: dict[tuple, DataFrame] = {}

    @staticmethod
    def of(blocking: Blocking, columns: list[str], selected: list[int] | None = None) -> Classes | None:
        """None where there is nothing to gain: a source by ranks tells all records apart, or most classes would have one record."""
        bound = blocking.bound if selected is None else [blocking.bound[k] for k in selected]
        if any(b.rank for b in bound):
            return None
        several = len(blocking.store.names) > 1
        by = list(dict.fromkeys([*(["__ds"] if several else []), *(b.key for b in bound if b.key), *columns]))
        counted = blocking.frame.groupBy(*(by or [F.lit(0).alias("__all")])).agg(F.count("*").alias("__n"))
        frame, count = with_row_numbers(counted)
        return Classes(blocking, by, frame, count) if 2 * count <= blocking.store.records else None

    def pairs(self, columns: list[str], masks: dict[str, Column] | None = None, selected: list[int] | None = None) -> DataFrame:
        """Pairs of classes, and classes of several records with themselves, as ``Blocking.pairs`` gives those of records; ``__w`` is a pair's number of record pairs."""
        masks = masks or {}
        frame = self.frame.withColumns(masks) if masks else self.frame
        on = self.blocking.on(frame, self.count)
        columns = [*columns, *masks, "__n"]
        out = on.pairs(columns, selected)
        if not self.blocking.store.cross:
            selected = list(range(len(on.bound))) if selected is None else selected
            several = frame.where("__n > 1")
            a, b = on.side("a", columns, several), on.side("b", columns, several)
            own = several.select(*(F.col(c[2:]).alias(c) for c in a.columns), *(F.col(c[2:]).alias(c) for c in b.columns))
            for n, k in enumerate(selected):
                fresh = on.bound[k].produces() & ~on.produced(selected[:n])
                out = out.unionByName(own.where(fresh).withColumn("source", F.lit(k)))
        n = F.col("a___n")
        return out.withColumn("__w", F.when(F.col("a___row") == F.col("b___row"), F.expr("a___n * (a___n - 1) div 2")).otherwise(n * F.col("b___n")))

    def store(self) -> Store:
        """The classes as records of the store they come from: value counts and the number of records stay its own."""
        whole, frame = self.blocking.store, self.frame.withColumn("__id", F.lit(""))
        for c in whole.schema.columns:
            whole.dictionary(c.name)
        return replace(whole, frame=frame if "__ds" in frame.columns else frame.withColumn("__ds", F.lit(0)))

    # -- from classes to records

    def members(self, held: dict[str, Column]) -> DataFrame:
        """(class, chunk, records): the records of every class in chunks of bounded length, with the columns ``held``."""
        frame = self.blocking.frame
        hashed = F.xxhash64(*self.by) if self.by else F.lit(0).cast("long")
        known = self.frame.select(F.col("__row").alias("__c"), F.col("__n").alias("__cn"), hashed.alias("__ch"), *(F.col(x).alias(f"__c_{x}") for x in self.by))
        same = reduce(Column.__and__, (F.col(x).eqNullSafe(F.col(f"__c_{x}")) for x in self.by), F.col("__h") == F.col("__ch"))
        record = F.struct(F.col("__row").alias("row"), *(x.alias(n) for n, x in held.items()))
        told = frame.withColumn("__h", hashed).join(known, same).select("__c", F.pmod(F.xxhash64("__row"), cells_of(F.col("__cn"))).cast("int").alias("__x"), record.alias("__r"))
        return told.groupBy("__c", "__x").agg(F.collect_list("__r").alias("__m"))

    def expand(self, pairs: DataFrame, payload: list[str], held: dict[str, Column]) -> DataFrame:
        """The record pairs of class pairs: ``a___row``, ``b___row``, ``a_x`` and ``b_x`` of what is held, in order, and the payload."""
        store = self.blocking.store
        tasks = self.blocking.tasks()
        members = self.members(held).checkpoint()
        own = F.col("a___row") == F.col("b___row")
        upto = lambda s: F.sequence(F.lit(0), cells_of(F.col(f"{s}___n")) - 1)
        dealt = pairs.select("a___row", "b___row", "b___n", *payload, F.explode(upto("a")).alias("__x"))
        dealt = dealt.select("a___row", "b___row", *payload, "__x", F.explode(upto("b")).alias("__y")).where(~own | F.expr("__x <= __y"))
        side = lambda s, x: members.select(F.col("__c").alias(f"{s}___row"), F.col("__x").alias(x), F.col("__m").alias(f"__m{s}"))
        # a task holds what one input row makes, so the records of a come to the chunks of b one by one; a chunk has DEALT copies, for as many tasks
        left = dealt.repartition(tasks, "a___row", "__x").join(side("a", "__x").repartition(tasks, "a___row", "__x").hint("shuffle_hash"), ["a___row", "__x"])
        left = left.select("b___row", "__y", (own & F.expr("__x = __y")).alias("__one"), *payload, F.explode("__ma").alias("__p")).withColumn("__s", F.pmod("__p.row", F.lit(DEALT)).cast("int"))
        right = side("b", "__y").withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        keys = ["b___row", "__y", "__s"]
        met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("shuffle_hash"), keys)
        met = met.select("__one", *payload, "__p", F.explode("__mb").alias("__q")).where(~F.col("__one") | (F.col("__p.row") < F.col("__q.row")))
        names = {"row": "__row", **{n: n for n in held}}
        turn = F.lit(False) if store.cross else F.col("__p.row") > F.col("__q.row")
        first = [F.when(turn, F.col(f"__q.{n}")).otherwise(F.col(f"__p.{n}")).alias(f"a_{c}") for n, c in names.items()]
        second = [F.when(turn, F.col(f"__p.{n}")).otherwise(F.col(f"__q.{n}")).alias(f"b_{c}") for n, c in names.items()]
        return met.select(*first, *second, *payload)


def weighted_pairs(blocking: Blocking, columns: list[str], masks: dict[str, Column] | None = None, selected: list[int] | None = None) -> DataFrame:
    """A pair frame to count over: of classes, with ``__w``, or of records where classes gain nothing."""
    masks = masks or {}
    classes = Classes.of(blocking, columns, selected)
    if classes is not None:
        return classes.pairs(columns, masks, selected)
    return blocking.pairs([*columns, *masks], selected, blocking.frame.withColumns(masks) if masks else None)


def pair_count(pairs: DataFrame) -> Column:
    """The number of record pairs in a frame of either kind."""
    return F.sum("__w") if "__w" in pairs.columns else F.count("*")


def spread(blocking: Blocking, columns: list[str], held: dict[str, Column], made: dict[str, Column] | None = None) -> DataFrame:
    """All pairs of a blocking with the columns ``held`` of both records, ``source``, and what is ``made`` of their ``columns`` (once a pair of classes)."""
    made = made or {}
    classes = Classes.of(blocking, columns)
    if classes is not None:
        return classes.expand(classes.pairs(columns).withColumns(made), ["source", *made], held)
    names = [c for c in dict.fromkeys(["__row", *columns]) if c not in held]
    frame = blocking.frame.withColumns({f"__h_{n}": x for n, x in held.items()})
    pairs = blocking.pairs([*names, *(f"__h_{n}" for n in held)], frame=frame)
    return pairs.select("a___row", "b___row", *(F.col(f"{s}___h_{n}").alias(f"{s}_{n}") for s in "ab" for n in held), "source", *(x.alias(n) for n, x in made.items()))
