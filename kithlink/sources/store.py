"""Inputs to one record frame: typed, null-normalised, derived columns added, rows numbered.

The frame has ``__row`` (dense over all inputs, in input order), ``__ds`` (the input's number), ``__id`` (text) and the
schema's columns. It is checkpointed, so numbers never change under a retry.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithlink.functions import text
from kithlink.operators.components import ensure_checkpoint_dir
from kithlink.plans.schema import Schema, SchemaError

MODES = ("dedup", "link-and-dedup", "link")
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def column_type(kind: T.DataType) -> str | None:
    """The schema type of a Spark type; None if it has none."""
    if isinstance(kind, (T.StringType, *_WHOLE)):
        return "string"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, *_WHOLE)):
        return "string_list"
    return None


def typed(name: str, kind: T.DataType, wanted: str) -> Column:
    """The column as the schema type. Integers are text, NaN and empty lists are null, lists are sets; kinds are not cast across."""
    x = F.col(f"`{name}`")
    if isinstance(kind, T.NullType):
        return F.lit(None).cast({"string_list": "array<string>"}.get(wanted, wanted))
    if column_type(kind) != wanted:
        raise SchemaError(f"column {name!r} is {kind.simpleString()} in the data and {wanted} in the schema")
    if wanted == "double":
        return F.when(~F.isnan(x), x.cast("double"))
    if wanted == "string_list":
        values = F.array_sort(F.array_distinct(F.array_compact(x.cast("array<string>"))))
        return F.when(F.size(values) > 0, values)
    return x.cast(wanted)


def dataset_names(paths: list[str]) -> list[str]:
    """File stems; commas and colons become underscores, a repeated one gets its place."""
    out: list[str] = []
    for i, p in enumerate(paths):
        stem = re.sub(r"[,:]", "_", re.sub(r"\.[^./]*$", "", p.rstrip("/").rsplit("/", 1)[-1]))
        out.append(f"{stem}#{i + 1}" if stem in out else stem)
    return out if len(paths) > 1 else [""]


def with_row_numbers(df: DataFrame, before: int = 0) -> tuple[DataFrame, int]:
    """The frame with ``__row``, dense numbers in its order by a count per partition and one prefix sum over partitions; and its rows."""
    marked = df.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}).checkpoint()
    sizes = {r["__p"]: r["n"] for r in marked.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts, at = [], before
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    if not starts:
        return marked.withColumn("__row", F.lit(0).cast("long")).drop("__p", "__m"), 0
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__p int, __start long"))
    return marked.join(offsets, "__p").withColumn("__row", F.col("__start") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__p", "__m", "__start"), at - before


@dataclass
class Store:
    """Records and what is known about their columns."""

    frame: DataFrame
    schema: Schema
    names: list[str]
    mode: str
    sizes: list[int]
    _dictionaries: dict = field(default_factory=dict)
    _tables: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    @property
    def records(self) -> int:
        return sum(self.sizes)

    @property
    def cross(self) -> bool:
        return self.mode == "link"

    @cached_property
    def pair_space(self) -> int:
        """Pairs that the mode admits."""
        n = self.records
        return n * (n - 1) // 2 - (sum(k * (k - 1) // 2 for k in self.sizes) if self.cross else 0)

    def dictionary(self, column: str) -> DataFrame:
        """(value, tf): records that hold each value; a list counts for each of its elements."""
        if column not in self._dictionaries:
            x = F.explode(column) if self.schema.type_of(column) == "string_list" else F.col(column)
            values = self.frame.where(F.col(column).isNotNull()).select(x.alias("value"))
            self._dictionaries[column] = values.groupBy("value").agg(F.count("*").alias("tf"))
        return self._dictionaries[column]

    def qualified(self, prefix: str) -> Column:
        """``dataset:id`` over several inputs, else the id."""
        if len(self.names) < 2:
            return F.col(f"{prefix}_id")
        names = F.array(*map(F.lit, self.names))
        return F.concat(names[F.col(f"{prefix}_ds")], F.lit(":"), F.col(f"{prefix}_id"))


def as_frame(spark: SparkSession, x) -> DataFrame:
    """A Spark frame as it is, a parquet path, a pandas frame, or whatever streams Arrow batches (``__arrow_c_stream__``)."""
    if isinstance(x, DataFrame):
        return x
    if isinstance(x, str):
        return spark.read.parquet(x)
    if hasattr(x, "__arrow_c_stream__"):
        import pyarrow as pa

        return spark.createDataFrame(pa.RecordBatchReader.from_stream(x).read_all())
    return spark.createDataFrame(x)


def load(spark: SparkSession, inputs, schema: Schema, mode: str | None = None, ids_only: bool = False) -> Store:
    """Inputs are a frame (of Spark, pandas or Arrow) or path, a list of them, or a dict by name. Only the schema's columns are read."""
    if isinstance(inputs, dict):
        names, frames = list(inputs), list(inputs.values())
    else:
        frames = list(inputs) if isinstance(inputs, (list, tuple)) else [inputs]
        paths = [x if isinstance(x, str) else f"input{i + 1}" for i, x in enumerate(frames)]
        names = dataset_names(paths)
    frames = [as_frame(spark, x) for x in frames]
    mode = mode or ("link" if len(frames) > 1 else "dedup")
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode == "link" and len(frames) < 2:
        raise ValueError("linking needs two inputs at least")
    ensure_checkpoint_dir(spark)
    used = [] if ids_only else [c.name for c in schema.columns if not c.source]
    schema = schema.typed({f.name: column_type(f.dataType) for f in frames[0].schema.fields})
    for c in schema.comparisons:
        if len(frames) < 2 and any(v.direction == "forward" for v in c.levels):
            raise SchemaError(f"comparison {c.name!r} has a forward level, which needs two inputs")
    parts, sizes, at = [], [], 0
    for i, df in enumerate(frames):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        lacking = [n for n in [*used, *([schema.unique_id] if schema.unique_id else [])] if n not in kinds]
        if lacking:
            raise SchemaError(f"input {names[i] or 1} has no column {lacking[0]!r}")
        identity = F.coalesce(F.col(f"`{schema.unique_id}`").cast("string"), F.lit("")) if schema.unique_id else F.lit(None).cast("string")
        part = df.select(F.lit(i).alias("__ds"), identity.alias("__id"), *(typed(n, kinds[n], schema.type_of(n)).alias(n) for n in used))
        part, size = with_row_numbers(part, at)
        sizes.append(size)
        at += sizes[-1]
        parts.append(part)
    frame = parts[0]
    for p in parts[1:]:
        frame = frame.unionByName(p)
    if not schema.unique_id:
        frame = frame.withColumn("__id", F.col("__row").cast("string"))
    if not ids_only:
        frame = frame.withColumns({c.name: text.transformed(F.col(c.source), c.transforms) for c in schema.columns if c.source})
    return Store(frame, schema, names, mode, sizes)
