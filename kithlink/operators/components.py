"""Connected components of an edge table by contraction.

Each round every vertex points to its smallest neighbour (or itself), pointers are jumped twice, edges are rewritten to
the pointers' ends and repeated ones dropped; a round shrinks a chain to a quarter and a star to nothing. Rounds are
cut by ``checkpoint()``, so lost executors never replay them. Pointer joins are keyed by vertex on one side and unique
there, so a hub only makes the other side skewed, which adaptive execution splits.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; set a temporary one only where none is set."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="kithlink-"))


def _jump(pointers: DataFrame) -> DataFrame:
    onward = pointers.where("node <> parent").select(F.col("node").alias("parent"), F.col("parent").alias("beyond"))
    return pointers.join(onward, "parent", "left").select("node", F.coalesce("beyond", "parent").alias("parent"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", jumps: int = 2) -> DataFrame:
    """(id, component) of every vertex of ``edges``; the component is its smallest vertex.

    Edges with a null end are ignored; loops and repeated edges do no harm; an empty table gives an empty table.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    current = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("u"), F.col(dst).alias("v"))
    loops = current.where("u = v").select(F.col("u").alias("id"))
    current = current.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().checkpoint()
    rounds: list[DataFrame] = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pointers = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("parent"))
        for _ in range(jumps):
            pointers = _jump(pointers)
        pointers = pointers.checkpoint()
        rounds.append(pointers)
        # the smaller end's pointer and the larger end's; both sides of the joins are unique by node
        a, b = (pointers.select(F.col("node").alias(c), F.col("parent").alias("p" + c)) for c in "uv")
        moved = current.join(a, "u").join(b, "v").where("pu <> pv")
        current = moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct().checkpoint()
    labels = None
    for pointers in reversed(rounds):
        if labels is None:
            labels = pointers
        else:
            later = labels.select(F.col("node").alias("parent"), F.col("parent").alias("final"))
            labels = pointers.join(later, "parent", "left").select("node", F.coalesce("final", "parent").alias("parent"))
    if labels is None:
        return loops.distinct().select("id", F.col("id").alias("component"))
    labels = labels.select(F.col("node").alias("id"), F.col("parent").alias("component"))
    alone = loops.distinct().join(labels, "id", "left_anti")
    return labels.unionByName(alone.select("id", F.col("id").alias("component")))
