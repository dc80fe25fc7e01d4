"""The folder that driver and executors share, and files in it.

Cut lineage and files that executors write go to ``spark.checkpoint.dir``. The
setting is read from the session; only where it is unset (tests, notebooks in
local mode) a temporary folder is chosen and set.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_tracked = threading.local()
#: What a worker holds from task to task.
_kept: list[dict] = []


def base_dir(spark: SparkSession) -> str:
    """The shared folder's URI."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kithlink-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared folder."""
    path = f"{base_dir(spark).rstrip('/')}/kithlink/{name}-{uuid.uuid4().hex[:12]}"
    for folders in getattr(_tracked, "lists", ()):
        folders.append(path)
    return path


@contextlib.contextmanager
def tracking():
    """The list of the work folders that this thread makes inside."""
    lists = _tracked.__dict__.setdefault("lists", [])
    folders: list[str] = []
    lists.append(folders)
    try:
        yield folders
    finally:
        lists[:] = [x for x in lists if x is not folders]


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Delete work folders. Only for callers that have written what they read from them."""
    jvm = spark.sparkContext._jvm
    for uri in folders:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, on storage that outlives executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(held: dict) -> dict:
    """``held``, which a worker keeps from task to task until a task of another operator asks for its memory."""
    _kept.append(held)
    return held


def let_go() -> None:
    """Give back what this worker keeps, and the freed memory that the allocators of Arrow and C still hold."""
    for held in _kept:
        held.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over batches in a worker that lets go of memory before and after."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]):
        let_go()
        try:
            yield from work(batches)
        finally:
            let_go()

    return run


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """The doc_ids of several rows, if there are any."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    found = settle(found, "repeated-ids")
    return None if found.isEmpty() else found


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """For executors: the file system of ``uri`` and the path in it. The Hadoop names of S3 are understood."""
    for name in ("s3a://", "s3n://"):
        if uri.startswith(name):
            uri = "s3://" + uri.removeprefix(name)
    return pafs.FileSystem.from_uri(uri)


def create_file(uri: str):
    """A new file to write to, folders included."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def pieces(uri: str, size: int):
    """A file's bytes, ``size`` at a time."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as src:
        while chunk := src.read(size):
            yield chunk


def write_file(uri: str, chunks) -> int:
    """Write byte chunks to a new file; bytes written."""
    total = 0
    with create_file(uri) as out:
        for chunk in chunks:
            out.write(chunk)
            total += len(chunk)
    return total


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as src:
        return src.read()


def attempt_name(prefix: str, seq: int = 0) -> str:
    """A file name that no other task or attempt uses: retried and speculative tasks never overwrite each other, and only the winners' names reach the manifest."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return f"{prefix}-{ctx.partitionId():06d}-{seq:04d}-{ctx.taskAttemptId()}"
