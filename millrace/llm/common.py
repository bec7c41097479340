"""What the operators of this subpackage share: shared folders, staged tables, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 12 << 20
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset, as in
    tests on one machine, a temporary folder of this machine is set; on a cluster
    that would be another folder for each executor, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _MADE.append((spark, folder))
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder; it is removed when the program ends."""
    path = f"{shared_dir(spark)}/millrace-{what}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is None:  # the session has ended; the folder's own policy applies
            return
        with contextlib.suppress(Exception):
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder of any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and lost executors cost nothing that was done before."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded by BATCH bytes, so that long texts don't add up in a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df


def open_fs(uri: str):
    """(file system, path) of a URI, for reading and writing bytes in tasks: local files, HDFS, S3 under any of Hadoop's names for it, and what else pyarrow reaches."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]://", "s3://", uri)

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def attempt_name(stem: str, suffix: str) -> str:
    """A file name that no other attempt of a task uses, so that a retried or speculative task harms no file."""
    context = TaskContext.get()
    return f"{stem}-{context.taskAttemptId() if context else 0}-{os.urandom(4).hex()}{suffix}"


#: What workers hold between tasks; a task that ends empties it.
HELD: list[Callable[[], None]] = []


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, which gives memory back when its task ends.

    Spark keeps idle Python workers and takes them in turn, so an executor has more
    of them than cores; what each kept of its last task would add up.
    """

    def held(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            release()

    return held


def resident() -> int:
    """Bytes of memory that this process has, where the system tells; else a large number."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError):
        return 1 << 40


def release(least: int = 160 << 20) -> None:
    """Empties what is held between tasks and hands free memory back to the system, in a process of at least `least` bytes: a short task costs nothing."""
    import ctypes
    import gc

    if resident() < least:
        return
    for empty in HELD:
        empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, schema: str, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], columns: list[str] | None = None) -> DataFrame:
    """mapInArrow over the named columns only."""
    return (df.select(*columns) if columns else df).mapInArrow(f, schema)


def text_column(df: DataFrame, name: str = "text"):
    """A column as text; null is empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4_000, size: Callable[[tuple], int] | None = None, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most `limit` rows and about `most` bytes."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row) if size else 0
        if len(held) >= limit or total >= most:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
