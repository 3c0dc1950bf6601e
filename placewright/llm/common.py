"""Small helpers that the operators share."""

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import new_folder, settle

__all__ = ["columns", "enter", "new_folder", "read_blobs", "settle", "table", "write_blobs"]

_kept = {}


def enter(owner, clear=None):
    """Begin a task of `owner` in this worker, which Spark may have used for other operators.

    What those keep between tasks (`clear` empties it) and what is free but still held is given
    back to the machine first.
    """
    others = [name for name in _kept if name != owner]
    for name in others:
        _kept.pop(name)()
    if clear is not None:
        _kept[owner] = clear
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def columns(df, **names):
    """Only the named columns, under fixed names: extra columns and clashing names end here."""
    return df.select(*[df[source].alias(name) for name, source in names.items()])


def write_blobs(blobs, path, last=b"\n"):
    """Write each row's `content` as one binary file with Spark's own committer.

    Every content must end in the byte `last`. The text writer adds it as its line end, so it is
    taken off here; the files hold the contents byte for byte. Only files of committed task
    attempts stay, on any file system that Spark writes to. Nulls and empty contents write none.
    """
    content = F.col("content")
    (
        blobs.where(F.length(content) > 0)
        .select(F.substring(content, F.lit(1), F.length(content) - 1).cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("lineSep", last.decode("latin-1"))
        .text(path)
    )
    return path


def read_blobs(spark, path):
    """Columns path, content: one row per file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
