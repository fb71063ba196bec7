"""What the operators of this subpackage share: session settings, texts as bytes, files."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import bandsift
from bandsift.runtime import cut_lineage, shared_folder

__all__ = ["MEMO", "batches", "cut_lineage", "documents", "free", "give_back", "open_in", "open_out", "packed", "ready", "shared_folder", "slices", "table", "texts", "unpacked"]

#: Rows and bytes of a batch handed to Python: bounds memory whatever the length of texts.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


class Memo(dict):
    """What a worker has loaded; a copy sent to another process starts empty.

    What a whole task has not asked for goes at its end: a worker that has turned to another operator
    doesn't keep the tables of the one before.
    """

    def __init__(self):
        super().__init__()
        self.asked: set[tuple] = set()

    def __reduce__(self):
        return Memo, ()

    def of(self, key: tuple, make):
        self.asked.add(key)
        if key not in self:
            self[key] = make()
        return self[key]

    def end_of_task(self) -> None:
        for key in set(self) - self.asked:
            del self[key]
        self.asked.clear()


MEMO = Memo()


def ready(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches; ship the package to workers that can't import it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = str(Path(bandsift.__file__).resolve().parents[1])
    if root not in [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        cloudpickle.register_pickle_by_value(sys.modules["bandsift"])
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text as an empty one; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def free(name: str, taken: list[str]) -> str:
    """The name, or one like it that no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"{name}_"
    return name


def slices(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many bytes of a text column (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n


def batches(it: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    try:
        for batch in it:
            yield from slices(batch, column)
    finally:
        give_back()


def give_back() -> None:
    """At the end of a task, memory that its worker no longer uses goes back to the system.

    Workers live on, and an executor has several; allocators would keep what the largest task needed.
    """
    MEMO.end_of_task()
    pa.default_memory_pool().release_unused()
    trim = MEMO.of(("malloc_trim",), _trim)
    if trim is not None:
        trim(0)


def _trim():
    """malloc_trim of the C library, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def packed(data: bytes) -> bytes:
    """Bytes for the way to another task."""
    return zstandard.compress(data, 1)


def unpacked(data: bytes) -> bytes:
    return zstandard.decompress(data)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def open_out(uri: str):
    """A stream that writes a file of the shared folder, from driver or executor."""
    system, path = _place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def open_in(uri: str):
    system, path = _place(uri)
    return system.open_input_file(path)
