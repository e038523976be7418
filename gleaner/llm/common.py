"""Helpers that several operators share: staged tables and Arrow text buffers."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A head with or without its end tag: it ends before the first text or element that can't be in it. For re.S and re.I.
HEAD = (
    r"""<head(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+>"""
    r"""(?:\s|<!--.*?(?:-->|\Z)|<(?P<kept>title|script|style)\b[^>]*>.*?(?:</(?P=kept)\s*>|\Z)"""
    r"""|<(?P<inner>noscript|template)\b[^>]*>(?:(?!</?(?:head|body)\b).)*?</(?P=inner)\s*>"""
    r"""|<(?:meta|link|base)\b(?:[^>"']|"[^"]*"|'[^']*')*+>|<[!?][^>]*>|</(?!(?:head|body|html|br)\b)[a-z][^>]*>)*+(?:</head\s*>)?"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset, and driver and executors are one process, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("gleaner.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("gleaner.shared.dir", found)
    return found.rstrip("/")


class Stages:
    """Tables written to the shared folder and read back.

    A lost executor then costs a re-read, lineage stays short, and joins get
    real sizes instead of guesses. While a table is written, Spark removes the
    shuffle files of that write as soon as it ends, and hands rows to Python in
    smaller batches than usual: a row may be a whole document.
    """

    WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2500"}

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in self.WHILE_WRITING}
        try:
            for k, v in self.WHILE_WRITING.items():
                conf.set(k, v)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a staged table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and where each row starts (one more than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = 1 << 22):
    """Slices of a batch with at most `limit` bytes of text each, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    _, at = utf8(column)
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


#: mallopt's number for the most arenas (fixed value). The thresholds stay as they are: setting them would end their adjustment.
ARENA_MAX = -8


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on a partition, in a worker that gives freed memory back: Spark keeps it for later tasks, and what it holds counts against the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        c = ctypes.CDLL(None) if sys.platform.startswith("linux") else None
        if hasattr(c, "mallopt"):
            c.mallopt(ARENA_MAX, 1)

        def give_back() -> None:
            if hasattr(c, "malloc_trim"):
                c.malloc_trim(0)

        def each() -> Iterator[pa.RecordBatch]:
            size = 0
            for batch in batches:
                size += batch.nbytes
                yield batch
                del batch
                if size > 1 << 24:
                    give_back()
                    size = 0

        yield from work(each())
        give_back()

    return run
