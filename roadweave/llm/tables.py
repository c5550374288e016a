"""Shared helpers: reading inputs, cutting lineage in the shared folder, slicing Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

#: Bytes of text that the vectorised kernels handle at once; a longer text is one slice of its own.
SLICE_BYTES = 1 << 19


#: Bytes and rows of an Arrow batch at most, where the session allows more: a worker and its JVM hold some batches at once, and keep what they took.
ARROW_BYTES, ARROW_ROWS = 4 << 20, 2_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, sf_dir, table)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a local one is set for a local master (tests), and any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/roadweave-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there and columns are pruned on reading."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, limit: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or one like it that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _give_back() -> None:
    """Return freed memory to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable, fields) -> DataFrame:
    """``mapInArrow`` over batches of bounded size; the worker's memory is given back at the end of a task."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)):
        number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", conf.get(name).strip().lower()).groups()
        if unit not in ("", "b") or not 0 < int(number) <= most:
            conf.set(name, str(most))
    return df.mapInArrow(released, fields)


def as_binary(column: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    """A text column's UTF-8 bytes with 64-bit offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if pa.types.is_string(column.type):
        column = column.view(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.view(pa.large_binary())
    return column.cast(pa.large_binary())


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets from 0) for runs of whole rows of about ``limit`` bytes."""
    array = as_binary(column)
    if not len(array):
        return
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(array):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, len(array))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
