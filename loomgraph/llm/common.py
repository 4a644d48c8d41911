"""Small helpers shared by the corpus operators: checked broadcasts, text batches, worker memory."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import Scratch, shared_dir
from ..session import ship_package

__all__ = ["BATCH_BYTES", "BROADCAST_ROWS", "Scratch", "crc_mod", "handing_back", "place_in_sample", "share_by", "shared_dir", "small_or_shuffled", "text_slices", "utf8_batches", "with_workers"]

#: Rows of a narrow table (ids, terms, model rows) up to which it is broadcast after being counted.
BROADCAST_ROWS = 500_000
#: Bytes of text that a numpy step handles at once.
BATCH_BYTES = 1 << 19
#: Bytes of an Arrow batch between executor and worker: buffers of a few MB, doubled as they fill, stay with the allocator of each task's thread.
ARROW_BYTES = 1 << 20


def with_workers(spark: SparkSession) -> SparkSession:
    """The session made ready for operators with Python steps: the package on all executors, and Arrow batches of one MB
    (texts are wide: Spark's default of 64 MB is held several times over in the executor and in each worker)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return ship_package(spark)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if its counted rows are within BROADCAST_ROWS; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % n, F.lit(-1))


def place_in_sample(key: str) -> Column:
    """A number from 0 to 1 from the hashed key: rows below a share are a sample that is the same on every run and for every partitioning."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)


def share_by(column: str, shares: dict) -> Column:
    """The share of each value of the column, 0 for other values."""
    pairs = [F.lit(x) for pair in shares.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(0.0)) if pairs else F.lit(0.0)


def text_slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The texts of a column in order ('' for null), a few at a time: at most ``limit`` bytes unless one text has more."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield column.slice(first, end - first).to_pylist()
        first = end


def utf8_batches(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in the bytes), each with at most `limit` bytes unless one text has more."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def handing_back(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's step that gives freed memory back to the system at its end: workers are kept for later stages, and what
    allocators hold on to would count against the executor until then."""

    @functools.wraps(step)
    def run(batches):
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run
