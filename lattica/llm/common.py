"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh

_C = ctypes.CDLL(None)


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context.

    Python functions below are pickled by reference, so an executor that was
    started without the package on its path (or a replacement for a lost one)
    must be able to fetch it; ``addPyFile`` gives it to those as well.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lattica_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(), "lattica_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(out)
    sc._lattica_shipped = True


#: Tables written by ``checkpointed`` inside the innermost ``short_lived`` block.
_short_lived: list[list[str]] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: its lineage is cut and lost executors cost nothing that was written."""
    path = fresh(df.sparkSession)
    if _short_lived:
        _short_lived[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def short_lived(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``checkpointed`` wrote inside the block when it ends: what was made of them must have been written by then."""
    _short_lived.append([])
    try:
        yield
    finally:
        remove(spark, *_short_lived.pop())


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders on any file system that Spark reaches."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def id_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a key filter at most; its size follows the keys up to there.
FILTER_BITS = 1 << 26


class KeyFilter:
    """Fixed-size bits of 64-bit keys: a key that was put in is always found, another seldom while there are few.

    It only spares rows a shuffle; what it lets through is joined exactly.
    """

    def __init__(self, keys: DataFrame, most_bits: int | None = None):
        """``keys``: one bigint column.  What reaches the driver is at most one row for each 64 bits."""
        (key,) = keys.columns
        most, self.bits = most_bits or FILTER_BITS, 1 << 10
        n = keys.count()
        while self.bits < min(16 * n, most):
            self.bits *= 2
        place = F.col(key).bitwiseAND(F.lit(self.bits - 1))
        words = keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(self.bits // 64, np.int64)
        table[words["word"].to_numpy()] = words["bits"].to_numpy()
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "table": self.table}

    def holds(self, keys: np.ndarray) -> np.ndarray:
        place = keys & np.int64(self.bits - 1)
        return (self.table.value[place >> 6] >> (place & 63)) & 1 > 0

    def may_hold(self, key: Column) -> Column:
        @F.arrow_udf("boolean")
        def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for keys in batches:
                yield pa.array(self.holds(keys.to_numpy(zero_copy_only=False)))

        return test(key)

    def only_held(self, keys: Column) -> Column:
        """The keys of an array that may be held."""

        @F.arrow_udf("array<bigint>")
        def some(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for lists in batches:
                values, edges = lists.flatten(), lists.offsets.to_numpy()
                held = self.holds(values.to_numpy(zero_copy_only=False))
                upto = np.concatenate([[0], np.cumsum(held)])
                yield pa.ListArray.from_arrays(pa.array(upto[edges - edges[0]].astype(np.int32)), values.filter(pa.array(held)))

        return some(keys)


def release() -> None:
    """Gives freed memory back to the system: a worker lives on between tasks, and its allocators keep what one batch needed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_C, "malloc_trim", None):
        trim(0)


#: Bytes of text that array operations take at a time.
SLICE_BYTES = 1 << 19


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of consecutive texts of at most ``most`` bytes in total (a longer text alone), each with the place of its first."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for a, b in pieces(sizes, most):
        yield a, texts.slice(a, b - a)


def slice_by_slice(batches: Iterator[pa.Array], work: Callable[[pa.Array], pa.Array]) -> Iterator[pa.Array]:
    """``work`` of each slice of texts, handed on slice by slice: no more of a batch's results is held, and what a batch took is given back when it is done with."""
    for texts in batches:
        for _, some in slices(texts):
            yield work(some)
        texts = some = None
        release()
    release()  # the reader holds a batch until it is asked for the next


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most ``most`` in total; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
