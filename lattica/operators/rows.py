"""Filtered, ordered and paged rows, and samples."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.predicates import where
from ..sources.scratch import fresh

MOST_ROWS, MOST_SAMPLE, DEFAULT_COLUMNS = 500, 100, 30


def resolve(df: DataFrame, column: str) -> str:
    """A column by name or by ``dataset::name#column``."""
    if column.endswith("#column") and "::" in column:
        column = column.split("::", 1)[1].removesuffix("#column")
    if column not in df.columns:
        raise RequestError("INVALID_COLUMN", f"no column {column!r}")
    return column


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    names = [resolve(df, c) for c in columns] if columns else df.columns[:DEFAULT_COLUMNS]
    return df.select(*[F.col(f"`{c}`") for c in names])


def left_out(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns that a page without chosen ones does not show."""
    return [] if columns else df.columns[DEFAULT_COLUMNS:]


def ordered(df: DataFrame, order_by: str | None, order_dir: str, ties: list[str]) -> DataFrame:
    """Sorted by one column, nulls smallest; ``ties`` make the order total."""
    if order_by is not None:
        resolve(df, order_by)
    if order_dir not in ("asc", "desc"):
        raise RequestError("INVALID_ORDER", "asc or desc")
    first = [F.desc(order_by) if order_dir == "desc" else F.asc(order_by)] if order_by else []
    keys = first + [F.asc(t) for t in ties if t != order_by]
    return df.orderBy(*keys) if keys else df


def get_rows(
    df: DataFrame, filters: list[dict] | None = None, columns: list[str] | None = None, order_by: str | None = None, order_dir: str = "asc", limit: int = 50, offset: int = 0, ties: list[str] | None = None
) -> DataFrame:
    """A page of filtered rows.  A sort with a limit is one top-k per task and a merge, never a full sort."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise RequestError("INVALID_LIMIT", f"1 to {MOST_ROWS} rows from offset 0 on")
    out = ordered(where(df, filters), order_by, order_dir, ties or [])
    return project(out.offset(offset).limit(limit) if offset else out.limit(limit), columns)


def total_matching(df: DataFrame, filters: list[dict] | None = None) -> DataFrame:
    return where(df, filters).agg(F.count(F.lit(1)).alias("total_matching"))


def sample_rows(df: DataFrame, n: int = 5, method: str = "head", key: str = "_row_id", columns: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """``n`` rows by ``key``: the first, the last (descending), or random ones.

    With a seed the keys 1..N are drawn on the driver, so the sample does not
    depend on how the rows are laid out; that needs a gapless key.
    """
    if method not in ("head", "tail", "random"):
        raise RequestError("INVALID_METHOD", method)
    n = max(1, min(n, MOST_SAMPLE))
    if method == "random" and seed is not None:
        size = df.count()
        keys = random.Random(seed).sample(range(1, size + 1), min(n, size))
        out = df.where(F.col(key).isin(keys)).orderBy(key)
    else:
        order = {"head": F.asc(key), "tail": F.desc(key), "random": F.rand()}[method]
        out = df.orderBy(order).limit(n)
    return project(out, columns)


def top_values(df: DataFrame, column: str, k: int = 50) -> DataFrame:
    """The most frequent values, exactly; ties by value."""
    resolve(df, column)
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(k)


def with_row_ids(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """Numbers rows 1..N in their present order: counts per partition first, then places inside each, so no task sees all rows.

    A row's partition is written down once, since a shuffle upstream may deal
    rows anew when they are read a second time.
    """
    path = fresh(df.sparkSession)
    df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")).write.parquet(path)
    marked = df.sparkSession.read.parquet(path).withColumn("part", F.shiftright("at", 33))
    counts = marked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return marked.join(F.broadcast(before), "part").select("row.*", number.alias(name))
