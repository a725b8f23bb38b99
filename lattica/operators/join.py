"""Two-table equality joins; the planner picks the physical join, and adaptive execution splits skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.predicates import where
from .rows import DEFAULT_COLUMNS, MOST_ROWS, ordered, resolve

KINDS = ("inner", "left", "right", "cross", "full")


def _side(df: DataFrame, key: str, columns: list[str] | None) -> list[str]:
    names = [resolve(df, c) for c in columns] if columns else df.columns[:DEFAULT_COLUMNS]
    return names if key in names else [key, *names]


def join(
    a: DataFrame, b: DataFrame, on_a: str, on_b: str, kind: str = "inner", columns_a: list[str] | None = None, columns_b: list[str] | None = None, filters_a: list[dict] | None = None, filters_b: list[dict] | None = None, filter_stage: str = "post"
) -> DataFrame:
    """Joins ``a`` and ``b``; a name of b's that a has too becomes ``<name>__b``.

    Filters act on the joined rows (so one on b turns a left join into an inner
    one) unless ``filter_stage`` is "pre".  A right join lists b's columns
    first.  Null keys match nothing.
    """
    if kind not in KINDS:
        raise RequestError("INVALID_JOIN", f"no join {kind!r}")
    on_a, on_b = resolve(a, on_a), resolve(b, on_b)
    if kind == "right":
        a, b, on_a, on_b, columns_a, columns_b, filters_a, filters_b = b, a, on_b, on_a, columns_b, columns_a, filters_b, filters_a
        kind = "left"
    if filter_stage == "pre":
        a, b, filters_a, filters_b = where(a, filters_a), where(b, filters_b), None, None
    take_a, take_b = _side(a, on_a, columns_a), _side(b, on_b, columns_b)
    need_a = take_a + [f["column"] for f in filters_a or [] if f["column"] not in take_a]
    need_b = take_b + [f["column"] for f in filters_b or [] if f["column"] not in take_b]
    left = a.select(*[F.col(f"`{resolve(a, c)}`").alias(f"a:{c}") for c in need_a])
    right = b.select(*[F.col(f"`{resolve(b, c)}`").alias(f"b:{c}") for c in need_b])
    joined = left.crossJoin(right) if kind == "cross" else left.join(right, F.col(f"`a:{on_a}`") == F.col(f"`b:{on_b}`"), kind)
    joined = where(joined, [f | {"column": f"a:{f['column']}"} for f in filters_a or []] + [f | {"column": f"b:{f['column']}"} for f in filters_b or []])
    return joined.select(*[F.col(f"`a:{c}`").alias(c) for c in take_a], *[F.col(f"`b:{c}`").alias(f"{c}__b" if c in take_a else c) for c in take_b])


def join_page(a: DataFrame, b: DataFrame, on_a: str, on_b: str, kind: str = "inner", order_by: str | None = None, order_dir: str = "asc", limit: int = 50, offset: int = 0, ties: list[str] | None = None, **more) -> DataFrame:
    if not 1 <= limit <= MOST_ROWS:
        raise RequestError("INVALID_LIMIT", f"1 to {MOST_ROWS} rows")
    out = ordered(join(a, b, on_a, on_b, kind, **more), order_by, order_dir, ties or [])
    return out.offset(offset).limit(limit) if offset else out.limit(limit)


def join_total(a: DataFrame, b: DataFrame, on_a: str, on_b: str, kind: str = "inner", **more) -> DataFrame:
    """One row: how many rows the join has, whatever the page holds; the sides keep their keys and filtered columns alone."""
    more = more | {"columns_a": [on_a], "columns_b": [on_b]}
    return join(a, b, on_a, on_b, kind, **more).agg(F.count(F.lit(1)).alias("total"))


def containment(a: DataFrame, column: str, b: DataFrame, key: str) -> DataFrame:
    """Share of the distinct values of ``a`` that are found in ``b``."""
    values = a.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct()
    keys = b.select(F.col(key).cast("string").alias("v")).distinct().withColumn("hit", F.lit(1))
    return values.join(keys, "v", "left").agg(F.count(F.lit(1)).alias("n_distinct"), F.count("hit").alias("n_found"))
