"""Filter specifications as column predicates; all run inside the JVM and reach the scan."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RequestError

OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "in", "is_null", "between")
HAVING_OPERATORS = tuple(o for o in OPERATORS if o != "contains")


def literal(value: Any, kind: T.DataType, ordering: bool) -> Column:
    """``value`` as a literal of the column's type.

    A value that does not fit compares as null (no row) for equality and is an
    error where an order is asked for.
    """
    if isinstance(kind, T.NumericType) and isinstance(value, str):
        try:
            value = float(value) if any(c in value for c in ".eE") else int(value)
        except ValueError:
            if ordering:
                raise RequestError("INVALID_FILTER", f"{value!r} is no number") from None
            return F.lit(None).cast(kind)
        return F.lit(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(value, str):
        return F.lit(value).try_cast(kind)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return F.lit(str(value))
    return F.lit(value)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def one(df: DataFrame, spec: dict, allowed: tuple[str, ...] = OPERATORS) -> Column:
    name, op = spec.get("column"), spec.get("op")
    kinds = {f.name: f.dataType for f in df.schema}
    if name not in kinds:
        raise RequestError("INVALID_COLUMN", f"no column {name!r}")
    if op not in allowed:
        raise RequestError("INVALID_FILTER", f"no operator {op!r}")
    if op != "is_null" and spec.get("value") is None:
        raise RequestError("INVALID_FILTER", f"{op} needs a value")
    c, v = F.col(f"`{name}`"), spec.get("value")
    if op == "is_null":
        return c.isNull() if v in (None, True) or v else c.isNotNull()
    if op == "contains":
        return c.cast("string").ilike(f"%{escaped(str(v))}%")
    if op == "in":
        if not isinstance(v, (list, tuple)) or not v:
            raise RequestError("INVALID_FILTER", "in needs a list that is not empty")
        return c.isin(*[literal(x, kinds[name], False) for x in v])
    if op == "between":
        if not isinstance(v, (list, tuple)) or len(v) != 2:
            raise RequestError("INVALID_FILTER", "between needs two values")
        return c.between(*[literal(x, kinds[name], True) for x in v])
    value = literal(v, kinds[name], op not in ("eq", "neq"))
    return {"eq": c == value, "neq": c != value, "gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op]


def where(df: DataFrame, filters: list[dict] | None, allowed: tuple[str, ...] = OPERATORS) -> DataFrame:
    """Rows that pass all filters."""
    parts = [one(df, f, allowed) for f in filters or []]
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df
