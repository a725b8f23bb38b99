"""Descriptions of a table and of one column, from profiles and one count of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from .distribution import numeric_distribution
from .rows import resolve

MOST_COLUMNS, PREVIEW = 60, 5


def column_summary() -> Column:
    """A sentence about a profiled column, as an expression over a profile's row."""
    ranged = F.col("type").isin("integer", "float", "datetime") & F.col("min").isNotNull()
    return F.concat_ws(
        ", ",
        F.format_string("%s column with %s distinct values", F.col("type"), F.col("cardinality").cast("string")),
        F.when(F.col("null_pct") > 0, F.concat(F.col("null_pct").cast("string"), F.lit("% null"))),
        F.when(ranged, F.format_string("from %s to %s", F.col("min"), F.col("max"))),
        F.when(F.col("semantic_type").isNotNull(), F.concat(F.lit("looks like "), F.col("semantic_type"))),
    )


def describe_dataset(profiles: DataFrame, values: DataFrame, columns: list[str] | None = None, offset: int = 0) -> DataFrame:
    """One page of column descriptions in the table's order; ``values`` (name, value, count, rank) gives each its most frequent ones.

    Named columns are not paged.  Both inputs have a row, or a bounded number
    of rows, for each column, so the join is small whatever the table's size.
    """
    rows = profiles
    if columns:
        unknown = sorted(set(columns) - {r["name"] for r in profiles.select("name").collect()})
        if unknown:
            raise RequestError("INVALID_COLUMN", ", ".join(unknown))
        rows = rows.where(F.col("name").isin(columns))
    preview = values.where(F.col("rank") <= PREVIEW).groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))), lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("top_values"))
    out = rows.join(preview, "name", "left").select(
        "position", "name", "type", "count", "null_count", "null_pct", "cardinality", "cardinality_is_exact", "is_unique", "is_primary_key_candidate", "min", "max", "mean", "std_dev", F.element_at("quantiles", 3).alias("median"), "semantic_type", "top_values", column_summary().alias("summary")
    )
    out = out.orderBy("position", "name")
    return out if columns else out.offset(max(0, offset)).limit(MOST_COLUMNS)


def value_distribution(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """(value, count, pct) of the most frequent values; shares are of all non-null rows; ties by value."""
    if not 1 <= top <= 200:
        raise RequestError("INVALID_LIMIT", "1 to 200 values")
    c = F.col(f"`{resolve(df, column)}`")
    counts = df.where(c.isNotNull()).groupBy(c.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(c).alias("total"))
    best = counts.orderBy(F.desc("count"), "value").limit(top)
    return best.crossJoin(F.broadcast(total)).select("value", "count", F.round(100.0 * F.col("count") / F.col("total"), 2).alias("pct")).orderBy(F.desc("count"), "value")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, count) over every row of a numeric column."""
    if not 1 <= bins <= 50:
        raise RequestError("INVALID_BINS", "1 to 50")
    return numeric_distribution(df, column, bins)


def describe_column(df: DataFrame, profiles: DataFrame, column: str, top: int = 20, bins: int = 10) -> dict[str, DataFrame]:
    """``column``: its profile; ``values``: its value distribution; ``histogram``: its bins, for numbers alone."""
    name = resolve(df, column)
    kind = next((r["type"] for r in profiles.where(F.col("name") == name).select("type").collect()), None)
    out = {"column": profiles.where(F.col("name") == name).withColumn("summary", column_summary()), "values": value_distribution(df, name, top)}
    return out | ({"histogram": histogram(df, name, bins)} if kind in ("integer", "float") else {})
