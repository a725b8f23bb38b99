"""Distributions and correlations, each in a fixed number of passes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RequestError
from .rows import resolve

LEAST_PAIRS = 10


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_distribution(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, count) of equal widths; the last bin is closed, empty bins are kept, one value makes one bin."""
    if not 1 <= bins <= 100:
        raise RequestError("INVALID_BINS", "1 to 100")
    v = F.col(f"`{resolve(df, column)}`").cast("double")
    values = df.select(F.when(~F.isnan(v), v).alias("v")).where("v is not null")
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = values.crossJoin(F.broadcast(bounds)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(bounds)).where("lo is not null and (hi > lo or bin = 0)")
    width = (F.col("hi") - F.col("lo")) / bins
    return spine.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("low"), F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("count")
    )


def datetime_distribution(df: DataFrame, column: str, unit: str = "month") -> DataFrame:
    """(bucket, count) by day, month or year."""
    form = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}.get(unit)
    if form is None:
        raise RequestError("INVALID_UNIT", unit)
    c = F.col(resolve(df, column))
    return df.where(c.isNotNull()).groupBy(F.date_format(c, form).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def categorical_distribution(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(value, count) of the most frequent values and one row ``<other>`` for the rest."""
    counts = df.where(F.col(resolve(df, column)).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), "value").limit(bins)
    return counts.join(F.broadcast(top.select("value", F.lit(1).alias("top"))), "value", "left").groupBy(F.when(F.col("top") == 1, F.col("value")).otherwise("<other>").alias("value")).agg(F.sum("count").alias("count"))


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.9, "very strong").when(a >= 0.7, "strong").when(a >= 0.5, "moderate").when(a >= 0.3, "weak").otherwise("negligible")


def correlations(df: DataFrame, columns: list[str] | None = None, least: float = 0.3, top: int = 20, method: str = "pearson") -> DataFrame:
    """(column_a, column_b, r, n, strength, direction) of all pairs, from one aggregation of the table."""
    names = [resolve(df, c) for c in columns] if columns else numeric_columns(df)
    names, pairs = sorted(names), list(combinations(sorted(names), 2))
    if not pairs:
        raise RequestError("INVALID_COLUMN", "two numeric columns are needed")
    if method == "spearman":
        df = average_ranks(df, names)
    elif method != "pearson":
        raise RequestError("INVALID_METHOD", method)
    col = lambda c: F.col(f"`{c}`").cast("double")
    both = lambda a, b: col(a).isNotNull() & col(b).isNotNull()
    one = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (F.corr(col(a), col(b)).alias(f"r{i}"), F.count_if(both(a, b)).alias(f"n{i}"))])
    rows = F.inline(F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(f"r{i}"))), 4).alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)]))
    kept = one.select(rows).where((F.col("n") >= LEAST_PAIRS) & (F.abs("r") >= least))
    return kept.select("*", strength(F.col("r")).alias("strength"), F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("direction")).orderBy(F.desc(F.abs("r")), "column_a", "column_b").limit(top)


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's average rank in place of its value.

    A window over the whole column would be one task; instead values are
    counted, and the counts are range-partitioned and summed per partition
    before a running sum inside each.
    """
    base = out = df.select(*[F.col(f"`{c}`") for c in columns])
    for c in columns:
        counts = base.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        out = out.join(running_total(counts, c).select(F.col(c), (F.col("upto") - (F.col("n") - 1) / 2).alias("__rank")), c, "left").withColumn(c, F.col("__rank")).drop("__rank")
    return out


def running_total(counts: DataFrame, key: str, buckets: int = 32) -> DataFrame:
    """Adds ``upto``, the sum of ``n`` over all keys up to this one; keys fall into buckets at approximate quantiles."""
    cuts = counts.agg(F.percentile_approx(key, F.array(*[F.lit((k + 1) / buckets) for k in range(buckets - 1)]), 1_000).alias("cuts"))
    # A bucket holds equal keys together, so its number is an order on keys whatever the cuts' accuracy.
    dealt = counts.crossJoin(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("cuts", lambda x: x < F.col(key)))).drop("cuts")
    totals = dealt.groupBy("bucket").agg(F.sum("n").alias("t"))
    before = totals.select("bucket", F.coalesce(F.sum("t").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("part", F.sum("n").over(inside)).join(F.broadcast(before), "bucket").withColumn("upto", F.col("before") + F.col("part"))
