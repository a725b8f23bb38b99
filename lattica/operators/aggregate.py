"""Grouped aggregates, exact and approximate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.predicates import HAVING_OPERATORS, where
from .rows import resolve

#: Groups of one page at most.
MOST_GROUPS = 1000
SAMPLE_ROWS = 50_000


def default_alias(spec: dict) -> str:
    return spec.get("alias") or f"{spec['function']}_{spec['column']}".replace("*", "all").replace(" ", "_")


def expression(df: DataFrame, spec: dict, approximate: bool = False) -> Column:
    name, function = spec.get("column", "*"), spec.get("function")
    if name == "*":
        if function != "count":
            raise RequestError("INVALID_AGGREGATION", f"{function} needs a column")
        return F.count(F.lit(1))
    c = F.col(f"`{resolve(df, name)}`")
    if approximate and function == "count_distinct":
        return F.approx_count_distinct(c, 0.023)
    if approximate and function == "median":
        return F.percentile_approx(c, 0.5, 10_000)
    known = {"count": F.count, "count_distinct": F.countDistinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "median": F.median}
    if function not in known:
        raise RequestError("INVALID_AGGREGATION", f"no function {function!r}")
    return known[function](c)


def medians_of(rows: DataFrame, keys: list[Column], value: Column, buckets: int = 32) -> DataFrame:
    """(g, median) exactly, g the struct of the keys, without any task that holds a group's values.

    Values are counted before they are shuffled, the counts fall into buckets
    at approximate quantiles, the buckets' totals tell in which of them a
    group's middle lies, and only there values are put in order.
    """
    counts = rows.select(F.struct(*(keys or [F.lit(0)])).alias("g"), value.cast("double").alias("v")).where("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.agg(F.percentile_approx("v", F.array(*[F.lit((k + 1) / buckets) for k in range(buckets - 1)]), 1_000).alias("cuts"))
    # A bucket holds equal values together, so its number is an order on values whatever the cuts' accuracy.
    dealt = counts.crossJoin(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    of = Window.partitionBy("g")  # a row for each bucket
    totals = dealt.groupBy("g", "bucket").agg(F.sum("n").alias("t"))
    placed = totals.select("g", "bucket", "t", (F.sum("t").over(of.orderBy("bucket")) - F.col("t")).alias("before"), F.sum("t").over(of).alias("all"))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    middle = placed.select("g", "bucket", "before", low.alias("low"), high.alias("high")).where((F.col("before") <= high) & (F.col("before") + F.col("t") > low))
    inside = dealt.join(middle, ["g", "bucket"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("g", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = lambda place: F.max(F.when((F.col("upto") - F.col("n") <= F.col(place)) & (F.col(place) < F.col("upto")), F.col("v")))
    return inside.groupBy("g").agg(((at("low") + at("high")) / 2).alias("median"))


def groups_of(df: DataFrame, aggregations: list[dict], group_by: list[str] | None = None, filters: list[dict] | None = None, having: list[dict] | None = None, approximate: bool = False) -> DataFrame:
    """All groups; HAVING filters on the aggregates' aliases, which may repeat a column's name."""
    if not aggregations:
        raise RequestError("INVALID_AGGREGATION", "none given")
    rows, keys = where(df, filters), [resolve(df, g) for g in group_by or []]
    aliases = [default_alias(a) for a in aggregations]
    # Aggregates carry their place as a name until the group columns are out of the way.
    exact = [i for i, a in enumerate(aggregations) if a.get("function") == "median" and not approximate and a.get("column", "*") != "*"]
    plain = [expression(df, a, approximate).alias(f"__a{i}") for i, a in enumerate(aggregations) if i not in exact]
    out = rows.groupBy(*[F.col(f"`{k}`").alias(f"__g{i}") for i, k in enumerate(keys)]).agg(*(plain or [F.count(F.lit(1)).alias("__n")]))
    for i in exact:
        medians = medians_of(rows, [F.col(f"`{k}`") for k in keys], F.col(f"`{resolve(df, aggregations[i]['column'])}`"))
        own = F.struct(*([F.col(f"__g{k}").alias(key) for k, key in enumerate(keys)] or [F.lit(0)]))
        out = out.withColumn("__key", own).join(medians.select(F.col("g").alias("__key"), F.col("median").alias(f"__a{i}")), "__key", "left").drop("__key")
    values = out.select(*[F.col(f"__g{i}") for i in range(len(keys))], *[F.col(f"__a{i}").alias(a) for i, a in enumerate(aliases)])
    values = where(values, having, HAVING_OPERATORS)
    return values.select(*[F.col(f"__g{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"`{a}`") for a in aliases])


def aggregate(
    df: DataFrame, aggregations: list[dict], group_by: list[str] | None = None, filters: list[dict] | None = None, having: list[dict] | None = None, order_by: str | None = None, order_dir: str = "desc", limit: int = 50, approximate: bool = False
) -> DataFrame:
    """A page of groups, ordered by a group column or an alias; ties by the group columns.  More than MOST_GROUPS at once are refused."""
    if not 1 <= limit <= MOST_GROUPS:
        raise RequestError("INVALID_LIMIT", f"1 to {MOST_GROUPS} groups")
    out = groups_of(df, aggregations, group_by, filters, having, approximate)
    if order_by is not None and order_by not in out.columns:
        raise RequestError("INVALID_COLUMN", f"cannot order by {order_by!r}")
    keys = ([F.desc(order_by) if order_dir == "desc" else F.asc(order_by)] if order_by else []) + [F.asc(g) for g in group_by or []]
    return (out.orderBy(*keys) if keys else out).limit(limit)


def total_groups(df: DataFrame, aggregations: list[dict], group_by: list[str] | None = None, filters: list[dict] | None = None, having: list[dict] | None = None) -> DataFrame:
    """One row: how many groups there are, whatever the page holds."""
    return groups_of(df, aggregations, group_by, filters, having).agg(F.count(F.lit(1)).alias("total_groups"))


def cube(df: DataFrame, keys: list[str], aggregations: list[dict], rollup: bool = False) -> DataFrame:
    """Subtotals over all subsets (or prefixes) of the keys."""
    grouped = df.rollup(*keys) if rollup else df.cube(*keys)
    return grouped.agg(*[expression(df, a).alias(default_alias(a)) for a in aggregations])


def sampled(df: DataFrame, column: str, seed: int = 0, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Sum and average of a numeric column with 95 % intervals, from about ``rows`` rows; exact for fewer.

    The sum is scaled by the rows that have a value.
    """
    c = F.col(f"`{resolve(df, column)}`")
    n = df.where(c.isNotNull()).count()
    share = min(1.0, rows / n) if n else 1.0
    part = df.where(c.isNotNull())
    part = part.sample(False, share, seed) if share < 1 else part
    s = part.agg(F.count(c).alias("sample_rows"), F.avg(c).alias("avg"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"))
    half = F.lit(0.0) if share == 1 else 1.96 * F.col("sd") / F.sqrt("sample_rows") * math.sqrt(1 - share)
    return s.select(
        F.lit(n).cast("long").alias("rows"), "sample_rows", "avg", (F.col("avg") - half).alias("avg_low"), (F.col("avg") + half).alias("avg_high"),
        (F.col("avg") * n).alias("sum"), ((F.col("avg") - half) * n).alias("sum_low"), ((F.col("avg") + half) * n).alias("sum_high"),
    )
