"""Column profiles: one wide aggregation for statistics, one unpivoted count for values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import LATITUDE, LONGITUDE, SEMANTIC
from ..functions.text import clean, rank_of
from .distribution import numeric_columns

QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)
MOST_INDEXED, TOP, SAMPLES = 1000, 50, 10
VIOLATIONS = 5
FIRES, LEAST_SAMPLES = 0.85, 3


def logical_type(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float"
    return "datetime" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


def as_text(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def stat_parts(df: DataFrame) -> tuple[list[Column], list[list[Column]]]:
    """Aggregates, and for each column the fields they give: counts, range, moments and quantiles.  NaN counts as null."""
    parts, rows = [], []
    for i, f in enumerate(df.schema):
        kind = logical_type(f.dataType)
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        number = kind in ("integer", "float")
        parts += [F.count(F.lit(1)).alias(f"n{i}"), F.count(c).alias(f"k{i}")]
        text = as_text(f)
        parts += [F.min(c if kind != "string" else text).cast("string").alias(f"lo{i}"), F.max(c if kind != "string" else text).cast("string").alias(f"hi{i}")]
        if number:
            d = c.cast("double")
            parts += [F.avg(d).alias(f"m{i}"), F.var_samp(d).alias(f"v{i}"), F.percentile_approx(d, list(QUANTILES), 10_000).alias(f"q{i}")]
        value = lambda name, cast: (F.col(f"{name}{i}") if number else F.lit(None)).cast(cast)  # noqa: B023, E731
        nulls = F.col(f"n{i}") - F.col(f"k{i}")
        rows.append(
            [
                F.lit(f.name).alias("name"), F.lit(i).alias("position"), F.lit(kind).alias("type"), F.col(f"n{i}").alias("count"), nulls.alias("null_count"),
                F.when(F.col(f"n{i}") > 0, F.round(100.0 * nulls / F.col(f"n{i}"), 1)).otherwise(0.0).alias("null_pct"),
                F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.round(value("m", "double"), 6).alias("mean"), F.round(F.sqrt(value("v", "double")), 6).alias("std_dev"), F.round(value("v", "double"), 6).alias("variance"), value("q", "array<double>").alias("quantiles"),
            ]
        )
    return parts, rows


def column_stats(df: DataFrame) -> DataFrame:
    """One row for each column, from one aggregation: counts, range, moments and quantiles."""
    parts, rows = stat_parts(df)
    return df.agg(*parts).select(F.inline(F.array(*[F.struct(*r) for r in rows])))


def lane(kind: T.DataType) -> str:
    """The type in which a column's values are counted; only what has no plain type of its own is counted as text."""
    if isinstance(kind, T.IntegralType):
        return "bigint"
    plain = (T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return kind.simpleString() if isinstance(kind, plain) else "string"


def typed_counts(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """(position, a column for each lane, n) of every distinct non-null value; formatting text costs more than counting, so it comes after."""
    lanes = sorted({lane(f.dataType) for f in df.schema})
    cell = lambda f, of: (as_text(f) if of == "string" else F.col(f"`{f.name}`").cast(of)) if lane(f.dataType) == of else F.lit(None).cast(of)
    rows = [F.struct(F.lit(i).alias("position"), *[cell(f, of).alias(f"in_{of}") for of in lanes]) for i, f in enumerate(df.schema)]
    held = [f"in_{of}" for of in lanes]
    cells = df.select(F.inline(F.array(*rows))).where(F.greatest(*[F.col(c).isNotNull() for c in held]) if len(held) > 1 else F.col(held[0]).isNotNull())
    return cells.groupBy("position", *held).agg(F.count(F.lit(1)).alias("n")), held


def named(df: DataFrame) -> Column:
    """A position's column name."""
    return F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("position") + 1).alias("name")


def value_counts(df: DataFrame) -> DataFrame:
    """(name, value, n) of every distinct non-null value of every column; tasks count before they shuffle."""
    counts, held = typed_counts(df)
    return counts.select(named(df), F.coalesce(*[F.col(c).cast("string") for c in held]).alias("value"), "n")


def cardinalities(df: DataFrame) -> DataFrame:
    """(name, cardinality, most) exactly, from the value counts."""
    counts, _ = typed_counts(df)
    return counts.groupBy("position").agg(F.count(F.lit(1)).alias("cardinality"), F.max("n").alias("most")).select(named(df), "cardinality", "most")


def sketched(f: T.StructField) -> Column:
    """Estimated distinct values of a column, from one sketch of 2^11 registers: a single buffer, where ``approx_count_distinct`` has hundreds."""
    c = F.col(f"`{f.name}`")
    if lane(f.dataType) == "bigint":
        value = c.cast("bigint")
    elif lane(f.dataType) == "string" and not isinstance(f.dataType, T.DecimalType):
        value = as_text(f)
    else:
        value = F.when(c.isNotNull(), F.xxhash64(c))
    return F.hll_sketch_estimate(F.hll_sketch_agg(value, 11))


def top_values(df: DataFrame, k: int = TOP) -> DataFrame:
    """(name, value, count, rank) of each column's most frequent values; ties by value."""
    w = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    return value_counts(df).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("name", "value", F.col("n").alias("count"), "rank")


def name_matches(name: str, hints: tuple[str, ...]) -> bool:
    lower = name.lower()
    return lower in hints or bool(set(lower.replace("-", "_").replace(" ", "_").split("_")) & set(hints))


def kind_parts(df: DataFrame) -> tuple[list[Column], list[list[Column]]]:
    """Aggregates, and for each column the fields they give: the first detector that holds for enough of its values, over all rows."""
    parts, rows = [], []
    for i, f in enumerate(df.schema):
        kind, c = logical_type(f.dataType), as_text(f)
        tests = [(n, c.rlike(p)) for n, p, hints in SEMANTIC if kind == "string" and (not hints or name_matches(f.name, hints))]
        if kind in ("integer", "float"):
            d = F.col(f"`{f.name}`").cast("double")
            tests += [("zip_us", c.rlike(r"^\d{5}$"))] if name_matches(f.name, SEMANTIC[8][2]) else []
            tests += [("latitude", d.between(-90, 90))] if name_matches(f.name, LATITUDE) else []
            tests += [("longitude", d.between(-180, 180))] if name_matches(f.name, LONGITUDE) else []
        found = F.lit(None).cast("struct<t:string,c:double>")
        if tests:
            parts.append(F.count(c).alias(f"p{i}"))
            parts += [F.count_if(t).alias(f"t{i}_{j}") for j, (_, t) in enumerate(tests)]
        for j, (n, _) in reversed(list(enumerate(tests))):
            ratio = F.col(f"t{i}_{j}") / F.nullif(F.col(f"p{i}"), F.lit(0))
            found = F.when((F.col(f"p{i}") >= LEAST_SAMPLES) & (ratio >= FIRES), F.struct(F.lit(n).alias("t"), F.round(ratio, 3).alias("c"))).otherwise(found)
        rows.append([found["t"].alias("semantic_type"), found["c"].alias("semantic_confidence")])
    return parts, rows


def fit_parts(df: DataFrame) -> tuple[list[Column], list[list[Column]]]:
    """Aggregates, and for each column the fields they give: the share of values that read as the column's type, how many do not, and up to VIOLATIONS of them.

    Typed columns hold their type alone.  In a text column what reads as a
    number or a date does not fit: it is there because some other value forced
    the column to be text.
    """
    parts, rows = [], []
    for i, f in enumerate(df.schema):
        if not isinstance(f.dataType, T.StringType):
            rows.append([F.lit(1.0).alias("type_confidence"), F.lit(0).cast("long").alias("violations"), F.array().cast("array<string>").alias("violation_samples")])
            continue
        c = clean(F.col(f"`{f.name}`"))
        odd = rank_of(c) < 3
        parts += [F.count(c).alias(f"f{i}"), F.count_if(odd).alias(f"w{i}")]
        # The least odd value of each of a few hash classes: distinct samples from buffers of fixed size.
        parts += [F.min(F.when(odd & (F.pmod(F.hash(c), F.lit(VIOLATIONS)) == k), c)).alias(f"w{i}_{k}") for k in range(VIOLATIONS)]
        share = F.when(F.col(f"f{i}") > 0, F.round(1 - F.col(f"w{i}") / F.col(f"f{i}"), 3)).otherwise(1.0)
        rows.append([share.alias("type_confidence"), F.col(f"w{i}").alias("violations"), F.sort_array(F.array_compact(F.array(*[F.col(f"w{i}_{k}") for k in range(VIOLATIONS)]))).alias("violation_samples")])
    return parts, rows


def type_fit(df: DataFrame) -> DataFrame:
    """(name, type_confidence, violations, violation_samples) of each column, from one aggregation."""
    parts, rows = fit_parts(df)
    return df.agg(F.count(F.lit(1)).alias("n"), *parts).select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("name"), *r) for f, r in zip(df.schema, rows, strict=True)])))


def semantic_types(df: DataFrame) -> DataFrame:
    """(name, semantic_type, semantic_confidence) of each column, from one aggregation."""
    parts, rows = kind_parts(df)
    return df.agg(F.count(F.lit(1)).alias("n"), *parts).select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("name"), *r) for f, r in zip(df.schema, rows, strict=True)])))


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row for each column.

    Statistics and semantic types are one aggregation of the table.  ``exact``
    counts distinct values by a shuffle of value counts; else sketches in that
    same aggregation do.
    """
    (stats, stat_rows), (kinds, kind_rows), (fits, fit_rows) = stat_parts(df), kind_parts(df), fit_parts(df)
    parts, rows = stats + kinds + fits, [a + b + c for a, b, c in zip(stat_rows, kind_rows, fit_rows, strict=True)]
    if not exact:
        parts += [sketched(f).alias(f"d{i}") for i, f in enumerate(df.schema)]
        rows = [r + [F.col(f"d{i}").alias("cardinality"), F.lit(None).cast("long").alias("most")] for i, r in enumerate(rows)]
    out = df.agg(*parts).select(F.inline(F.array(*[F.struct(*r) for r in rows])))
    if exact:
        out = out.join(cardinalities(df), "name", "left")
    present = F.col("count") - F.col("null_count")
    unique = (present > 0) & (F.col("null_count") == 0) & (F.col("cardinality") == present)
    return (
        out.withColumn("cardinality", F.coalesce("cardinality", F.lit(0)))
        .withColumn("cardinality_is_exact", F.lit(exact))
        .withColumn("is_unique", unique)
        .withColumn("is_primary_key_candidate", unique & F.col("type").isin("integer", "string"))
    )


#: What stands for a missing value in tables of all kinds: words, and runs of one character.
MISSING_WORDS = ["anonymous", "blank", "empty", "missing", "no_info", "noinfo", "none", "not available", "pending", "redacted", "tbd", "undefined", "unknown", "void", "-1"]
MISSING_RUNS = r"^(9{2,}|-9+|0{2,}|-{2,}|\.{2,}|\?+|\*+|[xX]+|_+|#+)$"


def learned_null_tokens(df: DataFrame, least_share: float = 0.005, top: int = 10) -> DataFrame:
    """(value, columns, count) of short values that look like a missing value, each in ``least_share`` of the present values of two or more columns."""
    looks = F.lower(F.trim("value")).isin(*MISSING_WORDS) | F.trim("value").rlike(MISSING_RUNS)
    counts = value_counts(df)
    present = counts.groupBy("name").agg(F.sum("n").alias("present"))  # one row a column
    hits = counts.where((F.length(F.trim("value")) <= 12) & looks).join(present, "name").where(F.col("n") >= least_share * F.col("present"))
    return hits.groupBy(F.trim("value").alias("value")).agg(F.count_distinct("name").alias("columns"), F.sum("n").alias("count")).where("columns >= 2").orderBy(F.desc("count"), "value").limit(top)


def without_tokens(df: DataFrame, tokens: list[str]) -> DataFrame:
    """Text columns with learned tokens taken for missing, typed anew."""
    from ..sources.files import infer

    strings = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    cleaned = df.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*tokens), F.col(f"`{c}`")).alias(c) if c in strings and tokens else F.col(f"`{c}`") for c in df.columns])
    return infer(cleaned) if tokens else df


def first_samples(df: DataFrame, column: str, key: str, n: int = SAMPLES) -> DataFrame:
    """The first ``n`` distinct values in the order of ``key``."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.min(key).alias("first")).orderBy("first").limit(n).select("value")


def value_index(df: DataFrame, column: str) -> DataFrame:
    """All values and counts of a column of few values, as one map; null beyond MOST_INDEXED."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    few = counts.limit(MOST_INDEXED + 1)
    return few.agg(F.when(F.count(F.lit(1)) <= MOST_INDEXED, F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "count"))))).alias("value_index"))


def summary(p: dict) -> str:
    """A sentence about a profiled column."""
    parts = [f"{p['type']} column with {p['cardinality']} distinct values"]
    if p.get("null_pct"):
        parts.append(f"{p['null_pct']}% null")
    if p["type"] in ("integer", "float", "datetime") and p.get("min") is not None:
        parts.append(f"from {p['min']} to {p['max']}")
    if p.get("semantic_type"):
        parts.append(f"looks like {p['semantic_type']}")
    return f"{p['name']}: " + ", ".join(parts)


def domain(profiles: list[dict]) -> str:
    """What kind of data a table holds, by names and semantic types."""
    names = {t for p in profiles for t in p["name"].lower().split("_")}
    kinds = {p.get("semantic_type") for p in profiles}
    if {"latitude", "longitude"} & kinds or names & {"lat", "lon", "geo"}:
        return "geo"
    if names & {"price", "amount", "balance", "acctbal", "totalprice", "extendedprice", "currency"} or "iso_currency" in kinds:
        return "financial"
    if names & {"log", "level", "severity", "message"}:
        return "log"
    if names & {"event", "session"}:
        return "event"
    return "temporal" if any(p["type"] == "datetime" for p in profiles) else "general"


__all__ = ["numeric_columns", "profile"]
