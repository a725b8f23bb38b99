"""Keys, joins between tables, similar columns and the impact of a change, from profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, name_parts
from .join import containment


def suggest_keys(profiles: DataFrame) -> DataFrame:
    """(name, confidence) of columns that can be a primary key."""
    score = 0.6 + F.when(F.col("type") == "integer", 0.15).otherwise(0.0) + F.when(F.col("semantic_type") == "uuid", 0.2).otherwise(0.0) + F.when(F.col("null_count") == 0, 0.1).otherwise(0.0) + F.when(F.col("cardinality_is_exact"), 0.05).otherwise(0.0)
    return profiles.where("is_primary_key_candidate").select("name", F.round(F.least(score, F.lit(1.0)), 2).alias("confidence")).orderBy(F.desc("confidence"), "name")


def suggest_joins(source: DataFrame, target: DataFrame, pairs: list[tuple[str, str]], least: float = 0.95) -> DataFrame:
    """(column, key, n_distinct, n_found, ratio) of those pairs whose values are found in the key; exact over all values."""
    out = None
    for column, key in pairs:
        one = containment(source, column, target, key).select(F.lit(column).alias("column"), F.lit(key).alias("key"), "n_distinct", "n_found", F.round(F.col("n_found") / F.nullif(F.col("n_distinct"), F.lit(0)), 4).alias("ratio"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("ratio") >= least)


def verdict(score: Column, name_score: Column, same_type: Column) -> Column:
    return F.when((score >= 0.85) & same_type, "near_duplicate").when((score >= 0.7) & (name_score < 0.5), "naming_drift").when((score >= 0.7) & (name_score >= 0.7), "parallel_definition").otherwise("overlapping_topic")


def similar_columns(profiles: DataFrame, least: float = 0.5, top: int = 50, same_type_only: bool = False) -> DataFrame:
    """Pairs of columns of different tables (profiles: dataset, name, type, cardinality, values array) by name, value, type and cardinality.

    Columns that share no part of their names and no value score 0.25 at most,
    so above that only those that share one are compared.
    """
    p = profiles.select("dataset", "name", "type", "cardinality", "values", name_parts(F.col("name")).alias("parts"))
    a, b = p.alias("a"), p.alias("b")
    apart = (F.col("a.dataset") < F.col("b.dataset")) & ((F.col("a.type") == F.col("b.type")) if same_type_only else F.lit(True))
    if least > 0.25:
        shared = F.explode(F.array_union(F.transform("parts", lambda x: F.concat(F.lit("name "), x)), F.transform("values", lambda x: F.concat(F.lit("value "), x))))
        t = p.select("dataset", "name", shared.alias("shared"))
        x, y = t.alias("x"), t.alias("y")
        pairs = x.join(y, (F.col("x.shared") == F.col("y.shared")) & (F.col("x.dataset") < F.col("y.dataset"))).select(F.col("x.dataset").alias("da"), F.col("x.name").alias("na"), F.col("y.dataset").alias("db"), F.col("y.name").alias("nb")).distinct()
        j = pairs.join(a, (F.col("a.dataset") == F.col("da")) & (F.col("a.name") == F.col("na"))).join(b, (F.col("b.dataset") == F.col("db")) & (F.col("b.name") == F.col("nb"))).where(apart)
    else:
        j = a.join(b, apart)
    name, value, same = jaccard(F.col("a.parts"), F.col("b.parts")), jaccard(F.col("a.values"), F.col("b.values")), F.col("a.type") == F.col("b.type")
    big, small = F.greatest("a.cardinality", "b.cardinality"), F.least("a.cardinality", "b.cardinality")
    card = F.when(big > 0, small / big).otherwise(0.0)
    score = F.round(0.45 * name + 0.3 * value + 0.15 * same.cast("double") + 0.1 * card, 4)
    rows = j.select(F.col("a.dataset").alias("dataset_a"), F.col("a.name").alias("column_a"), F.col("b.dataset").alias("dataset_b"), F.col("b.name").alias("column_b"), score.alias("score"), F.round(name, 4).alias("name_score"), same.alias("same_type"))
    kept = rows.where(F.col("score") >= least)
    return kept.select("dataset_a", "column_a", "dataset_b", "column_b", "score", verdict(F.col("score"), F.col("name_score"), F.col("same_type")).alias("verdict")).orderBy(F.desc("score"), "dataset_a", "column_a", "dataset_b", "column_b").limit(top)


def clusters(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Groups of names joined by kept pairs (a few columns: on the driver)."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(b)] = root(a)
    groups: dict[str, list[str]] = {}
    for x in sorted(parent):
        groups.setdefault(root(x), []).append(x)
    return sorted(groups.values())


def foreign_keys(profiles: DataFrame) -> DataFrame:
    """(from_dataset, from_column, to_dataset, to_column): a column named like another table's key, or ``<table>_id`` beside a key ``id``."""
    keys = profiles.where("is_primary_key_candidate").select(F.col("dataset").alias("to_dataset"), F.col("name").alias("to_column"))
    cols = profiles.select(F.col("dataset").alias("from_dataset"), F.col("name").alias("from_column"))
    stem = F.regexp_extract(F.lower("from_column"), "^(.+)_id$", 1)
    other = F.col("from_dataset") != F.col("to_dataset")
    same = cols.join(keys, (F.lower("from_column") == F.lower("to_column")) & other)
    tables = cols.where(stem != "").withColumn("table", F.explode(F.array(stem, F.concat(stem, F.lit("s")))))
    named = tables.join(keys.where(F.lower("to_column") == "id"), (F.col("table") == F.lower("to_dataset")) & other).drop("table")
    return same.unionByName(named)


def worked_out(df: DataFrame) -> DataFrame:
    """A table with a row for each column of the catalogue, worked out once instead of at every use."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def schema_impact(edges: DataFrame, dataset: str, column: str, depth: int = 3, traffic: float = 0.0, total: int | None = None) -> tuple[DataFrame, float]:
    """Columns reached from ``dataset.column`` over foreign keys within ``depth`` steps, and the blast radius from 0 to 1.

    The edges are a row for each key pair of the catalogue, so they are worked
    out once and the walk's frontier stays profile-sized.
    """
    spark = edges.sparkSession
    edges = worked_out(edges)
    seen = spark.createDataFrame([(dataset, column, 0)], "dataset string, column string, depth int")
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges, (F.col("dataset") == F.col("to_dataset")) & (F.col("column") == F.col("to_column"))).select(F.col("from_dataset").alias("dataset"), F.col("from_column").alias("column")).distinct()
        front = step.join(seen.select("dataset", "column"), ["dataset", "column"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    reached = seen.where("depth > 0")
    counts = {r["depth"]: r["n"] for r in reached.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}
    direct, transitive = counts.get(1, 0), sum(n for d, n in counts.items() if d > 1)
    n = total if total is not None else edges.count()
    return reached, min(1.0, (2 * direct + direct + 0.5 * transitive + 0.5 * traffic) / (0.3 * n + 1))


def drop_check(profiles: DataFrame, edges: DataFrame, dataset: str, column: str, calls: int = 0) -> dict:
    """Whether a column can be dropped, and what stands against it."""
    profiles, edges = worked_out(profiles.select("dataset", "name", "is_primary_key_candidate")), worked_out(edges)
    mine = (F.col("dataset") == dataset) & (F.col("name") == column)
    is_key = bool(profiles.where(mine & F.col("is_primary_key_candidate")).limit(1).count())
    targets = edges.where((F.col("to_dataset") == dataset) & (F.col("to_column") == column)).count()
    sources = edges.where((F.col("from_dataset") == dataset) & (F.col("from_column") == column)).count()
    same = profiles.where((F.col("name") == column) & (F.col("dataset") != dataset)).count()
    blockers = [w for w, hit in (("primary_key", is_key), ("referenced_by_foreign_key", targets), ("runtime_traffic", calls)) if hit]
    cautions = [w for w, hit in (("is_foreign_key", sources), ("same_name_elsewhere", same)) if hit]
    return {"verdict": "unsafe" if blockers else "caution" if cautions else "safe", "blockers": blockers[:5], "cautions": cautions}
