"""Query-log mining: which tables and columns are used, how often, and which never."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import SQL_WORDS
from ..functions.text import fingerprint
from .redaction import sql_text

TABLE = r"""(?i)\b(?:from|join|update|insert\s+into|delete\s+from|merge\s+into)\s+((?:["`\[]?[a-z_]\w*["`\]]?\.)*["`\[]?[a-z_]\w*["`\]]?)"""
CLAUSE = r"(?is)\b(?:select|where|on|group\s+by|order\s+by|having)\b(.*?)(?=\b(?:from|where|join|left|right|inner|cross|group\s+by|order\s+by|having|limit|union|on)\b|$)"
NAME = r"[A-Za-z_]\w*"
KEYS = ["fingerprint", "dataset", "column", "source"]


def tables_of(q: Column) -> Column:
    """Last parts of the names after FROM, JOIN and the like, in lower case."""
    found = F.regexp_extract_all(q, F.lit(TABLE), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.lower(F.regexp_replace(F.element_at(F.split(t, r"\."), -1), r'["`\[\]]', ""))))


def columns_of(q: Column) -> Column:
    """Names in the select list and the clauses, but SQL's own words."""
    bare = F.regexp_replace(q, r"'[^']*'", " ")
    clauses = F.array_join(F.regexp_extract_all(bare, F.lit(CLAUSE), F.lit(1)), " ")
    return F.array_except(F.array_distinct(F.transform(F.regexp_extract_all(clauses, F.lit(NAME), F.lit(0)), F.lower)), F.array(*[F.lit(w) for w in SQL_WORDS]))


def rollup(log: DataFrame, catalog: DataFrame, source: str = "sql_log") -> DataFrame:
    """One row for each fingerprint, table and column of the catalogue (dataset, name) that the log's queries name; column '' counts the table.

    log: query, calls, total_time, seen.  Names outside the catalogue fall out
    in the join.
    """
    parsed = log.select(fingerprint(sql_text(F.col("query"))).alias("fingerprint"), tables_of(F.col("query")).alias("tables"), columns_of(F.col("query")).alias("columns"), "calls", "total_time", "seen")
    rows = parsed.select("fingerprint", F.explode("tables").alias("dataset"), "columns", "calls", "total_time", "seen").select("*", F.explode(F.array_union(F.col("columns"), F.array(F.lit("")))).alias("column")).drop("columns")
    known = catalog.select(F.lower("dataset").alias("dataset"), F.lower("name").alias("column")).unionByName(catalog.select(F.lower("dataset").alias("dataset"), F.lit("").alias("column"))).distinct()
    return merge(rows.join(known, ["dataset", "column"]).withColumn("source", F.lit(source)))


def merge(*parts: DataFrame) -> DataFrame:
    """Adds up calls and times of equal keys."""
    cols = [*KEYS, "calls", "total_time", "seen"]
    all_rows = parts[0].select(*cols)
    for p in parts[1:]:
        all_rows = all_rows.unionByName(p.select(*cols))
    return all_rows.groupBy(*KEYS).agg(F.sum("calls").alias("calls"), F.sum("total_time").alias("total_time"), F.max("seen").alias("seen"))


def unused_columns(profiles: DataFrame, calls: DataFrame, since: Column, least: int = 0, audit: tuple[str, ...] = ("created_at", "updated_at", "deleted_at")) -> DataFrame:
    """(dataset, name, state): columns never used, not used since, or used less than ``least`` times; keys and audit names are left out."""
    use = calls.where("column <> ''").groupBy("dataset", "column").agg(F.sum("calls").alias("calls"), F.max("seen").alias("seen"))
    j = profiles.where(~F.col("is_primary_key_candidate") & ~F.lower("name").isin(*audit)).join(use, (F.lower(profiles["dataset"]) == use["dataset"]) & (F.lower(profiles["name"]) == use["column"]), "left")
    state = F.when(F.col("calls").isNull(), "zero_hits").when(F.col("seen") < since, "stale").when(F.col("calls") < least, "below_min_calls")
    return j.select(profiles["dataset"], profiles["name"], state.alias("state")).where("state is not null")


def redaction_log(log: DataFrame, since: Column, source: str | None = None) -> DataFrame:
    """(pattern, count) since a time."""
    rows = log.where(F.col("seen") >= since)
    rows = rows.where(F.col("source") == source) if source else rows
    return rows.groupBy("pattern").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "pattern")
