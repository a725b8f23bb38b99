"""Read-only SQL over named tables, gated by the parsed plan, in a session of its own."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from ..errors import RequestError

MOST_ROWS, MOST_TABLES, SECONDS = 500, 10, 10.0
#: Plan nodes that change something or run a command; a read-only plan has none.
_COMMANDS = re.compile(r"Insert\w*|Create\w*|Drop\w*|Delete\w*|Update\w*|Merge\w*|Alter\w*|Truncate\w*|Set\w*Command|Replace\w*|Cache\w*|Uncache\w*|Load\w*|\w*Command\w*|\w*ExecuteImmediate\w*|CompoundBody|SingleStatement")
#: Plan nodes by which a query reaches beyond the tables it was given.
_OUTSIDE = re.compile(r"ScriptTransformation|PlanWithUnresolvedIdentifier|ExpressionWithUnresolvedIdentifier|UnresolvedTableSpec|RelationTimeTravel|NamedStreamingRelation")
#: Functions that call code by name or read something, and the only functions that may stand for tables.
_FORBIDDEN = {"java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "read_files"}
_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "collations", "sql_keywords"}
_START = re.compile(r"^\s*(?:(?:--[^\n]*\n|/\*.*?\*/)\s*)*\(*\s*(?:select|with|values|from|table)\b", re.I | re.S)
#: Literals, quoted names and comments, in which nothing is renamed.
_OPAQUE = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/"


def _nodes(x: object) -> Iterator[dict]:
    if isinstance(x, dict):
        if "class" in x:
            yield x
        for v in x.values():
            yield from _nodes(v)
    elif isinstance(x, list):
        for v in x:
            yield from _nodes(v)


def _names(x: object) -> Iterator[str]:
    """Names that the query itself gives to tables in its WITH clauses."""
    for n in _nodes(x):
        for pair in n.get("cteRelations") or []:
            if isinstance(pair, dict) and isinstance(pair.get("_1"), str):
                yield pair["_1"]


def check(spark: SparkSession, sql: str, tables: list[str] | None = None) -> None:
    """Raises unless ``sql`` parses as one query that reads only ``tables`` and calls nothing by name.  Words inside literals do not matter, since the plan decides."""
    if not _START.match(sql):
        raise RequestError("INVALID_SQL", "a SELECT or WITH query is needed")
    try:
        plan = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON())
    except Exception as e:
        raise RequestError("INVALID_SQL", str(e).splitlines()[0]) from None
    known = {t.lower() for t in [*(tables or []), *_names(plan)]}
    for node in _nodes(plan):
        kind = node["class"].rsplit(".", 1)[-1]
        if _COMMANDS.fullmatch(kind):
            raise RequestError("FORBIDDEN_SQL", "only queries are run")
        if _OUTSIDE.fullmatch(kind):
            raise RequestError("FORBIDDEN_SQL", "a query reads its tables alone")
        parts = [p.strip() for p in str(node.get("multipartIdentifier") or node.get("nameParts") or node.get("name") or "").strip("[]").split(",")]
        if kind == "UnresolvedRelation" and tables is not None and (len(parts) != 1 or parts[0].lower() not in known):
            raise RequestError("FORBIDDEN_SQL", f"no table {'.'.join(parts)}")
        if kind == "UnresolvedFunction" and parts[-1].lower() in _FORBIDDEN:
            raise RequestError("FORBIDDEN_SQL", f"no function {parts[-1]}")
        if kind == "UnresolvedTableValuedFunction" and parts[-1].lower() not in _TABLE_FUNCTIONS:
            raise RequestError("FORBIDDEN_SQL", f"no table function {parts[-1]}")


def plain_names(sql: str, tables: list[str]) -> str:
    """``<id>.rows`` as ``<id>``, but not inside literals and comments."""
    for name in tables:
        sql = re.sub(rf"({_OPAQUE})|(?<![\w.`])`?{name}`?\s*\.\s*`?rows`?(?![\w`])", lambda m: m[1] if m[1] else name, sql, flags=re.S)  # noqa: B023
    return sql


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int = MOST_ROWS) -> DataFrame:
    """The query's first ``limit`` rows, as a table that no job has run for yet.  The first table is also named ``rows``, and ``<id>.rows`` is ``<id>``.

    The tables are views of a session made for this query, so neither other
    callers nor the caller's own views meet them.
    """
    if not tables or len(tables) > MOST_TABLES:
        raise RequestError("INVALID_DATASETS", f"1 to {MOST_TABLES} tables")
    for name in tables:
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise RequestError("INVALID_DATASETS", name)
    sql = plain_names(sql, list(tables))
    check(spark, sql, [*tables, "rows"])
    own = spark._jsparkSession.cloneSession()
    for name, df in [("rows", next(iter(tables.values()))), *tables.items()]:
        spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    try:
        out = own.sql(sql)
    except Exception as e:
        raise RequestError("INVALID_SQL", str(e).splitlines()[0]) from None
    return DataFrame(out, SparkSession(spark.sparkContext, own)).limit(max(1, limit))


@dataclass
class Answer:
    """Rows of a query, and whether there were more."""

    rows: list[Row]
    table: DataFrame
    truncated: bool


def answer(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int = MOST_ROWS, seconds: float = SECONDS) -> Answer:
    """At most ``limit`` rows of the query (MOST_ROWS at most), within ``seconds``, and whether it has more."""
    limit = max(1, min(limit, MOST_ROWS))
    df = run_sql(spark, sql, tables, limit + 1)
    found = collect_within(df, seconds)
    return Answer(found[:limit], spark.createDataFrame(found[:limit], df.schema), len(found) > limit)


def collect_within(df: DataFrame, seconds: float = SECONDS) -> list[Row]:
    """Rows of ``df``, or an error when its jobs take longer."""
    sc = df.sparkSession.sparkContext
    tag = f"lattica-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception:
        if late.is_set():
            raise RequestError("TIMEOUT", f"more than {seconds} s") from None
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
