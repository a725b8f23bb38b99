"""Queries that write a table in another form, read it back, and must find what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as prof
from ..operators import sql as gate
from ..operators import workload
from ..sources import files
from ..sources.scratch import fresh
from ..sources.store import Store
from .registry import query, table


@query("SELECT * FROM orders")
def read_csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, ".csv")
    table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    return files.read_file(spark, path)


@query("SELECT p_partkey, 'é ' || p_name AS p_name, p_size, p_retailprice FROM part")
def read_csv_latin1_semicolons(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, ".csv")
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("é "), "p_name").alias("p_name"), "p_size", "p_retailprice")
    part.write.option("header", True).option("sep", ";").option("encoding", "iso-8859-1").csv(path)
    return files.read_file(spark, path).withColumn("p_size", F.col("p_size").cast("int"))


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey FROM customer")
def read_tsv_header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, ".tsv")
    lines = table(spark, sf_dir, "customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string")).alias("value"))
    head = spark.createDataFrame([("customers\t\t",), ("c_custkey\tc_name\tc_nationkey",)], "value string").coalesce(1)
    head.unionByName(lines).coalesce(1).write.text(path)
    return files.read_file(spark, path, header_row=1)


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def read_csv_quoted_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, quotes and delimiters, each in one cell."""
    path = fresh(spark, ".csv")
    keep = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, sf_dir, "documents").select("doc_id", "text").write.options(**keep).csv(path)
    return files.read_file(spark, path, typed=False).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"))


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, ".jsonl")
    table(spark, sf_dir, "events").write.json(path)
    return files.read_file(spark, path).select("event_id", "user_id", "event_type", "value", "props")


#: Forms that text takes, by the remainder of a key.
_FORMS = {
    0: ("strftime(o_orderdate, '%-m/%-d/%Y')", lambda: F.date_format("o_orderdate", "M/d/yyyy"), 2), 1: ("o_orderkey::VARCHAR", lambda: F.col("o_orderkey").cast("string"), 0), 2: ("'0' || o_orderkey", lambda: F.concat(F.lit("0"), F.col("o_orderkey").cast("string")), 3),
    3: ("o_orderkey || 'd'", lambda: F.concat(F.col("o_orderkey").cast("string"), F.lit("d")), 3), 4: ("o_orderkey || '.5'", lambda: F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")), 1), 5: ("' N/A '", lambda: F.lit(" N/A "), None),
    6: ("'13/45/2020'", lambda: F.lit("13/45/2020"), 3), 7: ("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", lambda: F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), 2), 8: ("o_orderstatus", lambda: F.col("o_orderstatus"), 3),
}
_RANKS = " ".join(f"WHEN {k} THEN {'NULL' if r is None else r}" for k, (_, _, r) in _FORMS.items())


@query(f"""SELECT o_orderkey, CASE o_orderkey % 9 {_RANKS} END AS rank, CASE WHEN o_orderkey % 9 = 1 THEN o_orderkey END AS whole, CASE o_orderkey % 9 WHEN 1 THEN o_orderkey::DOUBLE WHEN 4 THEN o_orderkey + 0.5::DOUBLE END AS real,
CASE WHEN o_orderkey % 9 IN (0, 7) THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def text_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import as_datetime, as_float, as_integer, clean, rank_of

    form = F.lit(None).cast("string")
    for k, (_, make, _) in _FORMS.items():
        form = F.when(F.col("o_orderkey") % 9 == k, make()).otherwise(form)
    t = clean(F.col("t"))
    return table(spark, sf_dir, "orders").select("o_orderkey", form.alias("t")).select("o_orderkey", rank_of(t).alias("rank"), as_integer(t).alias("whole"), as_float(t).alias("real"), F.date_format(as_datetime(t), "yyyy-MM-dd").alias("day"))


@query("SELECT 'code' AS name, 'string' AS type, round(1 - count(*) FILTER (WHERE o_orderkey % 9 IN (0, 1, 4, 7)) / count(*) FILTER (WHERE o_orderkey % 9 <> 5), 3) AS type_confidence, count(*) FILTER (WHERE o_orderkey % 9 IN (0, 1, 4, 7)) AS violations FROM orders UNION ALL SELECT 'o_orderkey', 'integer', 1.0, 0")
def profile_type_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.lit(None).cast("string")
    for k, (_, make, _) in _FORMS.items():
        form = F.when(F.col("o_orderkey") % 9 == k, make()).otherwise(form)
    return prof.profile(table(spark, sf_dir, "orders").select("o_orderkey", form.alias("code"))).select("name", "type", "type_confidence", "violations")


@query("SELECT 'SELECT c_name FROM customer WHERE c_custkey = ' || c_custkey AS query, c_nationkey::BIGINT + 1 AS calls, c_acctbal AS total_time FROM customer")
def read_sql_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, ".csv")
    c = table(spark, sf_dir, "customer")
    c.select(F.concat(F.lit("SELECT c_name FROM customer WHERE c_custkey = "), F.col("c_custkey").cast("string")).alias("statement"), (F.col("c_nationkey") + 1).alias("executions"), F.col("c_acctbal").alias("duration")).write.option("header", True).csv(path)
    return files.read_sql_log(spark, path).select("query", "calls", "total_time")


def _store(spark: SparkSession, sf_dir: str, *names: str) -> Store:
    store = Store(spark, fresh(spark))
    for n in names:
        store.index(n, table(spark, sf_dir, n), "first")
    return store


@query("SELECT row_number() OVER (ORDER BY event_id) AS _row_id, event_id, user_id, event_type, value FROM events")
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "events").rows("events").select("_row_id", "event_id", "user_id", "event_type", "value")


@query("SELECT 'c_custkey' AS name, count(DISTINCT c_custkey) AS cardinality, min(c_custkey)::VARCHAR AS min FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name), min(c_name) FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), min(c_nationkey)::VARCHAR FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), min(c_mktsegment) FROM customer")
def store_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "customer").profiles("customer").where("name <> 'c_acctbal'").select("name", "cardinality", "min")


@query("SELECT 'nation' AS dataset, count(*) AS rows, 3 AS columns FROM nation UNION ALL SELECT 'region', count(*), 2 FROM region")
def store_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "nation", "region").list_datasets().select("dataset", "rows", "columns")


@query("SELECT 1 AS version, count(*) AS rows FROM nation UNION ALL SELECT 2, count(*) FROM nation WHERE n_regionkey <> 0")
def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three index runs the second changes nothing, for its source is the first's."""
    store = _store(spark, sf_dir, "nation")
    store.index("nation", table(spark, sf_dir, "region"), "first")
    store.index("nation", table(spark, sf_dir, "nation").where("n_regionkey <> 0"), "second")
    lines = store.history("nation").orderBy("indexed_at").collect()
    return spark.createDataFrame([(k + 1, r["rows"]) for k, r in enumerate(lines)], "version int, rows long")


@query("SELECT sha256(concat_ws(chr(10), 'n_name', 'n_nationkey', 'n_regionkey', string_agg(sha256(concat_ws(chr(31), n_name, n_nationkey, n_regionkey)), chr(10) ORDER BY n_nationkey))) AS fingerprint FROM nation")
def store_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_store(spark, sf_dir, "nation").manifest("nation")["fingerprint"],)], "fingerprint string")


@query("SELECT 'nation' AS dataset, 'ok' AS status, count(*) AS rows FROM nation UNION ALL SELECT 'region', 'error', count(*) - 1 FROM region")
def store_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset as it was written, and one whose rows were changed behind its manifest."""
    store = _store(spark, sf_dir, "nation", "region")
    store.rows("region").where("_row_id > 1").write.parquet(f"{store.root}/less")
    rows = f"{store.manifest('region')['base']}/rows"
    store._fs.delete(store._path(rows), True)
    store._fs.rename(store._path(f"{store.root}/less"), store._path(rows))
    return spark.createDataFrame([(n, store.validate(n)["status"], store.rows(n).count()) for n in ("nation", "region")], "dataset string, status string, rows long")


@query("SELECT 'region' AS dataset, count(*) AS rows FROM region")
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "nation", "region")
    store.delete("nation")
    return store.list_datasets().select("dataset", "rows")


@query("SELECT count(*) > 500 AS truncated, least(count(*), 500) AS returned FROM orders")
def sql_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gate.answer(spark, "SELECT o_orderkey FROM orders.rows", {"orders": table(spark, sf_dir, "orders")}, seconds=300)
    return spark.createDataFrame([(got.truncated, len(got.rows))], "truncated boolean, returned long")


@query("SELECT event_type AS pattern, sum(user_id)::BIGINT AS count FROM events WHERE ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY 1")
def redaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    return workload.redaction_log(e.select(F.col("event_type").alias("pattern"), F.col("user_id").alias("count"), F.col("ts").alias("seen")), F.lit(lo + (hi - lo) / 2))
