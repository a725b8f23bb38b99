"""The engine's queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import SECRETS
from ..functions.predicates import where
from ..functions.text import cosine, fingerprint, jaccard, name_parts
from ..operators import aggregate as agg
from ..operators import describe, health, redaction, relations, rows, search, workload
from ..operators import distribution as dist
from ..operators import join as joins
from ..operators import profile as prof
from ..operators import sql as gate
from ..streaming import workload as streams
from . import kept  # noqa: F401  (registers its queries)
from .registry import QUERIES, SQL, Query, query, table

def _filter_query(name: str, of: str, spec: dict, columns: list[str], condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return where(table(spark, sf_dir, of), [spec]).select(*columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {of} WHERE {condition}")(run)


_O, _L = ["o_orderkey", "o_orderstatus", "o_totalprice"], ["l_orderkey", "l_linenumber", "l_quantity"]
_filter_query("filter_eq", "orders", {"column": "o_orderstatus", "op": "eq", "value": "F"}, _O, "o_orderstatus = 'F'")
_filter_query("filter_eq_text_number", "lineitem", {"column": "l_quantity", "op": "eq", "value": "17"}, _L, "l_quantity = 17")
_filter_query("filter_neq", "orders", {"column": "o_orderstatus", "op": "neq", "value": "F"}, _O, "o_orderstatus <> 'F'")
_filter_query("filter_gt", "lineitem", {"column": "l_quantity", "op": "gt", "value": 48}, _L, "l_quantity > 48")
_filter_query("filter_gte", "lineitem", {"column": "l_quantity", "op": "gte", "value": 49}, _L, "l_quantity >= 49")
_filter_query("filter_lt", "lineitem", {"column": "l_quantity", "op": "lt", "value": 3}, _L, "l_quantity < 3")
_filter_query("filter_lte", "lineitem", {"column": "l_quantity", "op": "lte", "value": 2}, _L, "l_quantity <= 2")
_filter_query("filter_contains", "part", {"column": "p_name", "op": "contains", "value": "A"}, ["p_partkey", "p_name"], "p_name ILIKE '%a%'")
_filter_query("filter_contains_escaped", "documents", {"column": "text", "op": "contains", "value": "%%"}, ["doc_id"], "contains(text, '%%')")
_filter_query("filter_in", "customer", {"column": "c_mktsegment", "op": "in", "value": ["BUILDING", "MACHINERY"]}, ["c_custkey", "c_mktsegment"], "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter_query("filter_not_null", "customer", {"column": "c_name", "op": "is_null", "value": False}, ["c_custkey", "c_name"], "c_name IS NOT NULL")
_filter_query("filter_between", "orders", {"column": "o_orderdate", "op": "between", "value": ["1995-01-01", "1995-12-31"]}, _O, "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def filter_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))
    return where(o, [{"column": "status", "op": "is_null", "value": True}]).select("o_orderkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 20")
def rows_column_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.get_rows(table(spark, sf_dir, "orders"), columns=["orders::o_orderkey#column", "orders::o_orderpriority#column"], order_by="o_orderkey", limit=20)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def rows_order_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.get_rows(table(spark, sf_dir, "orders"), [{"column": "o_orderstatus", "op": "eq", "value": "O"}], ["o_orderkey", "o_totalprice"], "o_totalprice", "desc", 50, 100, ["o_orderkey"])


@query("SELECT count(*) AS total_matching FROM orders WHERE o_totalprice > 100000")
def rows_total_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.total_matching(table(spark, sf_dir, "orders"), [{"column": "o_totalprice", "op": "gt", "value": 100000}])


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.top_values(table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate")), "d", 50)


@query("SELECT row_number() OVER (ORDER BY event_id) AS _row_id, event_id FROM events")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.with_row_ids(table(spark, sf_dir, "events").select("event_id")).select("_row_id", "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20")
def sample_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sample_rows(table(spark, sf_dir, "orders"), 20, "head", "o_orderkey", ["o_orderkey", "o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def sample_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sample_rows(table(spark, sf_dir, "orders"), 20, "tail", "o_orderkey", ["o_orderkey", "o_custkey"])


_SEEDED = " ".join(f"WHEN {n} THEN {random.Random(7).sample(range(1, n + 1), 20)}" for n in (150, 1500, 15_000))


@query(f"WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) AS _row_id, c_custkey FROM customer) SELECT * FROM c WHERE _row_id IN (SELECT unnest(CASE (SELECT count(*) FROM customer) {_SEEDED} END))")
def sample_random_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sample_rows(rows.with_row_ids(table(spark, sf_dir, "customer").orderBy("c_custkey")), 20, "random", "_row_id", ["_row_id", "c_custkey"], seed=7)


_ALL = [
    {"column": "*", "function": "count", "alias": "n"}, {"column": "l_suppkey", "function": "count_distinct", "alias": "suppliers"}, {"column": "l_quantity", "function": "sum", "alias": "sum_qty"},
    {"column": "l_extendedprice", "function": "max", "alias": "max_price"}, {"column": "l_extendedprice", "function": "min", "alias": "min_price"}, {"column": "l_quantity", "function": "median", "alias": "median_qty"},
]
_ALL_SQL = "count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(l_quantity) AS sum_qty, max(l_extendedprice) AS max_price, min(l_extendedprice) AS min_price, median(l_quantity) AS median_qty"


@query(f"SELECT {_ALL_SQL} FROM lineitem")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.groups_of(table(spark, sf_dir, "lineitem"), _ALL)


@query(f"SELECT l_returnflag, l_linestatus, {_ALL_SQL} FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 50")
def agg_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.aggregate(table(spark, sf_dir, "lineitem"), _ALL, ["l_returnflag", "l_linestatus"], order_by="n")


@query("SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS avg_discount FROM lineitem GROUP BY 1, 2")
def agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.groups_of(table(spark, sf_dir, "lineitem"), [{"column": "l_discount", "function": "avg", "alias": "avg_discount"}], ["l_returnflag", "l_linestatus"])
    return out.withColumn("avg_discount", F.round("avg_discount", 6))


@query("SELECT l_partkey, count(*) AS n, sum(l_quantity) AS l_quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1 HAVING count(*) >= 5 AND sum(l_quantity) BETWEEN 100 AND 400 ORDER BY 3 DESC, 1 LIMIT 100")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.aggregate(
        table(spark, sf_dir, "lineitem"), [{"column": "*", "function": "count", "alias": "n"}, {"column": "l_quantity", "function": "sum", "alias": "l_quantity"}], ["l_partkey"],
        [{"column": "l_shipdate", "op": "between", "value": ["1994-01-01", "1996-12-31"]}], [{"column": "n", "op": "gte", "value": 5}, {"column": "l_quantity", "op": "between", "value": [100, 400]}], "l_quantity", "desc", 100,
    )


@query("SELECT o_orderpriority, count(*) AS count_all, count(DISTINCT o_custkey) AS count_distinct_o_custkey FROM orders GROUP BY 1")
def agg_default_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.groups_of(table(spark, sf_dir, "orders"), [{"column": "*", "function": "count"}, {"column": "o_custkey", "function": "count_distinct"}], ["o_orderpriority"])


_APPROX = [{"column": "l_partkey", "function": "count_distinct", "alias": "parts"}, {"column": "l_quantity", "function": "median", "alias": "median_qty"}]


@query("SELECT l_returnflag, true AS parts_within_7_percent, true AS median_within_1 FROM lineitem GROUP BY 1")
def agg_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate figures of each group, held to three times their stated error."""
    items = table(spark, sf_dir, "lineitem")
    near, exact = (agg.groups_of(items, _APPROX, ["l_returnflag"], approximate=a) for a in (True, False))
    both = near.join(exact.withColumnsRenamed({"parts": "p", "median_qty": "m"}), "l_returnflag")
    return both.select("l_returnflag", (F.abs(F.col("parts") / F.col("p") - 1) <= 0.07).alias("parts_within_7_percent"), (F.abs(F.col("median_qty") - F.col("m")) <= 1).alias("median_within_1"))


@query("SELECT count(*) AS rows, true AS avg_within_2_percent, true AS sum_within_2_percent FROM lineitem")
def agg_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    exact = items.agg(F.avg("l_extendedprice").alias("a"), F.sum("l_extendedprice").alias("s"))
    return agg.sampled(items, "l_extendedprice", seed=3).crossJoin(F.broadcast(exact)).select("rows", (F.abs(F.col("avg") / F.col("a") - 1) <= 0.02).alias("avg_within_2_percent"), (F.abs(F.col("sum") / F.col("s") - 1) <= 0.02).alias("sum_within_2_percent"))


@query("SELECT count(*) AS total_groups FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 30)")
def agg_total_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.total_groups(table(spark, sf_dir, "lineitem"), [{"column": "*", "function": "count", "alias": "n"}], ["l_partkey"], None, [{"column": "n", "op": "gte", "value": 30}])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.cube(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [{"column": "*", "function": "count", "alias": "n"}])


_OC = {"columns_a": ["o_orderkey", "o_custkey"], "columns_b": ["c_custkey", "c_name"]}


@query("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", filters_b=[{"column": "c_mktsegment", "op": "eq", "value": "BUILDING"}], **_OC)


@query("SELECT c_custkey, c_name, o_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "left", ["c_custkey", "c_name"], ["o_custkey", "o_orderkey"])


@query("SELECT c_custkey, c_name, o_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "right", ["o_custkey", "o_orderkey"], ["c_custkey", "c_name"])


@query("SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation CROSS JOIN region")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), "n_nationkey", "r_regionkey", "cross", ["n_nationkey", "n_name"])


@query("SELECT a.n_nationkey, a.n_name, b.n_regionkey, b.n_name AS n_name__b FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey")
def join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return joins.join(n, n, "n_nationkey", "n_regionkey", "inner", ["n_nationkey", "n_name"], ["n_regionkey", "n_name"])


@query("SELECT c_custkey, o_custkey, o_orderkey FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "full", ["c_custkey"], ["o_custkey", "o_orderkey"], None, [{"column": "o_orderstatus", "op": "eq", "value": "P"}], "pre")


@query("SELECT c_custkey, o_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000")
def join_left_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "left", ["c_custkey"], ["o_custkey", "o_orderkey"], None, [{"column": "o_totalprice", "op": "gt", "value": 300000}])


@query("SELECT c_custkey, o_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
def join_left_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "left", ["c_custkey"], ["o_custkey", "o_orderkey"], None, [{"column": "o_totalprice", "op": "gt", "value": 300000}], "pre")


@query("SELECT o_orderkey, o_totalprice, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def join_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_page(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", order_by="o_totalprice", order_dir="desc", limit=25, ties=["o_orderkey"], columns_a=["o_orderkey", "o_totalprice", "o_custkey"], columns_b=["c_custkey", "c_name"])


@query("SELECT count(*) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000")
def join_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_total(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "left", filters_b=[{"column": "o_totalprice", "op": "gt", "value": 300000}])


@query("SELECT count(*) AS n_distinct, count(c_custkey) AS n_found FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN customer ON o_custkey = c_custkey")
def join_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.containment(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


_SQL_TEXTS = {
    "sql_cte_window": ("orders", "WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT count(*) AS n, sum(o_orderkey) AS keys, max(o_totalprice) AS top FROM t WHERE rn = 1"),
    "sql_setops": ("orders customer", "SELECT count(*) AS n, sum(k) AS keys FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000) t"),
    "sql_union_all": ("nation region", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region"),
    "sql_subquery": ("customer orders", "SELECT count(*) AS n, sum(c_custkey) AS keys FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    "sql_semi_anti": ("customer orders", "SELECT c_nationkey, count(*) AS n, sum(c_custkey) AS keys FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY c_nationkey"),
    "sql_multiway": ("nation customer orders region", "SELECT r_name, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "sql_theta_join": ("part", "SELECT a.p_brand, count(*) AS pairs, sum(b.p_size - a.p_size) AS steps FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size < b.p_size GROUP BY a.p_brand"),
    "sql_recursive": ("region", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t"),
    "sql_grouping_sets": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
}
#: Texts that the gate runs in place of those above: the same rows without forming every pair.
_SQL_RUN = {
    # The steps of all pairs add up from the gaps between neighbouring sizes, each crossed by every pair of a part below it and one above.
    "sql_theta_join": """WITH s AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL GROUP BY p_brand, p_type, p_size),
w AS (SELECT p_brand, n, lead(p_size) OVER (PARTITION BY p_brand, p_type ORDER BY p_size) - CAST(p_size AS BIGINT) AS gap, sum(n) OVER (PARTITION BY p_brand, p_type ORDER BY p_size ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY p_brand, p_type) AS every FROM s)
SELECT p_brand, sum(n * (upto - n)) AS pairs, sum(gap * upto * (every - upto)) AS steps FROM w GROUP BY p_brand HAVING sum(n * (upto - n)) > 0""",
}


def _sql_query(name: str, tables: list[str], text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gate.run_sql(spark, _SQL_RUN.get(name, text), {t: table(spark, sf_dir, t) for t in tables})

    run.__name__ = name
    query(text)(run)


for _name, (_tables, _text) in _SQL_TEXTS.items():
    _sql_query(_name, _tables.split(), _text)


@query("""WITH b AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem), s AS (SELECT unnest(range(20)) AS bin),
c AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT s.bin::INT AS bin, round(lo + s.bin * (hi - lo) / 20, 4) AS low, round(CASE WHEN s.bin = 19 THEN hi ELSE lo + (s.bin + 1) * (hi - lo) / 20 END, 4) AS high, coalesce(n, 0) AS count FROM s CROSS JOIN b LEFT JOIN c ON c.bin = s.bin""")
def dist_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dist.numeric_distribution(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20)
    return d.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query("SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS count FROM orders GROUP BY 1")
def dist_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.datetime_distribution(table(spark, sf_dir, "orders"), "o_orderdate", "month")


@query("""WITH c AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS k FROM c)
SELECT CASE WHEN k <= 10 THEN v ELSE '<other>' END AS value, sum(n)::BIGINT AS count FROM r GROUP BY 1""")
def dist_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.categorical_distribution(table(spark, sf_dir, "part"), "p_type", 10)


_N4 = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
_STRENGTH = "CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'negligible' END AS strength, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction"


def _corr_sql(source: str) -> str:
    parts = [f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS r, count(*) AS n FROM {source}" for i, a in enumerate(_N4) for b in _N4[i + 1 :]]
    return f"SELECT column_a, column_b, r, n, {_STRENGTH} FROM ({' UNION ALL '.join(parts)})"


@query(_corr_sql("lineitem"))
def corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.correlations(table(spark, sf_dir, "lineitem"), _N4, 0.0)


@query("WITH k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _N4) + " FROM lineitem) " + _corr_sql("k"))
def corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.correlations(table(spark, sf_dir, "lineitem"), _N4, 0.0, method="spearman")


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{k}' AS type, count(*) AS count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS cardinality, (count(DISTINCT {c}) = count(*)) AS is_unique, (count(DISTINCT {c}) = count(*) AND '{k}' IN ('integer', 'string')) AS is_primary_key_candidate FROM {name}" for c, k in columns.items()
    )


_PROFILED = {
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "string"},
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "string"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "float"},
    "events": {"event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string", "value": "float", "props": "string"},
}
_P = ["name", "type", "count", "null_count", "cardinality", "is_unique", "is_primary_key_candidate"]


def _profile_query(name: str, columns: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return prof.profile(table(spark, sf_dir, name).select(*columns)).select(*_P)

    run.__name__ = f"profile_{name}"
    query(_profile_sql(name, columns))(run)


for _name, _columns in _PROFILED.items():
    _profile_query(_name, _columns)


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std_dev FROM lineitem" for c in _N4))
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prof.column_stats(table(spark, sf_dir, "lineitem").select(*_N4))
    return s.select("name", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("min", "max", "mean", "std_dev")])


@query("SELECT name, value, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY count DESC, value) AS rank FROM (SELECT 'l_returnflag' AS name, l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2)) WHERE rank <= 5")
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.top_values(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"), 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT column_name AS name, true AS within_7_percent FROM (DESCRIBE lineitem)")
def profile_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched cardinalities of all columns, held to three times the sketch's error."""
    items = table(spark, sf_dir, "lineitem")
    exact = prof.cardinalities(items).select("name", F.col("cardinality").alias("exact"))
    return prof.profile(items, exact=False).join(exact, "name").select("name", (F.abs(F.col("cardinality") / F.col("exact") - 1) <= 0.07).alias("within_7_percent"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, {', '.join(f'quantile_disc({c}, {q})::DOUBLE AS q{round(100 * q)}' for q in prof.QUANTILES)} FROM lineitem" for c in ("l_quantity", "l_linenumber", "l_discount")))
def profile_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prof.column_stats(table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber", "l_discount"))
    return s.select("name", *[F.element_at("quantiles", k + 1).alias(f"q{round(100 * q)}") for k, q in enumerate(prof.QUANTILES)])


@query("SELECT 'l_shipdate' AS name, 'datetime' AS type, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS min, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS max FROM lineitem")
def profile_datetime_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.profile(table(spark, sf_dir, "lineitem").select("l_shipdate"), exact=False).select("name", "type", "min", "max")


_URL, _FLAG = r"(?i)^https?://[^\s/$.?#].[^\s]*$", r"(?i)^(?:true|false|t|f|yes|no|y|n|0|1)$"


@query(f"""WITH p AS (SELECT url, CASE WHEN page_id % 7 = 0 THEN 'maybe' WHEN page_id % 2 = 0 THEN 'yes' ELSE 'no' END AS flag, CASE WHEN page_id % 5 = 0 THEN 'maybe' ELSE 'no' END AS odd, html FROM pages),
r AS (SELECT 'url' AS name, 'url' AS t, avg(regexp_matches(url, '{_URL}')::INT) AS c FROM p UNION ALL SELECT 'flag', 'boolean_text', avg(regexp_matches(flag, '{_FLAG}')::INT) FROM p UNION ALL SELECT 'odd', 'boolean_text', avg(regexp_matches(odd, '{_FLAG}')::INT) FROM p UNION ALL SELECT 'html', 'url', avg(regexp_matches(html, '{_URL}')::INT) FROM p)
SELECT name, CASE WHEN c >= 0.85 THEN t END AS semantic_type, CASE WHEN c >= 0.85 THEN round(c, 3) END AS semantic_confidence FROM r""")
def profile_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    flag, odd = F.when(k % 7 == 0, "maybe").when(k % 2 == 0, "yes").otherwise("no"), F.when(k % 5 == 0, "maybe").otherwise("no")
    return prof.semantic_types(table(spark, sf_dir, "pages").select("url", flag.alias("flag"), odd.alias("odd"), "html"))


@query("SELECT event_type AS value FROM (SELECT event_type, min(event_id) AS f FROM events GROUP BY 1 ORDER BY 2 LIMIT 10)")
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.first_samples(table(spark, sf_dir, "events"), "event_type", "event_id")


#: Facts that the quality queries rest on, one row a column, from SQL alone.
_NUMBERLIKE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{4}"


def _column_facts(name: str, columns: dict[str, str]) -> str:
    """SQL of (name, type, n, nulls, card, fit) of each column."""
    fit = lambda c, k: f"avg(CASE WHEN regexp_matches({c}, '{_NUMBERLIKE}') THEN 0.0 ELSE 1.0 END)" if k == "string" else "1.0"
    return " UNION ALL ".join(f"SELECT '{name}' AS dataset, '{c}' AS name, '{k}' AS type, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS card, {fit(c, k)} AS fit FROM {name}" for c, k in columns.items())


_UNIQUE = "(nulls = 0 AND n > 0 AND card = n AND type IN ('integer', 'string'))"


def _facts_sql(name: str, columns: dict[str, str]) -> str:
    return (
        f"WITH c AS ({_column_facts(name, columns)}), f AS (SELECT count(*) AS k, avg(round(100.0 * nulls / n, 1)) AS null_pct, avg(fit) AS fit, count(*) FILTER (WHERE card <= 1) AS constant, bool_or({_UNIQUE}) AS has_pk,"
        " count(*) FILTER (WHERE type IN ('string', 'integer', 'float')) AS candidates FROM c) "
    )


def _axes_sql(of: str = "f") -> str:
    return (
        f"SELECT 'null_health' AS axis, 100 - null_pct AS score FROM {of} UNION ALL SELECT 'type_confidence', 100 * fit FROM {of} UNION ALL SELECT 'cardinality_health', greatest(0, 100 - 500.0 * constant / k) FROM {of}"
        f" UNION ALL SELECT 'pk_presence', CASE WHEN has_pk THEN 100 ELSE 50 END FROM {of} UNION ALL SELECT 'semantic_coverage', CASE WHEN candidates > 0 THEN 0 ELSE 100 END FROM {of}"
    )


@query(f"SELECT name, round(0.6 + CASE WHEN type = 'integer' THEN 0.15 ELSE 0 END + 0.1 + 0.05, 2)::DOUBLE AS confidence FROM ({_column_facts('orders', _PROFILED['orders'])} UNION ALL {_column_facts('orders', {'o_orderkey || o_orderstatus': 'string'}).replace(chr(39) + 'o_orderkey || o_orderstatus' + chr(39), chr(39) + 'code' + chr(39))}) WHERE {_UNIQUE}")
def suggest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return relations.suggest_keys(prof.profile(o.withColumn("code", F.concat(F.col("o_orderkey").cast("string"), "o_orderstatus"))))


@query("SELECT * FROM (SELECT 'o_custkey' AS \"column\", 'c_custkey' AS key, count(*) AS n_distinct, count(c_custkey) AS n_found, round(count(c_custkey) / count(*), 4) AS ratio FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'o_orderkey', 'c_custkey', count(*), count(c_custkey), round(count(c_custkey) / count(*), 4) FROM orders LEFT JOIN customer ON o_orderkey = c_custkey) WHERE ratio >= 0.95")
def suggest_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.suggest_joins(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey"), ("o_orderkey", "c_custkey")])


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("region", "nation", "customer", "supplier"):
        df = table(spark, sf_dir, name)
        values = prof.top_values(df, 50).groupBy("name").agg(F.sort_array(F.collect_list("value")).alias("values"))
        one = prof.profile(df).join(values, "name").withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return relations.worked_out(out)


_STAR = {
    "region": {"r_regionkey": "integer", "r_name": "string"}, "nation": {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"}, "customer": _PROFILED["customer"],
    "supplier": {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "float"},
}
_STAR_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, '{c}' AS name, '{k}' AS type, (SELECT count(DISTINCT {c}) FROM {t}) AS card, (SELECT count(DISTINCT {c}) = count(*) FROM {t}) AND '{k}' IN ('integer', 'string') AS pk, (SELECT list(v) FROM (SELECT {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50)) AS vals"
    for t, columns in _STAR.items() for c, k in columns.items()
)
_JAC = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"
_SIMILAR = f"""WITH p AS (SELECT *, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS parts FROM ({_STAR_SQL})),
j AS (SELECT a.dataset AS dataset_a, a.name AS column_a, b.dataset AS dataset_b, b.name AS column_b, {_JAC.format("a.parts", "b.parts")} AS nj, a.type = b.type AS same,
  round(0.45 * {_JAC.format("a.parts", "b.parts")} + 0.3 * {_JAC.format("a.vals", "b.vals")} + 0.15 * (a.type = b.type)::INT + 0.1 * least(a.card, b.card) / greatest(a.card, b.card), 4) AS score FROM p a JOIN p b ON a.dataset < b.dataset)
SELECT dataset_a, column_a, dataset_b, column_b, score, CASE WHEN score >= 0.85 AND same THEN 'near_duplicate' WHEN score >= 0.7 AND round(nj, 4) < 0.5 THEN 'naming_drift' WHEN score >= 0.7 AND round(nj, 4) >= 0.7 THEN 'parallel_definition' ELSE 'overlapping_topic' END AS verdict
FROM j WHERE score >= 0.3 ORDER BY score DESC, 1, 2, 3, 4 LIMIT 50"""


@query(_SIMILAR)
def similar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.similar_columns(_star(spark, sf_dir), 0.3)


_EDGES = f"p AS (SELECT dataset, regexp_replace(name, '^[a-z]_', '') AS name, pk FROM ({_STAR_SQL})), e AS (SELECT a.dataset AS from_dataset, a.name AS from_column, b.dataset AS to_dataset, b.name AS to_column FROM p a JOIN p b ON b.pk AND a.dataset <> b.dataset AND a.name = b.name)"


@query(f"WITH {_EDGES} SELECT * FROM e")
def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _star(spark, sf_dir).withColumn("name", F.regexp_replace("name", "^[a-z]_", ""))
    return relations.foreign_keys(p)


@query(f"WITH {_EDGES} SELECT CASE WHEN bool_or(pk) OR (SELECT count(*) FROM e WHERE to_dataset = 'nation' AND to_column = 'nationkey') > 0 THEN 'unsafe' ELSE 'safe' END AS verdict, (SELECT count(*) FROM e WHERE to_dataset = 'nation' AND to_column = 'nationkey') AS referenced FROM p WHERE dataset = 'nation' AND name = 'nationkey'")
def column_drop_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _star(spark, sf_dir).withColumn("name", F.regexp_replace("name", "^[a-z]_", ""))
    edges = relations.foreign_keys(p)
    verdict = relations.drop_check(p, edges, "nation", "nationkey")["verdict"]
    return edges.where("to_dataset = 'nation' AND to_column = 'nationkey'").agg(F.lit(verdict).alias("verdict"), F.count(F.lit(1)).alias("referenced"))


_KIND = "CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN column_type = 'DOUBLE' THEN 'float' ELSE 'string' END"


@query(f"""WITH a AS (SELECT column_name AS name, {_KIND} AS t FROM (DESCRIBE customer)), b AS (SELECT column_name AS name, {_KIND} AS t FROM (DESCRIBE SELECT * EXCLUDE (c_acctbal) REPLACE (c_nationkey::VARCHAR AS c_nationkey), 1 AS extra FROM customer))
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' ELSE 'type' END AS change, a.t AS type_before, b.t AS type_after FROM a FULL JOIN b ON a.name = b.name WHERE a.t IS DISTINCT FROM b.t""")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer")
    b = a.drop("c_acctbal").withColumn("c_nationkey", F.col("c_nationkey").cast("string")).withColumn("extra", F.lit(1))
    return health.schema_drift(prof.profile(a, exact=False), prof.profile(b, exact=False)).select("name", "change", "type_before", "type_after")


_HOT = "SELECT name, round(0.3 * card + 0.3 * outlier, 4) AS score FROM ("
_HOT += " UNION ALL ".join(
    f"SELECT '{c}' AS name, CASE WHEN count(DISTINCT {c}) <= 1 THEN 0.8 ELSE 0.2 * count(DISTINCT {c}) / count(*) END AS card, least((max({c}) - min({c})) / abs(avg({c})) / 5, 1.0) AS outlier FROM orders" for c in ("o_custkey", "o_totalprice")
)


@query(_HOT + ")")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.hotspots(prof.profile(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"))).select("name", "score")


@query(_facts_sql("orders", _PROFILED["orders"]) + "SELECT round(0.3 * (1 - null_pct / 100) + 0.3 * fit + 0.1 * ((1 - constant / k) + CASE WHEN has_pk THEN 1 ELSE 0.5 END + 0 + 1), 4)::DOUBLE AS score, CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.7 THEN 'C' WHEN score >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM f")
def dataset_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.dataset_health(prof.profile(table(spark, sf_dir, "orders"))).select("score", "grade")


@query(_facts_sql("part", _PROFILED["part"]) + f"SELECT axis, round(score, 2)::DOUBLE AS score FROM ({_axes_sql()} UNION ALL SELECT 'schema_stability', 100)")
def health_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.radar(prof.profile(table(spark, sf_dir, "part")), drift_free=True)


_RADARS = _facts_sql("orders", _PROFILED["orders"]) + ", " + _facts_sql("orders", {c: k for c, k in _PROFILED["orders"].items() if c != "o_orderkey"}).removeprefix("WITH ").replace("c AS (", "d AS (", 1).replace("f AS (", "g AS (", 1).replace("FROM c)", "FROM d)")
_RADARS += f"SELECT a.axis, a.score::DOUBLE AS baseline, b.score::DOUBLE AS current, round(b.score - a.score, 2)::DOUBLE AS delta, CASE WHEN delta <= -3 THEN 'regression' WHEN delta >= 3 THEN 'improvement' ELSE 'stable' END AS change FROM ({_axes_sql('f')}) a JOIN ({_axes_sql('g')}) b ON a.axis = b.axis"


@query(_RADARS)
def health_radar_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return health.diff_radar(health.radar(prof.profile(o)), health.radar(prof.profile(o.drop("o_orderkey"))))


_TERMS = ["the", "licensed", "with"]
_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(sorted(_TERMS)))
_BM = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * dl / avgdl))" for i in range(3))


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), c AS (SELECT doc_id, len(t) AS dl, {_TF} FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(3))} FROM c)
SELECT doc_id, round({_BM}, 6) AS score FROM c, s WHERE tf0 + tf1 + tf2 > 0 ORDER BY 2 DESC, 1 LIMIT 50""")
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), " ".join(_TERMS), "doc_id", "text", 50)


@query()
def search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _star(spark, sf_dir).withColumn("summary", F.concat_ws(" ", "type", "name"))
    return search.search_columns(p.select("name", "type", "summary", "values"), "market segment building")


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 4) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return search.cosine_top(e, q, "vec_id", "embedding", 20).withColumn("score", F.round("score", 4))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(cosine(F.col("a.embedding"), F.col("b.embedding")), 4).alias("cos"))


#: All kinds but cards, which have a query of their own, and those whose pattern looks ahead, which DuckDB cannot.
_PLAIN_KINDS = [(k, p) for k, p in SECRETS if k != "credit_card" and "(?!" not in p]
_REDACTED = "text"
for _kind, _pattern in _PLAIN_KINDS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '[REDACTED:{_kind}]', 'g')"


@query(f"SELECT doc_id, md5({_REDACTED}) AS digest FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redaction.redacted(F.col("text"), [k for k, _ in _PLAIN_KINDS])).alias("digest"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS matches, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS texts FROM documents" for k, p in _PLAIN_KINDS))
def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.redaction_counts(table(spark, sf_dir, "documents"), "text", [k for k, _ in _PLAIN_KINDS])


_DIGITS_OF = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(reverse({_DIGITS_OF}).split(''), lambda d, j: CASE WHEN j % 2 = 1 THEN d::INT WHEN d::INT < 5 THEN 2 * d::INT ELSE 2 * d::INT - 9 END)) % 10 = 0"


@query(f"""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '{redaction.CARD}', '\x01\\0\x01', 'g'), '\x01') AS parts FROM documents)
SELECT doc_id, md5(list_aggregate(list_transform(parts, lambda x, i: CASE WHEN i % 2 = 0 AND {_LUHN} THEN '[REDACTED:credit_card]' ELSE x END), 'string_agg', '')) AS digest FROM d""")
def redact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.redact_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), kinds=["credit_card"]).select("doc_id", F.md5("text").alias("digest"))


#: A query of each customer and order, with literals of its own.
_QUERY_C = ("SELECT c_name, c_acctbal FROM customer WHERE c_custkey = ", "c_custkey", "c_nationkey + 1", "c_acctbal")
_QUERY_O = ("select o_totalprice from orders join customer on o_custkey = c_custkey where c_mktsegment = 'X' and o_orderkey > ", "o_orderkey", "o_custkey % 5", "o_totalprice")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(q), F.col(k).cast("string")).alias("query"), F.expr(n).cast("long").alias("calls"), F.col(s).cast("double").alias("total_time")) for t, (q, k, n, s) in (("customer", _QUERY_C), ("orders", _QUERY_O))]
    unknown = spark.createDataFrame([("SELECT x FROM unknown_table", 4, 1.0)], "query string, calls long, total_time double")
    return parts[0].unionByName(parts[1]).unionByName(unknown).withColumn("seen", F.lit("2024-01-01").cast("timestamp"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, c) for t in ("customer", "orders") for c in table(spark, sf_dir, t).columns], "dataset string, name string")


_USES = [("customer", "", "co"), ("customer", "c_name", "c"), ("customer", "c_acctbal", "c"), ("customer", "c_custkey", "co"), ("customer", "c_mktsegment", "o"), ("orders", "", "o"), ("orders", "o_totalprice", "o"), ("orders", "o_custkey", "o"), ("orders", "o_orderkey", "o")]
_USES_SQL = "WITH c AS (SELECT sum(c_nationkey + 1) AS n, sum(c_acctbal) AS t FROM customer), o AS (SELECT sum(o_custkey % 5) AS n, sum(o_totalprice) AS t FROM orders) "
_USES_SQL += " UNION ALL ".join(f"SELECT '{d}' AS dataset, '{c}' AS \"column\", ({' + '.join(f'{x}.n' for x in of)})::BIGINT AS calls, round({' + '.join(f'{x}.t' for x in of)}, 2) AS total_time FROM {', '.join(of)}" for d, c, of in _USES)


@query(_USES_SQL)
def workload_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.rollup(_log(spark, sf_dir), _columns(spark, sf_dir)).groupBy("dataset", "column").agg(F.sum("calls").alias("calls"), F.round(F.sum("total_time"), 2).alias("total_time"))


@query(f"SELECT dataset, name, 'zero_hits' AS state FROM ({_column_facts('customer', _PROFILED['customer'])} UNION ALL {_column_facts('orders', _PROFILED['orders'])}) WHERE NOT {_UNIQUE} AND name NOT IN ({', '.join(repr(c) for _, c, _ in _USES if c)})")
def unused_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = None
    for t in ("customer", "orders"):
        one = prof.profile(table(spark, sf_dir, t)).withColumn("dataset", F.lit(t))
        p = one if p is None else p.unionByName(one)
    return workload.unused_columns(p, workload.rollup(_log(spark, sf_dir), _columns(spark, sf_dir)), F.lit("2020-01-01").cast("timestamp"))


@query("SELECT o_orderkey, 'sha256:' || sha256(o_orderstatus || o_orderkey)[:32] AS fp FROM orders")
def fingerprint_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", fingerprint(F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))).alias("fp"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 4) AS jaccard FROM (SELECT p_partkey, regexp_extract_all(lower(p_type), '[a-z0-9]+') AS w FROM part) a JOIN (SELECT p_partkey, regexp_extract_all(lower(p_type), '[a-z0-9]+') AS w FROM part) b ON b.p_partkey = a.p_partkey + 1")
def jaccard_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", name_parts(F.col("p_type")).alias("w"))
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.round(jaccard(F.col("a.w"), F.col("b.w")), 4).alias("jaccard"))


@query("SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING) AS recent FROM orders")
def window_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum("o_totalprice").over(w).alias("recent"))


@query(
    "SELECT 'p_size' AS name, 'integer' AS type, count(DISTINCT p_size) AS cardinality, min(p_size)::VARCHAR AS min, max(p_size)::VARCHAR AS max FROM part UNION ALL SELECT 'p_brand', 'string', count(DISTINCT p_brand), min(p_brand), max(p_brand) FROM part"
)
def describe_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_size")
    return describe.describe_dataset(prof.profile(p), prof.top_values(p, describe.PREVIEW), ["p_size", "p_brand"]).select("name", "type", "cardinality", "min", "max")


@query("SELECT c_mktsegment AS value, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM customer), 2) AS pct FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def describe_column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.value_distribution(table(spark, sf_dir, "customer"), "c_mktsegment", 20)


@query("""WITH b AS (SELECT min(p_size) lo, max(p_size) hi FROM part), s AS (SELECT unnest(range(10)) AS bin), c AS (SELECT least(floor((p_size - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n FROM part, b GROUP BY 1)
SELECT s.bin::INT AS bin, coalesce(n, 0) AS count FROM s LEFT JOIN c ON c.bin = s.bin""")
def describe_column_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.histogram(table(spark, sf_dir, "part"), "p_size", 10).select("bin", "count")


@query("SELECT l_linenumber::VARCHAR AS value, count(*) AS count FROM lineitem GROUP BY 1")
def profile_value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.value_index(table(spark, sf_dir, "lineitem"), "l_linenumber").select(F.explode("value_index").alias("value", "count"))


@query("SELECT '-1' AS value, 2::BIGINT AS columns, (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') + count(*) FILTER (WHERE o_orderpriority LIKE '1%') FROM orders)::BIGINT AS count")
def profile_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = F.when(F.col("o_orderstatus") == "F", "-1").otherwise(F.col("o_orderstatus"))
    b = F.when(F.col("o_orderpriority").startswith("1"), "-1").otherwise(F.col("o_orderpriority"))
    return prof.learned_null_tokens(o.select(a.alias("a"), b.alias("b")))


@query("SELECT strftime(o_orderdate, '%Y') AS bucket, count(*) AS count FROM orders GROUP BY 1")
def dist_datetime_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.datetime_distribution(table(spark, sf_dir, "orders"), "o_orderdate", "year")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.cube(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [{"column": "*", "function": "count", "alias": "n"}], rollup=True)


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.windowed(e, "ts", ["event_type"], "1 hour", "2 hours", F.count(F.lit(1)).alias("n"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM s GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


@query(f"WITH RECURSIVE {_EDGES}, r(dataset, col, depth) AS (SELECT 'nation', 'nationkey', 0 UNION SELECT e.from_dataset, e.from_column, r.depth + 1 FROM r JOIN e ON e.to_dataset = r.dataset AND e.to_column = r.col WHERE r.depth < 3) SELECT dataset, col AS \"column\", min(depth) AS depth FROM r GROUP BY 1, 2 HAVING min(depth) > 0")
def schema_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _star(spark, sf_dir).withColumn("name", F.regexp_replace("name", "^[a-z]_", ""))
    return relations.schema_impact(relations.foreign_keys(p), "nation", "nationkey")[0]


@query("SELECT 'SELECT a FROM t WHERE b = ? AND c > ?' AS masked, count(*) AS n FROM customer")
def sql_text_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.lit("SELECT a FROM t WHERE b = '"), F.col("c_name"), F.lit("' AND c > "), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select(redaction.sql_text(q).alias("masked")).groupBy("masked").agg(F.count(F.lit(1)).alias("n"))


@query(_facts_sql("customer", _PROFILED["customer"]) + f"SELECT round(avg(score), 1)::DOUBLE AS composite, CASE WHEN round(avg(score), 1) >= 90 THEN 'A' WHEN round(avg(score), 1) >= 80 THEN 'B' WHEN round(avg(score), 1) >= 70 THEN 'C' WHEN round(avg(score), 1) >= 60 THEN 'D' ELSE 'F' END AS grade FROM ({_axes_sql()})")
def health_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.composite(health.radar(prof.profile(table(spark, sf_dir, "customer"))))


@query("SELECT 'client [REDACTED:ipv4_address] asked' AS masked, count(*) AS n FROM customer")
def trace_text_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.concat(F.lit("client 10."), (F.col("c_custkey") % 250).cast("string"), F.lit("."), F.col("c_nationkey").cast("string"), F.lit(".7 asked"))
    return table(spark, sf_dir, "customer").select(redaction.trace_text(host).alias("masked")).groupBy("masked").agg(F.count(F.lit(1)).alias("n"))


FLAGSHIP = [*_ALL, {"column": "l_extendedprice", "function": "avg", "alias": "avg_price"}]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered, grouped and held-to aggregates of lineitem."""
    return agg.aggregate(
        table(spark, sf_dir, "lineitem"), FLAGSHIP, ["l_returnflag", "l_linestatus"], [{"column": "l_shipdate", "op": "between", "value": ["1993-01-01", "1998-09-02"]}], [{"column": "n", "op": "gte", "value": 1}], "n"
    )


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
