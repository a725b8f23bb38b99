import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.errors import RequestError
from lattica.functions.predicates import where
from lattica.operators import aggregate as agg
from lattica.operators import distribution as dist
from lattica.operators import join as joins
from lattica.operators import rows
from lattica.operators import sql as gate
from lattica.operators.sql import collect_within
from lattica.plans import catalog


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "Ann_%", 30, 1.5), (2, "Bob", None, 2.5), (3, None, 25, float("nan")), (4, "ann", 30, None)]
    return spark.createDataFrame(data, "id long, name string, age int, score double")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        (("age", "eq", "30"), [1, 4]),
        (("age", "eq", "abc"), []),
        (("age", "neq", 30), [3]),
        (("age", "gte", 30), [1, 4]),
        (("name", "contains", "ANN"), [1, 4]),
        (("name", "contains", "_%"), [1]),
        (("name", "in", ["Bob", "ann"]), [2, 4]),
        (("name", "is_null", True), [3]),
        (("name", "is_null", False), [1, 2, 4]),
        (("age", "between", [25, 29]), [3]),
    ],
)
def test_filters(people, spec, want):
    assert ids(where(people, [dict(zip(("column", "op", "value"), spec))])) == want


@pytest.mark.parametrize(
    ("spec", "code"),
    [
        ({"column": "no", "op": "eq", "value": 1}, "INVALID_COLUMN"),
        ({"column": "age", "op": "like", "value": 1}, "INVALID_FILTER"),
        ({"column": "age", "op": "gt", "value": "abc"}, "INVALID_FILTER"),
        ({"column": "age", "op": "in", "value": []}, "INVALID_FILTER"),
        ({"column": "age", "op": "between", "value": [1]}, "INVALID_FILTER"),
        ({"column": "age", "op": "eq"}, "INVALID_FILTER"),
    ],
)
def test_bad_filters(people, spec, code):
    with pytest.raises(RequestError) as e:
        where(people, [spec])
    assert e.value.code == code


def test_rows_page_and_errors(people):
    page = rows.get_rows(people, order_by="age", order_dir="desc", limit=2, offset=1, columns=["ds::id#column"], ties=["id"])
    assert [r["id"] for r in page.collect()] == [4, 3]
    with pytest.raises(RequestError):
        rows.get_rows(people, limit=501)
    with pytest.raises(RequestError):
        rows.get_rows(people, order_by="nope")


def test_having_on_an_alias_that_is_a_column(spark):
    df = spark.createDataFrame([(g, 1) for g in "aaaaabbccccccccd"], "g string, n int")
    out = agg.groups_of(df, [{"column": "*", "function": "count", "alias": "n"}], ["g"], having=[{"column": "n", "op": "gt", "value": 2}])
    assert sorted(map(tuple, out.collect())) == [("a", 5), ("c", 8)]


def test_aggregate_alias_like_group(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2)], "g string, v int")
    out = agg.groups_of(df, [{"column": "v", "function": "median", "alias": "v"}], ["g"])
    assert [tuple(r) for r in out.collect()] == [("x", 1.5)]
    with pytest.raises(RequestError):
        agg.groups_of(df, [{"column": "*", "function": "sum"}])
    with pytest.raises(RequestError):
        agg.aggregate(df, [{"column": "v", "function": "sum"}], order_by="nope")


def test_null_is_a_group(people):
    out = agg.groups_of(people, [{"column": "*", "function": "count"}], ["age"])
    assert {r["age"]: r["count_all"] for r in out.collect()} == {30: 2, None: 1, 25: 1}


def test_sampled_is_exact_for_few_rows(spark):
    r = agg.sampled(spark.range(100).withColumn("v", F.when(F.col("id") % 2 == 0, F.col("id"))), "v").first()
    assert (r["rows"], r["sum"], r["avg_low"] == r["avg_high"]) == (50, 2450.0, True)


def test_filter_stage_of_left_join(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    only = [{"column": "v", "op": "eq", "value": "x"}]
    post = joins.join(a, b, "k", "k", "left", filters_b=only)
    pre = joins.join(a, b, "k", "k", "left", filters_b=only, filter_stage="pre")
    assert post.columns == ["k", "k__b", "v"]
    assert sorted(map(tuple, post.collect()), key=str) == [(1, 1, "x")]
    assert sorted(map(tuple, pre.collect()), key=str) == [(1, 1, "x"), (2, None, None), (None, None, None)]


def test_row_ids_are_gapless(spark):
    out = rows.with_row_ids(spark.range(0, 1000, 1, 7))
    assert [tuple(r) for r in out.orderBy("_row_id").select("id", "_row_id").collect()] == [(i, i + 1) for i in range(1000)]


def test_seeded_sample_does_not_depend_on_layout(spark):
    df = rows.with_row_ids(spark.range(200))
    a = rows.sample_rows(df, 10, "random", seed=3).collect()
    assert a == rows.sample_rows(df.repartition(5), 10, "random", seed=3).collect()


def test_numeric_distribution_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,), (float("nan"),)], "v double")
    out = [r["count"] for r in dist.numeric_distribution(df, "v", 4).orderBy("bin").collect()]
    assert out == [1, 0, 1, 1]
    same = dist.numeric_distribution(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4).collect()
    assert [r["count"] for r in same] == [2]
    assert dist.numeric_distribution(df.limit(0), "v", 4).collect() == []


def test_spearman_uses_average_ranks(spark):
    df = spark.createDataFrame([(x // 3, (x // 3) ** 3) for x in range(60)], "a long, b long")
    r = dist.correlations(df, method="spearman").first()
    assert (r["r"], r["strength"], r["direction"]) == (1.0, "very strong", "positive")


@pytest.mark.parametrize("sql", ["DROP TABLE rows", "INSERT INTO rows VALUES (1)", "SELECT 1; SELECT 2", "CREATE TABLE x AS SELECT 1", "not sql", "SET a = 1"])
def test_gate_refuses(spark, sql):
    with pytest.raises(RequestError):
        gate.run_sql(spark, sql, {"t": spark.range(3)})


REFUSED = [
    "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM text.`/etc/hosts`", "SELECT 1 FROM t WHERE id IN (SELECT 1 FROM parquet.`/x`)", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT reflect('java.lang.System', 'currentTimeMillis') FROM t", "SELECT * FROM other", "WITH u AS (SELECT * FROM hidden) SELECT * FROM u", "SELECT (SELECT max(id) FROM hidden) FROM t", "SELECT * FROM IDENTIFIER('hidden')",
    "SELECT TRANSFORM(id) USING 'cat' FROM t", "SELECT input_file_name() FROM t", "SELECT * FROM t, LATERAL (SELECT * FROM hidden)", "SELECT * FROM default.t", "FROM t |> UNION ALL TABLE hidden", "SELECT try_reflect('a', 'b')",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_gate_reads_its_tables_alone(spark, sql):
    spark.range(1).createOrReplaceTempView("hidden")
    with pytest.raises(RequestError, match="FORBIDDEN_SQL|INVALID_SQL"):
        gate.run_sql(spark, sql, {"t": spark.range(3)}).collect()


def test_gate_keeps_names_apart(spark):
    spark.range(7).createOrReplaceTempView("t")
    out = gate.run_sql(spark, "SELECT 't.rows' AS a, \"x t.rows\" AS b, count(*) AS n, (SELECT count(*) FROM `t`.rows) AS m /* t.rows */ FROM t.rows", {"t": spark.range(3)})
    again = gate.run_sql(spark, "WITH t2 AS (SELECT * FROM rows) SELECT count(*) AS n FROM t2 JOIN T USING (id)", {"t": spark.range(2)})
    assert tuple(out.first()) == ("t.rows", "x t.rows", 3, 3) and again.first()["n"] == 2
    assert spark.table("t").count() == 7
    assert [r["id"] for r in gate.run_sql(spark, "SELECT * FROM range(2) ORDER BY id", {"t": spark.range(3)}).collect()] == [0, 1]


def test_gate_lets_words_in_literals_pass(spark):
    out = gate.run_sql(spark, "SELECT 'DELETE; DROP' AS a, replace('x', 'x', 'y') AS b, count(*) AS n FROM t.rows", {"t": spark.range(3)})
    assert [tuple(r) for r in gate.collect_within(out, 60)] == [("DELETE; DROP", "y", 3)]


def test_medians_are_exact(spark):
    import random
    import statistics

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, rng.uniform(-5, 5), float(rng.randrange(4))])) for _ in range(3000)] + [("only", 1, None), ("one", 1, 7.5)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    got = {(r["g"], r["h"]): r for r in agg.groups_of(df, [{"column": "v", "function": "median", "alias": "m"}, {"column": "v", "function": "count_distinct", "alias": "d"}], ["g", "h"]).collect()}
    want = {}
    for g, h, v in rows:
        want.setdefault((g, h), []).extend([] if v is None else [v])
    assert set(got) == set(want)
    for k, values in want.items():
        assert got[k]["m"] == (pytest.approx(statistics.median(values)) if values else None) and got[k]["d"] == len(set(values))
    assert agg.groups_of(df, [{"column": "v", "function": "median"}]).first()[0] == pytest.approx(statistics.median(v for *_, v in rows if v is not None))
    assert agg.groups_of(df.limit(0), [{"column": "v", "function": "median"}]).first()[0] is None


def test_theta_join_counts_pairs_without_forming_them(spark, tmp_path):
    """40,000 parts of one brand and type make 800 million pairs; nulls and lone parts make none, and the gate still runs the join as written."""
    many = [(i, "Brand#1", "A", i % 20_000) for i in range(40_000)]
    odd = [(1, "Brand#2", "A", 5), (2, "Brand#2", "A", None), (3, None, "A", 6), (4, None, "A", 7), (5, "Brand#3", None, 1), (6, "Brand#3", None, 2), (7, "Brand#4", "A", 3), (8, "Brand#4", "A", 3), (9, "Brand#5", "B", -2), (10, "Brand#5", "B", 2**30), (11, "Brand#5", "B", 0), (12, "Brand#5", "C", 9)]
    spark.createDataFrame(many + odd, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.queries()["sql_theta_join"](spark, str(tmp_path))
    n = 20_000
    got = {r["p_brand"]: (r["pairs"], r["steps"]) for r in collect_within(df, 10)}
    assert got == {"Brand#1": (4 * n * (n - 1) // 2, 4 * (n - 1) * n * (n + 1) // 6), "Brand#5": (3, 2 + 2**30 + 2**30 + 2)}
    few = spark.createDataFrame(odd, "p_partkey long, p_brand string, p_type string, p_size int")
    joined = gate.run_sql(spark, catalog.oracle_sql()["sql_theta_join"], {"part": few})
    assert [tuple(r) for r in joined.collect()] == [("Brand#5", 3, 2 + 2**30 + 2**30 + 2)]


def test_seeded_sample_numbers_rows_by_key(spark, tmp_path):
    """150 customers in files of falling keys: the rows of the query's SQL, which numbers them by key."""
    for k in range(3):
        spark.range(101 - 50 * k, 151 - 50 * k, 1, 1).withColumnRenamed("id", "c_custkey").orderBy(F.desc("c_custkey")).write.mode("append").parquet(f"{tmp_path}/customer.parquet")
    got = catalog.queries()["sample_random_seeded"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["sample_random_seeded"]).fetchall()
    assert len(want) == 20 and sorted(map(tuple, got.collect())) == sorted(want)
