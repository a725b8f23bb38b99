"""The workspace: files in, every operator by dataset name."""

import pytest
from pyspark.sql import functions as F

from lattica.errors import RequestError
from lattica.workspace import Workspace

CUSTOMERS = "customer_id,email,city\n" + "".join(f"{k},p{k}@example.com,{'Oslo' if k % 2 else 'Rome'}\n" for k in range(1, 21))
ORDERS = "order_id,customer_id,amount,placed\n" + "".join(f"{100 + k},{1 + k % 20},{10.5 * k},2024-0{1 + k % 3}-15\n" for k in range(30))
LOG = 'query,calls,total_time\n"SELECT email FROM customers WHERE customer_id = 7",3,1.5\n"SELECT amount FROM orders WHERE customer_id = 8",2,0.5\n"SELECT x FROM elsewhere WHERE y = \'a@b.com\'",4,1\n'


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name, text in (("customers.csv", CUSTOMERS), ("orders.csv", ORDERS), ("log.csv", LOG)):
        (d / name).write_text(text)
    return d


@pytest.fixture(scope="module")
def space(spark, files, tmp_path_factory):
    w = Workspace(spark, str(tmp_path_factory.mktemp("space")))
    w.index_local(str(files / "customers.csv"))
    w.index_local(str(files / "orders.csv"), depth="deep")
    return w


def test_datasets_are_listed_and_described(space):
    assert [r["dataset"] for r in space.list_datasets().orderBy("dataset").collect()] == ["customers", "orders"]
    rows = space.describe_dataset("customers").collect()
    assert [r["name"] for r in rows] == ["customer_id", "email", "city"]
    assert [tuple(v) for v in rows[2]["top_values"]] == [("Oslo", 10), ("Rome", 10)]
    assert rows[0]["is_primary_key_candidate"] and "20 distinct" in rows[0]["summary"]
    assert [r["name"] for r in space.describe_dataset("customers", ["city"]).collect()] == ["city"]
    assert space.describe_dataset("customers", columns_offset=2).count() == 1
    with pytest.raises(RequestError):
        space.describe_dataset("customers", ["nothing"])


def test_a_column_is_described(space):
    d = space.describe_column("orders", "amount", histogram_bins=5)
    assert d["histogram"].agg(F.sum("count")).first()[0] == 30
    assert [r["pct"] for r in space.describe_column("customers", "city")["values"].collect()] == [50.0, 50.0]
    masked = space.describe_column("customers", "email", 3)["values"].collect()
    assert {r["value"] for r in masked} == {"[REDACTED:email]"}


def test_rows_groups_and_joins(space):
    got = space.get_rows("orders", [{"column": "amount", "op": "gt", "value": 300}], ["order_id"]).collect()
    assert [tuple(r) for r in got] == [(30, 129)]
    assert space.total_matching("orders", [{"column": "amount", "op": "lte", "value": 300}]) == 29
    counted = space.aggregate("customers", [{"column": "*", "function": "count", "alias": "n"}], ["city"], order_by="city", order_dir="asc")
    assert [tuple(r) for r in counted.collect()] == [("Oslo", 10), ("Rome", 10)]
    hits = space.cache.hits
    space.aggregate("customers", [{"column": "*", "function": "count", "alias": "n"}], ["city"], order_by="city", order_dir="asc")
    assert space.cache.hits == hits + 1
    assert space.join_datasets("orders", "customers", "customer_id", "customer_id", limit=500).where("email = '[REDACTED:email]'").count() == 30
    assert space.run_sql("SELECT count(*) AS n FROM rows JOIN orders USING (customer_id)", ["customers", "orders"])["rows"].first()["n"] == 30
    few = space.run_sql("SELECT * FROM orders", ["orders"], limit=7)
    assert (few["returned"], few["truncated"], few["rows"].count()) == (7, True, 7) and not space.run_sql("SELECT 1", ["orders"])["truncated"]
    with pytest.raises(RequestError, match="TIMEOUT"):
        space.run_sql("SELECT count(*) FROM range(100000000000) a WHERE sqrt(id) < 0", ["orders"], seconds=0.5)
    assert space.total_groups("orders", [{"column": "*", "function": "count"}], ["customer_id"]) == space._columns("orders").select("customer_id").distinct().count()
    assert space.total_joined("orders", "customers", "customer_id", "customer_id") == 30
    assert space.within_budget(space._columns("orders"), 50)["truncated"]
    assert space.search_verdict("customers", "zzz")["state"] == "absent"
    assert space.sample_rows("orders", 2, "tail", ["order_id"]).collect()[0][0] == 129
    assert space.get_distribution("orders", "placed").agg(F.sum("count")).first()[0] == 30
    assert "strength" in space.get_correlations("orders", 0.0).columns


def test_search_prefers_the_named_column(space):
    assert space.search_data("customers", "email").first()["name"] == "email"
    assert space.search_data("customers", "Rome", "values").first()["name"] == "city"
    assert space.search_data("customers", "email", semantic=True).first()["name"] == "email"
    assert space.check_embedding_drift().where("alarm").count() == 0
    assert space.tune_weights("customers", {"name_exact": 33})["name_exact"] == 33
    assert space.tune_weights("orders")["name_exact"] == 20 and space.tune_weights("customers", reset=True)["name_exact"] == 20
    with pytest.raises(ValueError):
        space.tune_weights(set_weights={"nothing": 1})


def test_keys_joins_and_impact(space):
    assert space.suggest_keys("customers").first()["name"] == "customer_id"
    assert ("customers", "customer_id", "customer_id") in {(r["dataset"], r["column"], r["key"]) for r in space.suggest_joins("orders").collect()}
    found = space.find_similar_columns()
    assert ["customers.customer_id", "orders.customer_id"] in found["clusters"]
    impact = space.get_schema_impact("customers", "customer_id")
    assert [(r["dataset"], r["column"], r["depth"]) for r in impact["impacted"].collect()] == [("orders", "customer_id", 1)] and 0 < impact["blast"] <= 1
    assert space.check_column_drop_safe("customers", "customer_id")["verdict"] == "unsafe"
    assert space.check_column_drop_safe("customers", "city")["verdict"] == "safe"


def test_quality_and_drift(space):
    assert space.get_dataset_health("customers").first()["grade"] in "ABC"
    radar = space.data_health_radar("orders")
    assert space.diff_data_health_radar(radar, radar).where("change <> 'stable'").count() == 0
    assert space.get_schema_drift("customers", "customers")["verdict"] == "identical"
    assert space.get_schema_drift("customers", "orders")["verdict"] == "breaking"
    assert space.get_data_hotspots("orders").count() == 4
    assert space.summarize_dataset("orders")["domain"] == "financial"


def test_the_query_log_is_kept_beside_the_datasets(space, files):
    with pytest.raises(RequestError):
        space.find_unused_columns("customers")
    space.ingest_sql_log(str(files / "log.csv"))
    space.ingest_sql_log(str(files / "log.csv"))
    unused = {r["name"] for r in space.find_unused_columns("customers").collect()}
    assert "city" in unused and "email" not in unused
    assert space.check_column_drop_safe("customers", "email")["blockers"]
    assert space._calls("customers", "email", 30) == 6
    assert {r["pattern"]: r["count"] for r in space.get_redaction_log().collect()} == {"email": 2}
    assert space.data_health_radar("customers").where("axis = 'runtime_coverage'").count() == 1
    space.index_local(str(files / "customers.csv"), incremental=False)
    assert space._calls("customers", "email", 30) == 6


def test_a_source_is_read_again_only_when_it_changed(space, files):
    path = files / "cities.csv"
    path.write_text("id,city\n1,Oslo\n")
    first = space.index_local(str(path))
    assert space.index_local(str(path)).get("skipped")
    path.write_text("id,city\n1,Oslo\n2,Rome\n")
    again = space.index_local(str(path))
    assert (first["rows"], again["rows"]) == (1, 2) and not again.get("skipped")
    assert space.validate_index("cities")["status"] == "ok" and space.get_dataset_history("cities").count() == 2
    assert space.delete_dataset("cities")["bytes_freed"] > 0
    with pytest.raises(RequestError):
        space.describe_dataset("cities")
    with pytest.raises(RequestError):
        space.index_local(str(path.with_name("gone.csv")))


def test_repositories_are_indexed_and_listed(space, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.jsonl").write_text('{"z": 1}\n{"z": 2}\n')
    fetched = []

    def fetch(path):
        fetched.append(path)
        return str(tmp_path / path.rsplit("/", 1)[-1])

    tree = [("data/a.csv", 10), ("b.jsonl", 20), ("readme.md", 5), ("big.csv", 10**9)]
    out = space.index_repo("Some/Repo", "abc", tree, fetch)
    assert out["datasets"] == ["some_repo.data_a", "some_repo.b"] and sorted(out["left"]) == [("big.csv", "size"), ("readme.md", "suffix")]
    assert [(r["repo"], r["head"], sorted(r["datasets"]), r["rows"]) for r in space.list_repos()] == [("Some/Repo", "abc", ["some_repo.b", "some_repo.data_a"], 3)]
    assert space.index_repo("Some/Repo", "abc", tree, fetch)["skipped"] and len(fetched) == 2
    assert "skipped" not in space.index_repo("Some/Repo", "def", tree, fetch)
