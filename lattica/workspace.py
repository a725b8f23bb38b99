"""All operators over datasets kept in one folder, addressed by the datasets' names."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import RequestError
from .functions.patterns import SECRETS
from .operators import aggregate as agg
from .operators import describe, distribution, guide, health, redaction, relations, rows, search, workload
from .operators import join as joins
from .operators import profile as prof
from .operators import sql as gate
from .sources import repositories
from .sources.files import read_file, read_sql_log
from .sources.store import ResultCache, Store

DEPTHS = {"shallow": 100_000, "standard": None, "deep": None}
#: Rows of a result that may be kept: the most that a page of groups, pairs or columns can hold.
MOST_KEPT = 1000
ROLLUP = "fingerprint string, dataset string, column string, source string, calls long, total_time double, seen timestamp"
REDACTIONS = "pattern string, count long, source string, seen timestamp"


class Workspace:
    """Datasets, the query log's rollup, weights and vectors under ``root``.  Tables come back as DataFrames, verdicts as dicts.

    What describes a dataset is read from its profile, one row a column; only
    rows, groups, joins and distributions read the dataset itself.  The query
    log's rollup lives beside the datasets, so indexing one again keeps it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.own = f"{self.store.root}/-workspace"  # no dataset's name can begin so
        self.store._fs.mkdirs(self.store._path(self.own))
        self.cache, self.times = ResultCache(), defaultdict(list)

    # Kept state: a small file that names the present version of each table.

    def _state(self) -> dict:
        return json.loads(self.store._text(f"{self.own}/state.json") or "{}")

    def _keep(self, key: str, value: Any) -> None:
        self.store.change(f"{self.own}/state.json", lambda old: json.dumps(json.loads(old or "{}") | {key: value}))

    def _kept_table(self, key: str, schema: str) -> DataFrame:
        path = self._state().get(key)
        return self.spark.read.parquet(path) if path else self.spark.createDataFrame([], schema)

    def _keep_table(self, key: str, df: DataFrame) -> None:
        path, before = f"{self.own}/{key}-{uuid.uuid4().hex}", self._state().get(key)
        df.write.parquet(path)
        self._keep(key, path)
        # The version before stays for those who read it; those before that go.
        fs, at = self.store._fs, self.store._path
        for s in fs.listStatus(at(self.own)):
            name = s.getPath().getName()
            if name.startswith(f"{key}-") and name not in (path.rsplit("/", 1)[-1], (before or "").rsplit("/", 1)[-1]):
                fs.delete(s.getPath(), True)

    def _timed(self, operator: str, make: Callable[[], Any]) -> Any:
        began = time.time()
        try:
            return make()
        finally:
            self.times[operator].append(1000 * (time.time() - began))

    def _cached(self, operator: str, dataset: str, arguments: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The same question to the same version of a dataset is answered once; answers of more than MOST_KEPT rows are not kept."""
        key = ResultCache.key(operator, self.store.manifest(dataset)["base"], arguments)
        kept = self.cache.get(key)
        if kept is None:
            df = make()
            kept = (df.schema, self._timed(operator, df.limit(MOST_KEPT + 1).collect))
            if len(kept[1]) > MOST_KEPT:
                return df
            self.cache.put(key, kept)
        return self.spark.createDataFrame(kept[1], kept[0])

    def _masked(self, df: DataFrame, redact: bool, patterns: list[str] | None, skip: list[str] | None = None) -> DataFrame:
        if not redact:
            return df
        good, bad = redaction.valid_patterns(patterns or [])
        if bad:
            raise RequestError("INVALID_PATTERN", ", ".join(bad))
        return redaction.redact_rows(df, skip, custom=good)

    def _table(self, dataset: str) -> DataFrame:
        return self.store.rows(dataset)

    def _columns(self, dataset: str) -> DataFrame:
        return self._table(dataset).drop("_row_id")

    # Datasets.

    def _digest(self, path: str) -> list:
        """Where, how long and how old every file of a source is: changes when it is written again."""
        p = self.store._path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            raise RequestError("FILE_NOT_FOUND", path)
        found, out = fs.listFiles(p, True), []
        while found.hasNext():
            s = found.next()
            out.append([s.getPath().toString(), s.getLen(), s.getModificationTime()])
        return sorted(out)

    def index_local(self, path: str, name: str | None = None, incremental: bool = True, encoding: str | None = None, delimiter: str | None = None, header_row: int = 0, sheet: str | None = None, depth: str = "standard", quoted_breaks: bool | None = None, repo: str | None = None, head: str | None = None) -> dict:
        """Reads a file and keeps it as a dataset; the same file with the same options again changes nothing.

        "shallow" keeps the first 100,000 rows; "deep" answers the question for
        correlations beforehand.  ``repo`` and ``head`` say which repository,
        and which state of it, the file was fetched from.
        """
        if depth not in DEPTHS:
            raise RequestError("INVALID_DEPTH", depth)
        suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
        options: dict = {}
        if suffix in (".csv", ".tsv", ".txt"):
            options = {"encoding": encoding, "delimiter": delimiter, "header_row": header_row, "quoted_breaks": quoted_breaks}
        elif suffix in (".xlsx", ".xls"):
            options = {"sheet": sheet}
        name = name or "".join(c if c.isalnum() or c in "_.-" else "_" for c in PurePosixPath(path.rstrip("/")).stem.lower())
        source = hashlib.sha256(json.dumps(self._digest(path)).encode()).hexdigest()
        df = read_file(self.spark, path, row_cap=DEPTHS[depth], **options)
        options |= {"depth": depth} | ({"repo": repo, "head": head} if repo else {})
        m = self.store.index(name, df, source, options, incremental)
        if depth == "deep" and not m.get("skipped") and len(distribution.numeric_columns(self._columns(name))) > 1:
            self.get_correlations(name)
        return m

    def list_datasets(self) -> DataFrame:
        return self.store.list_datasets()

    def index_repo(self, repo: str, head: str, tree: list[tuple[str, int]], fetch: Callable[[str], str], incremental: bool = True) -> dict:
        """Indexes the data files of a repository's ``tree`` (path, bytes); ``fetch`` brings a path to where Spark reads it and returns that place.

        Nothing is fetched where this ``head`` is indexed already.
        """
        kept = next((r for r in self.list_repos() if r["repo"] == repo), None)
        if incremental and kept and not repositories.needs_fetch(kept["head"], head):
            return {"repo": repo, "skipped": True, "datasets": kept["datasets"]}
        taken, left = repositories.discover(tree)
        stem = "".join(c if c.isalnum() else "_" for c in repo.lower())
        names = [f"{stem}.{''.join(c if c.isalnum() or c in '_.-' else '_' for c in path.rsplit('.', 1)[0].lower())}" for path in taken]
        for path, name in zip(taken, names, strict=True):
            self.index_local(fetch(path), name, incremental, repo=repo, head=head)
        return {"repo": repo, "head": head, "datasets": names, "left": left}

    def list_repos(self) -> list[dict]:
        """Repositories that datasets were indexed from, with the head last indexed, the datasets and their rows."""
        found = [(n, self.store.manifest(n)) for n in self.store.names()]
        return repositories.listed([(n, m["rows"], m["indexed_at"], m.get("options") or {}) for n, m in found])

    def describe_dataset(self, dataset: str, columns: list[str] | None = None, columns_offset: int = 0) -> DataFrame:
        return describe.describe_dataset(self.store.profiles(dataset), self.store.values(dataset), columns, columns_offset)

    def describe_column(self, dataset: str, column: str, top_n: int = 20, histogram_bins: int = 10, redact: bool = True, redact_patterns: list[str] | None = None) -> dict[str, DataFrame]:
        out = describe.describe_column(self._columns(dataset), self.store.profiles(dataset), column, top_n, histogram_bins)
        out["values"] = self._masked(out["values"], redact, redact_patterns)
        out["column"] = self._masked(out["column"], redact, redact_patterns, ["name", "type", "semantic_type"])
        return out

    def summarize_dataset(self, dataset: str) -> dict:
        """What the dataset is about, in sentences, from its profile."""
        m = self.store.manifest(dataset)
        profiles = [r.asDict() for r in self.store.profiles(dataset).orderBy("position").collect()]
        kind = prof.domain(profiles)
        text = f"{kind} data: {m['rows']} rows, {len(profiles)} columns"
        return {"dataset": dataset, "domain": kind, "summary": text, "columns": {p["name"]: prof.summary(p) for p in profiles}}

    def delete_dataset(self, dataset: str) -> dict:
        return {"dataset": dataset, "bytes_freed": self.store.delete(dataset)}

    def validate_index(self, dataset: str) -> dict:
        return self.store.validate(dataset)

    def get_dataset_history(self, dataset: str, n: int = 10) -> DataFrame:
        return self.store.history(dataset, n)

    # Rows, groups, joins and SQL.

    def get_rows(self, dataset: str, filters: list[dict] | None = None, columns: list[str] | None = None, order_by: str | None = None, order_dir: str = "asc", limit: int = 50, offset: int = 0, redact: bool = True, redact_patterns: list[str] | None = None, redact_skip_columns: list[str] | None = None) -> DataFrame:
        df = self._table(dataset)
        shown = ["_row_id", *(columns or [c for c in df.columns if c != "_row_id"][: rows.DEFAULT_COLUMNS])]
        return self._masked(rows.get_rows(df, filters, list(dict.fromkeys(shown)), order_by, order_dir, limit, offset, ["_row_id"]), redact, redact_patterns, redact_skip_columns)

    def total_matching(self, dataset: str, filters: list[dict] | None = None) -> int:
        return rows.total_matching(self._table(dataset), filters).first()[0]

    def aggregate(self, dataset: str, aggregations: list[dict], group_by: list[str] | None = None, filters: list[dict] | None = None, having: list[dict] | None = None, order_by: str | None = None, order_dir: str = "desc", limit: int = 50, approximate: bool = False, redact: bool = True, redact_patterns: list[str] | None = None, redact_skip_columns: list[str] | None = None) -> DataFrame:
        asked = {k: v for k, v in locals().items() if k != "self"}
        return self._cached("aggregate", dataset, asked, lambda: self._masked(agg.aggregate(self._columns(dataset), aggregations, group_by, filters, having, order_by, order_dir, limit, approximate), redact, redact_patterns, redact_skip_columns))

    def sample_rows(self, dataset: str, n: int = 5, method: str = "head", columns: list[str] | None = None, seed: int | None = None, redact: bool = True, redact_patterns: list[str] | None = None, redact_skip_columns: list[str] | None = None) -> DataFrame:
        df = self._table(dataset)
        shown = columns or [c for c in df.columns if c != "_row_id"][: rows.DEFAULT_COLUMNS]
        return self._masked(rows.sample_rows(df, n, method, "_row_id", shown, seed), redact, redact_patterns, redact_skip_columns)

    def join_datasets(self, dataset_a: str, dataset_b: str, join_column_a: str, join_column_b: str, join_type: str = "inner", columns_a: list[str] | None = None, columns_b: list[str] | None = None, filters_a: list[dict] | None = None, filters_b: list[dict] | None = None, limit: int = 50, offset: int = 0, order_by: str | None = None, order_dir: str = "asc", filter_stage: str = "post", redact: bool = True) -> DataFrame:
        page = joins.join_page(self._columns(dataset_a), self._columns(dataset_b), join_column_a, join_column_b, join_type, order_by, order_dir, limit, offset, columns_a=columns_a, columns_b=columns_b, filters_a=filters_a, filters_b=filters_b, filter_stage=filter_stage)
        return self._masked(page, redact, None)

    def run_sql(self, sql: str, datasets: list[str], limit: int = gate.MOST_ROWS, redact: bool = True, redact_patterns: list[str] | None = None, redact_skip_columns: list[str] | None = None, seconds: float = gate.SECONDS) -> dict:
        """``rows`` of a query, ``returned``, ``row_cap`` and whether it was ``truncated``; an error after ``seconds``.  Dots and dashes in a dataset's name are underscores in SQL."""
        tables = {"".join(c if c.isalnum() else "_" for c in d): self._columns(d) for d in datasets}
        got = self._timed("run_sql", lambda: gate.answer(self.spark, sql, tables, limit, seconds))
        return {"rows": self._masked(got.table, redact, redact_patterns, redact_skip_columns), "returned": len(got.rows), "row_cap": max(1, min(limit, gate.MOST_ROWS)), "truncated": got.truncated}

    def total_groups(self, dataset: str, aggregations: list[dict], group_by: list[str] | None = None, filters: list[dict] | None = None, having: list[dict] | None = None) -> int:
        return agg.total_groups(self._columns(dataset), aggregations, group_by, filters, having).first()[0]

    def total_joined(self, dataset_a: str, dataset_b: str, join_column_a: str, join_column_b: str, join_type: str = "inner", filters_a: list[dict] | None = None, filters_b: list[dict] | None = None, filter_stage: str = "post") -> int:
        return joins.join_total(self._columns(dataset_a), self._columns(dataset_b), join_column_a, join_column_b, join_type, filters_a=filters_a, filters_b=filters_b, filter_stage=filter_stage).first()[0]

    def columns_left_out(self, dataset: str, columns: list[str] | None = None) -> list[str]:
        """Columns that ``get_rows`` does not show unless they are named."""
        return rows.left_out(self._columns(dataset), columns)

    def within_budget(self, table: DataFrame, budget: int) -> dict:
        """Rows of an answer as far as they fit a budget of tokens, and whether some are left out."""
        return guide.within_budget({"rows": [r.asDict(recursive=True) for r in table.limit(MOST_KEPT).collect()]}, budget)

    def get_distribution(self, dataset: str, column: str, bins: int = 20, unit: str = "month") -> DataFrame:
        """By the column's type: equal widths, time buckets, or the most frequent values."""
        df = self._columns(dataset)
        kind = prof.logical_type(df.schema[rows.resolve(df, column)].dataType)
        if kind in ("integer", "float"):
            return distribution.numeric_distribution(df, column, bins)
        return distribution.datetime_distribution(df, column, unit).orderBy("bucket") if kind == "datetime" else distribution.categorical_distribution(df, column, bins)

    def get_correlations(self, dataset: str, min_abs_correlation: float = 0.3, columns: list[str] | None = None, top_n: int = 20, method: str = "pearson") -> DataFrame:
        asked = {k: v for k, v in locals().items() if k != "self"}
        return self._cached("correlations", dataset, asked, lambda: distribution.correlations(self._columns(dataset), columns, min_abs_correlation, top_n, method))

    # Search.

    def _searched(self, dataset: str) -> DataFrame:
        values = self.store.values(dataset).groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("values"))
        return self.store.profiles(dataset).join(values, "name", "left").select("name", "type", describe.column_summary().alias("summary"), "values")

    def search_data(self, dataset: str, query: str, search_scope: str = "all", max_results: int = 10, semantic: bool = False, semantic_weight: float = 0.5, semantic_only: bool = False) -> DataFrame:
        """(name, score) of the best columns by names and summaries ("schema"), by values ("values"), or by all; ``search_verdict`` tells what no hit means."""
        if search_scope not in ("all", "schema", "values"):
            raise RequestError("INVALID_SCOPE", search_scope)
        columns = self._searched(dataset)
        if search_scope == "schema":
            columns = columns.withColumn("values", F.array().cast("array<string>"))
        weights = self.tune_weights(dataset)
        if search_scope == "values":
            weights |= {k: 0.0 for k in ("name_exact", "name_substring", "name_word", "summary_word")}
        if search_scope != "all":
            weights["bm25"] = 0.0
        if not (semantic or semantic_only):
            return search.search_columns(columns, query, min(max_results, 50), weights)
        vector = self.spark.createDataFrame([(query,)], "q string").select(search.hashed_vector(F.col("q"))).first()[0]
        return search.search_columns(columns, query, min(max_results, 50), weights, self.embed_dataset(dataset), list(vector), 1.0 if semantic_only else semantic_weight)

    def search_verdict(self, dataset: str, query: str, semantic: bool = False, **options) -> dict:
        """Whether the search found something, or proved that nothing is there, and names near the query if not."""
        hits = self.search_data(dataset, query, semantic=semantic, **options).count()
        return search.search_verdict(hits, [r["name"] for r in self.store.profiles(dataset).select("name").collect()], query, semantic)

    def embed_dataset(self, dataset: str, force: bool = False) -> DataFrame:
        """(name, vector) of every column, kept with the version of the dataset that they describe."""
        path = f"{self.store.manifest(dataset)['base']}/vectors"
        if force or not self.store._fs.exists(self.store._path(f"{path}/_SUCCESS")):
            text = F.concat_ws(" ", "name", "summary", F.array_join(F.coalesce("values", F.array().cast("array<string>")), " "))
            self._searched(dataset).select("name", search.hashed_vector(text).alias("vector")).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def check_embedding_drift(self, force: bool = False, threshold: float = 0.05) -> DataFrame:
        """(text, distance, alarm) of the fixed texts against the vectors first kept; ``force`` keeps new ones."""
        if force or "canaries" not in self._state():
            texts = self.spark.createDataFrame([(c,) for c in search.CANARIES], "text string")
            self._keep_table("canaries", texts.select("text", search.hashed_vector(F.col("text")).alias("vector")))
        return search.embedding_drift(self.spark, self._kept_table("canaries", "text string, vector array<double>"), threshold)

    def tune_weights(self, dataset: str | None = None, set_weights: dict[str, float] | None = None, reset: bool = False) -> dict[str, float]:
        """Weights of the search: defaults, then those for all datasets, then the dataset's own; changes are kept."""
        kept = self._state().get("weights", {})
        mine = dataset or ""
        if set_weights or reset:
            changed = search.tuned(set_weights or {})  # refuses unknown names and holds values inside their bounds
            kept[mine] = ({} if reset else kept.get(mine, {})) | {k: changed[k] for k in set_weights or {}}
            self._keep("weights", kept)
        return search.tuned(kept.get(mine, {}), kept.get("", {}))

    # Quality, keys and impact.

    def get_schema_drift(self, dataset_a: str, dataset_b: str) -> dict:
        changes = health.schema_drift(self.store.profiles(dataset_a), self.store.profiles(dataset_b))
        return {"changes": changes, "verdict": health.drift_verdict(changes).first()[0]}

    def get_data_hotspots(self, dataset: str, top_n: int = 10, include_runtime: bool = True, window_days: int = 30) -> DataFrame:
        traffic = self._traffic(dataset, window_days) if include_runtime and self._state().get("rollup") else None
        asked = {"top_n": top_n, "window_days": window_days, "rollup": self._state().get("rollup") if include_runtime else None}
        return self._cached("hotspots", dataset, asked, lambda: health.hotspots(self.store.profiles(dataset), traffic, top_n))

    def get_dataset_health(self, dataset: str) -> DataFrame:
        return health.dataset_health(self.store.profiles(dataset), self._drift_free(dataset))

    def _drift_free(self, dataset: str) -> bool:
        """Whether the columns are those of the version before."""
        last = [r["columns"] for r in self.store.history(dataset, 2).collect()]
        return len(set(last)) <= 1

    def data_health_radar(self, dataset: str, include_runtime: bool = True, window_days: int = 30) -> DataFrame:
        coverage = None
        if include_runtime and self._state().get("rollup"):
            names = self.store.profiles(dataset).select("name")
            hit = names.join(self._traffic(dataset, window_days), "name", "left").agg(F.count(F.lit(1)).alias("n"), F.count("calls").alias("used")).first()
            coverage = 100.0 * hit["used"] / hit["n"] if hit["n"] else 0.0
        return health.radar(self.store.profiles(dataset), self._drift_free(dataset), coverage)

    def diff_data_health_radar(self, baseline: DataFrame, current: DataFrame) -> DataFrame:
        return health.diff_radar(baseline, current)

    def suggest_keys(self, dataset: str) -> DataFrame:
        return relations.suggest_keys(self.store.profiles(dataset))

    def _catalogue(self, datasets: list[str] | None = None) -> DataFrame:
        """Profiles of many datasets, one row a column, with their most frequent values."""
        out = None
        for d in datasets or self.store.names():
            values = self.store.values(d).groupBy("name").agg(F.sort_array(F.collect_list("value")).alias("values"))
            one = self.store.profiles(d).join(values, "name", "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>"))).withColumn("dataset", F.lit(d))
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise RequestError("NOT_INDEXED", "no datasets")
        return out

    def suggest_joins(self, dataset: str) -> DataFrame:
        """(dataset, column, key, n_distinct, n_found, ratio): columns whose values are nearly all found in another dataset's key."""
        mine = self.store.profiles(dataset).where((~F.col("is_primary_key_candidate")) & F.col("type").isin("integer", "string") & (F.col("null_pct") <= 50) & (F.col("cardinality") >= 5)).select("name", "type").collect()
        out = None
        for other in [d for d in self.store.names() if d != dataset]:
            keys = self.store.profiles(other).where("is_primary_key_candidate").select("name", "type").collect()
            pairs = [(c["name"], k["name"]) for c in mine for k in keys if c["type"] == k["type"]]
            if pairs:
                one = relations.suggest_joins(self._columns(dataset), self._columns(other), pairs).withColumn("dataset", F.lit(other))
                out = one if out is None else out.unionByName(one)
        empty = "column string, key string, n_distinct long, n_found long, ratio double, dataset string"
        return out if out is not None else self.spark.createDataFrame([], empty)

    def find_similar_columns(self, datasets: list[str] | None = None, min_score: float = 0.5, top_n: int = 50, same_type_only: bool = False) -> dict:
        """``pairs`` of similar columns, and ``clusters`` that they join."""
        pairs = relations.similar_columns(self._catalogue(datasets), min_score, top_n, same_type_only)
        names = [(f"{r['dataset_a']}.{r['column_a']}", f"{r['dataset_b']}.{r['column_b']}") for r in pairs.collect()]  # at most top_n
        return {"pairs": pairs, "clusters": relations.clusters(names)}

    def get_schema_impact(self, dataset_id: str, column: str, kind: str = "drop_column", new_name: str | None = None, new_type: str | None = None, max_depth: int = 3, window_days: int = 30) -> dict:
        """What a drop, rename or change of type reaches, and its blast radius from 0 to 1."""
        if kind not in ("drop_column", "rename_column", "retype_column"):
            raise RequestError("INVALID_KIND", kind)
        rows.resolve(self._columns(dataset_id), column)
        everything, calls = self._catalogue(), self._calls(dataset_id, column, window_days)
        reached, blast = relations.schema_impact(relations.foreign_keys(everything), dataset_id, column, max_depth, float(calls > 0), len(self.store.names()))
        after = new_type if kind == "retype_column" else None
        kinds = everything.select("dataset", F.col("name").alias("column"), "type")
        items = reached.join(kinds, ["dataset", "column"], "left").withColumn("type_mismatch", F.lit(after is not None) & (F.col("type") != F.lit(after))).orderBy("depth", "dataset", "column").limit(50)
        return {"kind": kind, "column": column, "new_name": new_name, "new_type": new_type, "impacted": items, "runtime_calls": calls, "blast": blast}

    def check_column_drop_safe(self, dataset_id: str, column: str, window_days: int = 30) -> dict:
        rows.resolve(self._columns(dataset_id), column)
        everything = self._catalogue()
        return relations.drop_check(everything, relations.foreign_keys(everything), dataset_id, column, self._calls(dataset_id, column, window_days))

    # Query logs.

    def _rollup(self) -> DataFrame:
        return self._kept_table("rollup", ROLLUP)

    def _since(self, days: int):
        return F.current_timestamp() - F.make_interval(days=F.lit(int(days)))

    def _traffic(self, dataset: str, days: int) -> DataFrame:
        r = self._rollup().where((F.col("dataset") == dataset.lower()) & (F.col("column") != "") & (F.col("seen") >= self._since(days)))
        used = r.groupBy("column").agg(F.sum("calls").alias("calls"))
        return self.store.profiles(dataset).select("name").join(used, F.lower("name") == F.col("column")).select("name", "calls")

    def _calls(self, dataset: str, column: str, days: int) -> int:
        return self._traffic(dataset, days).where(F.col("name") == column).agg(F.coalesce(F.sum("calls"), F.lit(0))).first()[0]

    def ingest_sql_log(self, file_path: str, source: str = "sql_log", redact: bool = True, max_rows: int | None = None) -> DataFrame:
        """Adds a log's queries to the rollup; returns (dataset, columns, calls) of what it named.  A query without a time counts as seen now."""
        log = read_sql_log(self.spark, file_path, max_rows).withColumn("seen", F.coalesce("seen", F.current_timestamp()))
        catalogue = self._catalogue().select("dataset", "name")
        fresh = workload.rollup(log, catalogue, source)
        self._keep_table("rollup", workload.merge(self._rollup(), fresh))
        if redact:
            found = redaction.redaction_counts(log, "query", [k for k, _ in SECRETS if k != "credit_card"]).where("matches > 0")
            counts = found.select(F.col("kind").alias("pattern"), F.col("matches").cast("long").alias("count"), F.lit(source).alias("source"), F.current_timestamp().alias("seen"))
            self._keep_table("redactions", self._kept_table("redactions", REDACTIONS).unionByName(counts))
        return fresh.groupBy("dataset").agg(F.count_distinct(F.nullif(F.col("column"), F.lit(""))).alias("columns"), F.sum(F.when(F.col("column") == "", F.col("calls"))).alias("calls"))

    def find_unused_columns(self, dataset_id: str, window_days: int = 30, min_calls: int = 0) -> DataFrame:
        """Refuses to answer without any log, since then every column would look unused."""
        calls = self._rollup()
        if calls.limit(1).count() == 0:
            raise RequestError("NO_TRAFFIC", "no query log was read")
        return workload.unused_columns(self.store.profiles(dataset_id).withColumn("dataset", F.lit(dataset_id)), calls, self._since(window_days), min_calls)

    def get_redaction_log(self, source: str | None = None, since_days: int = 30) -> DataFrame:
        return workload.redaction_log(self._kept_table("redactions", REDACTIONS), self._since(since_days), source)

    # Guidance and figures of this session.

    def plan_query(self, intent: str = "summarize") -> tuple[str, list[str]]:
        return guide.plan_query(intent)

    def analyze_perf(self, top: int = 20, operator: str | None = None) -> dict[str, dict[str, float]]:
        """Milliseconds of the operators that ran jobs here, slowest first."""
        figures = {k: guide.latency(v) for k, v in self.times.items() if operator in (None, k)}
        return dict(sorted(figures.items(), key=lambda x: -x[1]["p95"])[:top])

    def get_session_stats(self) -> dict[str, Any]:
        return {"calls": {k: len(v) for k, v in self.times.items()}, "cache_hits": self.cache.hits, "cache_misses": self.cache.misses}
