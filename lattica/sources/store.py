"""Tables kept under a root folder: versioned data, profiles, a manifest, history and a result cache."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RequestError
from ..operators.profile import profile, top_values
from ..operators.rows import with_row_ids

FORMAT, HISTORY = 3, 50
#: Versions that are kept: the present one and one before it.
KEPT = 2


def valid_id(name: str) -> str:
    if not re.fullmatch(r"[a-z0-9_][a-z0-9_.-]*", name):
        raise RequestError("INVALID_DATASET", name)
    return name


class Store:
    """Datasets under ``root`` on any file system that Spark reaches.

    A version is written in full before a new manifest names it, and manifests
    are never replaced but numbered, so readers see the old version or the new
    one at every moment and writers notice each other.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _versions(self, path: str) -> list[int]:
        """Numbers of the versions of a small file, oldest first."""
        p = self._path(path)
        if not self._fs.exists(p.getParent()):
            return []
        name = f"{p.getName()}."
        found = [s.getPath().getName() for s in self._fs.listStatus(p.getParent())]
        return sorted(int(n[len(name) :]) for n in found if n.startswith(name) and n[len(name) :].isdigit())

    def _read(self, path: str) -> tuple[int, str | None]:
        """The number and text of a small file's last version; 0 and None where there is none."""
        for _ in range(5):  # a version may be removed between listing and reading, when two newer ones have come
            versions = self._versions(path)
            if not versions:
                return 0, None
            try:
                stream = self._fs.open(self._path(f"{path}.{versions[-1]:09d}"))
            except Exception:
                continue
            try:
                return versions[-1], bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        raise RequestError("READ_FAILED", path)

    def _text(self, path: str) -> str | None:
        return self._read(path)[1]

    def _put(self, path: str, text: str, after: int | None = None) -> None:
        """Publishes the next version: written in full beside, then given a name that is not taken.

        Nothing is deleted or overwritten that a reader may hold, so there is
        no moment without a version.  With ``after`` the version must be the
        last still, else CONFLICT.
        """
        last = self._versions(path)[-1:] or [0]
        if after is not None and last[0] != after:
            raise RequestError("CONFLICT", path)
        draft = self._path(f"{path}.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, self._path(f"{path}.{last[0] + 1:09d}"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            raise RequestError("CONFLICT", f"{path}: {str(e).splitlines()[0]}") from None
        for n in self._versions(path)[:-KEPT]:
            self._fs.delete(self._path(f"{path}.{n:09d}"), False)

    def change(self, path: str, how: Callable[[str | None], str]) -> None:
        """Reads, changes and publishes; begins again if another writer came between."""
        for attempt in range(20):
            version, text = self._read(path)
            try:
                return self._put(path, how(text), version)
            except RequestError as e:
                if e.code != "CONFLICT" or attempt == 19:
                    raise
                time.sleep(0.05 * (attempt + 1))

    def manifest(self, name: str) -> dict:
        text = self._text(f"{self.root}/{valid_id(name)}/manifest.json")
        if text is None:
            raise RequestError("NOT_INDEXED", name)
        return migrated(json.loads(text))

    def names(self) -> list[str]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory()]
        return sorted(n for n in found if self._versions(f"{self.root}/{n}/manifest.json"))

    def list_datasets(self) -> DataFrame:
        rows = [(n, m["rows"], len(m["columns"]), m["indexed_at"]) for n in self.names() for m in [self.manifest(n)]]
        return self.spark.createDataFrame(rows, "dataset string, rows long, columns int, indexed_at double")

    def index(self, name: str, df: DataFrame, source: str = "", options: dict | None = None, incremental: bool = True) -> dict:
        """Writes rows (numbered from 1), profiles and manifest; the same source and options again change nothing."""
        key = hashlib.sha256(json.dumps([source, options or {}], sort_keys=True).encode()).hexdigest()
        if incremental and source and valid_id(name) in self.names() and self.manifest(name)["source_key"] == key:
            return self.manifest(name) | {"skipped": True}
        base = f"{self.root}/{valid_id(name)}/v-{uuid.uuid4().hex}"
        with_row_ids(df).write.parquet(f"{base}/rows")
        rows = self.spark.read.parquet(f"{base}/rows")
        profile(rows.drop("_row_id")).coalesce(1).write.parquet(f"{base}/profiles")
        top_values(rows.drop("_row_id")).coalesce(1).write.parquet(f"{base}/values")
        m = {"format": FORMAT, "dataset": name, "base": base, "rows": rows.count(), "columns": [[f.name, f.dataType.simpleString()] for f in df.schema], "source": source, "source_key": key, "options": options or {}, "indexed_at": time.time()}
        m["fingerprint"] = fingerprint(rows, df.columns)
        self.publish(name, m)
        line = [name, m["indexed_at"], m["rows"], json.dumps(m["columns"])]
        self.change(f"{self.root}/{name}/history.json", lambda old: json.dumps([*json.loads(old or "[]"), line][-HISTORY:]))
        self._retire(name)
        return m

    def _bases(self, name: str) -> list[str]:
        """Names of the folders of all versions of a dataset's tables, oldest first."""
        found = [s for s in self._fs.listStatus(self._path(f"{self.root}/{name}")) if s.isDirectory() and s.getPath().getName().startswith("v-")]
        return [s.getPath().getName() for s in sorted(found, key=lambda s: (s.getModificationTime(), s.getPath().getName()))]

    def _retire(self, name: str) -> None:
        """Removes versions of tables but the present one and the KEPT - 1 before it, which readers may still hold."""
        present = self.manifest(name)["base"].rsplit("/", 1)[-1]
        others = [b for b in self._bases(name) if b != present]
        for b in others[: len(others) - (KEPT - 1)]:
            self._fs.delete(self._path(f"{self.root}/{name}/{b}"), True)

    def publish(self, name: str, m: dict) -> None:
        m["checksum"] = hashlib.sha256(json.dumps({k: v for k, v in m.items() if k != "checksum"}, sort_keys=True).encode()).hexdigest()
        self._put(f"{self.root}/{name}/manifest.json", json.dumps(m))

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.manifest(name)['base']}/rows")

    def profiles(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.manifest(name)['base']}/profiles")

    def values(self, name: str) -> DataFrame:
        """(name, value, count, rank) of each column's most frequent values."""
        return self.spark.read.parquet(f"{self.manifest(name)['base']}/values")

    def history(self, name: str, n: int = HISTORY) -> DataFrame:
        """The last ``n`` versions, the latest first; HISTORY of them are kept."""
        lines = json.loads(self._text(f"{self.root}/{valid_id(name)}/history.json") or "[]")[::-1][: min(n, HISTORY)]
        return self.spark.createDataFrame([(a, float(b), int(c), d) for a, b, c, d in lines], "dataset string, indexed_at double, rows long, columns string")

    def delete(self, name: str) -> int:
        """Removes a dataset; returns the bytes freed."""
        self.manifest(name)
        p = self._path(f"{self.root}/{name}")
        size = self._fs.getContentSummary(p).getLength()
        self._fs.delete(p, True)
        return size

    def validate(self, name: str) -> dict:
        """Whether data, profile, manifest and checksum agree: ok, warning (it can be used, but something is left over) or error, with what is wrong."""
        m, wrong, odd = self.manifest(name), [], []
        if m.get("checksum") != hashlib.sha256(json.dumps({k: v for k, v in m.items() if k != "checksum"}, sort_keys=True).encode()).hexdigest():
            wrong.append("checksum")
        for part in ("rows", "profiles", "values"):
            if not self._fs.exists(self._path(f"{m['base']}/{part}/_SUCCESS")):
                wrong.append(part)
        if "rows" not in wrong:
            rows = self.rows(name)
            if rows.count() != m["rows"]:
                wrong.append("row count")
            if sorted(rows.columns) != sorted([c for c, _ in m["columns"]] + ["_row_id"]):
                wrong.append("columns")
        if "profiles" not in wrong and sorted(r["name"] for r in self.profiles(name).select("name").collect()) != sorted(c for c, _ in m["columns"]):
            wrong.append("profiles")
        if len(self._bases(name)) > KEPT:
            odd.append("versions left over")
        if any(".draft-" in s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{name}"))):
            odd.append("drafts left over")
        return {"status": "error" if wrong else "warning" if odd else "ok", "problems": wrong, "warnings": odd}


def fingerprint(rows: DataFrame, columns: list[str], n: int = 1000) -> str:
    """Digest of the sorted column names and the first rows."""
    head = rows.where(F.col("_row_id") <= n).select("_row_id", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sorted(columns)]), 256).alias("h"))
    digests = [r["h"] for r in head.orderBy("_row_id").collect()]
    return hashlib.sha256("\n".join([*sorted(columns), *digests]).encode()).hexdigest()


def migrated(m: dict) -> dict:
    """A manifest of an older format in the present one."""
    m = dict(m)
    if m.get("format", 1) < 2:
        m.setdefault("source_key", "")
    if m.get("format", 1) < 3:
        m.setdefault("fingerprint", "")
    return m | {"format": FORMAT}


class ResultCache:
    """The latest results by operator, data version and arguments."""

    def __init__(self, most: int = 256):
        self.most, self.kept, self.hits, self.misses = most, OrderedDict(), 0, 0

    @staticmethod
    def key(operator: str, version: str, arguments: dict) -> str:
        return hashlib.sha256(json.dumps([operator, version, arguments], sort_keys=True, default=str).encode()).hexdigest()

    def get(self, key: str) -> Any:
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
            return self.kept[key]
        self.misses += 1
        return None

    def put(self, key: str, value: Any) -> None:
        self.kept[key] = value
        self.kept.move_to_end(key)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
