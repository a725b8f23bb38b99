"""Files to DataFrames.  Text sources are read as strings and typed over all their rows."""

from __future__ import annotations

import csv
import importlib
import io
import zlib
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RequestError
from ..functions.text import as_datetime, as_float, as_integer, clean, rank_of

TYPES = ("integer", "float", "datetime", "string")
SNIFFED = 64 * 1024
#: Workbooks are read in one piece; their own formats end at 2^20 rows a sheet.
MOST_WORKBOOK = 512 * 1024 * 1024


def head(spark: SparkSession, path: str, size: int = SNIFFED) -> bytes:
    """The first bytes of the first file at ``path``, through Spark's own file systems; no more of it is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in sorted(fs.globStatus(at) or [], key=lambda s: s.getPath().toString()):
        below = [found] if found.isFile() else sorted(fs.listStatus(found.getPath()), key=lambda s: s.getPath().toString())
        for file in below:
            if file.isFile() and not file.getPath().getName().startswith(("_", ".")):
                stream = fs.open(file.getPath())
                try:
                    return bytes(stream.readNBytes(size))
                finally:
                    stream.close()
    raise RequestError("FILE_NOT_FOUND", path)


def whole(spark: SparkSession, path: str, most: int) -> bytes:
    """All bytes of a file that must be read in one piece, through Spark's own file systems; more than ``most`` is an error."""
    raw = head(spark, path, most + 1)
    if len(raw) > most:
        raise RequestError("FILE_TOO_LARGE", f"more than {most} bytes")
    return raw


def sniff_encoding(raw: bytes) -> str:
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    for cut in range(4 if len(raw) >= SNIFFED else 1):  # of a longer file the last character may be cut
        try:
            raw[: len(raw) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            pass
    return "iso-8859-1"


def sniff_delimiter(raw: bytes, encoding: str) -> str:
    text = raw.decode(encoding, "replace")
    try:
        return csv.Sniffer().sniff(text[:8192], ",\t|;").delimiter
    except csv.Error:
        return ","


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a line of the file has an odd number of quotes, as one in the middle of a quoted cell has; every line is looked at until one is found."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, header_row: int = 0, typed: bool = True, quoted_breaks: bool | None = None) -> DataFrame:
    """A delimited file; quoted line breaks are kept, missing cells are null, rows before the header row are dropped.

    A file whose quoted cells hold line breaks cannot be split, so one task
    reads it; others are dealt over many tasks.  Unless ``quoted_breaks`` says
    which, a pass over all lines looks for one with an odd number of quotes.
    """
    raw = head(spark, path) if encoding is None or (delimiter is None and not path.endswith(".tsv")) else b""
    encoding = encoding or sniff_encoding(raw)
    delimiter = delimiter or ("\t" if path.endswith(".tsv") else sniff_delimiter(raw, encoding))
    if quoted_breaks is None:
        quoted_breaks = encoding.upper().startswith("UTF-16") or has_quoted_breaks(spark, path)
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("multiLine", quoted_breaks).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    if not header_row:
        return infer(reader.option("header", True).csv(path)) if typed else reader.option("header", True).csv(path)
    plain = reader.option("header", False).csv(path).withColumn("__at", F.monotonically_increasing_id())
    top = plain.orderBy("__at").limit(header_row + 1).collect()
    if len(top) <= header_row:
        raise RequestError("INVALID_HEADER", f"no row {header_row}")
    names = [c if c else f"column_{k}" for k, c in enumerate(top[header_row][:-1])]
    body = plain.where(F.col("__at") > top[header_row]["__at"]).drop("__at").toDF(*names)
    return infer(body) if typed else body


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line, schema from all lines; bad lines are skipped."""
    return spark.read.option("mode", "DROPMALFORMED").option("samplingRatio", 1.0).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A workbook's sheet, where a reader for its format is installed; the file may lie wherever Spark reads."""
    engine = "xlrd" if path.lower().endswith(".xls") else "openpyxl"
    try:
        importlib.import_module(engine)
    except ImportError:
        raise RequestError("MISSING_READER", f"{engine} is needed for {path.rsplit('.', 1)[-1]} files") from None
    import pandas as pd

    table = pd.read_excel(io.BytesIO(whole(spark, path, MOST_WORKBOOK)), sheet_name=sheet or 0, dtype=str, engine=engine)
    return infer(spark.createDataFrame(table.astype(object).where(table.notna(), None), ", ".join(f"`{c}` string" for c in table.columns)))


READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": read_csv, ".tsv": read_csv, ".txt": read_csv, ".jsonl": read_jsonl, ".ndjson": read_jsonl, ".parquet": read_parquet, ".xlsx": read_excel, ".xls": read_excel,
}


def read_file(spark: SparkSession, path: str, row_cap: int | None = None, **options) -> DataFrame:
    """Reads by the file's suffix; ``row_cap`` is an opt-in limit."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in READERS:
        raise RequestError("UNSUPPORTED_FORMAT", suffix or path)
    df = READERS[suffix](spark, path, **options)
    return df.limit(row_cap) if row_cap else df


def infer_types(df: DataFrame, nulls: bool = True) -> dict[str, str]:
    """Each column's type: the least specific that any value needs, from one aggregation over all rows.

    Numbers and dates have no common type but text, so a column of both is text.
    """
    value = (lambda c: clean(c)) if nulls else (lambda c: c)
    ranks = [rank_of(value(F.col(f"`{c}`"))) for c in df.columns]
    one = df.agg(*[x for i, r in enumerate(ranks) for x in (F.max(r).alias(f"t{i}"), F.min(r).alias(f"l{i}"))]).first()
    of = lambda low, high: 3 if high is None or (high == 2 and low < 2) else high
    return {c: TYPES[of(one[f"l{i}"], one[f"t{i}"])] for i, c in enumerate(df.columns)}


def typed_column(c: Column, kind: str) -> Column:
    return {"integer": as_integer, "float": as_float, "datetime": as_datetime, "string": lambda x: x}[kind](c)


def infer(df: DataFrame, nulls: bool = True) -> DataFrame:
    """String columns cast to the types that infer_types finds, which every value of a column has; missing-value tokens become null."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    kinds = infer_types(df.select(*[F.col(f"`{c}`") for c in strings]), nulls) if strings else {}
    return df.select(*[typed_column(clean(F.col(f"`{c}`")) if nulls else F.col(f"`{c}`"), kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


def read_sql_log(spark: SparkSession, path: str, row_cap: int | None = None) -> DataFrame:
    """(query, calls, total_time, seen) from statement statistics as CSV, JSON lines or one JSON array, also gzipped, whatever the columns are called.

    ``row_cap`` is an opt-in limit.
    """
    plain = path.removesuffix(".gz")
    start = head(spark, path, 4096)
    if path.endswith(".gz"):
        start = zlib.decompressobj(31).decompress(start)
    array = start.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"[")
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if plain.endswith(".csv") else spark.read.option("multiLine", array).json(path)
    names = {c.lower(): c for c in raw.columns}

    def first(options: list[str], kind: str, default: object) -> Column:
        found = [F.col(f"`{names[o]}`").cast("string").try_cast(kind) for o in options if o in names]
        return F.coalesce(*found, F.lit(default).cast(kind)) if found else F.lit(default).cast(kind)

    out = raw.select(
        first(["query", "sql", "statement", "text"], "string", None).alias("query"), first(["calls", "count", "executions"], "bigint", 1).alias("calls"),
        first(["total_time", "total_exec_time", "duration", "time"], "double", 0.0).alias("total_time"), first(["last_seen", "seen", "timestamp", "ts"], "timestamp", None).alias("seen"),
    )
    found = out.where("query is not null")
    return found.limit(row_cap) if row_cap else found
