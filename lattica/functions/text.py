"""Scalar functions over text and arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for a missing value in text sources.
NULL_TOKENS = ["", "null", "NULL", "none", "None", "N/A", "n/a", "NA", "na", "NaN", "nan", "-", ".", "#N/A", "#NA", "#NULL!", "n.a.", "N.A."]
# Date and time forms that are recognised, as (name, Java format, pattern).
DATETIMES = [
    ("%Y-%m-%d", "yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("%m/%d/%Y", "M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"),
    ("%m/%d/%Y %H:%M:%S", "M/d/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("%m/%d/%Y %I:%M:%S %p", "M/d/yyyy h:mm:ss a", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$"),
]


def clean(c: Column) -> Column:
    """Trimmed text, null where it is a token for a missing value."""
    t = F.trim(c)
    return F.when(~t.isin(*NULL_TOKENS), t)


#: Numbers as text writes them: no type letters at the end, which a plain cast would take, and no leading zeros.
_WHOLE, _REAL, _ZERO_LED = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"^[+-]?0\d"


def as_integer(c: Column) -> Column:
    """A whole number, or null; codes with leading zeros are no numbers."""
    return F.when(c.rlike(_WHOLE) & ~c.rlike(_ZERO_LED), c.try_cast("bigint"))


def as_float(c: Column) -> Column:
    """A number, or null; codes with leading zeros or letters at the end are no numbers."""
    return F.when(c.rlike(_REAL) & ~c.rlike(_ZERO_LED), c.try_cast("double"))


def as_datetime(c: Column) -> Column:
    """A date or time in one of the known forms, or null where the value has the form but names no day."""
    return F.coalesce(*[F.when(c.rlike(p), F.try_to_timestamp(F.substring(c, 1, 19) if "T" in f or f.startswith("yyyy-MM-dd HH") else c, F.lit(f))) for _, f, p in DATETIMES]).cast("timestamp_ntz")


def rank_of(c: Column) -> Column:
    """0 integer, 1 float, 2 datetime, 3 string; null for null.  What does not begin as a number does is text without a further look."""
    number = F.when(as_integer(c).isNotNull(), 0).when(as_float(c).isNotNull(), 1).when(as_datetime(c).isNotNull(), 2).otherwise(3)
    return F.when(c.isNull(), None).when(~c.rlike(r"^[+-]?\.?\d"), 3).when(F.length(c) > 400, 3).otherwise(number)


def words(c: Column) -> Column:
    """Lower-case letter-and-digit words."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def name_parts(c: Column) -> Column:
    """Parts of an identifier, cut at separators and where lower case meets upper."""
    return F.array_distinct(words(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def fingerprint(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(c, 256), 1, 32))


def card_number(c: Column) -> Column:
    """13 to 19 digits that pass the Luhn check."""
    digits = F.regexp_replace(c, "[ -]", "")
    return digits.rlike(r"^\d{13,19}$") & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
