"""Redaction of secrets and personal data, all of it in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import IPV4, SECRETS, SQL_NUMBER, SQL_STRING
from ..functions.text import card_number

CARD = dict(SECRETS)["credit_card"]


#: Stands around each match while a text is cut at its matches; a text that holds it already has all its matches masked.
_CUT = "\ufffe\uffff\ufffe"


def _mask_cards(c: Column) -> Column:
    """Matches of the card pattern that pass the Luhn check masked, in the JVM: the text is cut at its matches and each is judged by itself."""
    mask = "[REDACTED:credit_card]"
    parts = F.split(F.regexp_replace(c, CARD, f"{_CUT}$0{_CUT}"), _CUT, -1)
    judged = F.transform(parts, lambda x, i: F.when((i % 2 == 1) & card_number(x), F.lit(mask)).otherwise(x))
    return F.when(c.contains(_CUT), F.regexp_replace(c, CARD, mask)).otherwise(F.array_join(judged, ""))


def redacted(c: Column, kinds: list[str] | None = None, cards: bool = True, custom: list[str] | None = None) -> Column:
    """Text with each match replaced by ``[REDACTED:kind]``."""
    for kind, pattern in SECRETS:
        if kinds is not None and kind not in kinds:
            continue
        if kind == "credit_card":
            if cards:
                c = F.when(c.rlike(pattern), _mask_cards(c)).otherwise(c)
        else:
            c = F.regexp_replace(c, pattern, f"[REDACTED:{kind}]")
    for i, pattern in enumerate(custom or []):
        c = F.regexp_replace(c, pattern, f"[REDACTED:custom_{i}]")
    return c


def valid_patterns(custom: list[str]) -> tuple[list[str], list[str]]:
    """Custom patterns that can be compiled, and those that cannot."""
    good, bad = [], []
    for p in custom:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            bad.append(p)
    return good, bad


def redact_rows(df: DataFrame, skip: list[str] | None = None, kinds: list[str] | None = None, custom: list[str] | None = None) -> DataFrame:
    """Every string column redacted, but those in ``skip``."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in (skip or [])]
    return df.withColumns({n: redacted(F.col(f"`{n}`"), kinds, custom=custom) for n in names})


def redaction_counts(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """(kind, matches, texts) over a column, in one pass."""
    c = F.col(column)
    one = df.agg(*[x for k in kinds for x in (F.coalesce(F.sum(F.regexp_count(c, F.lit(dict(SECRETS)[k]))), F.lit(0)).alias(f"m_{k}"), F.count_if(c.rlike(dict(SECRETS)[k])).alias(f"t_{k}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"m_{k}").alias("matches"), F.col(f"t_{k}").alias("texts")) for k in kinds])))


def sql_text(c: Column) -> Column:
    """A query with its literals replaced by ``?`` and its secrets masked."""
    c = F.regexp_replace(F.regexp_replace(c, SQL_STRING, "?"), SQL_NUMBER, "?")
    return redacted(c, cards=False)


def trace_text(c: Column) -> Column:
    return F.regexp_replace(redacted(c), IPV4, "[REDACTED:ipv4_address]")
