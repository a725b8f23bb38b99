"""Driver-side helpers: which operator answers a question, how large an answer may be, latency figures."""

from __future__ import annotations

import json
from typing import Any

#: Beginnings of words by which a question shows what it is about.
INTENTS = {
    "summarize": ["summar", "descri", "overview", "profile", "look like", "contain"],
    "anomalies": ["anomal", "outlier", "odd", "wrong", "quality", "problem", "suspect"],
    "compare": ["compar", "differ", "drift", "chang", "versus"],
    "join": ["join", "combin", "link", "match up", "merg"],
    "filter": ["filter", "only", "rows with", "rows where", "find"],
    "trend": ["trend", "over time", "per month", "per year", "by month", "by year", "season"],
    "correlate": ["correlat", "depend", "relation", "go together", "predict"],
}
STEPS = {
    "summarize": ["profile", "dataset_health", "sample_rows"],
    "anomalies": ["hotspots", "describe"],
    "compare": ["schema_drift", "diff_radar"],
    "join": ["suggest_keys", "suggest_joins", "join"],
    "filter": ["search_columns", "get_rows"],
    "trend": ["datetime_distribution", "aggregate"],
    "correlate": ["correlations", "numeric_distribution"],
}


def plan_query(question: str) -> tuple[str, list[str]]:
    """The likeliest intent of a question and the operators that answer it."""
    text = question.lower()
    best = max(INTENTS, key=lambda k: (sum(w in text for w in INTENTS[k]), k == "summarize"))
    return best, STEPS[best]


def tokens_of(value: Any) -> int:
    return len(json.dumps(value, default=str).encode()) // 4


def within_budget(answer: dict, budget: int, rows: str = "rows") -> dict:
    """The answer with as many of its rows as fit the budget of tokens, by halving."""
    if tokens_of(answer) <= budget:
        return answer
    low, high = 0, len(answer.get(rows, []))
    while low < high:
        mid = (low + high + 1) // 2
        if tokens_of(answer | {rows: answer[rows][:mid], "truncated": True}) <= budget:
            low = mid
        else:
            high = mid - 1
    return answer | {rows: answer.get(rows, [])[:low], "truncated": True}


def number(n: float | int | None) -> str:
    """A number for reading: thousands apart, at most two decimals, none from a million on; ``?`` for none."""
    if n is None or isinstance(n, float) and n != n:
        return "?"
    if isinstance(n, int) or abs(n) >= 1_000_000 or n == int(n):
        return f"{n:,.0f}"
    return f"{n:,.2f}"


def size(n: int) -> str:
    """Bytes for reading."""
    value, unit = float(n), "B"
    for bigger in ("KB", "MB", "GB", "TB"):
        if value < 1024:
            break
        value, unit = value / 1024, bigger
    return f"{value:.0f} {unit}" if unit == "B" else f"{value:.1f} {unit}"


def latency(samples: list[float]) -> dict[str, float]:
    """Count, median, 95th percentile and maximum, by nearest rank."""
    s = sorted(samples)
    at = lambda p: s[min(len(s) - 1, max(0, -(-int(p * len(s) * 100) // 100) - 1))] if s else 0.0
    return {"count": len(s), "p50": at(0.5), "p95": at(0.95), "max": s[-1] if s else 0.0}
