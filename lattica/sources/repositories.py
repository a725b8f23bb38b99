"""Choosing data files of a remote repository; fetching is the caller's, since it needs a network."""

from __future__ import annotations

from pathlib import PurePosixPath

from .files import READERS

MOST_BYTES, MOST_FILES = 50 * 1024 * 1024, 20


def discover(tree: list[tuple[str, int]]) -> tuple[list[str], list[tuple[str, str]]]:
    """Of (path, bytes): the smallest readable files, and the others with why they are left."""
    taken, left = [], []
    for path, size in sorted(tree, key=lambda x: (x[1], x[0])):
        if PurePosixPath(path).suffix.lower() not in READERS:
            left.append((path, "suffix"))
        elif size > MOST_BYTES:
            left.append((path, "size"))
        elif len(taken) >= MOST_FILES:
            left.append((path, "count"))
        else:
            taken.append(path)
    return taken, left


def listed(datasets: list[tuple[str, int, float, dict]]) -> list[dict]:
    """Repositories by what was indexed from them: (dataset, rows, indexed_at, options) to one entry for each, the latest first."""
    out: dict[str, dict] = {}
    for name, rows, at, options in datasets:
        if repo := options.get("repo"):
            entry = out.setdefault(repo, {"repo": repo, "head": None, "datasets": [], "rows": 0, "indexed_at": 0.0})
            entry["datasets"].append(name)
            entry["rows"] += rows
            if at >= entry["indexed_at"]:
                entry |= {"indexed_at": at, "head": options.get("head")}
    return sorted(out.values(), key=lambda e: (-e["indexed_at"], e["repo"]))


def needs_fetch(kept_head: str | None, head: str) -> bool:
    return kept_head != head
