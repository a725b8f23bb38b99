"""Quality rules: word and line counts, and compression ratios held to bands that depend on length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slice_by_slice
from .words import WHITE, hashed, windows

SYMBOLS = b"#*$%&|<>"
#: (bytes from, lowest and highest ratio of compressed to plain bytes): short texts compress less, because the frame and its tables weigh more.
BANDS = [
    (0, 0.30, 2.00),
    (100, 0.40, 1.30),
    (200, 0.36, 1.00),
    (400, 0.32, 0.88),
    (800, 0.28, 0.80),
    (1600, 0.26, 0.76),
    (3200, 0.24, 0.74),
    (6400, 0.22, 0.72),
    (25600, 0.20, 0.72),
]
#: Chunks of CHUNK bytes are judged by this band, and what is left over by the band of its length (under LEAST_TAIL bytes it belongs to the chunk before).
#: A text fails if more than BAD_CHUNKS of its chunks lie outside: clean prose has none.
CHUNK, CHUNK_BAND, LEAST_TAIL, BAD_CHUNKS = 4096, (0.22, 0.74), 100, 0.05
LEVEL = 3

RESULT = pa.struct(
    [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64()), ("n_chunks", pa.int64()), ("kept", pa.bool_())]
)
SCHEMA = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,ratio:double,bad_chunks:bigint,n_chunks:bigint,kept:boolean>"


def repeat_words(window_hashes: np.ndarray, size: int = 3) -> int:
    """Words that lie in a window found twice or more."""
    if len(window_hashes) < 2:
        return 0
    order = np.sort(window_hashes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(window_hashes, np.unique(twice)))
    covered = np.zeros(len(window_hashes) + size - 1, bool)
    for k in range(size):
        covered[hit + k] = True
    return int(covered.sum())


def band(n: int) -> tuple[float, float]:
    return next((lo, hi) for start, lo, hi in reversed(BANDS) if n >= start)


def judge(raw: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """Ratio of the whole, chunks out of band, chunks, and whether the text lies inside the bands."""
    if not raw:
        return None, 0, 0, False
    ratio = len(squeeze.compress(raw)) / len(raw)
    lo, hi = band(len(raw))
    edges = [*range(0, len(raw) - len(raw) % CHUNK + 1, CHUNK)]
    if len(edges) > 1 and len(raw) - edges[-1] >= LEAST_TAIL:
        edges.append(len(raw))
    else:
        edges[-1] = len(raw) if len(edges) > 1 else 0
    n = len(edges) - 1  # none in a text of less than a chunk, which is judged as a whole
    bad = 0
    for a, b in zip(edges, edges[1:], strict=False):
        low, high = CHUNK_BAND if b - a >= CHUNK else band(b - a)
        bad += not low <= len(squeeze.compress(raw[a:b])) / (b - a) <= high
    return ratio, bad, n, lo <= ratio <= hi and bad <= BAD_CHUNKS * n


def measure(texts: list[str | None], squeeze: zstandard.ZstdCompressor) -> list[dict]:
    raws = [(t or "").encode() for t in texts]
    out = []
    if raws:
        w = hashed(raws)
        triples, first = windows(w, 3)
        for k, raw in enumerate(raws):
            text = texts[k] or ""
            lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
            n_words = int(w.first[k + 1] - w.first[k])
            repeats = repeat_words(triples[first[k] : first[k + 1]])
            failed = n_words < 50 or 100 * repeats > 50 * n_words
            ratio, bad, n, fine = judge(raw, squeeze)
            out.append(
                {
                    "n_words": n_words,
                    "word_chars": len(text) - (len(raw) - len(raw.translate(None, WHITE))),
                    "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
                    "n_dup_lines": len(lines) - len(set(lines)),
                    "n_repeat_words": repeats,
                    "base_failed": failed,
                    "ratio": ratio,
                    "bad_chunks": bad,
                    "n_chunks": n,
                    "kept": not failed and fine,
                }
            )
    return out


def with_quality(docs: DataFrame, into: str, text_col: str = "text") -> DataFrame:
    """Adds a struct column ``into`` with the counts, ratios and verdict of each text.

    A null text counts as empty: no words, so it fails.  Every other column is
    passed on as it is and only the text travels to Python.  Repeated rows get
    equal verdicts.  An empty table stays empty.  A column named like ``into``
    is replaced.  A very long text is measured alone, in some twenty times its
    bytes.
    """
    ship(docs.sparkSession)

    @F.arrow_udf(SCHEMA)
    def verdicts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        return slice_by_slice(batches, lambda some: pa.array(measure(some.to_pylist(), squeeze), RESULT))

    # Named nondeterministic so that a filter on the verdict does not evaluate it a second time.
    return docs.withColumn(into, verdicts.asNondeterministic()(F.col(text_col)))
