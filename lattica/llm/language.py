"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A letter trigram is the product
(binding) of its letters' vectors, permuted by place; a text is the sum
(bundle) of its trigrams; a language prototype is the bundle of its texts.  A
text gets the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, release, ship, slice_by_slice, slices
from .words import mix

DIMENSIONS = 1024
#: Characters and texts taken at a time, and cells of a table of texts by trigrams.
BATCH_CHARS, TEXT_COST, CELLS = 400_000, 400, 1 << 22
GRAM_ROWS = 2048
#: Languages whose profiles may be held and sent to every task.
MOST_LANGUAGES = 8192
UNKNOWN = "und"
RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


@functools.cache
def letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if unicodedata.category(chr(i))[0] == "L":
            out[i] = i
    return out


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each letter, the same on every machine."""
    words = np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        seed = mix(letters.astype(np.uint64) + np.uint64(0x5DEECE66D))
        bits = mix(seed[:, None] ^ (words * np.uint64(0x9E3779B97F4A7C15))[None, :])
    return (1 - 2 * np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8)).astype(np.int8)


@dataclass
class Grams:
    """Distinct trigrams of some texts (as places in ``letters``) and, for each found trigram, its text and which one it is."""

    letters: np.ndarray
    parts: tuple[np.ndarray, np.ndarray, np.ndarray]
    text: np.ndarray
    which: np.ndarray


def trigrams(texts: list[str], cut: tuple[bool, bool] = (False, False)) -> Grams:
    """Letter trigrams inside words, with a gap before and after each word.

    Where a longer text was ``cut`` before or after, the first or last letter
    is there for its neighbour alone and is no trigram's middle.
    """
    lowered = [t.lower() for t in texts] if not any(cut) else texts
    joined = "\n" + "\n".join(lowered) + "\n"
    codes = letter_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    seen[0] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int32)
    place[letters] = np.arange(len(letters))
    owner = np.repeat(np.arange(len(texts) + 1), [1] + [len(t) + 1 for t in lowered])
    if cut[0]:
        owner[1] = 0
    if cut[1]:
        owner[-2] = 0
    gap = codes == 0
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[0] = True
    line, owner = place[codes[keep]], owner[keep] - 1
    if len(line) < 3:
        empty = np.empty(0, np.int64)
        return Grams(letters, (empty, empty, empty), empty, empty)
    middle = np.flatnonzero((line[1:-1] != 0) & (owner[1:-1] >= 0)) + 1
    k = len(letters)
    code = (line[middle - 1].astype(np.int64) * k + line[middle]) * k + line[middle + 1]
    if k**3 <= 1 << 22:
        present = np.zeros(k**3, bool)
        present[code] = True
        distinct = np.flatnonzero(present)
        where = np.zeros(k**3, np.int32)
        where[distinct] = np.arange(len(distinct))
        which = where[code]
    else:
        distinct, which = np.unique(code, return_inverse=True)
    return Grams(letters, (distinct // (k * k), distinct // k % k, distinct % k), owner[middle], which)


def bundles(g: Grams, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of trigram vectors by ``group`` of the text; one row for each group."""
    out = np.zeros((groups, DIMENSIONS), np.float32)
    if not len(g.which):
        return out
    distinct = len(g.parts[0])
    rows = min(GRAM_ROWS, max(1, CELLS // groups))
    of, which = group[g.text].astype(np.int64), g.which
    whole = groups * distinct <= CELLS
    if whole:
        counts = np.bincount(of * distinct + which, minlength=groups * distinct).reshape(groups, distinct).astype(np.float32)
    else:
        order = np.argsort(which, kind="stable")
        of, which = of[order], which[order]
    third = letter_vectors(g.letters)
    first, second = np.roll(third, 2, axis=1), np.roll(third, 1, axis=1)
    for a in range(0, distinct, rows):
        x, y, z = (p[a : a + rows] for p in g.parts)
        bound = first[x]
        bound *= second[y]
        bound *= third[z]
        if whole:
            some = counts[:, a : a + rows]
        else:
            lo, hi = np.searchsorted(which, [a, a + len(x)])
            some = np.bincount(of[lo:hi] * len(x) + (which[lo:hi] - a), minlength=groups * len(x)).reshape(groups, len(x)).astype(np.float32)
        out += some @ bound.astype(np.float32)
    return out


def text_bundles(texts: list[str], group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the trigram vectors of all texts by group, and how many trigrams each group has, in bounded memory for many short texts and for very long ones."""
    out, many = np.zeros((groups, DIMENSIONS)), np.zeros(groups, np.int64)
    for a, b in pieces([len(t) + TEXT_COST for t in texts], BATCH_CHARS):
        if b - a == 1 and len(texts[a]) > BATCH_CHARS:
            lowered = texts[a].lower()
            for k in range(0, len(lowered), BATCH_CHARS):
                g = trigrams([lowered[max(0, k - 1) : k + BATCH_CHARS + 1]], (k > 0, k + BATCH_CHARS < len(lowered)))
                out[group[a]] += bundles(g, np.zeros(1, np.int64), 1)[0]
                many[group[a]] += len(g.which)
        else:
            g = trigrams(texts[a:b])
            ids, local = np.unique(group[a:b], return_inverse=True)
            out[ids] += bundles(g, local, len(ids))
            many += np.bincount(group[a:b][g.text], minlength=groups)
    return out, many


@dataclass
class Profiles:
    """Prototypes: unit rows, with what all languages share taken away where there are several."""

    langs: list[str]
    rows: np.ndarray


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Prototypes of every language of ``docs``, from all rows with a text and a language.

    Each partition bundles its own texts; only one vector for each language
    and partition is shuffled, and one for each language reaches the driver.
    More than MOST_LANGUAGES different values are an error, since profiles of
    so many are not held in one place.  Rows of a null text or language teach
    nothing, repeated rows teach each, an empty table gives no language, and a
    very long text is bundled in pieces to the same sum.
    """
    ship(docs.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, some in slices(batch.column(0)):
                texts, langs = some.to_pylist(), batch.column(1).slice(at, len(some)).to_pylist()
                names = sorted(set(langs))
                number = {x: k for k, x in enumerate(names)}
                for name, row in zip(names, text_bundles(texts, np.array([number[x] for x in langs], np.int64), len(names))[0], strict=True):
                    sums[name] = sums.get(name, 0) + row
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
            batch = some = texts = None
        release()
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(row)], ["lang", "place", "value"])

    known = docs.select(F.col(text_col), F.col(lang_col)).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    total = known.mapInArrow(bundle, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value")))["value"].alias("row"))  # DIMENSIONS values each
    found = vectors.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found.sort(key=lambda r: r["lang"])
    return Profiles([r["lang"] for r in found], centred(np.array([r["row"] for r in found]).reshape(-1, DIMENSIONS)))


def centred(rows: np.ndarray) -> np.ndarray:
    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    rows = unit(rows)
    return unit(rows - rows.mean(axis=0)) if len(rows) > 1 else rows


def predict(texts: list[str], profiles: Profiles) -> tuple[list[str], list[float]]:
    names, scores = [], []
    table = profiles.rows.T.astype(np.float32)
    for a, b in pieces([len(t) + TEXT_COST for t in texts], BATCH_CHARS):
        vectors, many = text_bundles(texts[a:b], np.arange(b - a), b - a)
        norm = np.linalg.norm(vectors, axis=1)
        near = vectors.astype(np.float32) @ table
        near = np.divide(near, norm[:, None], out=np.zeros_like(near), where=norm[:, None] > 0)
        for k in range(b - a):
            if many[k] and len(profiles.langs):
                best = int(near[k].argmax())
                names.append(profiles.langs[best])
                scores.append(float(min(1.0, max(0.0, near[k, best]))))
            else:
                names.append(UNKNOWN)
                scores.append(0.0)
    return names, scores


def with_language(docs: DataFrame, profiles: Profiles, into: str, text_col: str = "text") -> DataFrame:
    """Adds a struct column ``into`` of ``lang_pred`` and ``score`` (cosine, cut at 0 and 1).

    Null texts and texts without a letter get ``und`` and 0; of equally near
    languages the first by name wins.  Other columns are passed on and are no
    input (one named like ``into`` is replaced).  Repeated rows get equal
    results; an empty table stays empty.  A very long text is bundled in
    pieces, to the same sum.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x DIMENSIONS numbers, whatever the input's size

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def predicted(some: pa.Array) -> pa.Array:
            names, scores = predict([t or "" for t in some.to_pylist()], shared.value)
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(RESULT))

        return slice_by_slice(batches, predicted)

    return docs.withColumn(into, identify.asNondeterministic()(F.col(text_col)))
