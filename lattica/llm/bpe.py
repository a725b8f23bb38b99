"""Byte-level BPE over whole texts, with boundaries found by transition-function scans.

A text is an array of code-point classes.  A small automaton says where a
pre-token starts; since composing its transition functions is associative, the
classes are cut into lanes, each lane's function is composed for all lanes at
once, a scan over lanes gives the state in which each lane begins, and a second
pass marks the starts.  The slices between starts are merged by rank, all new
slices of one length at once, and kept in a cache.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, release, ship, slices

BATCH_CHARS = 1_000_000
LANE = 256
CACHE_SLICES = 350_000
LONG_SLICE = 128

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, ONE, FIRST_E, FIRST_L, LAST_E = range(10)
# Symbols of the automaton: classes with one code point of lookahead.
S_LETTER, S_SINGLE, S_PAIR, S_NUMBER, S_OTHER, S_QUOTE, S_INNER, S_GLUE, S_WHITE = range(9)
SYMBOLS = 9
# States after a code point.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, GLUED, IN_WHITE, QUOTED, HALF = range(8)
STATES = 8


@functools.cache
def class_table() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
        elif kind == "Z":
            out[i] = WHITE
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]] = WHITE
    out[0x20], out[0x27] = SPACE, QUOTE
    out[[ord(c) for c in "stmd"]] = ONE  # with a quote before it, a contraction by itself
    out[[ord(c) for c in "rv"]] = FIRST_E  # ... if an e follows
    out[ord("l")] = FIRST_L  # ... if an l follows
    out[ord("e")] = LAST_E
    return out


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token starts, by symbol and state; symbols from SYMBOLS on open a text."""
    following = np.zeros((2 * SYMBOLS, STATES), np.uint8)
    starts = np.zeros((2 * SYMBOLS, STATES), bool)
    for symbol in range(SYMBOLS):
        for state in range(STATES):
            start = True
            if symbol in (S_LETTER, S_SINGLE, S_PAIR):
                to = IN_LETTERS
                if state in (IN_LETTERS, GLUED):
                    start = False
                elif state == HALF:
                    to, start = FRESH, False
                elif state == QUOTED and symbol == S_SINGLE:
                    to, start = FRESH, False
                elif state == QUOTED and symbol == S_PAIR:
                    to, start = HALF, False
            elif symbol == S_NUMBER:
                to, start = IN_NUMBERS, state not in (IN_NUMBERS, GLUED)
            elif symbol == S_OTHER:
                to, start = IN_OTHER, state not in (IN_OTHER, GLUED, QUOTED)
            elif symbol == S_QUOTE:
                start = state not in (IN_OTHER, GLUED, QUOTED)
                to = QUOTED if start else IN_OTHER
            elif symbol == S_INNER:
                to, start = IN_WHITE, state != IN_WHITE
            else:
                to = GLUED if symbol == S_GLUE else FRESH
            following[symbol, state], starts[symbol, state] = to, start
    following[SYMBOLS:], starts[SYMBOLS:] = following[:SYMBOLS, :1], True
    return following, starts


def symbols_of(codes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The automaton's symbols; ``opens``: where texts begin."""
    kind = class_table()[codes]
    n = len(kind)
    last = np.zeros(n, bool)
    last[opens[1:] - 1] = True
    last[-1] = True
    after = np.empty_like(kind)
    after[:-1] = kind[1:]
    after[-1] = WHITE
    after[last] = WHITE
    solid = (after != SPACE) & (after != WHITE)
    to = np.array([S_LETTER, S_NUMBER, S_OTHER, S_INNER, S_INNER, S_QUOTE, S_SINGLE, S_LETTER, S_LETTER, S_LETTER], np.uint8)
    out = to[kind]
    out[((kind == FIRST_E) & (after == LAST_E)) | ((kind == FIRST_L) & (after == FIRST_L))] = S_PAIR
    out[(kind == SPACE) & solid] = S_GLUE
    out[(kind == WHITE) & solid] = S_WHITE
    out[opens] += SYMBOLS
    return out


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Row by row, the function that applies ``first`` and then ``then``."""
    return np.take_along_axis(then, first.astype(np.intp), axis=1)


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions, in a logarithmic number of steps."""
    out, step = functions.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step], out[step:])
        step *= 2
    return out


def boundaries(codes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Places where a pre-token starts."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    following, starts = automaton()
    lanes = -(-n // LANE)
    padded = np.zeros(lanes * LANE, np.uint8)
    padded[:n] = symbols_of(codes, opens)
    grid = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    flat = following.ravel()
    every = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (lanes, STATES)).copy()
    # A lane's function is constant once a symbol forgets the state, so lanes leave the first pass early.
    live, now = np.arange(lanes), every
    for k in range(LANE - 1, -1, -1):
        # composed from the lane's end: now(x) := now(f_k(x))
        now = np.take_along_axis(now, following[grid[k, live]].astype(np.intp), axis=1)
        if k % 16 == 0 and k:
            every[live] = now
            same = (now == now[:, :1]).all(axis=1)
            live, now = live[~same], now[~same]
            if not len(live):
                break
    else:
        every[live] = now
    entry = np.zeros(lanes, np.uint8)
    entry[1:] = scan(every)[:-1, FRESH]
    marked = np.empty((LANE, lanes), bool)
    begin, state = starts.ravel(), entry.astype(np.intp)
    for k in range(LANE):
        at = grid[k].astype(np.intp) * STATES + state
        marked[k] = begin[at]
        state = flat[at].astype(np.intp)
    return np.flatnonzero(marked.T.ravel()[:n])


class Codec:
    """Byte-pair merges by rank over a given vocabulary; nothing is trained."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.vocab: list[bytes] = [b""] * self.size
        for piece, rank in ranks.items():
            self.vocab[rank] = piece
        self.lengths = np.array([len(x) for x in self.vocab], np.uint32)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.cache: dict[bytes, bytes] = {}

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Open table of joinable pairs and their ranks, made when the first slice is merged; decoding needs none."""
        keys, values = [], []
        for piece, rank in self.ranks.items():
            for k in range(1, len(piece)):
                a, b = self.ranks.get(piece[:k]), self.ranks.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(rank)
        return self._hashed(np.array(keys, np.int64), np.array(values, np.int64))

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs are found in ``probes`` steps at most."""
        self.bits = max(12, int(len(keys) * 4).bit_length())
        mask = (1 << self.bits) - 1
        table, found = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.size, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            at = (self._slot(keys[left]) + self.probes) & mask
            free = table[at] < 0
            table[at[free]] = keys[left[free]]
            won = table[at] == keys[left]
            found[at[won]] = values[left[won]]
            left = left[~won]
            self.probes += 1
        return table, found

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, ``size`` where it is no token (a negative b: none)."""
        table, ranks = self.pairs
        keys = a * self.size + b
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        out = np.full(keys.shape, self.size, np.int64)
        for k in range(self.probes):
            at = (slot + k) & mask
            hit = table[at] == keys
            out[hit] = ranks[at[hit]]
            if k == 0 and bool((hit | (table[at] < 0)).all()):
                break
        out[b < 0] = self.size
        return out

    def merge_equal(self, slices: list[bytes]) -> list[np.ndarray]:
        """Merges slices of one length, all at once: each step joins the lowest rank of every row, the leftmost of equals."""
        n, width = len(slices), len(slices[0])
        ids = self.single[np.frombuffer(b"".join(slices), np.uint8).reshape(n, width)]
        size = np.full(n, width)
        if width > 1:
            pairs = np.full((n, width), self.size, np.int64)
            pairs[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
            live, columns = np.arange(n), np.arange(width)
            while len(live):
                rows = pairs[live]
                at = rows.argmin(axis=1)
                best = rows[np.arange(len(live)), at]
                go = best < self.size
                live, at, best = live[go], at[go], best[go]
                if not len(live):
                    break
                old, row = ids[live], pairs[live][:, :]
                shift = columns[None, :] > at[:, None]
                moved = np.concatenate([old[:, 1:], np.full((len(live), 1), -1)], axis=1)
                new = np.where(shift, moved, old)
                k = np.arange(len(live))
                new[k, at] = best
                moved = np.concatenate([row[:, 1:], np.full((len(live), 1), self.size)], axis=1)
                row = np.where(shift, moved, row)
                right = np.where(at + 1 < width, new[k, np.minimum(at + 1, width - 1)], -1)
                row[k, at] = self.pair_ranks(new[k, at], right)
                back = at > 0
                row[k[back], at[back] - 1] = self.pair_ranks(new[k[back], at[back] - 1], new[k[back], at[back]])
                ids[live], pairs[live] = new, row
                size[live] -= 1
        return [ids[i, : size[i]] for i in range(n)]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long slice, by a heap over a linked list."""
        n = len(piece)
        ids: list[int] = self.single[np.frombuffer(piece, np.uint8)].tolist()
        text: list[bytes] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if (j := after[i]) < n and (rank := self.ranks.get(text[i] + text[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if gone[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], text[i], gone[j] = rank, text[i] + text[j], True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([ids[i] for i in range(n) if not gone[i]])

    def _learn(self, slices: set[bytes]) -> None:
        by_length: dict[int, list[bytes]] = {}
        for x in slices:
            if (rank := self.ranks.get(x)) is not None:
                self.cache[x] = rank.to_bytes(4, "little")
            elif len(x) > LONG_SLICE:
                self.cache[x] = self.merge_long(x).astype("<u4").tobytes()
            else:
                by_length.setdefault(len(x), []).append(x)
        for group in by_length.values():
            for a in range(0, len(group), 20_000):
                part = group[a : a + 20_000]
                for x, ids in zip(part, self.merge_equal(part), strict=True):
                    self.cache[x] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        for a, b in pieces([len(t) for t in texts], BATCH_CHARS):
            out += self._encode(texts[a:b])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        raw = joined.encode()
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        opens = np.unique(np.concatenate([[0], ends[:-1]]))
        opens = opens[opens < len(codes)]
        starts = boundaries(codes, opens)
        plain = np.frombuffer(raw, np.uint8)
        where = starts if len(raw) == len(codes) else np.flatnonzero((plain & 0xC0) != 0x80)[starts]
        cut = where.tolist() + [len(raw)]
        slices = [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)]
        if len(self.cache) > CACHE_SLICES:
            self.cache = {}
        self._learn({x for x in set(slices) if x not in self.cache})
        ids = list(map(self.cache.__getitem__, slices))
        first = np.searchsorted(starts, np.concatenate([[0], ends])).tolist()
        return [b"".join(ids[i:j]) for i, j in zip(first, first[1:], strict=False)]

    def offsets(self, ids: bytes) -> bytes:
        """Byte place at which each id starts in the decoded text."""
        lengths = self.lengths[np.frombuffer(ids, "<u4")]
        return (np.cumsum(lengths, dtype=np.uint32) - lengths).astype("<u4").tobytes()

    def decode(self, ids: bytes, offsets: bytes | None = None) -> bytes:
        """The bytes of a run of ids; kept offsets must agree with them."""
        out = b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if offsets is not None and len(offsets):
            starts = np.frombuffer(offsets, "<u4")
            if len(offsets) != len(ids) or int(starts[-1]) + len(self.vocab[int.from_bytes(ids[-4:], "little")]) != len(out):
                raise ValueError("offsets do not fit the ids")
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Ranks from a tokenizer's JSON file, whose strings stand for bytes by the usual printable alphabet; special tokens are left out."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {x["content"] for x in data.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in word): rank for word, rank in data["model"]["vocab"].items() if word not in special}


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(read_vocabulary(path) if path.endswith(".json") else read_ranks(path))


def _binary(field: str) -> T.StructField:
    return T.StructField(field, T.BinaryType())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", and_decode: bool = False) -> DataFrame:
    """id, ``ids`` and ``offsets`` (little-endian 32-bit integers) of every row of ``docs``; other columns are not looked at.

    With ``and_decode`` the ids are decoded again by the same task, into
    ``decoded``.  Null and empty texts have no ids.  Special tokens' strings
    are ordinary text.  Repeated rows are encoded each; an empty table stays
    empty.  Results leave in slices, so no more than a slice is held encoded.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col))
    schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType), _binary("ids"), _binary("offsets")] + [_binary("decoded")] * and_decode)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids = c.encode([t or "" for t in texts.to_pylist()])
                offsets = [c.offsets(x) for x in ids]
                columns = [batch.column(0).slice(at, len(ids)), pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())]
                if and_decode:
                    columns.append(pa.array([c.decode(x, y) for x, y in zip(ids, offsets, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
            release()

    return rows.mapInArrow(encode, schema)


def decoded(ids: Column, offsets: Column, path: str) -> Column:
    """The bytes that encoded ids stand for."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        c = codec(path)
        for some, places in batches:
            parts = [pa.array([], pa.binary())]
            for at, part in slices(some):
                rows = zip(part.to_pylist(), places.slice(at, len(part)).to_pylist(), strict=True)
                parts.append(pa.array([c.decode(x or b"", y) for x, y in rows], pa.binary()))
            yield pa.concat_arrays(parts)

    return decode(ids, offsets)


def decode_documents(codes: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the text, to the rows that encode_documents returns."""
    ship(codes.sparkSession)
    return codes.withColumn("decoded", decoded(F.col("ids"), F.col("offsets"), path))
