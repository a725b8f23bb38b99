"""Personal data by a skip-chain conditional random field over the words that may carry it.

Exact patterns give the base spans.  The field's nodes are the words with a
digit or an at sign; neighbouring nodes are joined in a chain, and repeated or
similar words of a document share skip edges, so that loopy message passing
spreads a label from where a pattern shows it to where the pattern fails.  Node
scores, chain scores and the strength of skip edges are fitted together, by
pseudo-likelihood, to the base spans of the whole corpus.  Words of which the
base spans tell nothing train nothing: those inside a match that was dropped
for running on too long (it may hold a true one), and those that repeat a
caught word without being caught.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, ship, slice_by_slice, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
SURE = 0.9
#: Messages pass until none changes by SETTLED; loops that never settle are left after MOST_ROUNDS.
SETTLED, MOST_ROUNDS, DAMPING = 1e-4, 200, 0.3
#: Where the strength of skip edges is expected before the corpus is seen (the score of equal labels, and minus that of different ones), and how firmly.
TIE, TIE_WEIGHT = 2.5, 0.02
RIDGE, STEPS = 1e-4, 600
SHORT_KEY = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits begins, so the looks behind change no result and keep the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
# Words with a digit or an at sign; only places where a word begins are tried, so long words without either stay linear.
_WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_DIGITS = re.compile(r"[0-9]")
_EDGES = ".,;:!?\"'<>[]{}()#$%&*|"
#: What is cut off before an added span, by its label: a phone number may begin with a bracket.
_OPENERS = {1: _EDGES, 2: _EDGES, 3: _EDGES, 4: _EDGES.replace("(", "")}

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", at + 1 if not m else m.end())


#: What is known of a dropped match: it cannot be one (other letters than a kind's), or it ran on too long and may hold one.
TOO_LONG = "*"


def base_spans(text: str, dropped: list[tuple[int, int, str]] | None = None) -> list[Span]:
    """(start, end, kind) of every base match, by start and then kind; matches that fail go to ``dropped`` with the reason."""
    if not _SIGN.search(text):
        return []
    drop = (lambda m, why: dropped.append((m.start(), m.end(), why))) if dropped is not None else (lambda m, why: None)
    out: list[Span] = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
        else:
            drop(m, "i")
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
        elif len(digits) >= 14:
            drop(m, TOO_LONG if len(digits) > 19 else "c")
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(_DIGITS.findall(m[0]))
            if 10 <= n <= 15:
                out.append((m.start(), m.end(), 3))
            else:
                drop(m, TOO_LONG if n > 15 else "p")
    out.sort(key=lambda s: (s[0], s[2]))
    return out


class Covers:
    """Which of many ranges, ordered by their starts, is the first to touch a given one."""

    def __init__(self, ranges: list[tuple]):
        self.ranges = ranges
        self.upto = list(itertools.accumulate((r[1] for r in ranges), max))

    def first(self, a: int, b: int) -> tuple | None:
        k = bisect.bisect_right(self.upto, a)
        return self.ranges[k] if k < len(self.ranges) and self.ranges[k][0] < b else None


@dataclass
class Graph:
    """Nodes of one text: places, feature patterns, labels shown by base spans, and those of which nothing is known; edges between nodes."""

    places: list[tuple[int, int]]
    patterns: list[str]
    labels: list[int]
    unknown: list[bool]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _bucket(n: int) -> str:
    return "0" if not n else "a" if n < 3 else "b" if n < 6 else "c" if n < 8 else "d" if n < 10 else "e" if n < 14 else "f" if n < 20 else "g"


def _shape(word: str) -> str:
    """A word's discrete features, one character each."""
    digits = "".join(_DIGITS.findall(word))
    mixed = any(c.isalpha() for c in word)
    check = ("L" if luhn(digits) else "l") if 14 <= len(digits) <= 19 and not mixed else "-"
    return _bucket(len(digits)) + "".join("01"[x] for x in ("@" in word, mixed, "+" in word, "(" in word, "-" in word)) + str(min(word.count("."), 4)) + check


def hidden(text: str, span: Span, share: float) -> bool:
    """Whether a base span is among the ``share`` that an experiment hides: by its own characters and place."""
    return share > 0 and zlib.crc32(f"{span[0]}:{text[span[0] : span[1]]}".encode()) < share * 2**32


def graph(text: str, spans: list[Span], dropped: list[tuple[int, int, str]], secret: list[Span] = ()) -> Graph:
    """The field of one text; words of ``secret`` spans are shown no label."""
    g = Graph([], [], [], [], [], [])
    base, failed = Covers([s for s in spans if s not in set(secret)]), Covers(sorted(dropped))
    hush = Covers(list(secret))
    keys: list[set[str]] = []
    words = [m.span() for m in _WORD.finditer(text)]
    shapes = [_shape(text[a:b]) for a, b in words]
    beside = [k > 0 and not _SOLID.search(text, words[k - 1][1], words[k][0]) for k in range(len(words))] + [False]
    for k, (a, b) in enumerate(words):
        found, why = base.first(a, b), failed.first(a, b)
        g.places.append((a, b))
        g.labels.append(found[2] + 1 if found else 0)
        g.unknown.append(not found and (bool(why and why[2] == TOO_LONG) or bool(hush.first(a, b))))
        mark = why[2] if why and why[2] != TOO_LONG and not found else "-"
        g.patterns.append(f"{shapes[k]}{mark}|{shapes[k - 1][:5] if beside[k] else '-'}|{shapes[k + 1][:5] if beside[k + 1] else '-'}")
        if beside[k]:
            g.chain.append((k - 1, k))
        word = text[a:b].strip(_EDGES).lower()
        digits = "".join(_DIGITS.findall(word))
        similar = {"w" + word} if len(word) >= SHORT_KEY else set()
        if len(digits) >= SHORT_KEY:
            similar |= {"d" + digits, "e" + digits[-7:]}
        keys.append(similar)
    # Every word is tied to hubs of its keys: the first word caught as each kind, whose label is certain, or the first word if none is.
    hubs: dict[str, dict[int, int]] = {}
    for i, similar in enumerate(keys):
        for x in similar:
            hubs.setdefault(x, {}).setdefault(g.labels[i], i)
    for i, similar in enumerate(keys):
        tied = {j for x in similar for label, j in hubs[x].items() if label or len(hubs[x]) == 1} - {i}
        if not g.labels[i]:
            g.unknown[i] = g.unknown[i] or any(g.labels[j] for j in tied)
        g.skip += [(j, i) for j in sorted(tied)]
    return g


def examples(g: Graph) -> Iterator[tuple[str, str]]:
    """(label, what its score depends on: pattern, labels of both chain neighbours, labels of the words it is tied to) of every node whose label is known.

    A neighbour of unknown label counts as none, written ``-``.
    """
    shown = ["-" if u else str(x) for x, u in zip(g.labels, g.unknown, strict=True)]
    before, after, ties = ["-"] * len(shown), ["-"] * len(shown), [""] * len(shown)
    for a, b in g.chain:
        before[b], after[a] = shown[a], shown[b]
    for a, b in g.skip:
        if not g.unknown[a]:
            ties[b] += shown[a]
    for k, label in enumerate(g.labels):
        if not g.unknown[k]:
            yield str(label), f"{g.patterns[k]}|{before[k]}|{after[k]}|{''.join(sorted(ties[k]))}"


@dataclass
class Weights:
    """Node scores by pattern (with a feature model for unseen ones), and edge scores."""

    features: dict[str, int]
    theta: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def node(self, pattern: str) -> np.ndarray:
        s = self.theta[[self.features[f] for f in features_of(pattern) if f in self.features]].sum(axis=0) + self.theta[-1]
        return s - np.logaddexp.reduce(s)


def features_of(pattern: str) -> list[str]:
    shape, before, after = pattern.split("|")[:3]
    return [f"{k}:{c}" for k, c in enumerate(shape)] + ["s:" + shape, "b:" + before, "a:" + after]


def fit_weights(counts: dict[tuple[str, str], int]) -> Weights:
    """Fits node scores, chain scores and the strength of skip edges together, by penalised pseudo-likelihood.

    counts: (label, example as in ``examples``) to a number.  Each example is a
    softmax over labels of its node's score, its neighbours' chain scores and
    its ties, so all three compete for what the labels show.
    """
    seen: dict[str, np.ndarray] = {}
    for (label, key), n in counts.items():
        seen.setdefault(key, np.zeros(LABELS))[int(label)] += n
    keys = sorted(seen)
    names = sorted({f for k in keys for f in features_of(k)})
    index = {f: k for k, f in enumerate(names)}
    theta, chain, tie = np.zeros((len(names) + 1, LABELS)), np.zeros((LABELS, LABELS)), TIE
    if keys:
        x = np.zeros((len(keys), len(names) + 1))
        x[:, -1] = 1
        before, after, ties = np.zeros((len(keys), LABELS)), np.zeros((len(keys), LABELS)), np.zeros((len(keys), LABELS))
        for i, k in enumerate(keys):
            x[i, [index[f] for f in features_of(k)]] = 1
            b, a, t = k.split("|")[3:]
            for row, some in ((before, b), (after, a), (ties, t)):
                for c in some:
                    if c != "-":
                        row[i, int(c)] += 1
        tied = 2 * ties - ties.sum(axis=1, keepdims=True)
        y = np.array([seen[k] for k in keys])
        # Damped counts keep an example that fills the corpus from drowning the others.
        y = y / np.sqrt(y.sum(axis=1, keepdims=True))
        of = y.sum(axis=1, keepdims=True)
        total = y.sum()
        moved = [np.zeros_like(theta), np.zeros_like(chain), 0.0]
        for _ in range(STEPS):
            s = x @ theta + before @ chain + after @ chain.T + tie * tied
            rest = (y - of * np.exp(s - np.logaddexp.reduce(s, axis=1, keepdims=True))) / total
            grads = [x.T @ rest - RIDGE * theta, before.T @ rest + (after.T @ rest).T - RIDGE * chain, float((rest * tied).sum()) - TIE_WEIGHT * (tie - TIE)]
            moved = [0.9 * m + g for m, g in zip(moved, grads, strict=True)]
            theta, chain, tie = theta + 0.5 * moved[0], chain + 0.5 * moved[1], tie + 0.5 * moved[2]
    return Weights(index, theta, chain, tie * (2 * np.eye(LABELS) - 1))


def marginals(unary: np.ndarray, edges: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Loopy sum-product beliefs; edges: (i, j) rows, potential: one LABELS x LABELS table for each edge."""
    if not len(edges):
        return np.exp(unary - np.logaddexp.reduce(unary, axis=1, keepdims=True))
    i, j = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    tables = np.concatenate([potential, potential.transpose(0, 2, 1)])
    opposite = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(i), LABELS))
    for _ in range(MOST_ROUNDS):
        belief = unary.copy()
        np.add.at(belief, j, message)
        new = np.logaddexp.reduce(tables + (belief[i] - message[opposite])[:, :, None], axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        new = DAMPING * message + (1 - DAMPING) * new
        change = np.abs(new - message).max()
        message = new
        if change < SETTLED:
            break
    belief = unary.copy()
    np.add.at(belief, j, message)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def beliefs(graphs: list[Graph], w: Weights, known: dict[str, np.ndarray]) -> np.ndarray:
    """Each node's label probabilities, a caught word's given: it speaks to its neighbours and hears none, so only the others pass messages."""
    first = np.cumsum([0] + [len(g.places) for g in graphs])
    unary = np.zeros((first[-1], LABELS))
    labels = np.array([x for g in graphs for x in g.labels], np.int64)
    for at, g in zip(first, graphs, strict=False):
        for k, (p, label) in enumerate(zip(g.patterns, g.labels, strict=True)):
            if not label:
                if p not in known:
                    known[p] = w.node(p)
                unary[at + k] = known[p]
    edges, tables = [], []
    for of, table in ((0, w.chain), (1, w.skip)):
        pairs = np.array([(at + a, at + b) for at, g in zip(first, graphs, strict=False) for a, b in (g.skip if of else g.chain)], np.int64).reshape(-1, 2)
        a, b = labels[pairs[:, 0]], labels[pairs[:, 1]]
        np.add.at(unary, pairs[(a > 0) & (b == 0), 1], table[a[(a > 0) & (b == 0)]])
        np.add.at(unary, pairs[(a == 0) & (b > 0), 0], table.T[b[(a == 0) & (b > 0)]])
        free = pairs[(a == 0) & (b == 0)]
        edges.append(free)
        tables.append(np.broadcast_to(table, (len(free), LABELS, LABELS)))
    free = np.flatnonzero(labels == 0)
    place = np.zeros(len(labels), np.int64)
    place[free] = np.arange(len(free))
    out = np.zeros((len(labels), LABELS))
    out[np.arange(len(labels)), labels] = 1
    out[free] = marginals(unary[free], place[np.concatenate(edges)], np.concatenate(tables))
    return out


def added_spans(texts: list[str], graphs: list[Graph], w: Weights, known: dict[str, np.ndarray]) -> list[list[Span]]:
    """Spans that the field adds to the base ones, for all texts at once."""
    belief = beliefs(graphs, w, known)
    best, sure = belief.argmax(axis=1), belief.max(axis=1)
    out = []
    at = 0
    for text, g in zip(texts, graphs, strict=True):
        linked = {b for _, b in g.chain}
        spans: list[Span] = []
        last = -2
        for k, (a, b) in enumerate(g.places):
            label = int(best[at + k])
            if g.labels[k] or not label or sure[at + k] < SURE:
                continue
            word = text[a:b]
            a, b = a + len(word) - len(word.lstrip(_OPENERS[label])), b - (len(word) - len(word.rstrip(_EDGES)))
            if a >= b:
                continue
            if last == k - 1 and k in linked and spans[-1][2] == label - 1 and not (label == 3 and check_of(g.patterns[k]) != "-"):
                spans[-1] = (spans[-1][0], b, label - 1)
            else:
                spans.append((a, b, label - 1))
            last = k
        out.append(spans)
        at += len(g.places)
    return out


def check_of(pattern: str) -> str:
    """The letter of a pattern that tells of a whole card number in one word."""
    return pattern.split("|")[0][-2]


def learn(docs: DataFrame, text_col: str = "text", hide: float = 0.0) -> Weights:
    """Weights from the base spans of all rows; what reaches the driver is one count for each distinct example.

    An example's parts are few: at most 8 * 32 * 5 * 3 * 4 shapes of a word, as
    many neighbours as the first five features of a shape allow, five labels
    of each neighbour, and three ties.  Their number does not follow the input.
    Null and empty texts teach nothing; with no example at all every label is
    as likely and no span is added.  ``hide`` leaves a share of the base spans
    out, as if no pattern had caught them.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in (t for _, some in slices(batch.column(0)) for t in some.to_pylist()):
                if text and _SIGN.search(text):
                    dropped: list = []
                    spans = base_spans(text, dropped)
                    found.update(examples(graph(text, spans, dropped, [s for s in spans if hidden(text, s, hide)])))
            batch = text = None
        release()
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["what", "key", "n"]
        )

    total = docs.select(F.col(text_col)).mapInArrow(count, "what string, key string, n bigint").groupBy("what", "key").agg(F.sum("n").alias("n"))
    return fit_weights({(r["what"], r["key"]): r["n"] for r in total.collect()})


def find(texts: list[str], w: Weights, known: dict[str, np.ndarray], hide: float = 0.0) -> list[list[tuple[int, int, int, bool]]]:
    """All spans of each text as (start, end, kind, base), by start and then kind; a hidden base span is there only if the field finds it."""
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    some = [k for k, t in enumerate(texts) if _SIGN.search(t)]
    base, graphs = [], []
    for k in some:
        dropped: list = []
        spans = base_spans(texts[k], dropped)
        secret = [s for s in spans if hidden(texts[k], s, hide)]
        graphs.append(graph(texts[k], spans, dropped, secret))
        base.append([s for s in spans if s not in set(secret)])
    if not some:
        return out
    for k, s, more in zip(some, base, added_spans([texts[k] for k in some], graphs, w, known), strict=True):
        taken = Covers(s)
        spans = [(*x, True) for x in s] + [(*x, False) for x in more if not taken.first(x[0], x[1])]
        out[k] = sorted(spans, key=lambda x: (x[0], x[2], x[1]))
    return out


def recovery(docs: DataFrame, hide: float, text_col: str = "text") -> DataFrame:
    """(kind, hidden, found, added): the base spans hidden from learning and finding alike, those the field finds exactly, and all spans it adds."""
    weights = learn(docs, text_col, hide)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((len(KINDS), 3), np.int64)
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            for _, some in slices(batch.column(0)):
                texts = [t or "" for t in some.to_pylist()]
                for text, spans in zip(texts, find(texts, weights, known, hide), strict=True):
                    more = {x[:3] for x in spans if not x[3]}
                    for s in base_spans(text):
                        tally[s[2]] += (hidden(text, s, hide), hidden(text, s, hide) and s in more, 0)
                    for x in more:
                        tally[x[2], 2] += 1
        yield pa.RecordBatch.from_arrays([pa.array(KINDS), *[pa.array(tally[:, k]) for k in range(3)]], ["kind", "hidden", "found", "added"])

    parts = docs.select(F.col(text_col)).mapInArrow(compare, "kind string, hidden bigint, found bigint, added bigint")
    return parts.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("hidden", "found", "added")])


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def with_spans(docs: DataFrame, weights: Weights, into: str, text_col: str = "text") -> DataFrame:
    """Adds ``into``: every span of the text (kind, start, end in code points, whether a base one), by start and then kind.

    Null and empty texts have none.  Repeated rows get equal spans, an empty
    table stays empty, other columns are passed on (one named like ``into`` is
    replaced).  A word that a base span touches is never given a further span.
    A very long text is one field, of which only words with a digit or an at
    sign are held; ties between labels go to the first as listed.
    """
    ship(docs.sparkSession)

    @F.arrow_udf(_SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, np.ndarray] = {}
        for texts in batches:
            found = [x for _, some in slices(texts) for x in find([t or "" for t in some.to_pylist()], weights, known)]
            yield pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, b, k, base in x] for x in found], _ARROW)
            release()

    return docs.withColumn(into, spans.asNondeterministic()(F.col(text_col)))


def cover(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    if text is None or not spans:
        return text
    parts, done = [], 0
    for a, b, kind, _ in spans:
        if a >= done:
            parts += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join(parts) + text[done:]


def masked(text: Column, weights: Weights) -> Column:
    """The text with each span replaced by its kind in square brackets; overlapping spans become one, named by the first.

    A null text stays null and an empty one empty; equal texts give equal ones.
    """

    @F.arrow_udf("string")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, np.ndarray] = {}

        def covered(some: pa.Array) -> pa.Array:
            plain = some.to_pylist()
            return pa.array([cover(t, s) for t, s in zip(plain, find([t or "" for t in plain], weights, known), strict=True)], pa.string())

        return slice_by_slice(batches, covered)

    return mask(text)
