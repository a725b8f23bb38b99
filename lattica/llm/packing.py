"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

The first packings of an island place its documents in random orders, so what
is better than they are comes from crossover: whole well-filled bins of one
packing are injected into another, bins that hold a duplicate are opened, and
the documents this displaces are placed by best fit.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks, read_vocabulary
from .common import checkpointed, ship, slice_by_slice

CAPACITY = 2048
#: Items of one island's problem, islands for each problem, and rounds between migrations.
GROUP, ISLANDS, EPOCHS = 2048, 2, 2
#: Packings of an island, children a generation, generations a round; a round ends early after PATIENCE generations without a bin less.
POPULATION, CHILDREN, GENERATIONS, PATIENCE = 12, 8, 40, 16
#: Share of a packing's bins that are injected, from and to; shares of the other's bins that are opened besides: the emptiest, and any.
INJECTED, EMPTIEST, ANY = (0.2, 0.7), 0.03, 0.1
#: Bins filled less than this are opened again and packed together with those of other groups.
WELL_FILLED = 0.97
#: Rows for each file that is written, at least: on a plain file system the JVM starts a process for each folder, file and checksum.
FILE_ROWS = 1 << 14


@dataclass
class Packing:
    """The bin of each item, and how full each bin is."""

    where: np.ndarray
    fill: np.ndarray

    def cost(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (lower is better)."""
        return len(self.fill), -float(((self.fill / capacity) ** 2).sum())


def best_fit(order: list[int], sizes: list[int], where: list[int], room: list[int], capacity: int) -> None:
    """Puts items, in the given order, each into the bin with the least room that holds it; ``where`` and ``room`` change in place."""
    open_bins = sorted((r, k) for k, r in enumerate(room) if r)
    for item in order:
        size = sizes[item]
        at = bisect.bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            r, k = open_bins.pop(at)
            room[k] = r - size
        else:
            k = len(room)
            room.append(capacity - size)
        where[item] = k
        if room[k]:
            bisect.insort(open_bins, (room[k], k))


def packed(order: np.ndarray, sizes: np.ndarray, capacity: int) -> Packing:
    """All items by best fit in the given order."""
    where, room = [0] * len(sizes), []
    best_fit(order.tolist(), sizes.tolist(), where, room, capacity)
    return Packing(np.array(where, np.int64), capacity - np.array(room, np.int64))


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Injects well-filled bins of ``b`` whole into ``a``, opens the bins that hold a duplicate, and best-fits what that displaced.

    As mutation some further bins of ``a`` are opened, and the displaced items
    come in an order that is falling, or nearly so.
    """
    count = max(1, int(rng.uniform(*INJECTED) * len(b.fill)))
    chosen = np.zeros(len(b.fill), bool)
    chosen[np.argsort(-(b.fill / capacity + 0.03 * rng.random(len(b.fill))), kind="stable")[:count]] = True
    taken = chosen[b.where]
    opened = np.zeros(len(a.fill), bool)
    opened[a.where[taken]] = True
    left = np.flatnonzero(~opened)
    opened[left[np.argsort(a.fill[left], kind="stable")[: int(EMPTIEST * len(a.fill)) + 1]]] = True
    opened[left[rng.random(len(left)) < ANY]] = True
    left = np.flatnonzero(~opened)
    name_a, name_b = np.full(len(a.fill), -1), np.full(len(b.fill), -1)
    name_b[chosen], name_a[left] = np.arange(count), np.arange(len(left)) + count
    where = np.where(taken, name_b[b.where], name_a[a.where])
    displaced = np.flatnonzero(where < 0)
    noise = rng.choice([0.0, 0.02, 0.1]) * rng.random(len(displaced))
    order = displaced[np.argsort(-sizes[displaced] * (1 - noise), kind="stable")]
    room = (capacity - np.concatenate([b.fill[chosen], a.fill[left]])).tolist()
    place = where.tolist()
    best_fit(order.tolist(), sizes.tolist(), place, room, capacity)
    return Packing(np.array(place, np.int64), capacity - np.array(room, np.int64))


def evolve(sizes: np.ndarray, start: list[Packing], capacity: int, seed: int) -> tuple[Packing, list[int], int]:
    """One round on one island: the best packing, its bins at the start and after each generation, and the crossovers made.

    The population is the given packings and others of items in random orders.
    A round ends where no packing can be better.
    """
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    people = [*start, *(packed(rng.permutation(len(sizes)), sizes, capacity) for _ in range(POPULATION - len(start)))]
    people.sort(key=lambda p: p.cost(capacity))
    bins, crossed = [len(people[0].fill)], 0
    while bins[-1] > least and len(bins) <= GENERATIONS and not (len(bins) > PATIENCE and bins[-1] == bins[-1 - PATIENCE]):
        for _ in range(CHILDREN):
            i, j = rng.choice(len(people), 2, replace=False) if len(people) > 1 else (0, 0)
            people.append(crossover(people[i], people[j], sizes, capacity, rng))
            crossed += 1
        unlike = {p.cost(capacity): p for p in people}  # packings of one cost are taken for the same
        people = [unlike[c] for c in sorted(unlike)[:POPULATION]]
        bins.append(len(people[0].fill))
    return people[0], bins, crossed


#: The alternative of the public pattern that looks ahead; it matters only where white space follows white space.
LOOKAHEAD = r"|\s+(?!\S)"
_RUN = re.compile(r"\s\s")


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokens that a JSON vocabulary sets apart from its merges, by their strings."""
    return {t["content"]: t["id"] for t in json.loads(Path(path).read_text()).get("added_tokens", [])} if path.endswith(".json") else {}


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str, added: bool = False) -> Callable[[str], np.ndarray]:
    """Ids of a text by merge ranks; strings of added tokens get those tokens' ids if ``added``, else they are ordinary text.

    Without a lookahead the pattern runs in a plain automaton, so texts with no
    run of white space, which the shorter pattern splits alike, take that way.
    """
    ranks = read_vocabulary(path) if path.endswith(".json") else read_ranks(path)
    special = added_tokens(path) if added else {}
    holds = re.compile("|".join(map(re.escape, special))) if special else None

    @functools.cache
    def by(pattern: str) -> tiktoken.Encoding:
        return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        by_pattern = by(pattern if _RUN.search(text) else pattern.replace(LOOKAHEAD, ""))
        return by_pattern.encode_to_numpy(text, allowed_special="all" if holds and holds.search(text) else set(), disallowed_special=())

    return encode


REPORT = ("first_bins", "group_bins", "crossovers")
_PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
_ARROW = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def cut(ids: np.ndarray, capacity: int) -> list[dict]:
    """Pieces of one document's ids: of ``capacity`` each, but the first, which takes what is left over."""
    first = (len(ids) - 1) % capacity + 1
    edges = [0, *range(first, len(ids) + 1, capacity)]
    return [{"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def cut_documents(docs: DataFrame, vocabulary: str, pattern: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, uid, piece, start, length, ids_crc32) of every piece; ``uid`` differs for every row."""
    ship(docs.sparkSession)

    @F.arrow_udf(_PIECES)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(vocabulary, pattern, added=True)

        def cut_all(some: pa.Array) -> pa.Array:
            ids = (encode(t) if t else np.empty(0, np.uint32) for t in some.to_pylist())
            return pa.array([cut(np.append(x, np.uint32(end_id)).astype("<u4", copy=False), capacity) for x in ids], _ARROW)

        return slice_by_slice(batches, cut_all)

    cuts = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("pieces"))
    return cuts.select("id", F.inline("pieces")).withColumn("uid", F.monotonically_increasing_id())


def _solve(pdf: pd.DataFrame, capacity: int, seed: int, last: bool) -> pd.DataFrame:
    """One island's round: rows of (uid, length, role, bin), role by which elite the bin is of (null bins: none yet).

    In the last round, a packing of the items by falling size joins the population.
    """
    own = pdf[pdf["role"] == pdf["role"].min()].sort_values("uid")
    sizes = own["length"].to_numpy(np.int64)
    start = []
    for _, rows in pdf[pdf["bin"] >= 0].groupby("role"):
        _, where = np.unique(rows.sort_values("uid")["bin"].to_numpy(), return_inverse=True)
        start.append(Packing(where, np.bincount(where, weights=sizes).astype(np.int64)))
    if last:
        start.append(packed(np.argsort(-sizes, kind="stable"), sizes, capacity))
    best, bins, crossed = evolve(sizes, start, capacity, seed)
    order = np.argsort(best.where, kind="stable")
    upto = np.cumsum(sizes[order])
    first = np.concatenate([[0], np.cumsum(best.fill)])[best.where[order]]
    offset = np.empty(len(sizes), np.int64)
    offset[order] = upto - sizes[order] - first
    cost = best.cost(capacity)
    return pd.DataFrame(
        {"uid": own["uid"].to_numpy(), "length": sizes, "group": pdf["group"].iloc[0], "island": pdf["island"].iloc[0], "bin": best.where, "offset": offset, "fill": best.fill[best.where]}
        | {"n_bins": cost[0], "cost": cost[1], "first_bins": own["first_bins"].to_numpy() if (own["bin"] >= 0).all() else bins[0], "crossovers": own["crossovers"].to_numpy() + crossed}
    )


_SOLVED = "uid long, length long, group long, island int, bin long, offset long, fill long, n_bins long, cost double, first_bins long, crossovers long"


def island_round(capacity: int, level: int, epoch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def island(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = hash((int(pdf["group"].iloc[0]), int(pdf["island"].iloc[0]), level, epoch)) & 0x7FFFFFFF
        return _solve(pdf, capacity, seed, epoch == EPOCHS - 1)

    return island


def in_files(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` in no more partitions than FILE_ROWS asks for, to however many its shuffles deal it."""
    return df.coalesce(max(1, -(-n_rows // FILE_ROWS)))


def pack_level(items: DataFrame, n_items: int, level: int, capacity: int) -> DataFrame:
    """Packs items of (uid, length) in groups of about GROUP, each by ISLANDS islands over EPOCHS rounds; the better island's bins stay."""
    groups = max(1, -(-n_items // GROUP))
    # ISLANDS and EPOCHS are bounds of the loop below, not numbers of rows.
    rows = items.select(
        "uid",
        "length",
        F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)).alias("group"),
        F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"),
        F.lit(0).alias("role"),
        F.lit(-1).cast("long").alias("bin"),
        F.lit(0).cast("long").alias("first_bins"),
        F.lit(0).cast("long").alias("crossovers"),
    )
    for epoch in range(EPOCHS):
        solved = rows.groupBy("group", "island").applyInPandas(island_round(capacity, level, epoch), _SOLVED)
        # Each island keeps its elite (role 0) and gets its neighbour's (role 1).
        rows = solved.select("uid", "length", "group", "bin", "first_bins", "crossovers", F.inline(F.array(F.struct(F.col("island"), F.lit(0).alias("role")), F.struct(F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.lit(1).alias("role")))))
    solved = checkpointed(in_files(solved, n_items * ISLANDS))
    best = solved.groupBy("group").agg(F.min(F.struct("n_bins", "cost", "island", "first_bins", "crossovers")).alias("best"))
    winner = best.select("group", "best.island", "best.first_bins", F.col("best.n_bins").alias("group_bins"), "best.crossovers")
    return solved.drop("first_bins", "crossovers").join(winner, ["group", "island"]).select("uid", "length", "group", "bin", "offset", "fill", *REPORT)


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    A document is its ids and then ``end_id``; a null text counts as empty, so
    it is the end alone.  Only longer documents are cut, into pieces of
    ``capacity``; the first may be shorter.  Full pieces are sequences as they
    are.  The others are dealt at random into groups; on each group's islands a
    population of packings evolves, and islands hand their best to a neighbour
    between rounds.  Bins that stay badly filled are opened and packed again
    with those of other groups, as long as that at least halves what is left.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset,
    first_bins, group_bins, crossovers), a row for each piece.  The last three
    tell of the island that placed the piece: the bins of its best packing in
    random order, the bins after evolution, and the crossovers made; they are
    null for full pieces.  Repeated rows are packed each,
    and an empty table gives an empty result.  A very long text is one
    document of many pieces; its ids are held by the task that cuts it.  Other
    columns are not looked at.
    """
    cuts = checkpointed(cut_documents(docs, vocabulary, pattern, capacity, end_id, id_col, text_col))
    full = cuts.where(F.col("length") == capacity).select("uid", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *[F.lit(None).cast("long").alias(c) for c in REPORT])
    left = cuts.where(F.col("length") < capacity).select("uid", "length")
    n_pieces, n = cuts.agg(F.count("*"), F.count_if(F.col("length") < capacity)).first()
    places, level, base = [full], 0, 0
    while n:
        solved = checkpointed(in_files(pack_level(left, n, level, capacity), n))
        groups = max(1, -(-n // GROUP))
        loose = (F.col("fill") < WELL_FILLED * capacity) if groups > 1 else F.lit(False)
        n_left = solved.where(loose).count() if groups > 1 else 0
        if n_left * 2 > n:
            loose, n_left = F.lit(False), 0
        number = F.lit(base) + F.col("group") * GROUP * 4 + F.col("bin")
        places.append(solved.where(~loose).select("uid", (number * 2 + 1).alias("sequence_id"), "offset", *REPORT))
        left, base = solved.where(loose).select("uid", "length"), base + groups * GROUP * 4
        n, level = n_left, level + 1
    placed = cuts.join(functools.reduce(DataFrame.unionByName, places), "uid").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *REPORT)
    return in_files(placed, n_pieces)
