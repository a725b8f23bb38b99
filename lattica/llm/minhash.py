"""N-gram Jaccard join: MinHash bands propose, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, KeyFilter, checkpointed, pieces, release, ship, slice_by_slice
from .words import hashed, mix, windows

WORDS, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.9995, 6
#: Texts and bytes of a block: what a task holds of a family is two of them.
BLOCK, BLOCK_BYTES = 128, 1 << 20
COLUMNS = 2048
#: Parts into which the rows of one key are dealt in joins, so that a crowded key meets in no single task; rows that make a key crowded.
SALTS, CROWD = 8, 10_000


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` values each with which a pair at ``similarity`` shares one with probability ``recall`` at least."""
    if similarity >= 1:
        return 1
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words has one n-gram, all its words, and none if it has no word."""
    out: list[np.ndarray] = []
    for a, b in pieces([len(t) for t in texts], SLICE_BYTES):
        w = hashed(texts[a:b])
        grams, first = windows(w, size)
        for k in range(b - a):
            n = int(w.first[k + 1] - w.first[k])
            if n >= size:
                out.append(np.unique(grams[first[k] : first[k + 1]]))
            elif n:
                h = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in w.hashes[w.first[k] : w.first[k + 1]]:
                        h = mix(np.array([h * np.uint64(0x100000001B3) ^ x], np.uint64))[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> list[list[int]]:
    """Hash of each band's MinHash values, different between bands; no bands for an empty set."""
    index = np.arange(1, bands * rows + 1, dtype=np.uint64)
    a = (mix(index) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (mix(index + np.uint64(1 << 20)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(1 << 40))
    out = []
    with np.errstate(over="ignore"):
        for s in sets:
            if not len(s):
                out.append([])
                continue
            low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
            least = np.full(len(a), 0xFFFFFFFF, np.uint32)
            for k in range(0, len(low), 2048):
                v = low[None, k : k + 2048] * a[:, None]
                v ^= v >> np.uint32(15)
                v *= b[:, None]
                np.minimum(least, v.min(axis=1), out=least)
            h = salt.copy()
            for column in least.reshape(bands, rows).T:
                h = mix(h * np.uint64(0x100000001B3) ^ column.astype(np.uint64))
            out.append(h.view(np.int64).tolist())
    return out


def salt_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def salted_join(rows: DataFrame, few: DataFrame, key: str, spread: str, how: str = "inner", many: Column | None = None) -> DataFrame:
    """Joins ``few`` (one row for each key) to ``rows``, of which one key may hold a great share: they are dealt by ``spread`` as well.

    Where ``few`` tells how ``many`` rows a key has, crowded keys alone are
    dealt; a filter of fixed size, asked on both sides, names them.
    """
    salt, salts = salt_of(spread), F.array(*[F.lit(k) for k in range(SALTS)])  # a fixed number
    if many is not None:
        crowd = KeyFilter(few.where(many >= CROWD).select(F.xxhash64(key).alias("key")))
        rows, few = (df.withColumn("crowd", crowd.may_hold(F.xxhash64(key))) for df in (rows, few))
        salt, salts = F.when(F.col("crowd"), salt).otherwise(0), F.when(F.col("crowd"), salts).otherwise(F.array(F.lit(0)))
    rows, few = rows.withColumn("salt", salt).drop("crowd"), few.withColumn("salt", F.explode(salts)).drop("crowd")
    return rows.join(few, [key, "salt"], how).drop("salt")


def components(edges: DataFrame, shared_only: bool = False) -> DataFrame:
    """(node, hub) edges to (node, root): nodes that share a hub, directly or through others, get one root, a node of theirs.

    Hubs take the least node seen near them and are merged as they meet, with
    every step a pre-aggregated minimum, until each node has one hub only.  The
    nodes of one hub are dealt over SALTS parts.  With ``shared_only`` hubs of
    one node are left out, and so are nodes that have no other.
    """
    edges = edges.distinct().withColumn("salt", salt_of("node"))
    parts = edges.groupBy("hub", "salt").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("c"))
    least = parts.groupBy("hub").agg(F.min("m").alias("to"), F.sum("c").alias("c")).where(F.col("c") > (1 if shared_only else 0))
    each = parts.select("hub", "salt").join(least.select("hub", "to"), "hub")  # at most SALTS rows of a hub
    now = checkpointed(edges.join(each, ["hub", "salt"]).select("node", F.col("to").alias("hub")).distinct())
    while True:
        by_node = now.groupBy("node").agg(F.min("hub").alias("m"), F.count(F.lit(1)).alias("c"))
        if not by_node.where(F.col("c") > 1).limit(1).count():
            return now.select("node", F.col("hub").alias("root"))
        hubs = checkpointed(now.join(by_node, "node").groupBy("hub").agg(F.min("m").alias("to")))
        for _ in range(2):  # pointer jumps shorten chains of hubs
            far = hubs.select(F.col("hub").alias("to"), F.col("to").alias("far"))
            hubs = salted_join(hubs, far, "to", "hub", "left").select("hub", F.coalesce("far", "to").alias("to"))
        now = checkpointed(salted_join(now, hubs, "hub", "node").select("node", F.col("to").alias("hub")).distinct())


def link_matrix(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of ``threshold`` or more; none with itself."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes.astype(np.int64))
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1 if len(values) else new  # a shingle of one text only is in no intersection
    column, owner = column[often], owner[often]
    common = np.zeros((n, n))  # whole numbers, and a test below without float32's rounding
    if len(column):
        fresh = np.concatenate([[True], column[1:] != column[:-1]])
        column = np.cumsum(fresh) - 1
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + COLUMNS, COLUMNS))
        for k in range(len(cuts) - 1):
            part = np.zeros((n, COLUMNS), np.float32)
            part[owner[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - k * COLUMNS] = 1
            common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    links = common >= threshold * union * (1 - 1e-12)
    np.fill_diagonal(links, False)
    links[sizes == 0] = False
    links[:, sizes == 0] = False
    return links


def local_roots(links: np.ndarray) -> np.ndarray:
    """Least place in each node's component."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def as_key(column: str) -> Column:
    """An id that can be joined even where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def digest_of(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def candidate_families(docs: DataFrame, words: int, similarity: float, recall: float, rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, text, digest), distinct texts (digest, bands, bytes, first_id, copies), and those of families (node, root, first_id, copies, bytes).

    Texts that share a band, directly or through others, form a family.
    """
    ship(docs.sparkSession)
    bands = bands_for(similarity, recall, rows)
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))

    @F.arrow_udf("array<bigint>")
    def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return slice_by_slice(batches, lambda some: pa.array(band_hashes(shingle_sets([t.encode() for t in some.to_pylist()], words), bands, rows), pa.list_(pa.int64())))

    # Equal texts have equal bands, so copies collapse before the shuffle.
    texts = checkpointed(
        plain.select("id", "digest", F.octet_length("text").cast("long").alias("bytes"), signature.asNondeterministic()(F.col("text")).alias("bands"))
        .groupBy("digest", "bands", "bytes")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    )
    crowded = checkpointed(texts.select(F.explode("bands").alias("hub")).groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("hub"))
    edges = checkpointed(texts.select(F.col("digest").alias("node"), F.explode(KeyFilter(crowded).only_held(F.col("bands"))).alias("hub")))
    families = checkpointed(components(edges, shared_only=True).join(texts.select(F.col("digest").alias("node"), "first_id", "copies", "bytes"), "node"))
    return plain, texts, families


def blocks_of(which: Column) -> Column:
    """Blocks that the texts of a group for which ``which`` holds are cut into."""
    return F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.sum(F.when(which, F.col("bytes")).otherwise(0)) / BLOCK_BYTES)).cast("int")


def dealt_into(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def in_blocks(families: DataFrame) -> DataFrame:
    """Families with their number of blocks and each text's block."""
    return salted_join(families, families.groupBy("root").agg(blocks_of(F.lit(True)).alias("blocks")), "root", "node").withColumn("block", dealt_into("blocks"))


def decided(plain: DataFrame, family: DataFrame, partners: Column, words: int, similarity: float, apart: bool) -> DataFrame:
    """(digest, hub, links): for each text and each pair of blocks in which it has a link, a text it is joined to and its links.

    ``partners`` are the blocks that a text's own block is paired with.  Pairs
    of blocks are dealt to tasks in turn, so no family is held in one task.
    With ``apart`` a pair of different blocks tells only of links between the
    two, so that each link is counted once; without, of links inside them too.
    """
    # One row for each text of a family: repeated rows collapse on the way to the join, by the key of the join.
    inside = KeyFilter(family.select(F.xxhash64("node").alias("key")))
    wanted = plain.where(inside.may_hold(F.xxhash64("digest"))).withColumn("key", as_key("id")).groupBy("key", "digest").agg(F.first("text").alias("text"))
    members = wanted.join(family.select(as_key("first_id").alias("key"), F.col("node").alias("digest"), "root", "copies", "blocks", "block", partners.alias("partners")), ["key", "digest"])
    low, high, n = F.col("low"), F.col("high"), F.col("blocks")
    tasks = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_turn = F.pmod(F.xxhash64("root") + low * n - (low * (low - 1) / 2).cast("long") + high - low, F.lit(tasks)).cast("int")
    pairs = members.select(
        "root",
        "digest",
        "copies",
        "blocks",
        "block",
        "text",
        F.explode(F.transform("partners", lambda k: F.struct(F.least(k, F.col("block")).cast("long").alias("low"), F.greatest(k, F.col("block")).cast("long").alias("high")))).alias("pair"),
    ).select("root", "pair.low", "pair.high", "digest", "copies", "blocks", "block", "text")
    pairs = pairs.select("root", "low", "high", "digest", "copies", "block", "text", in_turn.alias("task"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        key = None
        for batch in batches:
            columns = batch.to_pydict()
            for row in zip(*(columns[c] for c in ("root", "low", "high", "digest", "copies", "block", "text")), strict=True):
                if row[:3] != key and held:
                    yield from decide(key, held)
                    held = {}
                key = row[:3]
                for name, x in zip(("digest", "copies", "block", "text"), row[3:], strict=True):
                    held.setdefault(name, []).append(x)
        if held:
            yield from decide(key, held)
        release()

    def decide(key: tuple, held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        links = link_matrix(shingle_sets([t.encode() for t in held["text"]], words), similarity)
        block, copies = np.array(held["block"]), np.array(held["copies"], np.int64)
        if apart and key[1] != key[2]:  # inside a block, pairs are counted by the task of that block alone
            links &= block[:, None] != block[None, :]
        some = np.flatnonzero(links.any(axis=1))
        if len(some):
            root = local_roots(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([held["digest"][k] for k in some], pa.binary()), pa.array([held["digest"][root[k]] for k in some], pa.binary()), pa.array((links[some] @ copies), pa.int64())],
                ["digest", "hub", "links"],
            )

    dealt = pairs.repartitionById(tasks, F.col("task")).sortWithinPartitions("root", "low", "high")
    return checkpointed(dealt.mapInArrow(verify, "digest binary, hub binary, links bigint"))


def joined_by(found: DataFrame) -> DataFrame:
    """(digest, root) of the texts that links join."""
    return components(found.select(F.col("digest").alias("node"), "hub")).select(F.col("node").alias("digest"), "root")


def jaccard_links(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links of each distinct text: (digest, class_id, n_links, first_id, root).

    Texts are one class of copies by digest.  MinHash bands (their number
    follows from ``recall`` at ``similarity``) are shuffled as counts of each
    band's texts; texts that share a band, directly or through others, form a
    family, and only families see their texts again (a filter of fixed size
    keeps the others from the shuffle): every pair inside one is decided on
    the full n-gram sets.  Families of more than a block are cut into blocks,
    every pair of blocks is decided by itself, and the pairs are dealt to tasks
    in turn, so no family is ever held in one task and what leaves a task is a
    count and a root for each text, never the pairs.

    ``class_id`` is the least id of all texts linked directly or through
    others, ``root`` the digest that stands for that class (ids may be null or
    repeated, so class_id does not); ``n_links`` is the number of other
    documents at ``similarity`` or more, copies included; ``first_id`` is the
    least id of the text's own copies.  Texts without a word link to their
    copies only.  Null texts count as empty, null ids are passed over unless a
    class has no other.  Repeated rows are copies; an empty table has no
    links; a very long text is a block of its own.
    """
    plain, texts, families = candidate_families(docs, words, similarity, recall, rows, id_col, text_col)
    found = decided(plain, in_blocks(families), F.sequence(F.lit(0), F.col("blocks") - 1), words, similarity, apart=True)
    near = joined_by(found).join(found.groupBy("digest").agg(F.sum("links").alias("links")), "digest")
    table = checkpointed(texts.select("digest", "first_id", "copies").join(near, "digest", "left").withColumn("root", F.coalesce("root", "digest")))
    least = table.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("texts"))
    return salted_join(table, least, "root", "digest", many=F.col("texts")).select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first_id", "root")


def near_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The classes of ``jaccard_links`` without its counts: (digest, first_id, root, alone) of each distinct text.

    Which texts are joined can be told without deciding every pair.  A family's
    blocks are first paired with its block 0 alone, which is linear in the
    family; of the texts so joined the most numerous class needs no pairs
    inside it any more.  What is left of the family is then compared with all
    of it, so no link is lost.  Where a family has a core of near copies, as a
    page's many versions have, little is left; where it has none, the work is
    that of ``jaccard_links``.  ``alone`` texts have neither copy nor link.
    """
    plain, texts, families = candidate_families(docs, words, similarity, recall, rows, id_col, text_col)
    family = checkpointed(in_blocks(families))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    found = decided(plain, family, F.when(F.col("block") == 0, every).otherwise(F.array(F.lit(0))), words, similarity, apart=False)
    parts = joined_by(found).select(F.col("digest").alias("node"), F.col("root").alias("part"))
    large = checkpointed(family.where("blocks > 1").drop("blocks", "block").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")))
    core = large.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max(F.struct("n", "part"))["part"].alias("core"), F.count(F.lit(1)).alias("parts"))
    left = checkpointed(salted_join(large, core.where("parts > 1"), "root", "node").withColumn("rest", F.col("part") != F.col("core")).drop("part", "core", "parts"))
    if left.limit(1).count():
        # Blocks of the rest come first: they are paired with all blocks, those of the core with them.
        cut = left.groupBy("root").agg(blocks_of(F.col("rest")).alias("rests"), blocks_of(~F.col("rest")).alias("cores"))
        left = salted_join(left, cut, "root", "node").withColumn("blocks", F.col("rests") + F.col("cores")).withColumn("block", F.when(F.col("rest"), dealt_into("rests")).otherwise(F.col("rests") + dealt_into("cores")))
        found = found.unionByName(decided(plain, left, F.when(F.col("rest"), every).otherwise(F.sequence(F.lit(0), F.col("rests") - 1)), words, similarity, apart=False))
        parts = joined_by(found).select(F.col("digest").alias("node"), F.col("root").alias("part"))
    near = parts.select(F.col("node").alias("digest"), F.col("part").alias("root"))
    linked = texts.select("digest", "first_id", "copies").join(near, "digest", "left")
    return linked.select("digest", "first_id", F.coalesce("root", "digest").alias("root"), (F.col("root").isNull() & (F.col("copies") == 1)).alias("alone"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row for each row of ``docs``: id, ``class_id``, ``n_links`` and ``copy_of`` (least id of the equal texts); cases as in ``jaccard_links``."""
    links = checkpointed(jaccard_links(docs, id_col=id_col, text_col=text_col, **settings))
    rows = docs.select(F.col(id_col).alias("id"), digest_of(text_col).alias("digest"))
    return salted_join(rows, links, "digest", "id", many=F.col("n_links")).select(F.col("id").alias(id_col), "class_id", "n_links", F.col("first_id").alias("copy_of"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each class, that of the least id, with all its columns, whatever they are called.

    Only rows of texts that have a link take part in a shuffle; all others are
    kept where they are.  Null texts are copies of the empty text.  Of rows
    with equal id and text the one whose other columns come first as JSON
    stays.  A null id comes after all others.  An empty table stays empty.
    """
    links = checkpointed(near_classes(docs, id_col=id_col, text_col=text_col, **settings))
    linked = KeyFilter(links.where(~F.col("alone")).select(F.xxhash64("digest").alias("key")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest_of(text_col).alias("digest"))
    rows = rows.withColumn("may", linked.may_hold(F.xxhash64("digest")))
    first = F.min(F.struct(F.col("first_id").isNull(), "first_id", "digest"))
    keep = links.where(linked.may_hold(F.xxhash64("digest"))).groupBy("root").agg(first.alias("first")).select(F.col("first.first_id").alias("keep_id"), F.col("first.digest").alias("keep_digest"))
    some = rows.where("may").join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest")), "left_semi")
    one = some.groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.where(~F.col("may")).select("row").unionByName(one.select("row")).select("row.*")
