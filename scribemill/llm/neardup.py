"""Near-duplicate groups by MinHash with tensored banding and full verification.

A text's set holds its distinct two-word shingles as 64-bit numbers. Instead of
one independent hash group per table, two small collections of 12 groups of
three minhashes are drawn; a table key combines group i of the first with group
j of the second, so 72 minhashes give 144 tables of six. A pair of similarity 0.8
shares a key with probability 0.9996, one of 0.02 with 1e-8.

Texts with equal sets form a class first, and only one member goes on. In each
table entry the smallest member is the hub; all members that share a hub form
its group. Any two texts that share a key share a hub, so comparing all members
of a group on full sets loses no candidate. Groups are cut into tiles of bounded
size, each tile is compared by a matrix product over the shingles its members
share, and returns only links that join its members, never all pairs. Links are
then closed to components.

Scale: texts are read twice and never shuffled. Keys are reduced to entries with
two members before hubs are joined back; minima are formed before rows move, and
a hot entry is an ordinary skewed join. Full sets move only for members of a
group. A group of g similar texts costs g * g / 256 moved sets.

Defined results: a null text, or one without words, has an empty set, a
component of its own and is kept; one word is one shingle. Rows with equal ids
count as one document. A row without an id takes part in no link and gets no
component; it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribemill.llm.components import component_labels
from scribemill.session import stage

PERCENT = 80
SHINGLE_WORDS = 2
TABLES = 12
BAND = 3
SEED = 20_240_229
# Members and shingles of one block; a tile holds two blocks.
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 1 << 18
# Ids of candidates and hubs are broadcast up to this many, joined by a shuffle beyond.
BROADCAST_IDS = 500_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``n`` words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.int64)
    if len(words) < n:
        found = {b" ".join(words)}
    elif n == 2:
        found = {a + b" " + b for a, b in zip(words, words[1:])}
    else:
        found = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
    import xxhash

    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    hashed.sort()
    return hashed.view(np.int64)


def minhash(values: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest of the values under each seeded mixing."""
    factor, offset = seeds
    low = np.full(len(factor), np.iinfo(np.uint64).max, dtype=np.uint64)
    raw = values.view(np.uint64)
    for at in range(0, len(raw), 1024):
        mixed = raw[at : at + 1024, None] * factor + offset
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, mixed.min(axis=0), out=low)
    return low


def _seeds(tables: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    n = 2 * tables * band
    return draw.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), draw.integers(0, 2**63, n, dtype=np.uint64)


def sketches(docs: DataFrame, id_column: str, text: str, n: int, tables: int, band: int) -> DataFrame:
    """Per row: id, n_shingles, a 128-bit digest of the set, and the two collections of hash groups."""
    seeds = _seeds(tables, band)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, k1, k2, first, second = [], [], [], [], []
            for one in batch.column(1):
                found = shingles(one.as_py(), n)
                digest = blake2b(found.tobytes(), digest_size=16).digest()
                sizes.append(len(found))
                k1.append(int.from_bytes(digest[:8], "little", signed=True))
                k2.append(int.from_bytes(digest[8:], "little", signed=True))
                # A group is one number: its minhashes multiplied into each other with its place.
                low = minhash(found, seeds).reshape(2 * tables, band)
                group = np.arange(1, 2 * tables + 1, dtype=np.uint64)
                for i in range(band):
                    group = (group ^ low[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                    group ^= group >> np.uint64(32)
                group = group.view(np.int64)
                first.append(group[:tables] if len(found) else [])
                second.append(group[tables:] if len(found) else [])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(first, lists), pa.array(second, lists)],
                names=["id", "n", "k1", "k2", "first", "second"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(sketch, "id long, n long, k1 long, k2 long, first array<long>, second array<long>")


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """Columns id and grams of rows with columns id and text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([shingles(t.as_py(), n) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], names=["id", "grams"])

    return rows.select("id", "text").mapInArrow(sets, "id long, grams array<long>")


def links_in_tile(ids: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of two blocks (or inside the one), as few as keep their components.

    Intersections are a matrix product over the shingles that two members hold, in slices of columns.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held >= 2
    renumber = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], renumber[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    total = int(shared.sum())
    for at in range(0, total, 8192):
        lo, hi = np.searchsorted(column, [at, min(total, at + 8192)])
        dense = np.zeros((n, min(8192, total - at)), dtype=np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1.0
        common += dense @ dense.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if blocks.min() != blocks.max():  # pairs inside one block belong to that block's own tile
        linked &= blocks[:, None] != blocks[None, :]
    np.fill_diagonal(linked, False)
    seen, out = np.zeros(n, dtype=bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        reached = [root]
        for at in reached:
            for x in np.flatnonzero(linked[at] & ~seen):
                seen[x] = True
                reached.append(int(x))
                out.append((int(ids[at]), int(ids[x])))
    return out


def tile_links(members: DataFrame, percent: int) -> DataFrame:
    """Links inside tiles. ``members``: hub, i, j, block, id, grams, one row per member and tile."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(ids, blocks, sets):
            found = links_in_tile(np.array(ids), np.array(blocks), sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"]
            )

        tile, ids, blocks, sets = None, [], [], []
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(3)]))
            own_blocks, own_ids, grams = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            flat, ends = grams.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *[len(g) for g in grams]])
            for row, key in enumerate(keys):
                if key != tile:
                    if len(ids) > 1:
                        yield links(ids, blocks, sets)
                    tile, ids, blocks, sets = key, [], [], []
                ids.append(own_ids[row])
                blocks.append(own_blocks[row])
                sets.append(flat[ends[row] : ends[row + 1]].copy())
        yield links(ids, blocks, sets)

    columns = ["hub", "i", "j", "block", "id", "grams"]
    dealt = members.select(*columns).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "id")
    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    shingle_words: int = SHINGLE_WORDS,
    tables: int = TABLES,
    band: int = BAND,
) -> DataFrame:
    """One row per input row: its id, n_shingles, component_id and kept."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = stage(sketches(rows, "id", "text", shingle_words, tables, band), "sketches")
    named = sketch.where("n > 0 and id is not null")
    # Classes of equal sets: only those with a second member need to be written down.
    classes = stage(
        named.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").drop("last"), "classes"
    )
    of_class = sketch.select("id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left").withColumn(
        "rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id"))
    )
    copies = of_class.where("id <> rep").select("id")
    keys = named.join(copies, "id", "left_anti").select(
        "id",
        F.explode(F.flatten(F.transform("first", lambda x: F.transform("second", lambda y: F.xxhash64(x, y))))).alias("key"),
    )
    live = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("far")).where("hub < far").select("key", "hub")
    live = stage(live, "entries")
    stars = stage(keys.join(live, "key").select("hub", "id").distinct(), "stars")
    wanted = stage(stars.select("id").distinct(), "candidates")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = stage(shingle_sets(rows.join(wanted, "id", "left_semi"), shingle_words), "sets")
    sized = stars.join(named.select("id", "n").dropDuplicates(["id"]), "id")
    groups = (
        sized.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("grams"))
        .where("members > 1")
        .select("hub", F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("grams") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    # Staged, so that its size is known and a hub of very many members can be split in the join.
    groups = stage(groups, "groups")
    if groups.count() <= BROADCAST_IDS:
        groups = F.broadcast(groups)
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tiled = stars.join(groups, "hub").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = tiled.select("hub", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(sets, "id")
    labels = component_labels(tile_links(members, percent))
    return of_class.join(labels, of_class["rep"] == labels["node"], "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep").alias("component_id"),
    ).withColumn("kept", F.when(F.col(id_column).isNull(), F.col("component_id").isNull()).otherwise(F.col(id_column) == F.col("component_id")))
