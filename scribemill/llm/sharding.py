"""Histogram sort: shards of near-equal bytes in the order of a key.

The key of a row is (digest of its text, digest of its id), so rows with equal
texts stand side by side and share a shard unless a border falls inside their
group. Borders are found by counting, not by sampling: a pass over the staged
keys sums the exact bytes and rows below candidate borders, spread over all
partitions; borders that are not yet within the tolerance of their target are
probed again, with finer candidates in the one interval that holds the target.
Then every row is moved once, to its range.

Two kinds of borders are sought at the same time: 39 by bytes, which divide the
shards, and further ones by rows, which only divide the work, so that a shard of
many short texts is numbered by several tasks. Rows below each border are known
exactly, so the place of a row in its shard is its place in its range plus a constant.

Kept on the driver: per border one interval, and per pass the sums of the
candidates in the intervals, 256 for each border at most.

Defined results: a null text counts as empty. Rows of equal text and id have
equal keys and stay in one range. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scribemill.llm.common import small_table
from scribemill.session import stage

SHARDS = 40
ROW_BYTES = 16
# A border may miss its target by this share of a shard.
TOLERANCE = 0.002
# Rows that one task numbers, about.
RANGE_ROWS = 2_000_000
FIRST_BITS = 12
NEXT_BITS = 8
LOWEST, HIGHEST = -(2**63), 2**63 - 1


@dataclass
class _Border:
    """A target and, once found, the smallest key above it with what lies below."""

    of: str
    target: int
    slack: float
    low: dict
    key: tuple[int, int] | None = None
    below: dict | None = None

    def settle(self, key: tuple[int, int], below: dict) -> None:
        self.key, self.below = key, below


def _histogram(rows: DataFrame, group: list[Column], key: str) -> list:
    return (
        rows.groupBy(*group)
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
        .collect()
    )


def _probe(border: _Border, cells: list, key_of) -> object | None:
    """Walk the candidates of one interval; settle the border or return the cell that holds its target."""
    below = dict(border.low)
    for cell in cells:
        end = {m: below[m] + cell[m] for m in ("bytes", "rows")}
        if end[border.of] > border.target:
            under, over = border.target - below[border.of], end[border.of] - border.target
            if under <= border.slack or over <= border.slack or cell["rows"] == 1:
                border.settle(*((key_of(cell, False), below) if under <= over else (key_of(cell, True), end)))
                return None
            border.low = below
            return cell
        below = end
    border.settle((HIGHEST, HIGHEST), below)
    return None


def find_borders(rows: DataFrame, targets: list[tuple[str, int, float]]) -> list[_Border]:
    """Keys (k1, k2) at which the rows below reach the targets. ``rows``: k1, k2, size."""
    borders = [_Border(of, target, slack, {"bytes": 0, "rows": 0}) for of, target, slack in targets]
    spark = rows.sparkSession
    # Intervals of the first key, then, inside one value of it, of the second key.
    shift = 64 - FIRST_BITS
    cells = sorted(_histogram(rows, [F.shiftright("k1", shift).alias("cell")], "k1"), key=lambda c: c["first"])
    first = lambda c, after: (c["last"], HIGHEST) if after else (c["first"], LOWEST)
    open_ = {}
    for b in borders:
        if cell := _probe(b, cells, first):
            open_.setdefault((cell["cell"], cell["first"] == cell["last"], cell["first"]), []).append(b)
    deep: dict[int, list[_Border]] = {}
    while open_:
        ready = {k: v for k, v in open_.items() if not k[1]}
        for (_, single, value), found in open_.items():
            if single:
                deep.setdefault(value, []).extend(found)
        if not ready:
            break
        wide = small_table(spark, [(int(k[0]),) for k in ready], "parent long")
        shift, up = max(0, shift - NEXT_BITS), shift
        inside = rows.join(F.broadcast(wide), F.shiftright("k1", up) == F.col("parent"), "left_semi")
        cells = sorted(_histogram(inside, [F.shiftright("k1", up).alias("parent"), F.shiftright("k1", shift).alias("cell")], "k1"), key=lambda c: c["first"])
        open_, by_parent = {}, defaultdict(list)
        for c in cells:
            by_parent[c["parent"]].append(c)
        for (parent, _, _), found in ready.items():
            own = by_parent[parent]
            for b in found:
                if cell := _probe(b, own, first):
                    open_.setdefault((cell["cell"], cell["first"] == cell["last"], cell["first"]), []).append(b)
    shift, held = 64, {(value, 0): found for value, found in deep.items()}
    while held:
        shift, up = max(0, shift - NEXT_BITS), shift
        parent = F.shiftright("k2", up) if up < 64 else F.lit(0).cast("long")
        wide = small_table(spark, [(int(v), int(p)) for v, p in held], "v long, w long")
        inside = rows.withColumn("p", parent).join(F.broadcast(wide), (F.col("k1") == F.col("v")) & (F.col("p") == F.col("w")), "left_semi")
        cells = sorted(_histogram(inside, ["k1", F.col("p").alias("parent"), F.shiftright("k2", shift).alias("cell")], "k2"), key=lambda c: c["first"])
        following, by_parent = {}, defaultdict(list)
        for c in cells:
            by_parent[c["k1"], c["parent"]].append(c)
        for (value, p), found in held.items():
            own = by_parent[value, p]
            for b in found:
                second = lambda c, after: (value, c["last"] + 1 if c["last"] < HIGHEST else HIGHEST) if after else (value, c["first"])  # noqa: B023, E731
                if cell := _probe(b, own, second):
                    if cell["first"] == cell["last"]:  # equal keys stay together
                        end = {m: b.low[m] + cell[m] for m in ("bytes", "rows")}
                        b.settle(*((second(cell, True), end) if b.target - b.low[b.of] > end[b.of] - b.target else (second(cell, False), dict(b.low))))
                    else:
                        following.setdefault((value, cell["cell"]), []).append(b)
        held = following
    return borders


def shard_by_bytes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    row_bytes: int = ROW_BYTES,
    tolerance: float = TOLERANCE,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per document: its id, size, text_crc32, shard and slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    keys = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(body).cast("long") + row_bytes).alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(body).alias("k1"),
        F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("null"))).alias("k2"),
    )
    keys = stage(keys, "shard-keys")
    total = keys.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    n_bytes, n_rows = total["bytes"] or 0, total["rows"]
    slack = tolerance * n_bytes / shards
    parts = shards * max(1, -(-n_rows // (shards * range_rows)))
    targets = [("bytes", n_bytes * i // shards, slack) for i in range(1, shards)]
    targets += [("rows", n_rows * i // parts, 0.1 * n_rows / parts) for i in range(1, parts)]
    borders = find_borders(keys, targets) if n_rows else []
    cuts = sorted(b.key for b in borders if b.of == "bytes")
    # Every range: from its first key on; its shard; the rows of the shard before it.
    starts = {(LOWEST, LOWEST): 0} | {b.key: b.below["rows"] for b in borders}
    edges, shard, base = [], 0, 0
    for i, key in enumerate(sorted(starts)):
        at = sum(c <= key for c in cuts)
        if at != shard:
            shard, base = at, starts[key]
        edges.append((i, key[0], key[1], shard, starts[key] - base))
    return _place(keys, edges).select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard", "slot"
    )


def _place(keys: DataFrame, edges: list[tuple]) -> DataFrame:
    """Move every row to its range and number it there. ``edges``: range, first key, shard, rows before."""
    spark, shift = keys.sparkSession, 64 - FIRST_BITS
    # Per interval of the first key the borders inside it and the range in which it begins: one small row each.
    inside: dict[int, list] = {}
    for r, k1, k2, _, _ in edges[1:]:
        inside.setdefault(k1 >> shift, []).append({"k1": k1, "k2": k2, "r": r})
    table, r = [], 0
    for cell in range(-(2 ** (FIRST_BITS - 1)), 2 ** (FIRST_BITS - 1)):
        table.append((cell, r, inside.get(cell, [])))
        r += len(inside.get(cell, []))
    cells = small_table(spark, table, "cell long, begin int, cuts array<struct<k1:long,k2:long,r:int>>")
    own = F.struct(F.col("k1"), F.col("k2"))
    ranged = keys.join(F.broadcast(cells), F.shiftright("k1", shift) == F.col("cell")).withColumn(
        "range", F.col("begin") + F.size(F.filter("cuts", lambda c: F.struct(c["k1"].alias("k1"), c["k2"].alias("k2")) <= own))
    )
    table = small_table(spark, [(r, s, n) for r, _, _, s, n in edges], "range int, shard int, before long")
    numbered = ranged.withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy("k1", "k2", "size", "crc")))
    return numbered.join(F.broadcast(table), "range").withColumn("slot", F.col("before") + F.col("n") - 1)
