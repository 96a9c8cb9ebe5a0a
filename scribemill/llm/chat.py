"""Chat formatting of the longest snapshots of logged conversations.

A log often holds a conversation several times, each time with more turns. Every
turn gets a hash of its place, role and text; the sums of these hashes over the
first k turns identify a prefix. A conversation whose full sums are the sums of
a proper prefix of another one is dropped by an anti-join, and of equal
conversations the smallest id stays. What remains is rendered.

Scale: turns are sorted once by range over id, number, role and text, so also the rows
without an id, or many rows of one number, are spread over tasks; only rows that share
all these up to the first ``RANGE_CHARS`` characters meet in one, which sorts them on disk if need be. Places
and running sums come from sums per block of ``BUCKET_TURNS`` turns, so one conversation may hold
any share of the turns. Prefixes shared by very many conversations are reduced before they move.
A rendered conversation comes in parts of ``PART_TURNS`` turns, in one row each, so no cell grows without bound.

Defined results: turns follow by number (null last), then role and text. Equal
rows count once. A null role or text is rendered as an empty string and differs
from one in the hashes. All rows with a null id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scribemill.session import stage

BUCKET_TURNS = 1024
# Characters of role and text by which turns are dealt into ranges. Samples of them go to the driver.
RANGE_CHARS = 256
PART_TURNS = 64
# The marks around a rendered turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LANES = ("l1", "l2", "l3", "l4")
NO_ID = -(2**63)


def _blocks_of(number: Column | str) -> Column:
    """``BUCKET_TURNS`` successive numbers to a block, in whole numbers: they go beyond what a double holds."""
    return F.call_function("div", F.col(number) if isinstance(number, str) else number, F.lit(BUCKET_TURNS))


def sorted_turns(turns: DataFrame, id_column: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct turns as a staged table: id, row, block, role, text and two hashes of role and text.

    ``row`` grows in the order of id, turn, role and text and has no gaps inside a block; a
    block holds rows of ``BUCKET_TURNS`` successive numbers at most.
    """
    rows = turns.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    ).distinct()
    number = F.col("turn").asc_nulls_last()
    starts = [F.substring(c, 1, RANGE_CHARS) for c in ("role", "text")]
    missing = F.concat(F.col("role").isNull().cast("int"), F.col("text").isNull().cast("int"))
    ordered = (
        rows.repartitionByRange("id", number, *starts)
        .sortWithinPartitions("id", number, "role", "text")
        .withColumn("row", F.monotonically_increasing_id())
    )
    return stage(
        ordered.select(
            "id", "row", _blocks_of("row").alias("block"), "role", "text",
            *[F.xxhash64("role", "text", missing, F.lit(seed)).alias(f"h{seed}") for seed in (1, 2)],
        ),
        "sorted-turns",
    )


def block_shifts(ordered: DataFrame) -> DataFrame:
    """Columns id, block and shift: ``row + shift`` is the 1-based place of a turn in its conversation."""
    before = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ordered.groupBy("id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    return blocks.select("id", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))


def placed_turns(ordered: DataFrame, shifts: DataFrame) -> DataFrame:
    """The turns of the blocks in ``shifts`` with their place ``at`` in the conversation."""
    return ordered.join(shifts, ["id", "block"]).withColumn("at", F.col("row") + F.col("shift")).drop("shift")


def turn_lanes(placed: DataFrame) -> DataFrame:
    """Columns id, bucket, at and the four halves of two hashes of the turn and its place."""

    def halves(seed: int) -> list[Column]:
        h = F.xxhash64("at", f"h{seed}", F.lit(seed))
        return [h.bitwiseAND(F.lit(2**32 - 1)), F.shiftrightunsigned(h, 32)]

    lanes = [c.alias(n) for c, n in zip([*halves(1), *halves(2)], LANES)]
    return placed.select("id", _blocks_of(F.col("at") - 1).alias("bucket"), "at", *lanes)


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """Columns id and n_turns of the conversations that are no prefix of another one. ``turns``: see ``turn_lanes``."""
    one = Window.partitionBy("id")
    before = one.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in LANES])
    offsets = sums.select(
        "id", "bucket", F.sum("n").over(one).alias("n_turns"),
        *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"b_{x}") for x in LANES],
    )
    upto = Window.partitionBy("id", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # Joined by bucket, so the turns of one conversation stay spread.
    prefixes = turns.join(offsets, ["id", "bucket"]).select(
        "id", "at", "n_turns", *[(F.col(f"b_{x}") + F.sum(x).over(upto)).alias(x) for x in LANES]
    )
    whole = sums.groupBy("id").agg(F.sum("n").alias("n_turns"), *[F.sum(x).alias(x) for x in LANES])
    proper = prefixes.where("at < n_turns").select(F.col("at").alias("n_turns"), *LANES).distinct()
    return whole.groupBy("n_turns", *LANES).agg(F.min("id").alias("id")).join(proper, ["n_turns", *LANES], "left_anti").select("id", "n_turns")


def format_chats(turns: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered maximal conversations: the id, n_turns, part (from 0) and rendered."""
    ordered = sorted_turns(turns, id_column, turn, role, text)
    shifts = block_shifts(ordered)
    kept = maximal_conversations(stage(turn_lanes(placed_turns(ordered, shifts)), "turns"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    piece = F.concat(F.lit(OPEN), blank("role"), F.lit(MIDDLE), blank("text"), F.lit(CLOSE))
    return (
        placed_turns(ordered, shifts.join(kept, "id"))
        .groupBy("id", "n_turns", F.floor((F.col("at") - 1) / PART_TURNS).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))).alias("pieces"))
        .select(
            F.when(F.col("id") != NO_ID, F.col("id")).alias(id_column),
            "n_turns",
            "part",
            F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rendered"),
        )
    )
