"""Running totals and dense positions without a global window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scribemill.session import shared_dir, stage

# Keys per lowest bucket (2**13) and buckets per next level (2**20). A window
# then never sees more than 8,192 keys or a million bucket sums, whatever the table size.
BUCKET_BITS = 13
FAN_BITS = 20


def _shifts(key_bits: int) -> list[int]:
    shifts = [BUCKET_BITS]
    while key_bits - shifts[-1] > FAN_BITS:
        shifts.append(shifts[-1] + FAN_BITS)
    return shifts


def running_sums(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    partition: Sequence[str] = (),
    ties: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
    key_bits: int = 63,
) -> DataFrame:
    """Add, per entry of ``sums``, the sum over all earlier rows (this row not included).

    ``order`` is a long column with values below ``2**key_bits`` that is unique
    within ``partition`` together with ``ties``. Rows are bucketed by the high
    bits of ``order``: bucket sums are added up level by level, and only rows of
    one bucket meet in a window, so a partition key may hold any share of the
    table. ``totals`` names, per output column, the sum it adds over the whole partition.
    The input is read twice; stage it first if it is costly or not repeatable.
    """
    shifts = _shifts(key_bits)
    part = list(partition)
    buckets = [f"__b{i}" for i in range(len(shifts))]
    values = {name: f"__v_{i}" for i, name in enumerate(sums)}
    totals = dict(totals or {})

    rows = df.withColumns(
        {b: F.shiftright(F.col(order), s) for b, s in zip(buckets, shifts)}
        | {values[name]: c for name, c in sums.items()}
    )
    level = rows.groupBy(*part, *buckets).agg(*[F.sum(v).alias(v) for v in values.values()])
    levels = [level]
    for i in range(1, len(shifts)):
        level = level.groupBy(*part, *buckets[i:]).agg(*[F.sum(v).alias(v) for v in values.values()])
        levels.append(level)

    def before(v: str, keys: list[str], by: list[str]) -> Column:
        w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(v).over(w), F.lit(0))

    top = buckets[-1]
    whole = Window.partitionBy(*part)
    offsets = levels[-1].select(
        *part,
        top,
        *[before(v, part, [top]).alias(f"__o_{v}") for v in values.values()],
        *[F.sum(values[name]).over(whole).alias(out) for out, name in totals.items()],
    )
    for i in range(len(shifts) - 2, -1, -1):
        keys = part + [buckets[i + 1]]
        offsets = levels[i].join(offsets, keys, "left").select(
            *part,
            buckets[i],
            *[(before(v, keys, [buckets[i]]) + F.col(f"__o_{v}")).alias(f"__o_{v}") for v in values.values()],
            *totals,
        )
    # Left joins keep null checks out of the bucket sums, so all levels share one shuffle of them.
    keys = part + [buckets[0]]
    return rows.join(offsets, keys, "left").select(
        *df.columns,
        *[
            (before(v, keys, [order, *ties]) + F.col(f"__o_{v}")).alias(name)
            for name, v in values.items()
        ],
        *totals,
    )


def dense_index(df: DataFrame, order: str, name: str = "position", key_bits: int = 63) -> DataFrame:
    """0-based position of every row in ``order``, without gaps."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, key_bits=key_bits)


def order_rows(df: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Add a long that sorts like the ``order`` columns, whatever their types and widths; nulls come first.

    The rows are sorted by range and written down, so the numbers stay: those of one range follow
    one another without gaps, and ranges are far apart. Rows that are equal in ``order`` get different
    numbers in any order. ``order`` should be short: samples of it go to the driver.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(placed.withColumn(name, F.monotonically_increasing_id()), "ordered")


def dense_index_by(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position by any order columns, for keys that are not one long.

    Rows are range-sorted and checkpointed, which fixes their partitions; a
    position is the row's place in its partition plus the rows of the
    partitions before it. The offset table has one row per sort partition.
    """
    shared_dir(df.sparkSession)
    placed = (
        df.orderBy(*order)
        .checkpoint()
        .withColumns(
            {
                "__p": F.spark_partition_id(),
                "__i": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)),
            }
        )
    )
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
        .select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    return placed.join(F.broadcast(offsets), "__p").select(
        *df.columns, (F.col("__before") + F.col("__i")).alias(name)
    )
