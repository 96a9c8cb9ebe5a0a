"""Lookup join that avoids shuffling beside a small table and spreads hot keys beside a large one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more left rows than this is spread over SALTS tasks.
HOT_ROWS = 1_000_000
SALTS = 64


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate. For a staged table it is the file size.

    Filters and aggregates are estimated no smaller than the files below them
    allow, joins as the product of their sides.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    return df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def small_enough(df: DataFrame) -> bool:
    """Whether ``df`` is within the broadcast limit of the session."""
    return estimated_bytes(df) <= broadcast_limit(df)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: str | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``left`` with ``right``, which has one row per key, keeping hot keys off one task.

    A side within the broadcast limit is broadcast (the left one only in an
    inner join) and the other stays where it is. Otherwise keys with more than ``hot_rows`` left rows get a salt on the left
    and one copy per salt on the right; all other keys are joined as they are.
    There are fewer than ``rows / hot_rows`` hot keys, so their list is small:
    a million keys at a trillion rows. ``spread_by`` is a column of ``left`` that tells
    rows of one key apart.
    """
    on = list(on)
    limit, right_bytes = broadcast_limit(left), estimated_bytes(right)
    if how == "inner" and estimated_bytes(left) <= min(limit, right_bytes):
        return F.broadcast(left).join(right, on)
    if right_bytes <= limit:
        return left.join(F.broadcast(right), on, how)
    hot = (
        left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > hot_rows)
        .select(*on, F.lit(True).alias("__hot"))
    )
    spread = F.pmod(F.xxhash64(spread_by or F.struct("*")), F.lit(salts)).cast("int")
    salted = left.join(F.broadcast(hot), on, "left").select(
        *left.columns, F.when(F.col("__hot"), spread).otherwise(0).alias("__salt")
    )
    copies = right.join(F.broadcast(hot), on, "left").select(
        *right.columns,
        F.explode(F.sequence(F.lit(0), F.when(F.col("__hot"), salts - 1).otherwise(0))).alias("__salt"),
    )
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
