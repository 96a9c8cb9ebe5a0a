"""Column helpers the operators of this package share."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the white space that separates words, space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """The words of a text, maximal runs of other characters than white space; null has none."""
    spaced = F.coalesce(text, F.lit(""))
    for mark in "\t\n\x0b\x0c\r":  # plain replacements and a one-character split are faster than a pattern
        spaced = F.replace(spaced, F.lit(mark), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(prefix: str) -> str:
    """A column name that no input column has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def file_partitions(spark) -> int:
    """Tasks for work on rows that were gathered from a scan: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of driver-side rows, few by construction, as one JSON literal."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    element = ",".join(f"{n}:{c.strip().split(' ', 1)[1]}" for n, c in zip(names, schema.split(", ")))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{element}>>")))


# A key with at least this part of the rows is hot; there can be no more hot keys than that.
HOT_PART = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: str, spread: str) -> DataFrame:
    """Left join with a staged table of one row per key that states in ``rows`` how many left rows have the key.

    Hot keys, ``HOT_PART`` of them at most, are broadcast. Their rows, and those
    without a key, go through the shuffle of the others by ``spread`` and meet nothing there.
    """
    values = [c for c in right.columns if c not in (key, rows)]
    hot_key, hot_values, cold_key, cold_values, meet = (fresh(n) for n in ("hot", "hot_values", "cold", "cold_values", "meet"))
    is_hot = F.col(rows) * HOT_PART >= left.count()
    found = F.struct(*values)
    hot = right.where(is_hot).select(F.col(key).alias(hot_key), found.alias(hot_values))
    cold = right.where(~is_hot).select(F.concat(F.lit("="), F.col(key)).alias(cold_key), found.alias(cold_values))
    first = left.join(F.broadcast(hot), left[key] == F.col(hot_key), "left")
    by = F.when(F.col(hot_key).isNull() & F.col(key).isNotNull(), F.concat(F.lit("="), F.col(key))).otherwise(F.concat(F.lit("#"), F.col(spread)))
    joined = first.withColumn(meet, by).join(cold, F.col(meet) == F.col(cold_key), "left")
    either = F.coalesce(F.col(hot_values), F.col(cold_values))
    return joined.select(*left.columns, *[either[v].alias(v) for v in values])


class ByValue:
    """Wraps an object for a broadcast, so that its class travels along and workers need not have this package."""

    def __init__(self, value):
        self.value = value

    def __reduce__(self):
        return cloudpickle.loads, (cloudpickle.dumps(self.value),)
