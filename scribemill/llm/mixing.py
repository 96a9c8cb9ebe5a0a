"""Mixing sources to target weights with Efraimidis-Spirakis keys.

Every document gets the key ``-ln(u) / q`` with a uniform ``u`` made from its id
and its quality weight ``q``; smaller keys come first. A source whose target is
``e`` times its size plus a rest takes every document ``e`` times (the complete
epochs) and then documents in key order while their running total stays nearest
to the rest. Whole documents are taken, so a source misses its target by half a
document at most.

Targets: weights by rank of the source, all sizes shared by weight, no target
above ``max_epochs`` times its source's size. The excess goes to the others by
weight until none is above; this is solved in closed form over the sources in
ascending order of size per weight.

Scale: texts are read once and reduced to a small table of keys, which is staged.
Running totals are taken per bucket of the key, with sums of buckets before
them on two levels, so a source of any share is spread over many tasks; whatever the weights, no
bucket is expected to hold more than twice the mean. Sources must be few: the table of
sources, one row each, meets in one task. Rows of one id share a key, so their number must be moderate.

Defined results: a null or blank text has size 0 and is never taken; a null
source is a source of its own and ranks last. Rows with equal ids get equal keys
and are ordered by size; equal rows share their result as a group. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scribemill.llm.common import word_array
from scribemill.session import stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# Rows of one bucket of keys, on average, in the largest source, and buckets whose sums are added up in one window.
BUCKET_ROWS, FAN = 500, 10_000
# The smallest quality weight; the largest is 1.
LEAST_WEIGHT = 0.5
SYMBOLS = "[#*$%&|<>]"


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.5 and 1: lower the more symbols a text has per word."""
    symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    return F.lit(1.0) - F.lit(1.0 - LEAST_WEIGHT) * F.least(F.lit(1.0), F.coalesce(symbols, F.lit(0)).cast("double") / F.greatest(size, F.lit(1)).cast("double"))


def uniform(key: Column) -> Column:
    """A number between 0 and 1, neither included, from the digest of ``key``."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10).cast("long")
    return (digits.cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources. ``sizes``: source, no_source (whether it is null, with source ''), source_size, one row per source."""
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    wide = lambda c: c.cast("decimal(38,0)")
    ranked = sizes.withColumn("__k", F.row_number().over(Window.orderBy("no_source", "source")) - 1).withColumn(
        "__w", F.element_at(cycle, (F.col("__k") % len(weights) + 1).cast("int"))
    )
    # Capped sources are the first ones by size per weight. Before each: what the capped ones take; from it on: the weights.
    by_room = Window.orderBy(F.col("source_size") / F.col("__w"), "__k")
    earlier, later = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    flagged = ranked.withColumns(
        {
            "__all": F.sum("source_size").over(everyone),
            "__before": F.coalesce(F.sum(cap).over(earlier), F.lit(0)),
            "__weights": F.sum("__w").over(later),
        }
    ).withColumn(
        "__capped", wide(cap) * wide(F.col("__weights")) < wide(F.col("__all") - F.col("__before")) * wide(F.col("__w"))
    )
    free = flagged.withColumns(
        {
            "__left": F.col("__all") - F.coalesce(F.sum(F.when(F.col("__capped"), cap)).over(everyone), F.lit(0)),
            "__open": F.sum(F.when(~F.col("__capped"), F.col("__w"))).over(everyone),
        }
    )
    share = (F.col("__left") * F.col("__w")).cast("double") / F.col("__open").cast("double")
    return free.select(
        "source", "no_source", "source_size", F.when(F.col("__capped"), cap.cast("double")).otherwise(share).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    keep: str | None = None,
) -> DataFrame:
    """One row per document: its id, source, size, source_size, target, copies and taken.

    ``copies`` is how often the mix takes the document, ``taken`` the words of these copies.
    ``keep`` names a column that goes along, such as a number that tells rows of one id apart.
    """
    extra = [] if keep is None else [keep]
    size = F.size(word_array(F.col("t"))).cast("long")
    keyed = (
        docs.select(F.col(id_column).alias("id"), F.col(source).alias("s"), F.col(text).alias("t"), *extra)
        .select("id", "s", "t", size.alias("size"), *extra)
        .select(
            *extra,
            "id",
            F.coalesce("s", F.lit("")).alias("source"),
            F.col("s").isNull().alias("no_source"),
            "size",
            (-F.log(uniform(F.col("id"))) / quality_weight(F.col("t"), F.col("size"))).alias("key"),
        )
    )
    keyed = stage(keyed, "mix-keys")
    part = ["source", "no_source"]
    sums = stage(keyed.groupBy(*part).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    largest = sums.agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-largest // BUCKET_ROWS))
    # A key of weight w is beyond k with probability exp(-k w). Where 1 - exp(-k LEAST_WEIGHT) cuts the buckets, those of the
    # least weight are spread evenly, and larger weights put at most 1 / LEAST_WEIGHT times the mean into one.
    even = F.lit(1.0) - F.exp(-F.col("key") * LEAST_WEIGHT)
    placed = keyed.withColumn("b", F.floor(even * buckets))
    cells = placed.groupBy(*part, "b").agg(F.sum("size").alias("size")).withColumn("fan", F.call_function("div", "b", F.lit(FAN)))
    before_fan = Window.partitionBy(*part).orderBy("fan").rowsBetween(Window.unboundedPreceding, -1)
    fans = cells.groupBy(*part, "fan").agg(F.sum("size").alias("size")).select(
        *part, "fan", F.coalesce(F.sum("size").over(before_fan), F.lit(0)).alias("fans_before")
    )
    before = Window.partitionBy(*part, "fan").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.join(fans, [*part, "fan"])
        .select(*part, "b", (F.col("fans_before") + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("before"))
        .join(source_targets(sums.drop("n"), weights, max_epochs), part)
    )
    within = Window.partitionBy(*part, "b").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - (full * F.col("source_size")).cast("double")
    start = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    one_more = (F.col("size") > 0) & ((rest - start.cast("double")) * 2 >= F.col("size").cast("double")) & (full < max_epochs)
    copies = F.when(F.col("size") > 0, full + one_more.cast("long")).otherwise(F.lit(0).cast("long"))
    return placed.join(offsets, [*part, "b"]).select(
        F.col("id").alias(id_column),
        F.when(~F.col("no_source"), F.col("source")).alias(source),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *extra,
    )
