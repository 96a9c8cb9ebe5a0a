"""Rate-limit windows that start at a caller's first call.

A window ends a fixed time after its first call, and the next call from then
on starts the next one: every start depends on the one before. To walk such a
chain in parallel, the time line of a caller is cut into nested cells, and a
cell is a map from the last window start before it to the last one within it.
Such maps are step functions and can be composed:

1. Each block, the finest cell, finds its map from its own calls.
2. Level by level, the maps of at most ``FAN`` neighbouring cells are composed
   into that of the cell above, until one cell spans the time line of a caller.
3. Back down, each cell is told the last start before it and tells its parts.
4. With that known, a block lists its own window starts, and each call takes the
   last one up to its time.

No step brings together more than the parts of one cell, so a single caller
runs on all cores. A block with more than ``BLOCK_CALLS`` calls is cut into finer
cells, down to a microsecond, and calls of equal time are one entry in its map.
A map holds at most the different call times of one window. Calls meet their block's starts in
a join, whose hot keys Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemill.session import stage

# Windows per block, calls of a block before it is cut, and parts of a cell.
BLOCK_WINDOWS = 32
BLOCK_CALLS = 50_000
FAN = 32
# No window start yet.
NONE = -(2**62)


def last_starts(t: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates for the first window start in sorted times ``t``, and the last start following from each.

    The running window ends less than ``width`` after ``t[0]``, so the first
    start is no later than the first time from then on.
    """
    candidates = t[: np.searchsorted(t, t[0] + width) + 1]
    last = candidates.copy()
    todo = np.arange(len(last))
    while len(todo):
        following = np.searchsorted(t, last[todo] + width)
        todo, following = todo[following < len(t)], following[following < len(t)]
        last[todo] = t[following]
    return candidates, last


def starts_from(t: np.ndarray, first: int, width: int) -> np.ndarray:
    """All window starts in sorted times ``t`` when ``first`` is one."""
    starts, at = [], int(np.searchsorted(t, first))
    while at < len(t):
        starts.append(t[at])
        at = int(np.searchsorted(t, t[at] + width))
    return np.array(starts, dtype=np.int64)


def _compressed(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps of a map: of entries with the same result the latest says it all."""
    step = np.ones(len(last), dtype=bool)
    step[:-1] = last[1:] != last[:-1]
    return first[step], last[step]


def block_map(t: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of a block with sorted times ``t``: if the first start is no later than an entry of the first array, the last start is that of the second."""
    return _compressed(*last_starts(t, width))


def after(anchor: int, cell: tuple[np.ndarray, np.ndarray], width: int) -> int:
    """The last window start at the end of a cell, ``anchor`` being the last one before it."""
    at = int(np.searchsorted(cell[0], anchor + width))
    return int(cell[1][at]) if at < len(cell[0]) else anchor


def composed(cells: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of neighbouring cells, given in order.

    A start before the first entry of a cell decides in that cell; the running
    window, which began before all of them, ends within a width of the first entry.
    """
    entries, reach = [], NONE
    for first, _ in cells:
        entries.append(first[first > reach])
        reach = max(reach, int(first[-1]))
    first = np.concatenate(entries)
    first = first[: np.searchsorted(first, first[0] + width) + 1]
    last = np.full(len(first), NONE, dtype=np.int64)
    free = first.copy()
    for steps, results in cells:
        at = np.searchsorted(steps, free)
        hit = at < len(steps)
        last[hit] = results[at[hit]]
        free[hit] = last[hit] + width
    return _compressed(first, last)


def cell_start(t: Column, base: int, widths: list[int]) -> Column:
    """Start of the finest of nested cells that holds ``t``; each width cuts the cells of the one before it."""
    rest = t - F.lit(base)
    for width in widths:
        rest = rest % F.lit(width)
    return t - rest


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    ends = np.cumsum(column.value_lengths().to_numpy())
    return np.split(column.flatten().to_numpy(), ends[:-1]) if len(column) else []


def _list_column(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.array([], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list]]:
    """Caller, cell and the rows (cell, first, last) of its parts, from rows sorted by caller, cell and part."""
    key, rows = None, []
    for batch in batches:
        names, above, cells = (batch.column(i).to_pylist() for i in range(3))
        for name, up, row in zip(names, above, zip(cells, _lists(batch.column(3)), _lists(batch.column(4)))):
            if (name, up) != key:
                if rows:
                    yield *key, rows
                key, rows = (name, up), []
            rows.append(row)
    if rows:
        yield *key, rows


MAPS = "__k string, cell long, first array<long>, last array<long>"


def maps_of_blocks(blocks: DataFrame, width: int) -> DataFrame:
    """``blocks`` is (__k, block, times)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [block_map(t, width) for t in _lists(batch.column(2))]
            columns = [batch.column(0), batch.column(1), _list_column([f for f, _ in maps]), _list_column([x for _, x in maps])]
            yield pa.RecordBatch.from_arrays(columns, names=["__k", "cell", "first", "last"])

    return blocks.select("__k", "block", "times").mapInArrow(find, MAPS)


def _dealt(maps: DataFrame, above: Column) -> DataFrame:
    rows = maps.select("__k", above.alias("above"), "cell", "first", "last")
    return rows.repartition("__k", "above").sortWithinPartitions("__k", "above", "cell")


def maps_above(maps: DataFrame, above: Column, width: int) -> DataFrame:
    """The maps of the cells above, whose start is ``above``."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, cell, rows in _parts(batches):
            first, last = composed([(f, x) for _, f, x in rows], width)
            columns = [pa.array([name], pa.string()), pa.array([cell], pa.int64()), _list_column([first]), _list_column([last])]
            yield pa.RecordBatch.from_arrays(columns, names=["__k", "cell", "first", "last"])

    return _dealt(maps, above).mapInArrow(compose, MAPS)


def starts_before(maps: DataFrame, above: Column, known: DataFrame | None, width: int) -> DataFrame:
    """The last window start before each cell (__k, cell, before). ``known`` has it for the cells above; none if each caller has one."""

    def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, rows in _parts(batches):
            anchor, cells, before = NONE, [], []
            for cell, first, last in rows:
                if cell == NONE:  # the row of the cell above
                    anchor = int(first[0])
                    continue
                cells.append(cell)
                before.append(anchor)
                anchor = after(anchor, (first, last), width)
            columns = [pa.array([name] * len(cells), pa.string()), pa.array(cells, pa.int64()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["__k", "cell", "before"])

    rows = maps.withColumn("above", above)
    if known is not None:
        heads = known.select("__k", F.lit(NONE).alias("cell"), F.array("before").alias("first"), F.array().cast("array<long>").alias("last"), F.col("cell").alias("above"))
        rows = rows.unionByName(heads)
    return _dealt(rows, F.col("above")).mapInArrow(push, "__k string, cell long, before long")


def _block_starts(blocks: DataFrame, width: int) -> DataFrame:
    """``blocks`` is (__k, block, times, before); the window starts that may hold in it."""

    def list_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(3).to_numpy()
            starts = [np.concatenate([[anchor], starts_from(t, anchor + width, width)]).astype(np.int64) for t, anchor in zip(_lists(batch.column(2)), before)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _list_column(starts)], names=["__k", "block", "starts"])

    return blocks.select("__k", "block", "times", "before").mapInArrow(list_starts, "__k string, block long, starts array<long>")


def cut_blocks(calls: DataFrame, base: int, coarse: int, block_calls: int) -> tuple[DataFrame, list[int]]:
    """``calls`` with the start of their block, and the widths of the nested blocks. Blocks of too many calls are cut, only those."""
    widths = [coarse]
    dealt = calls.withColumn("block", cell_start(F.col("__t"), base, widths))
    counted = dealt
    while widths[-1] > 1:
        dense = counted.groupBy("__k", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_calls)
        dense = stage(dense.select("__k", "block", F.lit(True).alias("dense")), "dense")
        if dense.isEmpty():
            break
        widths.append(-(-widths[-1] // FAN))
        finer = F.when(F.col("dense"), cell_start(F.col("__t"), base, widths)).otherwise(F.col("block"))
        dealt = stage(dealt.drop("dense").join(dense, ["__k", "block"], "left").withColumn("block", finer), "calls")
        counted = dealt.where("dense")
    return dealt.drop("dense"), widths


def cell_widths(span: int, widths: list[int]) -> list[int]:
    """Widths of all cells, from one that spans all call times to the finest block."""
    above = [widths[0]]
    while above[0] <= span:
        above.insert(0, above[0] * FAN)
    return above + widths[1:]


def label_windows(calls: DataFrame, width: int, block_windows: int = BLOCK_WINDOWS, block_calls: int = BLOCK_CALLS) -> DataFrame:
    """``calls`` is (``__k`` string, ``__t`` microseconds, ``__id``), nothing null; adds ``__anchor``, the window start."""
    first, last = calls.agg(F.min("__t"), F.max("__t")).first()
    if first is None:
        return calls.withColumn("__anchor", F.col("__t"))
    dealt, widths = cut_blocks(calls, first, width * block_windows, block_calls)
    # Equal times are one entry, collected in the tasks before they move.
    blocks = stage(dealt.groupBy("__k", "block").agg(F.sort_array(F.collect_set("__t")).alias("times")), "blocks")
    cells = cell_widths(last - first, widths)
    if len(cells) == 1:
        known = blocks.withColumn("before", F.lit(NONE))
    else:
        above = [cell_start(F.col("cell"), first, cells[:level]) for level in range(1, len(cells))]
        levels = [stage(maps_of_blocks(blocks, width), "maps")]
        for start in reversed(above[1:]):
            levels.append(stage(maps_above(levels[-1], start, width), "maps"))
        before = None
        for maps, start in zip(reversed(levels), above):
            before = stage(starts_before(maps, start, before, width), "before")
        known = blocks.join(before.withColumnRenamed("cell", "block"), ["__k", "block"])
    starts = stage(_block_starts(known, width), "starts")
    anchor = F.array_max(F.filter("starts", lambda s: s <= F.col("__t")))
    return dealt.join(starts, ["__k", "block"]).select("__k", "__t", "__id", anchor.alias("__anchor"))
