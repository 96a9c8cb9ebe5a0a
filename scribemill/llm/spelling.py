"""Spelling variants: words one edit apart, found through a reduced alphabet.

Every character is hashed to one of ``SYMBOLS`` symbols. Words that differ by one
inserted, deleted or replaced character have reduced words that are equal or
one edit apart. So each distinct reduced word generates its whole one-edit
neighbourhood, the neighbourhood is joined with the reduced vocabulary, and the
words behind a hit are verified on their own characters. Neighbours are mutual:
a deletion here is an insertion there, and of two replacements one leads to the
larger symbol. Each pair is therefore generated once, by its longer word or
the one with the smaller symbol, which halves the rows and loses no pair.

The neighbourhood is computed as 64-bit polynomial hashes, eight bytes a
neighbour however long the word, with arithmetic on prefixes. Equal hashes of
different strings cost a comparison and no result.

Scale: one pass over the texts counts words, summed per task before they move;
all later steps work on the vocabulary. A word of length c makes about
c * (1 + SYMBOLS / 2) neighbours. With 16 symbols the shortest words of five
characters fall into a million reduced words, so few words share one.

Defined results: a null text counts as empty, a null id as the empty string in
the rule that drops characters. Repeated rows count again. Ties of form go to
the smallest word by code point. No words give no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribemill.llm.common import file_partitions
from scribemill.session import stage

SYMBOLS = 16
MIN_CHARS = 5
MIN_COUNT = 3
DROP_EVERY = 97
# A word's form has at least this many times its count.
FORM_FACTOR = 2
# A task hands its counts on when it holds so many words, or has read so many characters.
HELD_WORDS = 500_000
HELD_CHARS = 64_000_000
# Characters whose neighbours are generated at a time; a longer word makes a block of its own.
BLOCK = 65_536
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 2**64)
# Code point of the letter that stands for symbol 0, and code points in all.
FIRST = 97
LETTERS = 0x110000


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, drop_every: int | None = DROP_EVERY) -> DataFrame:
    """Columns word and n: runs of Latin letters, A-Z lower-cased, with their number.

    With ``drop_every``, a run loses the character at h modulo its length when h,
    the crc32 of ``<id>:<run>``, is a multiple of it.
    """
    # A run without five characters cannot become a word, and a shorter piece of a longer run is not matched.
    runs_of = re.compile(rb"[a-z\xc0-\xff]{%d,}" % min_chars).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, read = Counter(), 0

        def packed() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in total.items() if n and len(w) >= min_chars]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                # Letters up to U+00FF become single bytes, everything beyond a question mark; bytes lower-case A-Z alone.
                body = (body.as_py() or "").encode("latin-1", "replace").lower()
                runs = runs_of(body)
                if not runs:
                    continue
                total.update(runs)
                read += len(body)
                if drop_every:
                    start = crc32(name.as_py().encode() + b":")
                    for run in set(runs):
                        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % drop_every == 0:
                            at, n = h % len(run), runs.count(run)
                            total[run] -= n
                            total[run[:at] + run[at + 1 :]] += n
                if len(total) > HELD_WORDS or read > HELD_CHARS:
                    yield packed()
                    total, read = Counter(), 0
        yield packed()

    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def by_length(strings: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the strings of one length, and a matrix of their characters' symbols, a row each; a few million entries at most, or one row."""
    places = defaultdict(list)
    for at, string in enumerate(strings):
        places[len(string)].append(at)
    for length, own in places.items():
        rows = max(1, BLOCK // max(length, 1))
        for lo in range(0, len(own), rows):
            joined = "".join([strings[at] for at in own[lo : lo + rows]])
            codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").reshape(-1, length)
            yield np.array(own[lo : lo + rows]), (codes % symbols).astype(np.uint64)


def prefix_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the places, and hashes of all prefixes of each row; the last one is the word's key."""
    powers = np.full(values.shape[1], BASE, dtype=np.uint64)
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    return powers, np.cumsum((values + np.uint64(1)) * powers, axis=1, dtype=np.uint64)


def neighbour_keys(values: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and hashes of the words themselves, of their deletions and of their replacements by a larger symbol; each string once."""
    powers, prefixes = prefix_keys(values)
    whole = prefixes[:, -1:]
    yield np.arange(len(values)), whole[:, 0]
    own = (values + np.uint64(1)) * powers
    gone = prefixes - own + (whole - prefixes) * np.uint64(BACK)
    # Deleting any character of a run of equal symbols gives the same string.
    first = np.ones(values.shape, dtype=bool)
    first[:, 1:] = values[:, 1:] != values[:, :-1]
    yield np.nonzero(first)[0], gone[first]
    for symbol in range(1, symbols):
        smaller = values < symbol
        replaced = whole + (np.uint64(symbol) - values) * powers
        yield np.nonzero(smaller)[0], replaced[smaller]


def reduced_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``words`` (word, n) with the reduced word, a letter from ``a`` for each symbol, and its key."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, keys = [""] * batch.num_rows, np.zeros(batch.num_rows, dtype=np.uint64)
            for places, values in by_length(batch.column(0).to_pylist(), symbols):
                keys[places] = prefix_keys(values)[1][:, -1]
                for at, row in zip(places.tolist(), (values + np.uint64(FIRST)).astype("<u4")):
                    strings[at] = row.tobytes().decode("utf-32-le")
            columns = [batch.column(0), batch.column(1), pa.array(strings, pa.string()), pa.array(keys.view(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "reduced", "key"])

    return words.select("word", "n").mapInArrow(add, "word string, n long, reduced string, key long")


def neighbourhoods(reduced: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Columns key and near: every neighbour of every reduced word (reduced, key)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for places, values in by_length(batch.column(0).to_pylist(), LETTERS):
                for rows, near in neighbour_keys(values - np.uint64(FIRST), symbols):
                    columns = [pa.array(keys[places[rows]], pa.int64()), pa.array(near.view(np.int64), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "near"])

    # So many tasks that the neighbours, far more than the words, are spread.
    dealt = reduced.select("reduced", "key").repartition(file_partitions(reduced.sparkSession), "key")
    return dealt.mapInArrow(spread, "key long, near long")


def one_edit_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Columns a, n_a, b, n_b: every pair of words (word, n) that are one edit apart, once."""
    table = stage(reduced_words(words, symbols), "reduced")
    near = neighbourhoods(table.select("reduced", "key").distinct(), symbols)
    # The vocabulary is hashed, the many neighbours stream past it unsorted.
    right = table.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("key").alias("near")).hint("shuffle_hash")
    left = table.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "key").hint("shuffle_hash")
    found = near.join(right, "near").join(left, "key")
    # Words with one reduced word meet in both orders.
    once = (F.col("key") != F.col("near")) | (F.col("a") < F.col("b"))
    close = F.abs(F.length("a") - F.length("b")) <= 1
    return found.where(once & close).where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def follow_forms(forms: DataFrame) -> DataFrame:
    """Columns word and root for every word that has a form (word, form). Counts grow along forms, so chains end.

    Each round doubles the steps taken and stages its result; chains are no
    longer than the logarithm of the largest count.
    """
    steps = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "forms")
    while not steps.where("open").isEmpty():
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = steps.where("open").join(ahead, "root", "left")
        moved = moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open"))
        steps = stage(steps.where("not open").unionByName(moved), "forms")
    return steps.select("word", "root")


def spelling_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    drop_every: int | None = DROP_EVERY,
    symbols: int = SYMBOLS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    counted = word_counts(docs, id_column, text, min_chars, drop_every)
    words = stage(counted.where(F.col("n") >= min_count), "words")
    pairs = stage(one_edit_pairs(words, symbols), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_a").alias("m"), F.col("a").alias("near"))
    )
    # The largest count first, then the smallest word: strings compare by code point.
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    large = -F.col("best.m") >= FORM_FACTOR * F.col("n")
    summary = words.join(best, "word", "left").select(
        "word",
        F.when(large, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(large, -F.col("best.m")).alias("form_n"),
    )
    summary = stage(summary, "summary")
    roots = follow_forms(summary.where("form is not null"))
    return summary.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
