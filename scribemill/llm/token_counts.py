"""Token counts by byte-pair merging with a heap over a linked list.

The symbols of a word form a linked list. A heap holds its adjacent pairs by
rank and place; the lowest pair is popped, its symbols become one, and the two
new neighbours are pushed. A popped pair that no longer stands in the list is
passed over. The count is the number of symbols at the start minus the number of
merges, so no identifiers are needed. A word of n symbols takes O(n log n) time.

The work is per document, in Arrow batches, without any shuffle.

Defined results: a null or empty text has 0 bytes and 0 tokens. A special string
of the vocabulary inside a text is one token.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemill.llm.common import ByValue
from scribemill.llm.vocabulary import Vocabulary, byte_letters, read_vocabulary, special_pattern

REMEMBERED_WORDS = 1_000_000
LIMIT = 512
# Fixed value: the pattern that cuts text into words for byte-level vocabularies of this kind.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class MergeCounter:
    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.ids
        self.symbols = [ids[c] for c in byte_letters()]
        # The rank of a pair of ids, written as one number, and the id that each rank makes.
        self.ranks = {ids[u] << 20 | ids[v]: rank for rank, (u, v) in enumerate(vocabulary.merges)}
        self.made = [ids[u + v] for u, v in vocabulary.merges]
        self.special = vocabulary.special
        self.counts: dict[str, int] = {}
        self.split = None

    def merges(self, symbols: list[int]) -> int:
        """How many merges a word's symbols allow; the list is used up."""
        rank_of, made, n = self.ranks.get, self.made, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            rank = rank_of(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                heap.append(rank * n + i)
        heapq.heapify(heap)
        push, pop, done = heapq.heappush, heapq.heappop, 0
        while heap:
            rank, i = divmod(pop(heap), n)
            j = after[i]
            if symbols[i] < 0 or j >= n or rank_of(symbols[i] << 20 | symbols[j]) != rank:
                continue
            done += 1
            symbols[i], symbols[j] = merged, _ = made[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(merged << 20 | symbols[k])
                if rank is not None:
                    push(heap, rank * n + i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] << 20 | merged)
                if rank is not None:
                    push(heap, rank * n + h)
        return done

    def word(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode("utf-8", "replace")]
        count = len(symbols) - self.merges(symbols)
        if len(self.counts) >= REMEMBERED_WORDS:
            self.counts.clear()
        self.counts[word] = count
        return count

    def text(self, text: str) -> int:
        if self.split is None:
            import regex

            self.split = regex.compile(WORD_PATTERN).findall
            self.cut = special_pattern(self.special)
        total, counts = 0, self.counts
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                total += 1
                continue
            for word in self.split(part):
                total += counts.get(word) or self.word(word)
        return total


def token_count(text: Column, counter) -> Column:
    """Tokens of a text. ``counter``: a broadcast of ``MergeCounter``."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter.value
        for texts in batches:
            yield pd.Series([own.text(t) if t else 0 for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens and over_limit."""
    counter = docs.sparkSession.sparkContext.broadcast(ByValue(MergeCounter(read_vocabulary(path))))
    return docs.select(
        F.col(id_column),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col(text), counter).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
