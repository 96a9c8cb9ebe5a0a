"""Byte-pair encoding and decoding with an automaton over tokens.

The automaton reads token sequences and accepts the one that byte-pair merging
gives. It starts with one state in which every symbol may follow. Each merge
``(u, v) -> w``, in rank order, adds a gadget: a copy of the state after ``u``
without the arc ``v`` becomes the state after ``u``, and wherever an arc ``u`` is,
an arc ``w`` is added that leads to the old state after ``v``. So there is one
state per merge, one state after each token, and an arc table that is kept by
its differences: the removed arc of a gadget and the arc whose places a new arc
took. An arc that was looked up once stays in a table.

A pre-split word is encoded from left to right. For each of its prefixes the
table holds the last token; exactly one token that ends there has an arc from
the state before it. The labels of the chosen arcs are the encoding; the strings
of the labels, in order, are the decoding.

The work is per document, in Arrow batches, without any shuffle. The tables are
two megabytes, go out once as a broadcast and remember words up to a fixed number.

Defined results: a null or empty text has no tokens and decodes to the empty
string. Words of any length take time proportional to their length.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemill.llm.common import ByValue
from scribemill.llm.vocabulary import Vocabulary, byte_letters, letters_of, read_vocabulary, special_pattern

# Words a worker remembers; it starts anew beyond that.
REMEMBERED_WORDS = 500_000
# Fixed value: the pattern that cuts normalised text into words in this vocabulary's file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class TokenAutomaton:
    """States, arcs and labels compiled from a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.ids
        self.ids, self.word_end, self.special = ids, vocabulary.word_end, vocabulary.special
        size = max(ids.values()) + 1
        # Per token: the gadget that made it, its left part, and the state after it.
        self.born, self.left, self.after = [0] * size, [-1] * size, [0] * size
        # Per state: the state it is a copy of and the arc it lost; its number is the gadget's.
        self.copied, self.lost = [0], [-1]
        self.arcs: dict[int, bool] = {}
        # A merge whose parts can never meet makes a token that no text reaches.
        dead: set[int] = set()
        for u, v in vocabulary.merges:
            left, right, made = ids[u], ids[v], ids[u + v]
            if left in dead or right in dead or not self.arc(self.after[left], right):
                dead.add(made)
            else:
                self._add_gadget(left, right, made)
        live = {t: i for t, i in ids.items() if i not in dead}
        self.labels = {i: t for t, i in ids.items()} | {i: t for t, i in vocabulary.special.items()}
        # Every string that begins a token: the token it is inside a word and at a word's end, -1 for none.
        self.table: dict[str, tuple[int, int]] = {}
        for token in live:
            body = token.removesuffix(self.word_end) if self.word_end else token
            for n in range(1, len(body) + 1):
                self.table.setdefault(body[:n], (live.get(body[:n], -1), live.get(body[:n] + self.word_end, -1)))

    def _add_gadget(self, u: int, v: int, w: int) -> None:
        number = len(self.copied)
        old = self.after[v]
        self.copied.append(self.after[u])
        self.lost.append(v)
        self.after[u] = number
        self.after[w], self.born[w], self.left[w] = old, number, u

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow in ``state``."""
        key = state << 20 | token
        known = self.arcs.get(key)
        if known is None:
            s, t = state, token
            known = True
            while s:
                if self.born[t] >= s:  # the arc came later, where its left part's arc was
                    t = self.left[t]
                elif self.lost[s] == t:
                    known = False
                    break
                else:
                    s = self.copied[s]
            if len(self.arcs) > 4_000_000:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def tokens(self, word: str) -> list[int]:
        """Ids of a word given in byte letters."""
        n, table, after, arcs = len(word), self.table, self.after, self.arcs
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            if start and last[start] < 0:
                continue
            state = after[last[start]] if start else 0
            for end in range(start + 1, n + 1):
                entry = table.get(word[start:end])
                if entry is None:
                    break
                token = entry[end == n]
                if token >= 0 and last[end] < 0:
                    follows = arcs.get(state << 20 | token)
                    if follows is None:
                        follows = self.arc(state, token)
                    if follows:
                        last[end], begin[end] = token, start
        found, end = [], n
        while end:
            found.append(last[end])
            end = begin[end]
        return found[::-1]


class TextCoder:
    """Encodes and decodes whole texts the way the vocabulary's own file describes."""

    def __init__(self, automaton: TokenAutomaton):
        import regex

        self.automaton = automaton
        self.letters = byte_letters()
        self.cut = special_pattern(automaton.special)
        self.split = regex.compile(WORD_PATTERN).findall
        self.words: dict[str, tuple[int, str, str]] = {}

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.automaton.tokens(letters_of(word, self.letters))
        labels = self.automaton.labels
        entry = len(ids), " ".join(map(str, ids)), " ".join([labels[i] for i in ids])
        if len(self.words) >= REMEMBERED_WORDS:
            self.words.clear()
        self.words[word] = entry
        return entry

    def normalised(self, text: str) -> str:
        if not text.isascii():
            # Letters are lowered one by one, so a sigma never takes its final form.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> list[tuple[int, str, str]]:
        """Count, ids and labels of each word of a text, in order."""
        parts = self.cut.split(text) if self.cut else [text]
        out, words, special = [], self.words, self.automaton.special
        for part in parts:
            if part in special:
                out.append((1, str(special[part]), part))
                continue
            for word in self.split(self.normalised(part)):
                out.append(words.get(word) or self._word(word))
        return out


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def encoding(text: Column, automaton) -> Column:
    """Count and digests of the ids and of the decoded text. ``automaton``: a broadcast of ``TokenAutomaton``."""

    @F.pandas_udf(RESULT)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = automaton.value
        coder = getattr(compiled, "coder", None)
        if coder is None:
            coder = compiled.coder = TextCoder(compiled)
        for texts in batches:
            rows = []
            for one in texts:
                words = coder.encode(one) if one else []
                rows.append(
                    (
                        sum([w[0] for w in words]),
                        _digest(" ".join([w[1] for w in words])),
                        _digest(" ".join([w[2] for w in words])),
                    )
                )
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(text)


def encoded_ids(text: Column, automaton) -> Column:
    """The token ids of a text as an array."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = TextCoder(automaton.value)
        for texts in batches:
            yield pd.Series([[int(i) for w in coder.encode(t) for i in w[1].split(" ")] if t else [] for t in texts])

    return encode(text)


def decoded_text(ids: Column, automaton) -> Column:
    """The labels of token ids, joined by spaces."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labels = automaton.value.labels
        for lists in batches:
            yield pd.Series([None if x is None else " ".join([labels[i] for i in x]) for x in lists])

    return decode(ids)


def broadcast_automaton(spark, path: str):
    return spark.sparkContext.broadcast(ByValue(TokenAutomaton(read_vocabulary(path))))


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, n_tokens, ids_sha256 and decoded_sha256."""
    automaton = broadcast_automaton(docs.sparkSession, path)
    return docs.select(F.col(id_column), encoding(F.col(text), automaton).alias("__e")).select(id_column, "__e.*")
