"""Line-first quality rules.

Every line of a text is tested by a punctuation, a navigation and a boilerplate
rule. Failing lines are removed, and a document that loses too large a share of
its word characters is rejected. Documents that are too short or mostly repeat
themselves fail before that.

All of it is column expressions inside one row: no shuffle, no Python. Repeated
three-word windows are found by sorting 64-bit numbers that hold a hash and a
position; words of equal hashes are compared, and a text in which two different
windows meet under one hash is counted again by sorting its windows themselves.
A text of n words takes O(n log n) time.

Defined results: a null text has no words and no lines, fails the base rules and
stays null; an empty text likewise stays empty. Rows with equal ids are judged
one by one. Columns of the input are never read by name except the text, so
they may have any name.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemill.llm.common import fresh, word_array

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOST_PERCENT = 40
WINDOW = 3

# Characters counted as symbols, marks that end a sentence,
# separators between the entries of a menu, and phrases of page furniture.
SYMBOLS = "[#*$%&|<>]"
SENTENCE_MARKS = "[.!?…。！？؟।]"
MENU_MARKS = r"[|>»›·•]"
MENU_WORDS = ("home", "login", "log in", "sign in", "menu", "search", "contact", "about", "next", "previous", "skip to content")
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "terms of use",
    "terms of service",
)
MAX_SYMBOL_PERCENT = 5
MAX_MENU_WORDS = 12
# Where the phrase rule is kept to short lines: the words of a line of page furniture.
MAX_PHRASE_WORDS = 30


def count_of(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in matches of ``pattern``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def line_fails(
    line: Column,
    symbols: Column,
    shouts: Column,
    menus: Column,
    furniture: Column,
    menu_words: Sequence[str] = MENU_WORDS,
    boilerplate: Sequence[str] = BOILERPLATE,
    max_phrase_words: int | None = None,
) -> Column:
    """Whether a line with a word breaks one of the three rules.

    Punctuation: no sentence mark anywhere, more than 5 % symbols, or a doubled
    exclamation mark behind more than half of its words. Navigation: at most 12
    words of which two menu separators, or a menu label, make a menu entry.
    Boilerplate: one of the phrases, in a line of at most ``max_phrase_words``
    words if that is given. The four flags tell whether the whole text
    has a symbol, a doubled exclamation mark, a menu separator or a phrase at
    all, so that lines of ordinary texts are not searched for them.
    """
    words = F.size(word_array(line))
    punctuation = (
        ~line.rlike(SENTENCE_MARKS)
        | (symbols & (count_of(line, SYMBOLS) * 100 > F.length(line) * MAX_SYMBOL_PERCENT))
        | (shouts & (count_of(line, "!!") > words))
    )
    labels = "|".join(menu_words)
    navigation = (F.length(line) <= 60) & line.rlike(f"(?i)^\\s*(?:{labels})\\b.{{0,20}}$") | (
        menus & line.rlike(f"{MENU_MARKS}.*{MENU_MARKS}") & (words <= MAX_MENU_WORDS)
    )
    phrase = furniture & _has_phrase(line, boilerplate)
    if max_phrase_words is not None:
        phrase = phrase & (words <= max_phrase_words)
    return punctuation | navigation | phrase


def _has_phrase(text: Column, phrases: Sequence[str]) -> Column:
    low = F.lower(text)
    return reduce(operator.or_, [F.contains(low, F.lit(p)) for p in phrases])


def _repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Words that lie in a window of three words found at least twice in the row."""
    n, bits, packed, ties, spots = (fresh(x) for x in ("n", "bits", "packed", "ties", "spots"))
    w = F.col(words)

    def upto(last: Column) -> Column:
        return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def same(i: Column, j: Column) -> Column:
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    df = df.withColumn(n, F.size(w)).withColumn(bits, F.length(F.bin(F.size(w).cast("long"))))
    starts, b = upto(F.col(n) - WINDOW), F.col(bits)
    # The high bits hold a window's hash, the low bits its place.
    df = df.withColumn(
        packed,
        F.sort_array(
            F.transform(
                starts,
                lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), b).bitwiseOR(i.cast("long")),
            )
        ),
    )
    p, mask = F.col(packed), F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
    place = lambda x: x.bitwiseAND(mask).cast("int")
    df = df.withColumn(
        ties,
        F.filter(
            F.zip_with(
                p,
                F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
                lambda x, y: F.when(F.call_function("shiftright", x.bitwiseXOR(y), b) == 0, F.struct(place(x).alias("i"), place(y).alias("j"))),
            ),
            lambda t: t.isNotNull(),
        ),
    )
    t = F.col(ties)
    clash = F.exists(t, lambda x: ~same(x["i"], x["j"]))
    fast = F.concat(F.transform(t, lambda x: x["i"]), F.transform(t, lambda x: x["j"]))
    slow = F.transform(
        F.array(
            F.array_sort(
                F.transform(
                    starts,
                    lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + d) for d in range(WINDOW)]).alias("w"), i.alias("i")),
                )
            )
        ),
        lambda s: F.transform(
            F.filter(
                F.transform(
                    s,
                    lambda x, k: F.struct(
                        x["i"].alias("i"),
                        F.coalesce((x["w"] == F.get(s, k - 1)["w"]) | F.lit(False), F.lit(False)).alias("a"),
                        F.coalesce((x["w"] == F.get(s, k + 1)["w"]) | F.lit(False), F.lit(False)).alias("b"),
                    ),
                ),
                lambda x: x["a"] | x["b"],
            ),
            lambda x: x["i"],
        ),
    )[0]
    df = df.withColumn(
        spots, F.when(F.size(t) == 0, F.array().cast("array<int>")).otherwise(F.sort_array(F.array_distinct(F.when(clash, slow).otherwise(fast))))
    )
    s = F.col(spots)
    covered = F.aggregate(
        upto(F.size(s) - 1),
        F.lit(0),
        lambda acc, j: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - F.get(s, j), F.lit(WINDOW))),
    )
    return df.withColumn(out, covered.cast("long")).drop(n, bits, packed, ties, spots)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT,
    max_lost_percent: int = MAX_LOST_PERCENT,
    prefix: str = "",
    max_phrase_words: int | None = None,
) -> DataFrame:
    """Add the counts, the verdict and the cleaned text to every row.

    New columns, each with ``prefix`` before its name: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, lost_chars,
    clean_text, base_failed, kept. A prefix keeps them apart from input columns
    of the same names; without one, such input columns are replaced.
    """
    kept_columns = [c for c in docs.columns if not prefix and c not in NEW_COLUMNS or prefix]
    w, lines, bad, body, flags = (fresh(x) for x in ("words", "lines", "bad", "body", "flags"))
    repeat = fresh("repeat")
    df = docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))).withColumn(w, word_array(F.col(body)))
    df = df.withColumn(lines, F.filter(F.split(F.col(body), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeated_words(df, w, repeat)
    chars = lambda xs: F.length(F.array_join(F.transform(xs, lambda x: F.regexp_replace(x, r"[\x20\x09-\x0D]+", "")), "")).cast("long")
    has_menu = F.col(body).rlike(MENU_MARKS)
    df = df.withColumn(
        flags,
        F.struct(
            count_of(F.col(body), SYMBOLS).alias("symbols"),
            F.contains(F.col(body), F.lit("!!")).alias("shouts"),
            has_menu.alias("menus"),
            _has_phrase(F.col(body), BOILERPLATE).alias("furniture"),
        ),
    )
    f = F.col(flags)
    df = df.withColumn(bad, F.filter(F.col(lines), lambda x: line_fails(x, f["symbols"] > 0, f["shouts"], f["menus"], f["furniture"], max_phrase_words=max_phrase_words)))
    # The counts go through a generator: the optimiser does not copy what they are made of into a filter on the verdict.
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(F.col(w), "")).cast("long").alias("word_chars"),
        f["symbols"].alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
        F.col(repeat).alias("n_repeat_words"),
        F.col(bad).alias("bad"),
    )
    df = df.select(*docs.columns, F.explode(F.array(counts)).alias(w))
    m = F.col(w)
    lost = F.when(F.size(m["bad"]) == 0, F.lit(0).cast("long")).otherwise(chars(m["bad"]))
    failed = (m["n_words"] < min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * max_repeated_percent)
    clean = F.when(F.col(text).isNull() | (F.size(m["bad"]) == 0), F.col(text)).otherwise(
        F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(m["bad"], x)), "\n")
    )
    new = {name: m[name] for name in NEW_COLUMNS[:5]} | {
        "n_lines_removed": F.size(m["bad"]).cast("long"),
        "lost_chars": lost,
        "clean_text": clean,
        "base_failed": failed,
        "kept": ~failed & (lost * 100 <= m["word_chars"] * max_lost_percent),
    }
    return df.select(*kept_columns, *[c.alias(prefix + name) for name, c in new.items()])


NEW_COLUMNS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines_removed",
    "lost_chars",
    "clean_text",
    "base_failed",
    "kept",
)
