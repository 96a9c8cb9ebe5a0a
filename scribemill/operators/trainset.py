"""Training texts, fixed-size token blocks and the size report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemill.functions.text import chat_text
from scribemill.operators.prefix import running_sums
from scribemill.session import stage

# Fixed value: tokens per training block.
BLOCK_TOKENS = 2048
# Sizes of a useful set of pairs.
TOO_FEW = 12
WANTED = 500
COMFORTABLE = 1_000
DIMINISHING = 10_000


def training_texts(pairs: DataFrame) -> DataFrame:
    """The single column ``text`` in the chat template. ``input`` is not used."""
    return pairs.select(chat_text(F.col("instruction"), F.col("output")).alias("text"))


# Same characters as SPACE_CHARS; the class shorthand is much faster than listing them.
_TOKEN = r"(?U)[^\s\x{1c}-\x{1f}]+"


def whitespace_tokens(text: Column) -> Column:
    """Default tokenizer: runs of characters other than whitespace."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def count_whitespace_tokens(text: Column) -> Column:
    """Number of those tokens, without building them."""
    return F.regexp_count(text, F.lit(_TOKEN))


def _placed(
    texts: DataFrame, order: str, count_tokens: Callable[[Column], Column], text: str, key_bits: int
) -> DataFrame:
    """(order, __n, __start): tokens of each text with its separator, and tokens before it.

    Counts are staged, so the texts are tokenised once and only counts are shuffled.
    """
    sized = texts.select(order, (count_tokens(F.col(text)) + 1).cast("long").alias("__n"))
    return running_sums(stage(sized, "token-counts"), order, {"__start": F.col("__n")}, key_bits=key_bits)


def _slices(block_tokens: int) -> Column:
    """The (block, lo, hi) entries of one placed text."""
    size = F.lit(block_tokens).cast("long")
    start, end = F.col("__start"), F.col("__start") + F.col("__n")
    blocks = F.sequence(F.call_function("div", start, size), F.call_function("div", end - 1, size))
    return F.transform(
        blocks,
        lambda b: F.struct(
            b.alias("block"),
            F.greatest(b * size - start, F.lit(0)).alias("lo"),
            F.least((b + 1) * size - start, F.col("__n")).alias("hi"),
        ),
    )


def packed_slices(
    texts: DataFrame,
    order: str,
    count_tokens: Callable[[Column], Column] = count_whitespace_tokens,
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    key_bits: int = 63,
) -> DataFrame:
    """Where each text lands when all texts, one separator after each, are cut every ``block_tokens``.

    One row per (block, text): tokens ``lo`` to ``hi`` (exclusive) of the text and its
    separator are in ``block``.
    """
    placed = _placed(texts, order, count_tokens, text, key_bits)
    return placed.select(order, F.explode(_slices(block_tokens)).alias("s")).select("s.block", order, "s.lo", "s.hi")


def packed_blocks(
    texts: DataFrame,
    order: str,
    tokenize: Callable[[Column], Column] = whitespace_tokens,
    count_tokens: Callable[[Column], Column] | None = None,
    separator: str = "</s>",
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    keep_partial: bool = True,
    key_bits: int = 63,
) -> DataFrame:
    """The tokens of every block. A block holds at most ``block_tokens`` tokens, so groups are small.

    The texts are shuffled once, to meet their place in the stream, and their
    pieces once, to meet in blocks.
    """
    count = count_tokens or (lambda c: F.size(tokenize(c)))
    placed = _placed(texts, order, count, text, key_bits)
    tokens = F.concat(tokenize(F.col(text)), F.array(F.lit(separator)))
    bound = texts.select(order, text).join(placed, order).select(order, tokens.alias("__t"), _slices(block_tokens).alias("__s"))
    # Pieces are cut inside the array, so no copy of all tokens goes with each piece.
    pieces = F.transform(
        "__s", lambda s: F.struct(s["block"].alias("block"), F.slice(F.col("__t"), s["lo"] + 1, s["hi"] - s["lo"]).alias("t"))
    )
    cut = bound.select(order, F.explode(pieces).alias("s"))
    piece = F.struct(F.col(order), F.col("s.t").alias("t"))
    blocks = cut.groupBy("s.block").agg(F.array_sort(F.collect_list(piece)).alias("__p")).select(
        "block", F.flatten(F.col("__p.t")).alias("tokens")
    )
    return blocks if keep_partial else blocks.where(F.size("tokens") == block_tokens)


def readiness(
    pairs: DataFrame, too_few: int = TOO_FEW, wanted: int = WANTED, comfortable: int = COMFORTABLE, diminishing: int = DIMINISHING
) -> DataFrame:
    """Number of pairs and how that compares with the wanted size."""
    n = F.col("pairs")
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).withColumn(
        "verdict",
        F.when(n <= too_few, "too few")
        .when(n < wanted, "below the wanted size")
        .when(n < comfortable, "enough")
        .when(n <= diminishing, "comfortable")
        .otherwise("diminishing returns"),
    )
