"""Pair generation over a corpus and the training set made of its pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribemill.functions.text import chat_text, clean_text
from scribemill.operators.corpus import SEQ_BITS, exact_sample
from scribemill.operators.pairs import (
    Generate,
    call_generator,
    parse_pairs,
    prompts,
    token_progress,
    token_totals,
)
from scribemill.operators.prefix import dense_index
from scribemill.operators.trainset import BLOCK_TOKENS, count_whitespace_tokens, packed_slices, training_texts
from scribemill.session import stage
from scribemill.sources.readers import JSONL_GLOB, PAIR_SCHEMA, list_files, read_jsonl_numbered, read_jsonl_ordered


@dataclass(frozen=True)
class PairRun:
    parsed: DataFrame
    totals: DataFrame
    progress: DataFrame


def generate_pairs(
    docs: DataFrame,
    generate: Generate,
    template: str,
    seq: str = "seq",
    sample: int = 0,
    seed: int = 42,
    parallelism: int | None = None,
    key_bits: int = SEQ_BITS,
) -> PairRun:
    """Sample, clean, prompt, call, parse. ``parsed`` has position, title, status, pairs and tokens per document.

    Positions are given to the parsed rows, so the texts are not shuffled for them.
    """
    chosen = exact_sample(docs, sample, seed, seq).withColumn("text", clean_text(F.col("text")))
    answered = call_generator(prompts(chosen, template), generate, [seq, "title"], parallelism=parallelism)
    parsed = stage(parse_pairs(answered, [seq, "title"]), "pairs")
    return PairRun(
        parsed=dense_index(parsed, seq, key_bits=key_bits),
        totals=token_totals(parsed),
        progress=token_progress(parsed, seq, key_bits=key_bits),
    )


def _must_match(spark: SparkSession, path: str, glob: str | None) -> None:
    """A folder without a matching file fails instead of giving no rows."""
    if glob:
        list_files(spark, path, glob)


def load_training_set(spark: SparkSession, path: str, glob: str | None = JSONL_GLOB) -> tuple[DataFrame, int]:
    """The column ``text`` of a file or folder of pairs, and its row count."""
    _must_match(spark, path, glob)
    texts = training_texts(read_jsonl_ordered(spark, path, PAIR_SCHEMA, glob))
    return texts, texts.count()


def ordered_training_set(spark: SparkSession, path: str, glob: str | None = JSONL_GLOB) -> DataFrame:
    """The same texts with their 0-based position in file and line order. No text moves for its number."""
    _must_match(spark, path, glob)
    pairs = read_jsonl_numbered(spark, path, PAIR_SCHEMA, glob)
    return pairs.select("position", chat_text(F.col("instruction"), F.col("output")).alias("text"))


def pack_folder(
    spark: SparkSession,
    path: str,
    count_tokens: Callable[[Column], Column] = count_whitespace_tokens,
    block_tokens: int = BLOCK_TOKENS,
    glob: str | None = JSONL_GLOB,
) -> DataFrame:
    """Block slices of a folder of pairs, texts in file and line order."""
    placed = ordered_training_set(spark, path, glob)
    return packed_slices(placed, "position", count_tokens, block_tokens=block_tokens)

