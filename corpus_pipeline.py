"""Document pipeline: quality rules, near-duplicates, secrets, mixing and encoding.

Every stage takes documents and returns documents, the last one the encodings.
``run`` writes each stage's result as Parquet into the shared folder and reads it
back for the next one, so a lost executor costs part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribemill.llm.bpe_automaton import encode_documents
from scribemill.llm.common import documents, fresh, join_counted
from scribemill.llm.mixing import mix_sources
from scribemill.llm.neardup import near_duplicates
from scribemill.llm.quality import MAX_PHRASE_WORDS, quality_rules
from scribemill.llm.secrets import redact_documents
from scribemill.session import stage

# Words of a shingle in the near-duplicate stage; the query of that operator has its own.
NEAR_SHINGLE_WORDS = 5
# Ids, or ids with a number, are broadcast up to this many rows and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _with_text(docs: DataFrame, text: str) -> list:
    """The columns of the documents with the text of another column and its length."""
    own = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        changed = ~F.col(text).eqNullSafe(F.col("text"))
        own["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return [own.get(c, F.col(c)).alias(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that break a rule are cut from the others. A phrase of page furniture condemns short lines only.

    Rows are judged one by one: a null or empty text is rejected, repeated rows fare alike. No rows give no rows.
    """
    prefix = fresh("quality")
    kept = quality_rules(docs, prefix=prefix, max_phrase_words=MAX_PHRASE_WORDS).where(f"{prefix}kept")
    return kept.select(*_with_text(docs, f"{prefix}clean_text"))


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """The documents with a number of their own, which tells rows of one id apart. Written down, so that it stays."""
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, shingle_words: int = NEAR_SHINGLE_WORDS) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows count one by one: rows of one id with different texts belong to
    different groups, repeated rows to one, of which one row stays. Rows without an id
    all stay, and are no group's document. Texts that are null or without words are in no group. No rows give no rows.
    """
    row = fresh("row")
    rows = _numbered(docs, row)
    found = near_duplicates(rows.select(row, "text"), row, shingle_words=shingle_words).select(row, "component_id")
    named = stage(found.join(rows.where("doc_id is not null").select(row, "doc_id"), row), "named")
    groups = named.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", row)).alias("first"))
    groups = stage(groups.where("n > 1").select("component_id", "n", F.col(f"first.{row}").alias("stays")), "groups")
    gone = join_counted(named, groups, "component_id", "n", row).where(F.col("stays") != F.col(row)).select(row)
    return rows.join(_small(stage(gone, "gone")), row, "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every row stays, null and empty texts as they are."""
    before = fresh("before")
    masked = redact_documents(docs.withColumn(before, F.col("text")))
    text = fresh("text")
    return masked.withColumnsRenamed({"text": text, before: "text"}).select(*_with_text(docs, text))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, each row by its own count.

    A null text has no words and is not taken; rows without a source are a source of their own. No rows give no rows.
    """
    row, copies = fresh("row"), fresh("copies")
    rows = _numbered(docs, row)
    taken = mix_sources(rows.select("doc_id", "text", "source", row), keep=row).where("copies > 0")
    taken = stage(taken.select(row, F.col("copies").cast("int").alias(copies)), "copies")
    repeats = F.explode(F.sequence(F.lit(1), F.col(copies)))
    return rows.join(_small(taken), row).select(*docs.columns, repeats.alias(fresh("copy"))).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the token ids and of the decoded texts, one row for each row; a null text counts as empty."""
    return encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("mixing_sources", mixing_stage),
    ("bpe_encoding", encoding_stage),
]
# Near-duplicate search by minhashes and a trained forest have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
