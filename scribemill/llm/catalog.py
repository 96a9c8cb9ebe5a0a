"""Registered queries of this package, each over its whole table, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribemill.llm import common
from scribemill.llm.oracles import ORACLES
from scribemill.llm.bpe_automaton import encode_documents
from scribemill.llm.centroids import cluster_vectors
from scribemill.llm.chat import format_chats
from scribemill.llm.fingerprints import fingerprints
from scribemill.llm.licenses import scan_licenses
from scribemill.llm.mixing import mix_sources
from scribemill.llm.neardup import near_duplicates
from scribemill.llm.quality import quality_rules
from scribemill.llm.secrets import scan_secrets
from scribemill.llm.sharding import shard_by_bytes
from scribemill.llm.spelling import spelling_groups
from scribemill.llm.token_counts import count_tokens
from scribemill.llm.web_archives import archive_pages
from scribemill.session import new_path

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, sf):
    docs = common.documents(spark, sf).select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_lines_removed",
        "lost_chars",
        "base_failed",
        "kept",
    )


@query
def op2_histogram_shards(spark, sf):
    docs = common.documents(spark, sf).select("doc_id", "text")
    return shard_by_bytes(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_mixed_sources(spark, sf):
    docs = common.documents(spark, sf).select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query
def op3_bpe_automaton(spark, sf):
    docs = common.documents(spark, sf).select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_token_counts(spark, sf):
    docs = common.documents(spark, sf).select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_tensored_minhash(spark, sf):
    return near_duplicates(common.documents(spark, sf).select("doc_id", "text"))


@query
def op7_imatch_fingerprints(spark, sf):
    return fingerprints(common.documents(spark, sf).select("doc_id", "text"))


@query
def op9_secret_forest(spark, sf):
    docs = common.documents(spark, sf).select("doc_id", "text", "source")
    found = scan_secrets(docs).withColumnRenamed("doc_id", "id")
    joined = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select(
        "doc_id",
        F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce("n_secrets", F.lit(0)).cast("long").alias("n_secrets"),
        "max_score",
        F.when(F.col("n_secrets") > 0, F.sha2(F.array_join("secrets", "\n"), 256)).alias("secrets_sha256"),
    )


@query
def op6_chat_snapshots(spark, sf):
    return format_chats(spark.read.parquet(f"{sf}/conversations.parquet"))


@query
def op8_license_digests(spark, sf):
    return scan_licenses(common.documents(spark, sf).select("doc_id", "text"))


@query
def op11_spelling_variants(spark, sf):
    return spelling_groups(common.documents(spark, sf).select("doc_id", "text"))


@query
def op12_laesa_clusters(spark, sf):
    return cluster_vectors(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"))


@query
def op13_web_archives(spark, sf):
    return archive_pages(spark.read.parquet(f"{sf}/pages.parquet"), new_path(spark, "packages"))
