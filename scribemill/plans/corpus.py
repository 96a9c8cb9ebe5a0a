"""Corpus build: listings and article pages in, deduplicated records out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemill.functions.text import MIN_TEXT_CHARS
from scribemill.operators.corpus import (
    attach_text,
    corpus_totals,
    first_captures,
    first_per_title,
    numbered_first_per_title,
    source_counts,
    union_sources,
)
from scribemill.operators.extract import (
    CardListing,
    TableListing,
    body_texts,
    listing_rows,
    parse_listings,
    until_first_gap,
)
from scribemill.operators.prefix import order_rows
from scribemill.operators.skew import spread_join
from scribemill.session import stage

RECORD = ("title", "date", "source", "url", "text")


@dataclass(frozen=True)
class Source:
    """One site: its listing pages (page_no, html), how to read them and where the article text is."""

    name: str
    listings: DataFrame
    form: TableListing | CardListing
    body: str
    accepts: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Corpus:
    raw: DataFrame
    unique: DataFrame
    counts: DataFrame
    totals: DataFrame


def index_rows(source: Source) -> DataFrame:
    """Index rows of one site up to its first empty, failed or missing listing page."""
    tagged = source.listings.select(F.lit(source.name).alias("source"), "page_no", "html")
    # Parsed once, read twice: to find the stop and to list the rows.
    parsed = stage(parse_listings(tagged, source.form), "listings")
    return listing_rows(until_first_gap(parsed)).drop("source")


def wanted_pages(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The HTML of the pages in ``wanted`` (page_id, wanted), which has one row per page.

    Beyond the broadcast limit both sides are shuffled, but HTML only of pages that may be
    wanted: from the condition on ``wanted`` Spark makes a Bloom filter of its page ids and applies it
    where the pages are read (thresholds in ``build_session``). Page ids are unique, so no task gets a large share.
    """
    return articles.select("page_id", "html").join(wanted.where(F.size("wanted") > 0), "page_id")


def build_corpus(sources: Sequence[Source], articles: DataFrame, min_chars: int = MIN_TEXT_CHARS) -> Corpus:
    """Records of all sources in order, and the same with only the first of every title.

    ``articles`` has page_id, url and html. The title filter runs on the index,
    so rejected rows take no part in the lookup.
    """
    found = [(s, index_rows(s)) for s in sources]
    index = union_sources(*[(s.name, rows) for s, rows in found])
    accepted = F.lit(True)
    for s, _ in found:
        if s.accepts:
            accepted = F.when(F.col("source") == s.name, s.accepts(F.col("title"))).otherwise(accepted)
    index = order_rows(index.withColumn("accepted", accepted), ["source_rank", "page_no", "row_no"], "seq")
    kept = index.where("accepted").drop("accepted")
    # Addresses are resolved to page ids first, so each text moves at most once:
    # not at all when the staged index is small enough to broadcast.
    located = stage(spread_join(kept, first_captures(articles), ["url"], spread_by="seq"), "located")
    # Only pages that a kept row points at are parsed, each with the selectors of its own sites.
    wanted = stage(located.groupBy("page_id").agg(F.collect_set("source").alias("wanted")), "wanted")
    texts = body_texts(wanted_pages(articles, wanted), {s.name: s.body for s, _ in found}, min_chars=min_chars, wanted="wanted")
    raw = stage(attach_text(located, texts, ["source", "page_id"]).select("seq", *RECORD), "raw-records")
    return Corpus(
        raw=raw,
        unique=first_per_title(raw),
        counts=source_counts(index, F.col("accepted")),
        totals=corpus_totals(raw),
    )


def numbered(corpus: Corpus) -> DataFrame:
    """The unique records with their dense position, ready for numbered files."""
    return numbered_first_per_title(corpus.raw)
