"""Listing entries and article text out of captured HTML pages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemill.functions.text import MIN_TEXT_CHARS
from scribemill.operators.markup import Node, parse
from scribemill.operators.skew import spread_join
from scribemill.session import stage

_ITEMS = "array<struct<url:string,title:string,date:string>>"


@dataclass(frozen=True)
class TableListing:
    """Entries are table rows; link and date sit in fixed cells."""

    base_url: str
    entry: str
    link_cell: int = 2
    date_cell: int = 0
    min_cells: int = 3

    def locate(self, entry: Node) -> tuple[Node | None, str]:
        cells = list(entry.select("td"))
        if len(cells) < self.min_cells:
            return None, ""
        return cells[self.link_cell].first("a"), cells[self.date_cell].text()


@dataclass(frozen=True)
class CardListing:
    """Entries are blocks; link and date are the first match of a selector. No date gives ""."""

    base_url: str
    entry: str
    link: str
    date: str | None = None

    def locate(self, entry: Node) -> tuple[Node | None, str]:
        date = entry.first(self.date) if self.date else None
        return entry.first(self.link), date.text() if date else ""


def _entries(html: str | None, form: TableListing | CardListing) -> list[dict] | None:
    """One item per entry element; an entry without a usable link has a null url."""
    if html is None:
        return None
    items = []
    for entry in parse(html).select(form.entry):
        link, date = form.locate(entry)
        href = link.attrs.get("href") if link else None
        if href:
            items.append({"url": urljoin(form.base_url, href), "title": link.text(), "date": date})
        else:
            items.append({"url": None, "title": None, "date": None})
    return items


def parse_listings(
    pages: DataFrame, form: TableListing | CardListing, keys: Sequence[str] = ("source", "page_no"), html: str = "html"
) -> DataFrame:
    """``keys`` and ``items``: every entry element of each listing page, null where the page has no HTML."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            out["items"] = [_entries(h, form) for h in batch[html]]
            yield out

    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, html).mapInPandas(run, f"{schema}, items {_ITEMS}")


def until_first_gap(
    pages: DataFrame,
    has_items: Column | None = None,
    source: str = "source",
    page_no: str = "page_no",
    first_page: int | None = None,
) -> DataFrame:
    """Keep the pages of each source before its first failed, empty or missing page.

    The crawl stops there, so later pages do not count even if they have rows.
    ``first_page`` is the smallest number in the table unless it is given.
    A page is good when ``has_items`` holds, by default when ``items`` is not empty.
    ``pages`` is read twice; stage it first if it is costly.
    """
    good = F.coalesce(F.size("items") > 0 if has_items is None else has_items, F.lit(False))
    numbered = pages.select(source, F.col(page_no).cast("long").alias("__page"), good.alias("__good"))
    first = F.lit(first_page).cast("long") if first_page is not None else numbered.agg(F.min("__page").alias("m")).select("m").scalar()
    # Every good page proposes its successor as the stop, every source its first
    # page; the smallest proposal that is not itself a good page is the stop.
    marks = F.explode(
        F.array(
            F.struct(F.col("__page").alias("page"), F.col("__good").alias("good"), F.lit(False).alias("stop")),
            F.struct(
                F.when(F.col("__good"), F.col("__page") + 1).otherwise(first).alias("page"),
                F.lit(False).alias("good"),
                F.lit(True).alias("stop"),
            ),
            F.struct(first.alias("page"), F.lit(False).alias("good"), F.lit(True).alias("stop")),
        )
    )
    stops = (
        numbered.select(source, marks.alias("m"))
        .groupBy(source, "m.page")
        .agg(F.max("m.good").alias("good"), F.max("m.stop").alias("stop"))
        .where(F.col("stop") & ~F.col("good") & (F.col("page") >= first))
        .groupBy(source)
        .agg(F.min("page").alias("__stop"))
    )
    # One row per source: staged, so that its true size decides how it is joined.
    kept = spread_join(pages, stage(stops, "stops"), [source], spread_by=page_no)
    return kept.where((F.col(page_no) >= first) & (F.col(page_no) < F.col("__stop"))).select(*pages.columns)


def listing_rows(listings: DataFrame, keys: Sequence[str] = ("source", "page_no")) -> DataFrame:
    """One index row per usable link: ``keys``, ``row_no`` within the page, url, title, date."""
    return (
        listings.select(*keys, F.posexplode("items").alias("row_no", "item"))
        .where(F.col("item.url").isNotNull())
        .select(*keys, "row_no", "item.url", "item.title", "item.date")
    )


def body_texts(
    pages: DataFrame,
    selectors: Mapping[str, str],
    keys: Sequence[str] = ("page_id",),
    html: str = "html",
    min_chars: int = MIN_TEXT_CHARS,
    wanted: str | None = None,
) -> DataFrame:
    """``keys``, ``source`` and ``text``: per selector the first matching element, one text piece per line.

    A page is parsed once for all ``selectors`` (by source name), or for those
    that its array column ``wanted`` names, and its tree is let go before the
    next one. Pages without HTML, without a match or with fewer than
    ``min_chars`` characters give no row.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, sources, texts = [], [], []
            for row, page in enumerate(batch[html]):
                tree = parse(page)
                for source in batch[wanted].iloc[row] if wanted else selectors:
                    if node := tree.first(selectors[source]):
                        rows.append(row)
                        sources.append(source)
                        texts.append(node.text("\n"))
            if rows:
                yield batch[keys].iloc[rows].assign(source=sources, text=texts)

    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    columns = [*keys, html, *([wanted] if wanted else [])]
    texts = pages.select(*columns).where(F.col(html).isNotNull()).mapInPandas(
        run, f"{schema}, source string, text string"
    )
    return long_enough(texts, min_chars)


def body_text(
    pages: DataFrame,
    selector: str,
    keys: Sequence[str] = ("page_id", "url"),
    html: str = "html",
    min_chars: int = MIN_TEXT_CHARS,
) -> DataFrame:
    """``keys`` and ``text`` for pages of one kind, see ``body_texts``."""
    return body_texts(pages, {"": selector}, keys, html, min_chars).drop("source")


def long_enough(df: DataFrame, min_chars: int = MIN_TEXT_CHARS, text: str = "text") -> DataFrame:
    """Drop rows whose text is null or shorter than ``min_chars`` code points."""
    return df.where(F.length(text) >= min_chars)
