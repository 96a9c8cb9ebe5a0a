"""Relational steps of the corpus: lookup, filter, union, dedup, sample, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scribemill.functions.text import title_key
from scribemill.operators.prefix import dense_index
from scribemill.operators.skew import HOT_ROWS, spread_join

_ROW_BITS = 20
_PAGE_BITS = 35
SEQ_BITS = 63


def order_key(source_rank: Column, page_no: Column, row_no: Column) -> Column:
    """One long that sorts like (source_rank, page_no, row_no); values that do not fit fail the job."""
    rank, page, row = (c.cast("long") for c in (source_rank, page_no, row_no))
    fits = rank.between(0, 127) & page.between(0, 2**_PAGE_BITS - 1) & row.between(0, 2**_ROW_BITS - 1)
    key = F.shiftleft(rank, _PAGE_BITS + _ROW_BITS) + F.shiftleft(page, _ROW_BITS) + row
    return F.when(fits, key).otherwise(F.raise_error(F.lit("row order out of range")).cast("long"))


def union_sources(*sources: tuple[str, DataFrame]) -> DataFrame:
    """All rows of the first source, then all of the second, ...; adds ``source`` and ``source_rank``."""
    tagged = [
        df.withColumns({"source": F.lit(name), "source_rank": F.lit(rank)}) for rank, (name, df) in enumerate(sources)
    ]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def first_captures(pages: DataFrame, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(url, page_id) with one page per url, the one with the smallest id. Reads no HTML."""
    return pages.groupBy(url).agg(F.min(page_id).alias(page_id))


def attach_text(
    index: DataFrame, texts: DataFrame, on: Sequence[str] = ("url",), spread_by: str = "seq", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Index rows with the text of their page; rows without a page are lost, duplicates stay.

    ``texts`` has one row per key. An index may point at one page any number
    of times, so popular pages are spread.
    """
    return spread_join(index, texts.select(*on, "text"), on, spread_by=spread_by, hot_rows=hot_rows)


def first_titles(df: DataFrame, title: str = "title", seq: str = "seq") -> DataFrame:
    """The ``seq`` of the earliest row of every title key.

    Only (key, seq) pairs are grouped, with partial minima before the shuffle.
    """
    return df.groupBy(title_key(F.col(title)).alias("__key")).agg(F.min(seq).alias(seq)).select(seq)


def first_per_title(df: DataFrame, title: str = "title", seq: str = "seq") -> DataFrame:
    """Keep the earliest row of every title key. The rows move once, by the unique ``seq``."""
    return df.join(first_titles(df, title, seq), seq, "left_semi")


def numbered_first_per_title(
    df: DataFrame, title: str = "title", seq: str = "seq", name: str = "position", key_bits: int = SEQ_BITS
) -> DataFrame:
    """The same rows with their dense 0-based position, still moved only once."""
    return df.join(dense_index(first_titles(df, title, seq), seq, name, key_bits), seq)


def source_counts(df: DataFrame, accepted: Column, source: str = "source") -> DataFrame:
    """Rows found and rows the title filter skips, per source."""
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(~F.coalesce(accepted, F.lit(False))).alias("skipped")
    )


def corpus_totals(df: DataFrame, title: str = "title") -> DataFrame:
    """Raw rows and rows left after first-wins dedup."""
    keys = df.groupBy(title_key(F.col(title)).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    return keys.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("raw_total"), F.count(F.lit(1)).alias("unique_total")
    )


# Up to this many sampled rows the tasks keep their own smallest hashes; beyond it the bound is found by counting.
TOP_ROWS = 10_000


def exact_sample(df: DataFrame, n: int, seed: int, key: str, top_rows: int = TOP_ROWS) -> DataFrame:
    """Exactly ``n`` rows without replacement; all rows when ``n <= 0`` or ``n`` exceeds the table.

    Rows are ranked by a hash of seed and the unique ``key``, so the same seed
    picks the same rows on any cluster. A null key, or a key that stands twice
    where the sample ends, fails the job. The rows themselves are filtered by
    the bound and never shuffled. Up to ``top_rows`` rows the bound comes from one
    scan of the keys, of which a task keeps ``n``; both ways pick the same rows.
    """
    if n <= 0:
        return df
    known = F.coalesce(F.col(key).cast("string"), F.raise_error(F.lit(f"sample key {key} is null")).cast("string"))
    ranked = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), known)))
    picked = _up_to_nth(ranked, n, key) if n <= top_rows else _below_rank(ranked, n, key)
    return picked.drop("__h")


def _up_to_nth(ranked: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` rows with the smallest hash, by the smallest ``n + 1`` of all."""
    top = ranked.select("__h", key).orderBy("__h", key).limit(n + 1)
    edge = top.agg(F.slice(F.sort_array(F.collect_list(F.struct("__h", key))), n, 2).alias("e")).select("e").scalar()
    last, following = F.get(edge, F.lit(0)), F.get(edge, F.lit(1))
    twice = F.raise_error(F.lit(f"sample key {key} is not unique")).cast("boolean")
    # There is no bound when the table has fewer than n rows.
    return ranked.where(F.when(last.isNull(), F.lit(True)).when(last.eqNullSafe(following), twice).otherwise(F.struct("__h", key) <= last))


def _below_rank(ranked: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` rows with the smallest hash, without sorting the table in one place.

    Counts per 16-bit hash prefix give the prefix in which rank ``n`` falls, a
    second round refines it to 32 bits. Only rows that share all 32 bits with
    the bound are ranked, by key alone; the last of them that is wanted is the
    bound up to which the table is kept. Whole rows are never shuffled.
    """
    keys = ranked.select("__h", key)
    low, need = F.lit(""), F.lit(n).cast("long")
    for digits in (4, 8):
        counts = (
            keys.where(F.substring("__h", 1, digits - 4) == low)
            .groupBy(F.substring("__h", 1, digits).alias("p"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
        before = F.coalesce(F.sum("n").over(w), F.lit(0))
        found = counts.withColumns({"before": before, "need": need}).where(
            (F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("n"))
        )
        bound = found.agg(F.max(F.struct("p", (F.col("need") - F.col("before")).alias("need"))).alias("b")).select("b").scalar()
        low, need = bound["p"], bound["need"]
    prefix = F.substring("__h", 1, 8)
    edge = keys.where(prefix == low).withColumns(
        {
            "__r": F.row_number().over(Window.partitionBy(prefix).orderBy("__h", key)),
            "__c": F.count(F.lit(1)).over(Window.partitionBy("__h", key)),
        }
    )
    last = edge.where(F.col("__r") <= need).agg(F.max(F.struct("__h", key, "__c")).alias("b")).select("b").scalar()
    unique = F.when(last["__c"] > 1, F.raise_error(F.lit(f"sample key {key} is not unique")).cast("boolean")).otherwise(F.lit(True))
    # There is no bound when the table has fewer than n rows.
    return ranked.where(last.isNull() | (unique & (F.struct("__h", key) <= F.struct(last["__h"], last[key]))))


TITLE_REPORT_CHARS = 60


def document_report(
    positioned: DataFrame, pairs: str = "pairs", title: str = "title", position: str = "position", total: str = "total"
) -> DataFrame:
    """One line per document: 1-based position of the total, pairs found and the capped title."""
    return positioned.select(
        (F.col(position) + 1).alias("position"),
        F.col(total).alias("total"),
        F.coalesce(F.size(pairs), F.lit(0)).alias("n_pairs"),
        F.substring(F.coalesce(F.col(title), F.lit("")), 1, TITLE_REPORT_CHARS).alias("title"),
    )


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail where one of the columns is null (a record without it cannot be processed)."""
    checks = {
        c: F.coalesce(F.col(c), F.raise_error(F.lit(f"record without {c}")).cast(df.schema[c].dataType))
        for c in columns
    }
    return df.withColumns(checks)
