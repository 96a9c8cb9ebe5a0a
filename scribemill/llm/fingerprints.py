"""I-Match fingerprints: hashes of the terms that fall into randomised lexicons.

The lexicon holds terms whose inverse document frequency, over all documents,
lies in a band: at least ``MIN_SHARE`` of the documents have the term, and two of
them, and at most ``MAX_SHARE``. Documents are counted per term, by its 63-bit
hash, and the sorted hashes of the terms in the band go to all tasks. A document
with d distinct terms can lift d / (``MIN_SHARE`` * documents) of them over the
edge, so the lexicon has at most mean d / ``MIN_SHARE`` terms at any size of the
corpus, eight bytes each. Each of ``DRAWS`` random draws deals
the lexicon into ``RATES`` subsets of a half, a quarter, an eighth and so on of
its terms. A fingerprint has one hash per subset, over the sorted distinct terms
that the text shares with it: the sum of their mixed hashes, mixed once more. The likeness of two fingerprints is the share of
equal hashes among the subsets that hit either text, counted over the rates at
which a good part of the subsets hits neither: larger subsets differ as soon as
one term does. Equal fingerprints have likeness 1.

Scale: one pass counts terms, with counts summed per task before they move, and
terms out of the band never leave the executors; the
second pass moves each text once, to a range of ids, because a text is compared
with its successor. The first text of a range is also sent to the range before
it. Ranges are streamed, so a task holds two texts at a time.

Defined results: a null text counts as empty. A text without any term in the
band has a piece of one long digest of itself in every place, so equal texts
always have equal fingerprints and different ones do not. Rows follow by id (null first) and, for equal ids, by text; the
successor of the last row is the first, of an only row the row itself.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribemill.llm.common import ByValue, file_partitions, small_table

DRAWS = 12
RATES = 10
# A rate counts while at most this share of its subsets hits.
MAX_HIT_SHARE = 0.75
EMPTY = "----"
# A cell without a hit, above all others.
NO_HIT = 1 << 16
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
MIN_DOCUMENTS = 2
MIN_SHARE = 1e-4
MAX_SHARE = 0.05
REMEMBERED_TERMS = 1_000_000
# Terms of documents that a task counts at a time.
COUNTED_TERMS = 2_000_000
RANGES_PER_TASK = 4
NO_ID = -(2**63)
# A term's place is its hash without the sign.
PLACE = (1 << 63) - 1
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_terms = re.compile(r"\w+").findall


def term_hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "replace"))


def term_counts(texts: DataFrame) -> DataFrame:
    """Documents per term, by its place, and in place -1 all documents. ``texts`` has one column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, known, found = 0, {}, array("q")

        def counted() -> Iterator[pa.RecordBatch]:
            places, n = np.unique(np.frombuffer(found, dtype=np.int64), return_counts=True)
            for at in range(0, len(places), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(places[part], pa.int64()), pa.array(n[part], pa.int64())], names=["place", "n"])

        for batch in batches:
            for one in batch.column(0):
                terms = set(_terms((one.as_py() or "").lower()))
                own = set(map(known.get, terms))
                if None in own:
                    own.discard(None)
                    new = {term: term_hash(term) & PLACE for term in terms if term not in known}
                    own.update(new.values())
                    if len(known) + len(new) > REMEMBERED_TERMS:
                        known.clear()
                    known.update(new)
                found.extend(own)
                if len(found) > COUNTED_TERMS:
                    yield from counted()
                    found = array("q")
            documents += batch.num_rows
        yield from counted()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([documents], pa.int64())], names=["place", "n"])

    return texts.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


class Lexicon:
    """The places of the terms in the band, in order."""

    def __init__(self, places: np.ndarray):
        self.places = np.sort(places)

    def holds(self, places: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.places, places)
        return self.places.take(at, mode="clip") == places if len(self.places) else np.zeros(len(places), dtype=bool)

    def __getitem__(self, place: int) -> int:
        return int(self.holds(np.array([place], dtype=np.int64))[0])


def lexicon_bits(texts: DataFrame, min_documents: int, max_share: float, min_share: float = MIN_SHARE) -> Lexicon:
    """Whether each place is in the band. The places come to the driver packed, eight bytes a term in the band."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [batch.column(0).to_numpy() for batch in batches]
        if places:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(places).tobytes()], pa.binary())], names=["places"])

    counts = term_counts(texts).persist()
    documents = counts.where("place = -1").agg(F.sum("n")).first()[0] or 0
    rarest = max(min_documents, min_share * documents)
    inside = counts.where((F.col("place") >= 0) & (F.col("n") >= rarest) & (F.col("n") <= max(rarest, max_share * documents)))
    packed = [bytes(row["places"]) for row in inside.select("place").mapInArrow(pack, "places binary").collect()]
    counts.unpersist()
    return Lexicon(np.frombuffer(b"".join(packed), dtype=np.int64))


class Fingerprinter:
    """Fingerprints of texts against a lexicon."""

    def __init__(self, inside: Lexicon):
        self.inside = inside
        self.factors = np.random.default_rng(9_176).integers(1, 2**63, DRAWS, dtype=np.uint64) | np.uint64(1)
        self.known: dict[str, int] = {}

    def _places(self, terms: list[str]) -> list[int]:
        """The terms' hashes, 0 for those that are not in the band."""
        values = np.fromiter(map(term_hash, terms), dtype=np.uint64, count=len(terms))
        values[~self.inside.holds((values & np.uint64(PLACE)).view(np.int64))] = 0
        values = values.tolist()
        if len(self.known) + len(values) > REMEMBERED_TERMS:
            self.known.clear()
        self.known.update(zip(terms, values))
        return values

    def cells(self, text: str) -> np.ndarray:
        """The fingerprint as numbers, ``NO_HIT`` for a subset that has none of the text's terms."""
        terms, known = set(_terms(text.lower())), self.known
        values = set(map(known.get, terms))
        if None in values:
            values.discard(None)
            values.update(self._places([term for term in terms if term not in known]))
        values.discard(0)
        if not values:
            digest = hashlib.shake_128(text.encode("utf-8", "replace")).digest(2 * DRAWS * RATES)
            return np.frombuffer(digest, dtype=">u2").astype(np.int32)
        hashed = np.sort(np.fromiter(values, dtype=np.uint64, count=len(values)))
        mixed = hashed[None, :] * self.factors[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        # The number of leading zeros says which subset of the draw a term is in.
        subset = np.minimum(64 - np.frexp(mixed.astype(np.float64))[1], RATES - 1) + np.arange(DRAWS)[:, None] * RATES
        subset = subset.ravel().astype(np.uint8)
        order = np.argsort(subset, kind="stable")
        # Within a subset the terms stay sorted; the leading zeros are the same there, so the low half is mixed in.
        mixed ^= mixed << np.uint64(29)
        ordered = subset[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sums = np.add.reduceat(mixed.ravel()[order], starts)
        sums ^= sums >> np.uint64(32)
        sums *= np.uint64(0x9FB21C651E98DF25)
        out = np.full(DRAWS * RATES, NO_HIT, dtype=np.int32)
        out[ordered[starts]] = (sums >> np.uint64(48)).astype(np.int32)
        return out

    def of(self, text: str) -> str:
        return as_text(self.cells(text))


def as_text(cells: np.ndarray) -> str:
    """Four characters a cell: hexadecimal digits, or the mark of a cell without a hit."""
    nibbles = (cells[:, None] >> np.array([12, 8, 4, 0])) & 15
    digits = np.where(cells[:, None] == NO_HIT, ord(EMPTY[0]), _HEX[nibbles])
    return digits.astype(np.uint8).tobytes().decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.array([NO_HIT if fingerprint[i] == EMPTY[0] else int(fingerprint[i : i + 4], 16) for i in range(0, len(fingerprint), 4)], dtype=np.int32)


def cell_likeness(a: np.ndarray, b: np.ndarray) -> float:
    same = a == b
    if same.all():
        return 1.0
    hit = ((a != NO_HIT) | (b != NO_HIT)).reshape(DRAWS, RATES)
    hits, sames = hit.sum(axis=0), (hit & same.reshape(DRAWS, RATES)).sum(axis=0)
    sparse = hits <= MAX_HIT_SHARE * DRAWS
    if hits[sparse].any():
        hits, sames = hits[sparse], sames[sparse]
    return float(sames.sum() / hits.sum()) if hits.any() else 0.0


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1."""
    return cell_likeness(from_text(a), from_text(b))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows with the range of their id, plus the first row of each range once more as ``extra`` of the range before it."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    borders = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, ids.to_numpy(), side="right")).astype("int32")

    firsts = sorted(docs.select("id", range_of("id").alias("range")).groupBy("range").agg(F.min("id").alias("id")).collect())
    # Where each first id goes once more: the range before its own; the very first to the last range, behind all.
    again = [(f["id"], firsts[i - 1]["range"], 2 if i == 0 else 1) for i, f in enumerate(firsts)]
    again = F.broadcast(small_table(spark, again, "id long, before int, extra int"))
    own = F.struct(F.col("range"), F.lit(0).alias("extra"))
    copy = F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.col("extra")))
    return (
        docs.withColumn("range", range_of("id")).join(again, "id", "left")
        .select("id", "no_id", "text", F.explode(F.filter(F.array(own, copy), lambda x: x.isNotNull())).alias("to"))
        .select("to.range", "to.extra", "id", "no_id", "text")
    )


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per document, see ``RESULT``."""
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(id_column).isNull().alias("no_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    maker = spark.sparkContext.broadcast(ByValue(Fingerprinter(lexicon_bits(rows.select("text"), min_documents, max_share, min_share))))
    tasks = file_partitions(spark)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, held = maker.value, [], None
        names = [c.split(" ")[0] for c in RESULT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for where, extra, number, no_id, body in zip(*columns, batch.column(4)):
                body = body.as_py()
                current = (where, extra, None if no_id else number, body, own.cells(body))
                # An extra row only ends its range: the row before it is the last one there.
                if held and held[0] == where and not held[1]:
                    new = edited(held[3], body)
                    made = own.cells(new)
                    out.append(
                        (
                            held[2],
                            len(held[3]),
                            hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(),
                            as_text(held[4]),
                            as_text(made),
                            cell_likeness(held[4], made),
                            cell_likeness(held[4], current[4]),
                        )
                    )
                held = current
            yield packed()
            out = []

    dealt = _ranged(rows, RANGES_PER_TASK * tasks).repartition("range").sortWithinPartitions("range", "extra", "id", "text")
    done = dealt.mapInArrow(compare, RESULT)
    return done.withColumnRenamed("doc_id", id_column) if id_column != "doc_id" else done
