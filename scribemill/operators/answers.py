"""Answer streams: events to lines, chunks back to tokens and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from scribemill.functions.answers import BYTE_CHARS, DONE, decode_line, done_line, encode_line, utf8_text
from scribemill.operators.prefix import running_sums

# Line numbers per partial text (2**12); partial texts of one answer are built in parallel.
_PART_BITS = 12


def encode_answers(events: DataFrame, requests: DataFrame | None = None, request: str = "request_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """Stream lines: one per non-empty text event, then one end mark per request.

    Events without text (other event kinds) give no line. ``requests`` may
    list requests that have no event at all.
    """
    lines = events.where(F.length(text) > 0).select(request, seq, encode_line(F.col(text)).alias("line"))
    ends = events.groupBy(request).agg(F.max(seq).alias(seq))
    if requests is not None:
        ends = requests.select(request).join(ends, request, "left")
    ends = ends.select(request, (F.coalesce(F.col(seq), F.lit(-1)) + 1).alias(seq), done_line().alias("line"))
    return lines.unionByName(ends)


def answer_tokens(chunks: DataFrame, request: str = "request_id", chunk: str = "chunk", data: str = "data", key_bits: int = 45) -> DataFrame:
    """Tokens of every request: (request, chunk in which the line ends, line_no, token).

    ``data`` is text, or bytes cut anywhere, also inside a character. Chunks are
    joined and cut at newlines; an unfinished last line is dropped.
    An end mark drops the later tokens of its own chunk, not those of later chunks.

    No UTF-8 sequence goes on after a newline, broken or not, so bytes can be cut there
    before they are decoded. Until its line is whole, a byte is one Latin-1 character; then the line is
    decoded on its own. That gives what decoding the whole answer would, and
    chunks of one answer need no decoder state from the chunks before them.

    A line number is the count of newlines before it, so pieces of a line are
    brought together by (request, line) and a long answer is decoded in parallel.
    """
    as_bytes = chunks.schema[data].dataType == BinaryType()
    rows = chunks.select(request, chunk, (F.decode(data, BYTE_CHARS) if as_bytes else F.col(data)).alias(data))
    newlines = F.size(F.split(data, "\n", -1)) - 1
    numbered = running_sums(
        rows,
        chunk,
        {"__before": newlines.cast("long")},
        partition=[request],
        totals={"__lines": "__before"},
        key_bits=key_bits,
    )
    pieces = (
        numbered.select(request, chunk, "__before", "__lines", F.posexplode(F.split(data, "\n", -1)).alias("__pos", "__piece"))
        .withColumn("line_no", F.col("__before") + F.col("__pos"))
        .where(F.col("line_no") < F.col("__lines"))
    )
    # Nearly all lines lie in one chunk; an ordered concatenation handles the rest.
    lines = pieces.groupBy(request, "line_no").agg(
        F.max(chunk).alias(chunk),
        F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("c"), F.col("__piece").alias("p")))).alias("__pieces"),
    )
    line = F.array_join(F.col("__pieces.p"), "")
    line = utf8_text(F.encode(line, BYTE_CHARS)) if as_bytes else line
    decoded = lines.select(request, chunk, "line_no", decode_line(line).alias("token")).where(F.col("token").isNotNull())
    same_chunk = Window.partitionBy(request, chunk)
    end = F.min(F.when(F.col("token") == DONE, F.col("line_no"))).over(same_chunk)
    return (
        decoded.withColumn("__end", end)
        .where(F.col("__end").isNull() | (F.col("line_no") < F.col("__end")))
        .drop("__end")
    )


def answer_texts(chunks: DataFrame, request: str = "request_id", chunk: str = "chunk", data: str = "data", key_bits: int = 45) -> DataFrame:
    """The full text shown for every request, empty when no token arrived."""
    tokens = answer_tokens(chunks, request, chunk, data, key_bits)
    parts = (
        tokens.groupBy(request, F.shiftright("line_no", _PART_BITS).alias("__part"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "token"))).alias("__t"))
        .select(request, "__part", F.array_join(F.col("__t.token"), "").alias("text"))
    )
    none = chunks.groupBy(request).agg(F.lit(-1).cast("long").alias("__part"), F.lit("").alias("text"))
    joined = parts.unionByName(none).groupBy(request).agg(
        F.array_sort(F.collect_list(F.struct("__part", "text"))).alias("__p")
    )
    return joined.select(request, F.array_join(F.col("__p.text"), "").alias("text"))
