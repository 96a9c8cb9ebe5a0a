"""Stateful stream forms of the rate limit, the first terminal status and answer reassembly.

Each keeps a small state per key and removes it when it can no longer matter: a
rate window when it is over, a job and an answer when nothing came for a time.
Times are event times behind the watermark: streams have ``delay`` to bring rows
into order, and a row that comes later than that has no result. Where chunks
of answers carry no time, their arrival is it. Rows of a key arrive in order
across triggers; within one they are sorted.

The state needs Spark's RocksDB store, which ``build_session`` sets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scribemill.functions.answers import BYTE_CHARS, DONE, decode_line, utf8_text
from scribemill.operators.anchored import starts_from
from scribemill.operators.jobs import TRAINING_TERMINAL, UNKNOWN
from scribemill.operators.requests import RATE_LIMIT

# How long a job or an answer without news is remembered.
JOB_IDLE_SECONDS = 7 * 86_400
ANSWER_IDLE_SECONDS = 3_600
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _sorted_rows(frames: Iterator[pd.DataFrame], columns: list[str], by: list[str]) -> pd.DataFrame:
    """All rows of a key in a trigger. Computed columns lose their names on the way to the state step, so they are named by place."""
    return pd.concat(list(frames)).set_axis(columns, axis=1).sort_values(by, kind="stable")


def _plain(values: list) -> pd.Series:
    """A column of Python objects; what leaves a state step must not be in Arrow-backed chunks, as texts are by default."""
    return pd.Series(values, dtype=object)


def _ms(micros: int) -> int:
    return -(-micros // 1000)


def admit(t: np.ndarray, start: int | None, used: int, limit: int, width: int, anchored: bool) -> tuple[np.ndarray, int, int]:
    """Which calls at the sorted times ``t`` are admitted, and the window and its calls behind the last of them.

    ``start`` and ``used`` are the window and its calls so far. A call from before that window counts in it.
    """
    if anchored:
        starts = starts_from(t, int(t[0]) if start is None else start + width, width)
    else:
        starts = np.unique(t - t % width)
        starts = starts if start is None else starts[starts > start]
    windows = starts if start is None else np.concatenate([[start], starts])
    at = np.maximum(np.searchsorted(windows, t, side="right") - 1, 0)
    rank = np.arange(len(t)) - np.searchsorted(at, at)
    if start is not None:
        rank[at == 0] += used
    return rank < limit, int(windows[at[-1]]), int(rank[-1]) + 1


class _Limiter(StatefulProcessor):
    """State of a bucket of callers: start of each caller's window and calls in it, until the window is over.

    Callers are taken by the bucket because a call of a state step costs far more than a caller's rows do.
    """

    def __init__(self, by: str, kind: str, request_id: str, limit: int, width: int, anchored: bool):
        self.by, self.kind, self.request_id, self.limit, self.width, self.anchored = by, kind, request_id, limit, width, anchored

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", f"caller {self.kind}", "start long, used long")

    def handleInputRows(self, key, rows, timerValues):
        frame = _sorted_rows(rows, ["__bucket", self.by, self.request_id, "__none", "__ts", "__t"], ["__t", "__none", self.request_id])
        codes, callers = pd.factorize(frame[self.by], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes)).tolist()
        t, admitted, starts = frame["__t"].to_numpy()[order], np.empty(len(frame), dtype=bool), []
        for caller, lo, hi in zip(callers.tolist(), [0, *ends], ends):
            who = (None if pd.isna(caller) else caller,)
            before, used = self.windows.getValue(who) or (None, 0)
            admitted[order[lo:hi]], start, used = admit(t[lo:hi], before, used, self.limit, self.width, self.anchored)
            self.windows.updateValue(who, (start, used))
            starts.append(start)
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(_ms(min(starts) + self.width))
        ids = _plain(list(frame[self.request_id])).mask(frame["__none"].to_numpy(), None)
        yield pd.DataFrame({self.by: _plain(list(frame[self.by])), self.request_id: ids, "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Windows that are over go. The next look is a width later, so a window stays for one width too long at most."""
        now = timerValues.getCurrentWatermarkInMs()
        found = [(tuple(who), _ms(window[0] + self.width) <= now) for who, window in self.windows.iterator()]
        if all(over for _, over in found):
            self.windows.clear()
            return iter(())
        for who, over in found:
            if over:
                self.windows.removeKey(who)
        self.handle.registerTimer(now + _ms(self.width))
        return iter(())

    def close(self) -> None:
        pass


# Buckets of callers in the state of a rate limit. Fixed for the life of a stream; those of a task are taken one after the other.
CALLER_BUCKETS = 1024


def rate_limit_stream(
    calls: DataFrame,
    limit: int = RATE_LIMIT,
    window_seconds: int = 60,
    anchored: bool = True,
    by: str = "caller",
    ts: str = "ts",
    request_id: str = "request_id",
    delay: str = "1 minute",
    buckets: int = CALLER_BUCKETS,
) -> DataFrame:
    """(caller, request_id, admitted) per call.

    ``anchored`` windows start at the caller's first call, otherwise windows are
    calendar-aligned. A call without a time is not admitted, and keeps no state.
    The rows of a bucket in one trigger meet in memory, so a stream of very many callers wants more ``buckets``.
    """
    when = F.col(ts).cast("timestamp")
    kind = {c: calls.schema[c].dataType.simpleString() for c in (by, request_id)}
    # A null would make the whole numbers beside it inexact: no id is a mark, and calls without a caller have a bucket of their own.
    known = F.coalesce(F.col(request_id), F.lit(0).cast(kind[request_id])) if kind[request_id] in INTEGERS else F.col(request_id)
    bucket = F.when(F.col(by).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(by), F.lit(buckets))).cast("int")
    timed = calls.where(F.col(ts).isNotNull()).select(
        bucket.alias("__bucket"), by, known.alias(request_id), F.col(request_id).isNull().alias("__none"), when.alias("__ts"), F.unix_micros(when).alias("__t")
    )
    marked = timed.withWatermark("__ts", delay).groupBy("__bucket").transformWithStateInPandas(
        _Limiter(by, kind[by], request_id, limit, window_seconds * 1_000_000, anchored),
        f"`{by}` {kind[by]}, `{request_id}` {kind[request_id]}, admitted boolean",
        "Append",
        "EventTime",
    )
    return marked.unionByName(calls.where(F.col(ts).isNull()).select(by, request_id, F.lit(False).alias("admitted")))


class _FirstEnd(StatefulProcessor):
    """State: polls so far, whether the job ended, and its last poll, until no poll came for ``idle``."""

    def __init__(self, job: str, poll_id: str, status: str, reason: str, ends: frozenset, failed: str, idle: int):
        self.job, self.poll_id, self.status, self.reason = job, poll_id, status, reason
        self.ends, self.failed, self.idle = ends, failed, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "polls long, done boolean, last long")

    def handleInputRows(self, key, rows, timerValues):
        frame = _sorted_rows(rows, [self.job, self.poll_id, self.status, self.reason, "__ts", "__t"], ["__t", self.poll_id])
        polls, done, last = self.seen.get() or (0, False, None)
        newest = int(frame["__t"].iloc[-1])
        ended = frame[self.status].isin(self.ends).to_numpy()
        if not done and ended.any():
            done, at = True, int(ended.argmax())
            row, why = frame.iloc[at], frame[self.reason].iloc[at]
            error = (UNKNOWN if pd.isna(why) else why) if row[self.status] == self.failed else None
            yield pd.DataFrame(
                {
                    self.job: _plain([key[0]]),
                    "status": _plain([row[self.status]]),
                    "ended_micros": [int(row["__t"])],
                    "polls": [polls + at + 1],
                    "error": _plain([error]),
                }
            )
        newest = newest if last is None else max(newest, last)
        self.seen.update((polls + len(frame), done, newest))
        if newest != last:
            self.handle.registerTimer(_ms(newest + self.idle))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen = self.seen.get()
        if seen and _ms(seen[2] + self.idle) <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_terminal_stream(
    polls: DataFrame,
    terminal: Sequence[str] = TRAINING_TERMINAL,
    failed: str = "Failed",
    job: str = "job_id",
    ts: str = "ts",
    poll_id: str = "poll_id",
    status: str = "status",
    reason: str = "reason",
    delay: str = "1 hour",
    idle_seconds: int = JOB_IDLE_SECONDS,
) -> DataFrame:
    """One row per job when its first terminal status arrives. Polls without a time are left out.

    A job that is polled again after ``idle_seconds`` without a poll starts anew.
    """
    when = F.col(ts).cast("timestamp")
    kind = polls.schema[job].dataType.simpleString()
    timed = polls.where(F.col(ts).isNotNull()).select(job, poll_id, status, reason, when.alias("__ts"), F.unix_micros(when).alias("__t"))
    out = timed.withWatermark("__ts", delay).groupBy(job).transformWithStateInPandas(
        _FirstEnd(job, poll_id, status, reason, frozenset(terminal), failed, idle_seconds * 1_000_000),
        f"`{job}` {kind}, status string, ended_micros long, polls long, error string",
        "Append",
        "EventTime",
    )
    return out.select(job, "status", F.timestamp_micros("ended_micros").alias("ended_at"), "polls", "error")


class _Assembler(StatefulProcessor):
    """State: bytes of the unfinished last line, the lines so far and the last arrival, until nothing came for ``idle``."""

    def __init__(self, request: str, chunk: str, idle: int):
        self.request, self.chunk, self.idle = request, chunk, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tail", "tail binary, lines long, last long")

    def handleInputRows(self, key, rows, timerValues):
        frame = _sorted_rows(rows, [self.request, self.chunk, "__bytes", "__ts", "__t"], [self.chunk])
        tail, lines, last = self.state.get() or (b"", 0, None)
        newest = int(frame["__t"].max()) if last is None else max(int(frame["__t"].max()), last)
        pieces = [bytes(piece) for piece in frame["__bytes"]]
        *whole, tail = b"".join([bytes(tail), *pieces]).split(b"\n")
        self.state.update((tail, lines + len(whole), newest))
        if newest != last:
            self.handle.registerTimer(_ms(newest + self.idle))
        # The lines that end in each chunk, as many as it has line ends.
        counts = np.array([piece.count(b"\n") for piece in pieces])
        ends = np.cumsum(counts)
        some = np.flatnonzero(counts)
        yield pd.DataFrame(
            {
                self.request: _plain([key[0]] * len(some)),
                self.chunk: frame[self.chunk].to_numpy()[some],
                "__first": lines + ends[some] - counts[some],
                "__lines": _plain([b"\n".join(whole[lo:hi]).decode(BYTE_CHARS) for lo, hi in zip((ends - counts)[some], ends[some])]),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.state.get()
        if state and _ms(state[2] + self.idle) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def answer_tokens_stream(
    chunks: DataFrame,
    request: str = "request_id",
    chunk: str = "chunk",
    data: str = "data",
    ts: str | None = None,
    delay: str = "1 second",
    idle_seconds: int = ANSWER_IDLE_SECONDS,
) -> DataFrame:
    """Tokens as their lines complete. ``data`` is text, or bytes cut anywhere, also inside a character.

    ``ts`` is when a chunk was sent; without it, the time of the trigger that takes it in. A
    chunk's lines leave the state step together, so the end mark of a chunk
    is applied to that chunk without further state. A chunk without data is an empty one.
    """
    kind = {c: chunks.schema[c].dataType.simpleString() for c in (request, chunk, data)}
    content = F.col(data) if kind[data] == "binary" else F.encode(data, "UTF-8")
    when = F.coalesce(F.col(ts).cast("timestamp"), F.current_timestamp()) if ts else F.current_timestamp()
    rows = chunks.select(request, chunk, F.coalesce(content, F.lit(b"")).alias("__bytes"), when.alias("__ts"))
    timed = rows.withColumn("__t", F.unix_micros("__ts")).withWatermark("__ts", delay)
    finished = timed.groupBy(request).transformWithStateInPandas(
        _Assembler(request, chunk, idle_seconds * 1_000_000),
        f"`{request}` {kind[request]}, `{chunk}` {kind[chunk]}, __first long, __lines string",
        "Append",
        "EventTime",
    )
    lines = F.split("__lines", "\n", -1)
    tokens = F.transform(lines, lambda line, i: F.struct(i.cast("long").alias("i"), decode_line(utf8_text(F.encode(line, BYTE_CHARS))).alias("t")))
    end = F.array_position(F.transform("__t", lambda x: F.coalesce(x["t"], F.lit(""))), DONE)
    kept = F.filter(
        F.when(end > 0, F.slice("__t", 1, (end - 1).cast("int"))).otherwise(F.col("__t")), lambda x: x["t"].isNotNull()
    )
    return (
        finished.withColumn("__t", tokens)
        .select(request, chunk, "__first", F.explode(kept).alias("x"))
        .select(request, chunk, (F.col("__first") + F.col("x.i")).alias("line_no"), F.col("x.t").alias("token"))
    )
