"""Request log: verdict per request, rate limits, outcome counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scribemill.functions.answers import caller, client_view, invalid_reason, service_status
from scribemill.functions.text import strip_control_tokens
from scribemill.operators.anchored import BLOCK_WINDOWS, label_windows
from scribemill.operators.skew import spread_join
from scribemill.session import stage

# Requests per caller and window.
RATE_LIMIT = 10
RATE_WINDOW = "1 minute"


# Above this rank Spark no longer limits groups before the shuffle.
_PLANNER_RANK = 1000
_SALTS = 64


def _group_key(by: str) -> Column:
    """Never null, so that calls without a caller are limited together."""
    return F.coalesce(F.col(by).cast("string"), F.lit(""))


def _over_limit(calls: DataFrame, group: list[str], limit: int, ts: str, request_id: str) -> DataFrame:
    """Per group with more than ``limit`` calls, the first call that is too many.

    The row_number filter is applied before the shuffle as well, so a task
    sends at most ``limit + 1`` rows of a group, however large the group is.
    For large limits the same is done by ranking within salts first.
    """

    def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ts, request_id))
        return df.withColumn("__rank", rank).where(F.col("__rank") <= limit + 1)

    rows = calls.select(*group, ts, request_id)
    if limit >= _PLANNER_RANK:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(request_id), F.lit(_SALTS)))
        rows = first_rows(salted, [*group, "__salt"]).drop("__salt", "__rank")
    last = first_rows(rows, group).where(F.col("__rank") == limit + 1)
    return last.select(*group, F.struct(F.col(ts).alias("ts"), F.col(request_id).alias("id")).alias("__cut"))


def _mark_over_limit(
    calls: DataFrame, group: list[str], limit: int, ts: str, request_id: str, name: str, counted: Column | None = None
) -> DataFrame:
    # Usually few groups go over the limit. The staged cuts show their true
    # size, so the calls need no shuffle when the cuts can be broadcast.
    cuts = stage(_over_limit(calls if counted is None else calls.where(counted), group, limit, ts, request_id), "cuts")
    at = F.struct(F.col(ts).alias("ts"), F.col(request_id).alias("id"))
    return spread_join(calls, cuts, group, "left", spread_by=request_id).select(
        *calls.columns, F.coalesce(at < F.col("__cut"), F.lit(True)).alias(name)
    )


def _micros(window: str) -> int:
    """Microseconds of a span such as ``90 seconds`` or ``1 minute``."""
    amount, unit = window.split(" ")
    return int(amount) * 1_000_000 * {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}[unit.removesuffix("s")]


def rate_limit(
    calls: DataFrame,
    limit: int = RATE_LIMIT,
    window: str = RATE_WINDOW,
    by: str = "caller",
    ts: str = "ts",
    request_id: str = "request_id",
    name: str = "admitted",
    counted: Column | None = None,
) -> DataFrame:
    """Add whether a call is among the first ``limit`` of its caller in its calendar window.

    Rejected calls count towards the limit. A call without a time is in no window and not admitted. ``counted`` restricts which calls
    count at all; the mark of the others has no meaning.
    """
    # Arithmetic instead of the window function, which drops rows without a time.
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    windowed = calls.withColumns({"__k": _group_key(by), "__w": F.floor(micros / F.lit(_micros(window))).cast("long")})
    marked = _mark_over_limit(windowed, ["__k", "__w"], limit, ts, request_id, name, counted).drop("__k", "__w")
    return marked.withColumn(name, F.col(ts).isNotNull() & F.col(name))


def rate_limit_anchored(
    calls: DataFrame,
    limit: int = RATE_LIMIT,
    window_seconds: int = 60,
    by: str = "caller",
    ts: str = "ts",
    request_id: str = "request_id",
    name: str = "admitted",
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The same with windows that start at a caller's first call and restart at the first call after their end.

    ``request_id`` is unique. Only (caller, time, id) rows go through the
    window labelling; the calls themselves meet the list of rejected ids.
    """
    width = window_seconds * 1_000_000
    narrow = calls.where(F.col(ts).isNotNull()).select(
        _group_key(by).alias("__k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"), F.col(request_id).alias("__id")
    )
    # Read twice: for the cut-offs and for the calls beyond them.
    labelled = stage(label_windows(narrow, width, block_windows), "windows")
    marked = _mark_over_limit(labelled, ["__k", "__anchor"], limit, "__t", "__id", "__ok")
    rejected = stage(marked.where(~F.col("__ok")).select(F.col("__id").alias(request_id), F.lit(False).alias("__ok")), "rejected")
    return spread_join(calls, rejected, [request_id], "left", spread_by=request_id).select(
        *calls.columns, (F.col(ts).isNotNull() & F.coalesce("__ok", F.lit(True))).alias(name)
    )


def validate(log: DataFrame, **limits: float) -> DataFrame:
    """Add ``caller``, ``clean_question`` and ``reason`` (null when the request is valid).

    ``limits`` are those of ``invalid_reason``.
    """
    return log.withColumns(
        {
            "caller": caller(F.col("user_id"), F.col("client_addr")),
            "clean_question": strip_control_tokens(F.col("question")),
            "reason": invalid_reason(F.col("question"), F.col("max_tokens"), F.col("temperature"), **limits),
        }
    )


def verdicts(
    log: DataFrame,
    limit: int = RATE_LIMIT,
    window: str = RATE_WINDOW,
    error: str = "error",
    authorized: str = "authorized",
    **limits: float,
) -> DataFrame:
    """HTTP status of every request: 401, 422, 429, 400, then what the service answered.

    Only calls that pass the first two checks count towards the rate limit.
    """
    checked = validate(log, **limits)
    reaches = F.col(authorized) & F.col("reason").isNull()
    limited = rate_limit(checked, limit, window, counted=reaches)
    status: Column = (
        F.when(~F.coalesce(F.col(authorized), F.lit(False)), 401)
        .when(F.col("reason").isNotNull(), 422)
        .when(~F.col("admitted") & F.col("ts").isNotNull(), 429)
        .when(F.col("clean_question") == "", 400)
        .otherwise(service_status(F.col(error)))
    )
    return limited.select(*checked.columns, status.alias("status"))


def outcome_report(answered: DataFrame, status: str = "status") -> DataFrame:
    """Requests per status and what the client does with it."""
    return (
        answered.groupBy(F.col(status).alias("status"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("client", client_view(F.col("status")))
    )
