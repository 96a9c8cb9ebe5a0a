"""Job status sequences, metric attributes and the keyed record table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scribemill.functions.text import py_float_text

# Statuses that end a job, and the registry key prefix.
TRAINING_TERMINAL = ("Completed", "Failed", "Stopped")
IMPORT_TERMINAL = ("Completed", "Failed")
REGISTRY_PREFIX = "bedrock-import-"
BASE_FIELDS = ("job_id", "timestamp", "status", "model_artifact")
UNKNOWN = "Unknown"


def timestamp_text(ts: Column) -> Column:
    """UTC second in the form 2024-01-31T12:00:00Z (the session time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def attribute_name(name: Column) -> Column:
    return F.translate(name, ":/", "__")


def usable_metrics(metrics: Column) -> Column:
    """The (MetricName, Value) entries that have a name and a value; an empty list when there is none."""
    named = F.filter(metrics, lambda m: (m["MetricName"] != "") & m["Value"].isNotNull())
    return F.coalesce(named, F.expr("cast(array() as array<struct<MetricName:string,Value:double>>)"))


def metric_attributes(usable: Column, names: Column, reserved: Sequence[str] = BASE_FIELDS) -> Column:
    """Map of attribute name to value text; later entries win.

    ``names`` holds the attribute name of every entry. Names that would
    replace a field of the record itself are left out.
    """
    entries = F.transform(usable, lambda m, i: F.struct(F.get(names, i).alias("key"), m["Value"].alias("value")))
    last = F.filter(
        entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]) & ~e["key"].isin(*reserved)
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], py_float_text(e["value"]))))


def reserved_names(names: Column, reserved: Sequence[str] = BASE_FIELDS) -> Column:
    """Attribute names that are left out because the record has a field of that name."""
    return F.array_distinct(F.filter(names, lambda n: n.isin(*reserved)))


def job_records(
    descriptions: DataFrame, job_id: str = "job_id", written_at: str = "written_at", keep: Sequence[str] = ()
) -> DataFrame:
    """One record per job description: base fields, the ``metrics`` map and the columns to ``keep``."""
    named = descriptions.withColumn("__m", usable_metrics(F.col("FinalMetricDataList"))).withColumn(
        "__n", F.transform("__m", lambda m: attribute_name(m["MetricName"]))
    )
    return named.select(
        F.col(job_id).alias("job_id"),
        timestamp_text(F.col(written_at)).alias("timestamp"),
        F.coalesce(F.col("TrainingJobStatus"), F.lit(UNKNOWN)).alias("status"),
        F.col("ModelArtifacts.S3ModelArtifacts").alias("model_artifact"),
        metric_attributes(F.col("__m"), F.col("__n")).alias("metrics"),
        reserved_names(F.col("__n")).alias("rejected_metrics"),
        *keep,
    )


def registry_records(
    models: DataFrame,
    name: str = "model_name",
    arn: str = "model_arn",
    written_at: str = "written_at",
    prefix: str = REGISTRY_PREFIX,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One record per imported model for the same table."""
    return models.select(
        F.concat(F.lit(prefix), F.col(name)).alias("job_id"),
        timestamp_text(F.col(written_at)).alias("timestamp"),
        F.lit("Completed").alias("status"),
        F.col(arn).alias("bedrock_model_arn"),
        F.col(name).alias("model_name"),
        *keep,
    )


def metric_columns(
    metrics: DataFrame, names: Sequence[str], job: str = "job_id", name: str = "name", value: str = "value", order: str = "seq"
) -> DataFrame:
    """Metrics that arrive as rows, one column per declared attribute name, last value wins.

    All columns come from one aggregation with partial results before the shuffle.
    """
    usable = metrics.where((F.col(name) != "") & F.col(value).isNotNull()).select(
        job, attribute_name(F.col(name)).alias("__name"), F.col(value).alias("__value"), F.col(order).alias("__order")
    )
    last = [
        F.max_by(F.when(F.col("__name") == n, F.col("__value")), F.when(F.col("__name") == n, F.col("__order"))).alias(n)
        for n in names
    ]
    return usable.groupBy(job).agg(*last)


def upsert(table: DataFrame | None, puts: DataFrame, keys: Sequence[str] = ("job_id", "timestamp"), order: str = "put_no") -> DataFrame:
    """The table after the puts: a put replaces the whole row of its key, the last one stays.

    ``order`` numbers the puts. Attributes of a replaced row do not survive.
    """
    rows = puts
    if table is not None:
        old = table.withColumn(order, F.lit(None).cast(puts.schema[order].dataType))
        rows = old.unionByName(puts, allowMissingColumns=True)
    latest = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return rows.withColumn("__r", F.row_number().over(latest)).where(F.col("__r") == 1).drop("__r", order)


# Width of the time buckets in which polls are summed up.
POLL_BUCKET_SECONDS = 3600


def first_terminal(
    polls: DataFrame,
    terminal: Sequence[str] = TRAINING_TERMINAL,
    failed: str = "Failed",
    job: str = "job_id",
    ts: str = "ts",
    poll_id: str = "poll_id",
    status: str = "status",
    reason: str = "reason",
    bucket_seconds: int = POLL_BUCKET_SECONDS,
) -> DataFrame:
    """Per job the first terminal status, the polls up to it, and the error of a failed job.

    A job without a terminal status is ``Running`` and all its polls count.
    Polls without a time come first. Polls are read once: those of a job in one
    span of time make a summary, its polls, its first end and the polls up to that, and the
    summaries of a job are put together in time order. So a job with all the polls is spread over its time.
    """
    at = F.struct(F.col(ts).alias("ts"), F.col(poll_id).alias("id"))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = F.coalesce(F.call_function("div", micros, F.lit(bucket_seconds * 1_000_000)), F.lit(-(2**63)))
    ended = F.col(status).isin(*terminal)
    # As the field of a struct, a null job id is equal to itself.
    rows = polls.select(
        F.struct(F.col(job).alias("j")).alias("__j"), span.alias("__b"), at.alias("__at"), F.when(ended, F.col(status)).alias("__s"),
        F.when(ended, F.col(reason)).alias("__r"),
    )
    # Ordered without a row frame, the count takes in polls of the same time and id.
    upto = F.count(F.lit(1)).over(Window.partitionBy("__j", "__b").orderBy("__at"))
    end = F.when(F.col("__s").isNotNull(), F.struct("__at", "__s", "__r", "__upto"))
    spans = rows.withColumn("__upto", upto).groupBy("__j", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min(end).alias("__end"))
    first = F.min(F.when(F.col("__end").isNotNull(), F.col("__b"))).over(Window.partitionBy("__j"))
    counted = F.when(F.col("__first").isNull() | (F.col("__b") < F.col("__first")), F.col("__n")).when(
        F.col("__b") == F.col("__first"), F.col("__end.__upto")
    )
    folded = spans.withColumn("__first", first).groupBy("__j").agg(
        F.sum(counted).alias("polls"), F.max(F.when(F.col("__b") == F.col("__first"), F.col("__end"))).alias("__end")
    )
    outcome = F.coalesce(F.col("__end.__s"), F.lit("Running"))
    return folded.select(
        F.col("__j.j").alias(job),
        outcome.alias("status"),
        F.col("__end.__at.ts").alias("ended_at"),
        "polls",
        F.when(outcome == failed, F.coalesce(F.col("__end.__r"), F.lit(UNKNOWN))).alias("error"),
    )


def latest_completed(records: DataFrame, by: str, artifact: str, timestamp: str = "timestamp", completed: str = "Completed") -> DataFrame:
    """The artifact of the newest completed record per job or model name."""
    return (
        records.where((F.col("status") == completed) & F.col(artifact).isNotNull())
        .groupBy(by)
        .agg(F.max_by(artifact, timestamp).alias(artifact), F.max(timestamp).alias(timestamp))
    )
