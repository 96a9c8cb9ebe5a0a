"""Job records into the record table, and reports over the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scribemill.operators.jobs import job_records, registry_records
from scribemill.operators.requests import RATE_LIMIT, RATE_WINDOW, outcome_report, verdicts
from scribemill.sources.writers import put_records


def record_jobs(descriptions: DataFrame, base: str, order: str = "put_no") -> DataFrame:
    """Put one record per job description; ``order`` numbers the puts."""
    return put_records(job_records(descriptions, keep=[order]).drop("rejected_metrics"), base, order=order)


def record_models(models: DataFrame, base: str, order: str = "put_no") -> DataFrame:
    """Put one registry record per imported model into the same table."""
    return put_records(registry_records(models, keep=[order]), base, order=order)


def request_report(log: DataFrame, limit: int = RATE_LIMIT, window: str = RATE_WINDOW) -> DataFrame:
    """Requests per final status of a request log."""
    return outcome_report(verdicts(log, limit, window))
