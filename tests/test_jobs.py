from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from scribemill.operators import jobs

DESCRIPTION = ("job_id string, written_at timestamp, TrainingJobStatus string, FailureReason string, "
               "ModelArtifacts struct<S3ModelArtifacts:string>, FinalMetricDataList array<struct<MetricName:string,Value:double>>")
AT = datetime.datetime(2024, 2, 3, 4, 5, 6)


def test_records_of_descriptions(spark):
    metrics = [("train:loss", 0.5), ("", 1.0), ("eval/accuracy", 0.85), ("gone", None), ("status", 9.0), (None, 1.0), ("train/loss", 0.396)]
    df = spark.createDataFrame([("j1", AT, "Completed", None, ("s3://m",), metrics), ("j2", AT, None, None, None, None)], DESCRIPTION)
    one, two = jobs.job_records(df).orderBy("job_id").collect()
    assert tuple(one) == ("j1", "2024-02-03T04:05:06Z", "Completed", "s3://m", {"train_loss": "0.396", "eval_accuracy": "0.85"}, ["status"])
    assert tuple(two) == ("j2", "2024-02-03T04:05:06Z", "Unknown", None, {}, [])


def test_registry_rows_join_the_same_table(spark):
    models = spark.createDataFrame([("m", "arn:x", AT)], "model_name string, model_arn string, written_at timestamp")
    row = jobs.registry_records(models).first()
    assert row.asDict() == {"job_id": "bedrock-import-m", "timestamp": "2024-02-03T04:05:06Z", "status": "Completed", "bedrock_model_arn": "arn:x", "model_name": "m"}


def test_metric_rows_become_columns(spark):
    rows = [("j", "a:b", 1.0, 0), ("j", "a/b", 2.0, 1), ("j", "a:b", None, 2), ("j", "", 5.0, 3), ("k", "c", 3.0, 0)]
    df = spark.createDataFrame(rows, "job_id string, name string, value double, seq long")
    assert {tuple(r) for r in jobs.metric_columns(df, ["a_b", "c"]).collect()} == {("j", 2.0, None), ("k", None, 3.0)}


def polls(spark, sequences):
    rows = [(job, AT + datetime.timedelta(minutes=i), i, s, r) for job, seq in sequences.items() for i, (s, r) in enumerate(seq)]
    return spark.createDataFrame(rows, "job_id string, ts timestamp, poll_id long, status string, reason string").repartition(3)


SEQUENCES = {
    "done": [("InProgress", None), ("InProgress", None), ("Completed", None), ("Failed", "late")],
    "why": [("Failed", "out of memory")],
    "unknown": [("InProgress", None), ("Failed", None)],
    "stopped": [("Stopped", None)],
    "running": [("InProgress", None), ("InProgress", None)],
}


def test_first_terminal_status(spark):
    got = {r.job_id: (r.status, r.polls, r.error) for r in jobs.first_terminal(polls(spark, SEQUENCES)).collect()}
    assert got == {"done": ("Completed", 3, None), "why": ("Failed", 1, "out of memory"), "unknown": ("Failed", 2, "Unknown"),
                   "stopped": ("Stopped", 1, None), "running": ("Running", 2, None)}
    imports = jobs.first_terminal(polls(spark, SEQUENCES), jobs.IMPORT_TERMINAL)
    assert {r.job_id: r.status for r in imports.collect()}["stopped"] == "Running"


def test_latest_completed_artifact(spark):
    rows = [("m", "Completed", "a", "t1"), ("m", "Completed", "b", "t3"), ("m", "Failed", "c", "t4"), ("m", "Completed", None, "t5")]
    df = spark.createDataFrame(rows, "model_name string, status string, artifact string, timestamp string")
    assert tuple(jobs.latest_completed(df, "model_name", "artifact").first()) == ("m", "b", "t3")


def test_upsert_without_puts_keeps_the_table(spark):
    table = spark.createDataFrame([("j", "t", "x")], "job_id string, timestamp string, status string")
    none = spark.createDataFrame([], "job_id string, timestamp string, status string, put_no long")
    assert [tuple(r) for r in jobs.upsert(table, none).collect()] == [("j", "t", "x")]


def test_jobs_and_models_share_one_table(spark, tmp_path):
    from scribemill.plans.serving import record_jobs, record_models

    base = str(tmp_path / "records")
    first = spark.createDataFrame([("j", AT, "Failed", None, None, [("loss", 1.0)]), ("j", AT, "Completed", None, ("s3://m",), None)], DESCRIPTION)
    record_jobs(first.coalesce(1).withColumn("put_no", F.monotonically_increasing_id()), base)
    table = record_models(spark.createDataFrame([("m", "arn:x", AT, 0)], "model_name string, model_arn string, written_at timestamp, put_no long"), base)
    rows = {r.job_id: (r.status, r.model_artifact, r.metrics, r.bedrock_model_arn) for r in table.collect()}
    assert rows == {"j": ("Completed", "s3://m", {}, None), "bedrock-import-m": ("Completed", None, None, "arn:x")}


def test_a_null_job_id_is_a_job(spark):
    df = spark.createDataFrame(
        [(None, 1, 1, "Running", None), (None, 2, 2, "Failed", "why"), (None, 3, 3, "Failed", "later"), ("a", 1, 4, "Running", None)],
        "job_id string, ts long, poll_id long, status string, reason string",
    )
    got = {r.job_id: (r.status, r.polls, r.error) for r in jobs.first_terminal(df).collect()}
    assert got == {None: ("Failed", 2, "why"), "a": ("Running", 1, None)}


def test_spans_of_any_width_fold_to_the_same_ends(spark):
    import random

    rng = random.Random(9)
    rows, want = [], {}
    for job in ["hot"] + [f"j{i}" for i in range(30)] + [None]:
        n, t = (600 if job == "hot" else rng.randrange(1, 12)), 0
        seen, end = 0, None
        for i in range(n):
            t += rng.choice([0, 1, 700, 4000, 90_000])
            status = rng.choices(["InProgress", "Completed", "Failed"], [50 if job == "hot" else 6, 1, 1])[0]
            why = rng.choice([None, "why"])
            rows.append((job, AT + datetime.timedelta(seconds=t), i, status, why))
            if end is None:
                seen += 1
                if status != "InProgress":
                    end = (status, rows[-1][1], (why or "Unknown") if status == "Failed" else None)
        want[job] = (*(end or ("Running", None, None)), seen)
    df = spark.createDataFrame(rows, "job_id string, ts timestamp, poll_id long, status string, reason string").repartition(4)
    for width in (1, 3600, 10**9):
        got = {r.job_id: (r.status, r.ended_at, r.error, r.polls) for r in jobs.first_terminal(df, bucket_seconds=width).collect()}
        assert got == want


def test_polls_without_a_time_come_first_and_equal_ones_count(spark):
    rows = [("a", None, 1, "InProgress", None), ("a", AT, 2, "Failed", "x"), ("a", AT, 2, "InProgress", None), ("b", None, 1, "Completed", None)]
    df = spark.createDataFrame(rows, "job_id string, ts timestamp, poll_id long, status string, reason string")
    assert {(r.job_id, r.status, r.polls, r.error) for r in jobs.first_terminal(df).collect()} == {("a", "Failed", 3, "x"), ("b", "Completed", 1, None)}
    plan = jobs.first_terminal(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
