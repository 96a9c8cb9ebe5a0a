"""Stream forms give the rows of the batch forms, also when input comes in several triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribemill.operators import answers, jobs, requests
from scribemill.streaming import stateful
from tests.test_jobs import SEQUENCES, polls
from tests.test_requests import random_calls, random_streams


def run(spark, path, parts, build, batch_schema):
    """Write ``parts`` as one file each and stream them one file per trigger, oldest first."""
    import os

    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            full = os.path.join(path, f)
            if f.endswith(".parquet") and os.path.getmtime(full) > 1_000_000:
                os.utime(full, (1000 + i, 1000 + i))
    source = spark.readStream.schema(batch_schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = build(source)
    query = (out.writeStream.format("parquet").option("path", path + "-out").option("checkpointLocation", path + "-state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert len(query.recentProgress) >= len(parts)
    return spark.read.schema(out.schema).parquet(path + "-out")


def test_rate_limit(spark, tmp_path):
    calls, expected = random_calls(spark)
    cuts = [("2024-01-01 00:00:00", "2024-01-01 10:05:00"), ("2024-01-01 10:05:00", "2024-01-01 10:20:30"), ("2024-01-01 10:20:30", "2025-01-01 00:00:00")]
    parts = [calls.where((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in cuts]
    got = run(spark, str(tmp_path / "a"), parts, lambda s: stateful.rate_limit_stream(s, 4, 60), calls.schema)
    assert {r.request_id: r.admitted for r in got.collect()} == expected
    calendar = run(spark, str(tmp_path / "c"), parts, lambda s: stateful.rate_limit_stream(s, 4, 60, anchored=False), calls.schema)
    batch = requests.rate_limit(calls, 4, "1 minute")
    assert {(r.request_id, r.admitted) for r in calendar.collect()} == {(r.request_id, r.admitted) for r in batch.collect()}


def test_rate_limit_of_many_callers_in_few_groups(spark, tmp_path):
    """Numbers as callers and ids, some null and some beyond the exact doubles, which all meet in a bucket or two."""
    n = F.col("id")
    big = F.lit(2**60)
    caller = F.when(n % 10 != 0, n % 10 + big)
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (n * 7_300_000))
    calls = spark.range(600).select(caller.alias("caller"), at.alias("ts"), F.when(n % 50 != 7, n + big).alias("request_id"))
    want, open_until = [], {}
    for r in calls.orderBy("ts").collect():
        end, used = open_until.get(r.caller, (0, 0))
        t = r.ts.timestamp()
        end, used = (t + 100, 0) if t >= end else (end, used)
        open_until[r.caller] = (end, used + 1)
        want.append((r.caller, r.request_id, used < 1))
    parts = [calls.where(n) for n in ("ts < '2024-01-01 00:20:00'", "ts >= '2024-01-01 00:20:00' and ts < '2024-01-01 00:50:00'", "ts >= '2024-01-01 00:50:00'")]
    for buckets in (1, 3):
        got = run(spark, str(tmp_path / f"b{buckets}"), parts, lambda s: stateful.rate_limit_stream(s, 1, 100, buckets=buckets), calls.schema)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert {r.caller for r in got.collect()} == {None, *(2**60 + i for i in range(1, 10))}


def test_first_terminal(spark, tmp_path):
    df = polls(spark, SEQUENCES)
    parts = [df.where("poll_id = 0"), df.where("poll_id between 1 and 2"), df.where("poll_id > 2")]
    got = run(spark, str(tmp_path / "p"), parts, stateful.first_terminal_stream, df.schema)
    batch = jobs.first_terminal(df).where("status <> 'Running'").select(got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_answers(spark, tmp_path):
    rows = [(r, i, c) for r, chunks in random_streams().items() for i, c in enumerate(chunks)]
    chunks = spark.createDataFrame(rows, "request_id string, chunk long, data string")
    parts = [chunks.where("chunk < 2"), chunks.where("chunk between 2 and 5"), chunks.where("chunk > 5")]
    got = run(spark, str(tmp_path / "s"), parts, stateful.answer_tokens_stream, chunks.schema)
    batch = answers.answer_tokens(chunks).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_answers_of_bytes(spark, tmp_path):
    rows = [(r, i, "".join(chunks[i]).encode()) for r, chunks in random_streams().items() for i in range(len(chunks))]
    # Cut again in the middle of every chunk, which falls inside many of the two-byte characters.
    halves = [(r, 2 * i + h, bytearray(data[: len(data) // 2] if h == 0 else data[len(data) // 2 :])) for r, i, data in rows for h in (0, 1)]
    chunks = spark.createDataFrame(halves, "request_id string, chunk long, data binary")
    parts = [chunks.where("chunk < 3"), chunks.where("chunk between 3 and 9"), chunks.where("chunk > 9")]
    got = run(spark, str(tmp_path / "b"), parts, stateful.answer_tokens_stream, chunks.schema)
    batch = answers.answer_tokens(chunks).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_admitting_in_steps_equals_one_walk():
    import random

    import numpy as np

    rng = random.Random(3)
    for anchored in (True, False):
        t = np.cumsum([rng.choice([0, 1, 5, 30, 61, 200]) for _ in range(300)])
        start, used, want = None, 0, []
        for x in t.tolist():
            if start is None or x >= start + 60:
                start, used = (x if anchored else x - x % 60), 0
            used += 1
            want.append(used <= 3)
        for step in (1, 7, 300):
            got, start, used = [], None, 0
            for lo in range(0, 300, step):
                flags, start, used = stateful.admit(t[lo : lo + step], start, used, 3, 60, anchored)
                got += flags.tolist()
            assert got == want


def state_rows(spark, path, parts, build, schema):
    """State rows after each trigger, with one file per trigger, and the rows that came out."""
    import os

    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            full = os.path.join(path, f)
            if f.endswith(".parquet") and os.path.getmtime(full) > 1_000_000:
                os.utime(full, (1000 + i, 1000 + i))
    out = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    query = (out.writeStream.format("parquet").option("path", path + "-out").option("checkpointLocation", path + "-state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress], spark.read.schema(out.schema).parquet(path + "-out")


def test_state_of_idle_callers_jobs_and_answers_goes(spark, tmp_path):
    """Ten triggers, each with new keys only: the state holds the last few of them, not all."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        base = F.lit("2024-01-01 00:00:00").cast("timestamp")
        def part(i):
            at = F.timestamp_micros(F.unix_micros(base) + F.lit(i * 600 * 1_000_000) + F.col("id") * 1_000_000)
            return spark.range(8).select(F.concat(F.lit(f"k{i}-"), F.col("id").cast("string")).alias("caller"), at.alias("ts"), (F.col("id") + 100 * i).alias("request_id"))
        parts = [part(i) for i in range(10)]
        limited, out = state_rows(spark, str(tmp_path / "l"), parts, lambda s: stateful.rate_limit_stream(s, 4, 60, delay="1 second"), parts[0].schema)
        assert out.where("admitted").count() == 80
        seen = [p.select(F.col("caller").alias("job_id"), "ts", F.col("request_id").alias("poll_id"), F.lit("Completed").alias("status"), F.lit(None).cast("string").alias("reason")) for p in parts]
        ended, out = state_rows(spark, str(tmp_path / "j"), seen, lambda s: stateful.first_terminal_stream(s, delay="1 second", idle_seconds=300), seen[0].schema)
        assert out.count() == 80
        pieces = [p.select(F.col("caller").alias("request_id"), F.lit(0).cast("long").alias("chunk"), F.lit('data: {"token": "a"}\nrest').alias("data")) for p in parts]
        told, out = state_rows(spark, str(tmp_path / "a"), pieces, lambda s: stateful.answer_tokens_stream(s, idle_seconds=1), pieces[0].schema)
        assert out.count() == 80
        # Per key there is a row of state, and while a timer is set, a few rows for it.
        for counts in (limited, ended, told):
            assert len(counts) >= 10 and max(counts) <= 4 * counts[0], counts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
