from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from scribemill.operators.prefix import dense_index_by
from scribemill.session import new_path, shared_dir
from scribemill.sources import readers, writers


@pytest.fixture
def folder(tmp_path):
    for i in range(10):
        (tmp_path / f"{i:05d}.jsonl").write_text(json.dumps({"title": f"t{i}", "text": f"x{i}"}) + "\n\n  \n")
    (tmp_path / "readme.txt").write_text("skip me")
    return str(tmp_path)


def test_folder_scan_picks_jsonl_and_skips_blank_lines(spark, folder):
    df = readers.read_jsonl(spark, folder, readers.SPEECH_SCHEMA, readers.JSONL_GLOB)
    assert df.columns == ["title", "date", "source", "url", "text"]
    assert sorted(r.title for r in df.collect()) == [f"t{i}" for i in range(10)]


@pytest.mark.parametrize("strict", [True, False])
def test_malformed_line_fails(spark, tmp_path, strict):
    (tmp_path / "a.jsonl").write_text('{"title": "t"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path), readers.SPEECH_SCHEMA, strict=strict).collect()


@pytest.mark.parametrize("line", ['{"title": "a"} tail', '{"title": "a"}{"title": "b"}', '{"title": "a"},{"title": "b"}',
                                  '{"title": "a"}] x', '{"title": "a"}} x', "{'title': 'a'}", "5", '["a"]', "null"])
def test_a_line_is_exactly_one_object(spark, tmp_path, line):
    (tmp_path / "a.jsonl").write_text(line)
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path), readers.SPEECH_SCHEMA).collect()


def test_lines_end_like_text_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes('{"title": "a"}\r\n\u00a0{"title": "b\u2028"} \n{"title": "c", "n": NaN}'.encode())
    assert sorted(r.title for r in readers.read_jsonl(spark, str(tmp_path), "title string").collect()) == ["a", "b\u2028", "c"]


@pytest.mark.parametrize("n, rows", [(3, 3), (0, 10), (10, 10), (50, 10), (-1, 10)])
def test_sampling_reads_only_chosen_files(spark, folder, n, rows):
    df = readers.read_sampled_files(spark, folder, readers.SPEECH_SCHEMA, n)
    assert df.count() == rows
    if n == 3:
        df.collect()
        scan = df._jdf.queryExecution().executedPlan().toString()
        assert "_metadata.file_path" in scan or "file_path" in scan


def test_samples_of_files_with_odd_names(spark, tmp_path, monkeypatch):
    names = ["a 0", "b[1]", "c%20", "dé", "e+f", "g#h", "i{j}"]
    for name in names:
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"title": name}) + "\n")
    for n in (3, 6, 7):
        found = {r.title for r in readers.read_sampled_files(spark, str(tmp_path), readers.SPEECH_SCHEMA, n).collect()}
        assert len(found) == n and found <= set(names)
        with monkeypatch.context() as patched:
            patched.setattr(readers, "MAX_PATH_LIST", 1)
            joined = readers.read_sampled_files(spark, str(tmp_path), readers.SPEECH_SCHEMA, n)
            assert {r.title for r in joined.collect()} == found


def test_an_empty_match_fails(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("nothing to read")
    with pytest.raises(FileNotFoundError):
        readers.list_files(spark, str(tmp_path))


def test_large_samples_join_by_path(spark, folder, monkeypatch):
    small = {r.title for r in readers.read_sampled_files(spark, folder, readers.SPEECH_SCHEMA, 4).collect()}
    monkeypatch.setattr(readers, "MAX_PATH_LIST", 2)
    large = readers.read_sampled_files(spark, folder, readers.SPEECH_SCHEMA, 4)
    assert large.columns == ["title", "date", "source", "url", "text"]
    assert {r.title for r in large.collect()} == small


def test_lines_are_ordered_across_files_and_splits(spark, tmp_path):
    n = 0
    for name in ("b.jsonl", "a.jsonl", "c.jsonl"):
        (tmp_path / name).write_text("".join(json.dumps({"title": f"{name}{i:04d}"}) + "\n" for i in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = readers.read_jsonl_ordered(spark, str(tmp_path), "title string")
        assert df.select("file", "block").distinct().count() > 6
        placed = dense_index_by(df, readers.LINE_ORDER).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.title for r in placed] == [f"{name}{i:04d}" for name in ("a.jsonl", "b.jsonl", "c.jsonl") for i in range(400)]


def test_file_ids_never_lose_digits(spark):
    df = spark.createDataFrame([(0,), (99_999,), (100_000,), (1_234_567,)], "p long").orderBy("p")
    assert [r[0] for r in df.select(writers.file_id(F.col("p"))).collect()] == ["00000", "99999", "100000", "1234567"]


def test_corpus_round_trip_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("t", None, 'é "q"\n')], "title string, date string, text string")
    writers.write_jsonl(df, str(tmp_path / "out"))
    (line,) = [x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert json.loads(line) == {"title": "t", "date": None, "text": 'é "q"\n'}


def test_numbered_folders(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("position"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"))
    writers.write_numbered(df.repartition(4), str(tmp_path / "n"), per_bucket=10)
    files = {p.parent.name: p.read_text().splitlines() for p in (tmp_path / "n").glob("bucket=*/*.json")}
    assert {k: len(v) for k, v in files.items()} == {"bucket=000000000000": 10, "bucket=000000000001": 10, "bucket=000000000002": 5}
    assert [json.loads(x)["file_id"] for x in files["bucket=000000000001"]] == [f"{i:05d}" for i in range(10, 20)]


def test_one_file_per_record_and_gaps_for_documents_without_pairs(spark, tmp_path):
    pair = "array<struct<instruction:string,input:string,output:string>>"
    df = spark.createDataFrame([(0, [("q", "", "a"), ("é", "", None)]), (1, []), (2, [("x", "", "y")])], f"position long, pairs {pair}")
    with_pairs = df.where(F.size("pairs") > 0).withColumn("content", writers.pair_lines(F.col("pairs")))
    uri = f"file://{tmp_path}/qa"
    writers.put_files(with_pairs, uri)
    writers.put_files(with_pairs, uri)
    files = {p.name: [json.loads(x) for x in p.read_text().splitlines()] for p in (tmp_path / "qa").iterdir()}
    assert set(files) == {"00000.jsonl", "00002.jsonl"}
    assert files["00000.jsonl"] == [{"instruction": "q", "input": "", "output": "a"}, {"instruction": "é", "input": "", "output": None}]
    back = readers.read_jsonl(spark, f"{tmp_path}/qa", readers.PAIR_SCHEMA, readers.JSONL_GLOB)
    assert back.count() == 3
    assert {(r.position, r.pair_no) for r in writers.numbered_pairs(df).collect()} == {(0, 0), (0, 1), (2, 0)}
    record = spark.createDataFrame([(7, "t", None)], "position long, title string, date string")
    writers.put_files(record.withColumn("content", writers.record_lines(["title", "date"])), f"file://{tmp_path}/one")
    assert (tmp_path / "one" / "00007.jsonl").read_text() == '{"title":"t","date":null}\n'


def test_files_of_a_cluster_go_to_the_shared_folder_only(spark, tmp_path, monkeypatch):
    folder = new_path(spark, "files")
    df = spark.range(3).select(F.col("id").alias("position"), F.lit("x\n").alias("content"))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    for uri in (folder, f"file://{folder}"):
        writers.put_files(df, uri)
    assert sorted(os.listdir(folder)) == ["00000.jsonl", "00001.jsonl", "00002.jsonl"]
    for uri in (str(tmp_path / "own"), f"file://{tmp_path}/own", f"{shared_dir(spark)}-not", f"{shared_dir(spark)}/../own"):
        with pytest.raises(ValueError, match="shared"):
            writers.put_files(df, uri)


def test_keyed_puts_replace_rows_and_version_the_table(spark, tmp_path):
    base = str(tmp_path / "records")
    assert readers.read_pages is not None and writers.read_records(spark, base) is None
    puts = spark.createDataFrame([("j", "t1", "Completed", "0.1", 0), ("j", "t2", "Failed", None, 1)], "job_id string, timestamp string, status string, loss string, put_no long")
    writers.put_records(puts, base)
    more = spark.createDataFrame([("j", "t1", "Stopped", 0, "m"), ("j", "t1", "Completed", 1, "n")], "job_id string, timestamp string, status string, put_no long, model_name string")
    writers.put_records(more, base)
    rows = {(r.timestamp, r.status, r.loss, r.model_name) for r in writers.read_records(spark, base).collect()}
    assert rows == {("t1", "Completed", None, "n"), ("t2", "Failed", None, None)}
    assert (tmp_path / "records" / "version=1").exists() and (tmp_path / "records" / "version=2").exists()
    (tmp_path / "records" / "version=3").mkdir()  # a put that never finished
    assert writers.read_records(spark, base).count() == 2


def test_a_put_of_ten_keys_rewrites_their_buckets_only(spark, tmp_path):
    base = str(tmp_path / "records")
    rows = spark.range(200_000).select(F.concat(F.lit("job-"), F.col("id").cast("string")).alias("job_id"), F.lit("t").alias("timestamp"),
                                       F.col("id").alias("loss"), F.col("id").alias("put_no"))
    writers.put_records(rows, base, buckets=1024)
    files = lambda: {p.relative_to(tmp_path): p.stat().st_size for p in (tmp_path / "records" / "data").rglob("*.parquet")}
    first = files()
    ten = spark.range(10).select(F.concat(F.lit("job-"), (F.col("id") * 19_997).cast("string")).alias("job_id"), F.lit("t").alias("timestamp"),
                                 F.lit("new").alias("model_name"), F.lit(1).cast("long").alias("put_no"))
    table = writers.put_records(ten, base)
    new = files().keys() - first.keys()
    assert len(new) <= 10 and sum(files()[f] for f in new) < 0.01 * sum(first.values()) + 10 * 2000
    assert table.count() == 200_000 and table.where("model_name = 'new' and loss is null").count() == 10
    found = writers.lookup_records(spark, base, ten.select("job_id", "timestamp"))
    assert found.count() == 10 and len(found.inputFiles()) <= 10
    # The version before is untouched until it is removed.
    writers.remove_old_versions(spark, base, keep=1)
    assert writers.read_records(spark, base).count() == 200_000 and not (tmp_path / "records" / "version=1").exists()


def test_puts_of_nothing_null_keys_and_other_key_types(spark, tmp_path):
    base = str(tmp_path / "records")
    schema = "job_id string, timestamp long, status string, put_no long"
    assert writers.put_records(spark.createDataFrame([], schema), base, buckets=4).count() == 0
    writers.put_records(spark.createDataFrame([(None, 1, "a", 0), (None, 1, "b", 1), ("j", None, "c", 2)], schema), base)
    other = spark.createDataFrame([("j", "7", "d", 0), (None, "1", "e", 1)], "job_id string, timestamp string, status string, put_no long")
    table = writers.put_records(other, base)
    assert {tuple(r) for r in table.collect()} == {(None, 1, "e"), ("j", None, "c"), ("j", 7, "d")}
    assert writers.put_records(spark.createDataFrame([], schema), base).count() == 3


def test_a_put_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    base = str(tmp_path / "records")
    puts = spark.createDataFrame([("j", "t", "a", 0)], "job_id string, timestamp string, status string, put_no long")
    writers.put_records(puts, base)
    broken = puts.withColumn("status", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        writers.put_records(broken, base)
    (tmp_path / "records" / "data" / "half").mkdir()
    assert [tuple(r) for r in writers.read_records(spark, base).collect()] == [("j", "t", "a")]


def test_line_numbers_move_no_text(spark, tmp_path):
    for name, lines in (("b.jsonl", 300), ("a.jsonl", 200), ("empty.jsonl", 0), ("c.jsonl", 100)):
        (tmp_path / name).write_text("".join(("\n  \n" if i % 7 == 0 else "") + json.dumps({"title": f"{name}{i:04d}"}) + "\n" for i in range(lines)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = readers.read_jsonl_numbered(spark, str(tmp_path), "title string")
        rows = df.orderBy("position").collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.position, r.title) for r in rows] == list(enumerate(f"{n}.jsonl{i:04d}" for n, k in (("a", 200), ("b", 300), ("c", 100)) for i in range(k)))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("__line" in line or "title" in line for line in moved)


def test_pages_keep_failed_captures(spark, tmp_path):
    spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    assert readers.read_pages(spark, str(tmp_path / "p")).first().html is None


def test_staging_uses_the_folder_the_session_names(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == named and new_path(spark, "x").startswith(named)


def test_worker_functions_travel_with_the_job():
    import scribemill  # noqa: F401
    from pyspark import cloudpickle

    from scribemill.operators.markup import parse

    assert b"_Builder" in cloudpickle.dumps(parse)  # by value, not as a module path
