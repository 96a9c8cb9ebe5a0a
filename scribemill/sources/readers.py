"""Scans: JSON Lines files and folders, captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from scribemill.functions.text import py_strip
from scribemill.operators.corpus import exact_sample
from scribemill.session import stage

SPEECH_SCHEMA = "title string, date string, source string, url string, text string"
PAIR_SCHEMA = "instruction string, input string, output string"
PAGE_SCHEMA = "page_id long, url string, html string"
# Files by hand end in .jsonl, files that Spark writes in .json.
JSONL_GLOB = "*.{json,jsonl}"
LINE_ORDER = ("file", "block", "line")
# Up to this many sampled files their paths also stand in a filter, so that Spark lists only these for reading.
MAX_PATH_LIST = 10_000


def _strict_records(lines: DataFrame, schema: str | StructType, *extra: str) -> DataFrame:
    """Parse each non-blank line as exactly one JSON object.

    A JSON reader stops after the first value, so glued or trailing text on a
    line would be lost. The line is therefore also read as the only member of
    an object, with its content skipped: no trailing text fits both readings.
    """
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    options = {"mode": "FAILFAST", "allowSingleQuotes": "false"}
    line = F.col("__line")
    element = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<struct<{ddl}>>", options)
    member = F.from_json(F.concat(F.lit('{"v":'), line, F.lit("}")), "struct<other:boolean>", options)
    one = line.startswith("{") & (F.size(element) == 1) & member.isNotNull()
    record = F.when(one, F.get(element, F.lit(0))).otherwise(
        F.raise_error(F.concat(F.lit("malformed line: "), F.substring(line, 1, 200))).cast(f"struct<{ddl}>")
    )
    return _stripped(lines).select(record.alias("__r"), *extra).select("__r.*", *extra)


def _stripped(lines: DataFrame) -> DataFrame:
    """The lines that are not blank, without the white space around them, as ``__line``."""
    if "__line" in lines.columns:
        return lines
    return lines.withColumn("__line", py_strip(F.col("value"))).where(F.col("__line") != "").drop("value")


def _lines(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path)


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: str | StructType, glob: str | None = None, strict: bool = True
) -> DataFrame:
    """Records of a JSON Lines file or folder. Blank lines are skipped, a malformed line fails the job.

    ``glob`` picks files of a folder by name, for example ``*.jsonl``. With
    ``strict`` off, text after the first object of a line is ignored, which
    is faster and safe for files that Spark wrote.
    """
    if strict:
        return _strict_records(_lines(spark, path, glob), schema)
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path)


def read_jsonl_ordered(spark: SparkSession, path: str, schema: str | StructType, glob: str | None = JSONL_GLOB) -> DataFrame:
    """The same with ``file``, ``block`` and ``line``, which sort like files by name, then lines in order.

    Files stay splittable: ``block`` is the start of the split, and ``line`` grows within a split.
    """
    lines = _lines(spark, path, glob).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return _strict_records(lines, schema, *LINE_ORDER)


def read_jsonl_numbered(
    spark: SparkSession, path: str, schema: str | StructType, glob: str | None = JSONL_GLOB, name: str = "position"
) -> DataFrame:
    """The same with the 0-based ``name`` of each record, files by name, then lines in order.

    A first pass counts the records of each split; the counts are added up, and a
    record's position is that of its split plus its place in it. So lines stay
    where they are read. What is broadcast is a row per file split, as many
    as the scan itself lists on the driver.
    """
    lines = _lines(spark, path, glob).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")
    )
    placed = _stripped(lines).withColumn("__row", F.monotonically_increasing_id())
    splits = placed.groupBy("__file", "__block").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("__file", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start"))
    numbered = placed.join(F.broadcast(starts), ["__file", "__block"]).withColumn(name, F.col("__row") + F.col("__start"))
    return _strict_records(numbered, schema, name)


def list_files(spark: SparkSession, path: str, glob: str = JSONL_GLOB) -> DataFrame:
    """Column ``file`` of the files under ``path`` whose name fits ``glob``; contents are not read. A folder without one fails."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    listed = files.select(F.col("_metadata.file_path").alias("file"))
    if not listed.take(1):  # isEmpty would run over all of them
        raise FileNotFoundError(f"no file {glob} under {path}")
    return listed


def read_sampled_files(
    spark: SparkSession, path: str, schema: str | StructType, n: int = 0, seed: int = 42, glob: str = JSONL_GLOB
) -> DataFrame:
    """All records of ``n`` sampled files; of every file when ``n <= 0`` or there are no more than ``n``.

    The sample is drawn from the listing by the names below ``path``, so it is
    the same wherever the folder stands. Listing and scan name a file the same
    way, and the join picks the rows at any ``n``; for small samples a filter on
    the names lets Spark leave the other files unread.
    """
    if n <= 0:
        return read_jsonl(spark, path, schema, glob)
    below = F.split_part("file", F.lit("/" + path.rstrip("/").rsplit("/", 1)[-1] + "/"), F.lit(-1))
    # The sample takes several passes, which over the folder would be a task for every few files each.
    listed = stage(list_files(spark, path, glob).withColumn("name", below).repartition("file"), "listed")
    chosen = exact_sample(listed, n, seed, "name").select("file")
    scan = _lines(spark, path, glob)
    if n <= MAX_PATH_LIST:
        scan = scan.where(F.col("_metadata.file_path").isin([row.file for row in chosen.collect()]))  # at most n names
    lines = scan.select("value", F.col("_metadata.file_path").alias("file"))
    return _strict_records(lines.join(chosen, "file", "left_semi"), schema)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages; a failed capture has null ``html``."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)
