"""Sinks: corpus files, numbered files, keyed record table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from scribemill.operators.jobs import upsert
from scribemill.session import is_shared, stage

FILES_PER_BUCKET = 8192
_KEEP_NULLS = {"ignoreNullFields": "false"}


def file_id(position: Column) -> Column:
    """Position with at least five digits; longer numbers keep all their digits."""
    digits = position.cast("string")
    return F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Write the records as JSON Lines into a new folder. ``path`` must not be one that ``df`` reads."""
    df.write.mode("overwrite").options(**_KEEP_NULLS).json(path)


def write_numbered(df: DataFrame, path: str, position: str = "position", per_bucket: int = FILES_PER_BUCKET) -> None:
    """Write the records with their ``file_id``, one folder per ``per_bucket`` positions, in order within it."""
    # Folder names have equal lengths, so that they sort like the positions.
    number = F.call_function("div", F.col(position), F.lit(per_bucket)).cast("string")
    bucket = F.when(F.length(number) < 12, F.lpad(number, 12, "0")).otherwise(number)
    bucketed = df.withColumns({"file_id": file_id(F.col(position)), "bucket": bucket})
    (
        bucketed.repartition("bucket")
        .sortWithinPartitions("bucket", position)
        .drop(position)
        .write.mode("overwrite").options(**_KEEP_NULLS).partitionBy("bucket").json(path)
    )


def numbered_pairs(parsed: DataFrame, position: str = "position") -> DataFrame:
    """Pairs with the position of their document. Documents without pairs leave a gap in the positions."""
    return parsed.select(position, F.posexplode("pairs").alias("pair_no", "pair")).select(position, "pair_no", "pair.*")


def record_lines(columns: Sequence[str]) -> Column:
    """File content of one record: a JSON object and a newline."""
    return F.concat(F.to_json(F.struct(*columns), _KEEP_NULLS), F.lit("\n"))


def pair_lines(pairs: Column) -> Column:
    """File content of one document's pairs: one JSON object per line."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.to_json(p, _KEEP_NULLS), F.lit("\n"))), "")


def put_files(df: DataFrame, uri: str, position: str = "position", content: str = "content") -> None:
    """Small-output mode: one file ``{position:05d}.jsonl`` per row under ``uri``.

    Tasks write to any file system Arrow knows (S3, HDFS, GCS, and POSIX folders
    that are shared: below ``spark.checkpoint.dir`` or in the warehouse). Name
    and content depend on the row alone, so a repeated task rewrites the same
    bytes. For large corpora use ``write_numbered``.
    """
    if not is_shared(df.sparkSession, uri):
        raise ValueError("executors would write to their own disks; name a shared file system")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(uri)
        target.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(batch["file_id"], batch[content]):
                with target.open_output_stream(f"{root}/{name}.jsonl") as out:
                    out.write(text.encode())
            yield batch[["file_id"]]

    named = df.select(file_id(F.col(position)).alias("file_id"), content)
    named.mapInPandas(run, "file_id string").write.format("noop").mode("overwrite").save()


def _versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the complete versions under ``base`` (a listing, no data)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in files.listStatus(path)]
    return sorted(
        int(name.removeprefix("version="))
        for child, name in names
        if name.startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(child, "_SUCCESS"))
    )


# Buckets of a record table by default, fixed by its first put; a large table wants more. Each holds the keys of one hash remainder.
BUCKETS = 16
_BUCKET = "bucket__"


@dataclass(frozen=True)
class Manifest:
    """One version of a record table: the folder of each bucket that has rows, below the table's own."""

    version: int
    buckets: int
    schema: StructType
    folders: dict[int, str]


def read_manifest(spark: SparkSession, base: str) -> Manifest | None:
    """The manifest of the newest complete version, None before the first put."""
    versions = _versions(spark, base)
    if not versions:
        return None
    # One row per bucket, and one without a bucket that tells of the table itself.
    rows = spark.read.parquet(f"{base}/version={versions[-1]}").collect()
    table = next(row for row in rows if row["bucket"] < 0)
    schema = StructType.fromJson(json.loads(table["folder"]))
    return Manifest(versions[-1], -table["bucket"], schema, {row["bucket"]: row["folder"] for row in rows if row["bucket"] >= 0})


def _read_buckets(spark: SparkSession, base: str, manifest: Manifest, buckets: Iterable[int]) -> DataFrame:
    paths = [f"{base}/{manifest.folders[b]}/{_BUCKET}={b}" for b in sorted(buckets) if b in manifest.folders]
    # Columns that came with later puts are null in older files.
    return spark.read.schema(manifest.schema).parquet(*paths) if paths else spark.createDataFrame([], manifest.schema)


def read_records(spark: SparkSession, base: str) -> DataFrame | None:
    """The newest complete version of the record table, None before the first put."""
    manifest = read_manifest(spark, base)
    return manifest and _read_buckets(spark, base, manifest, manifest.folders)


def lookup_records(spark: SparkSession, base: str, wanted: DataFrame, keys: Sequence[str] = ("job_id", "timestamp")) -> DataFrame | None:
    """The rows of the keys in ``wanted``; only the buckets of these keys are read."""
    manifest = read_manifest(spark, base)
    if manifest is None:
        return None
    cast = wanted.select(*[F.col(k).cast(manifest.schema[k].dataType).alias(k) for k in keys]).distinct()
    touched = [row[0] for row in cast.select(_bucket_of(keys, manifest.buckets)).distinct().collect()]
    rows = _read_buckets(spark, base, manifest, touched)
    return rows.join(cast, [rows[k].eqNullSafe(cast[k]) for k in keys], "left_semi")


def _bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def put_records(puts: DataFrame, base: str, keys: Sequence[str] = ("job_id", "timestamp"), order: str = "put_no", buckets: int = BUCKETS) -> DataFrame:
    """Keyed put: write the next version of the record table and return it. One writer at a time.

    A put replaces the whole row of its key, the last one by ``order`` stays. Only
    the buckets of the keys that are put are read and written, into a new folder.
    The manifest of the new version is written last, so readers see the table
    before the put or after it; what a failed put left is in no manifest. The
    number of buckets, an argument of the first put, bounds what goes through the driver.
    """
    spark = puts.sparkSession
    known = read_manifest(spark, base)
    n = known.buckets if known else buckets
    last = upsert(None, puts, keys, order)
    if known:  # a key of another type would hash to another bucket
        last = last.withColumns({k: F.col(k).cast(known.schema[k].dataType) for k in keys})
    new = stage(last.withColumn(_BUCKET, _bucket_of(keys, n)), "puts")
    touched = {row[0] for row in new.select(_BUCKET).distinct().collect()}
    rows = new.withColumn("__new", F.lit(True))
    if known:
        old = _read_buckets(spark, base, known, touched)
        rows = old.withColumns({_BUCKET: _bucket_of(keys, n), "__new": F.lit(False)}).unionByName(rows, allowMissingColumns=True)
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema if f.name not in (_BUCKET, "__new")])
    folder = f"data/{uuid.uuid4().hex}"
    if touched:
        # Rows meet by bucket; the keys of a bucket are in the same task, so the window needs no further shuffle.
        newest = Window.partitionBy(_BUCKET, *keys).orderBy(F.col("__new").desc())
        merged = rows.repartition(_BUCKET).withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r", "__new")
        merged.write.partitionBy(_BUCKET).parquet(f"{base}/{folder}")
    folders = (known.folders if known else {}) | {b: folder for b in touched}
    version = known.version + 1 if known else 1
    manifest = [(-n, schema.json()), *sorted(folders.items())]
    spark.createDataFrame(manifest, "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{base}/version={version}")
    return _read_buckets(spark, base, Manifest(version, n, schema, folders), folders)


def remove_old_versions(spark: SparkSession, base: str, keep: int = 2) -> None:
    """Remove all but the newest ``keep`` versions and the bucket folders that only the others named. Not while a put is under way."""
    versions = _versions(spark, base)
    kept = {row["folder"] for v in versions[-keep:] for row in spark.read.parquet(f"{base}/version={v}").where("bucket >= 0").collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for version in versions[:-keep]:
        files.delete(path(f"{base}/version={version}"), True)
    if files.exists(path(f"{base}/data")):
        for status in files.listStatus(path(f"{base}/data")):
            if f"data/{status.getPath().getName()}" not in kept:
                files.delete(status.getPath(), True)
