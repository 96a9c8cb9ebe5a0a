"""Session settings and the shared folder used for staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
STATE_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Paths given out by this process and not yet removed.
_given: list[str] = []


def build_session(app_name: str = "scribemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were measured with."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Documents can be long, so Python workers get small batches.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        # A list of keys larger than what is broadcast still goes ahead of a large scan as a Bloom filter.
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
        # Timers and times to live of stream state need this store.
        STATE_STORE_KEY: STATE_STORE,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables and checkpoints that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session,
    where driver and executors are one machine, may fall back to a folder made here.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scribemill-"))
        folder = context.getCheckpointDir()
    elif not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _local_path(uri: str) -> str:
    path = uri.removeprefix("file:")
    return os.path.normpath("/" + path.lstrip("/"))


def is_shared(spark: SparkSession, uri: str) -> bool:
    """Whether driver and executors see the same files at ``uri``.

    On a cluster a POSIX path is shared below the folder of ``shared_dir`` and in the warehouse.
    Stores of other schemes are taken to be shared, and one machine shares all.
    """
    master = spark.sparkContext.master
    if not uri.startswith(("/", "file:")) or master == "local" or master.startswith("local["):
        return True
    roots = [shared_dir(spark), spark.conf.get("spark.sql.warehouse.dir")]
    return any(_local_path(uri).startswith(f"{_local_path(r)}/") for r in roots if r.startswith(("/", "file:")))


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path in the shared folder."""
    _given.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _given[-1]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that path, in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [status.getPath().getName() for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def cleanup(spark: SparkSession) -> None:
    """Remove every staged table of this process. Results that still read one must have been written or collected."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in map(hadoop, _given):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _given.clear()


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a costly or non-repeatable column feeds more than one branch.
    Unlike a cached block the table outlives a lost executor, and as Parquet
    later branches read only the columns they need.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
