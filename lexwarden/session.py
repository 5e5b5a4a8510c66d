"""Session helpers: table access, lineage cutting and the settings a local run needs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int | str = "*", app: str = "lexwarden", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEXWARDEN_DRIVER_MEMORY", "6g"))
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """A table scan over at least as many partitions as there are cores, for heavy narrow work.

    A scan of many files stays as it is, without a shuffle; only a table of a few small files is dealt out.  For plain
    scans and projections of them, as the plan is made to count the partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster without one raises, as a folder of one
    machine would be lost with it.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lexwarden-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    if "://" not in shared:  # the folder's full name, as workers may open it by themselves
        path = context._jvm.org.apache.hadoop.fs.Path(shared)
        shared = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
        shared = shared.replace("file:/", "file:///", 1) if shared.startswith("file:/") and not shared.startswith("file://") else shared
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.  The files survive the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, by: str | None = None) -> tuple[DataFrame, str]:
    """Writes ``df`` as a Parquet table into the shared folder; returns the table read back, and its place.

    Unlike a checkpoint, it is compressed and later reads take only the columns they need.
    """
    place = f"{shared_folder(df.sparkSession).rstrip('/')}/lexwarden-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place), place
