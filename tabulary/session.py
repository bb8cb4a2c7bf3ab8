"""Session settings and the shared folder used to cut lineage and to hold stream state."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Settings that hold from a laptop to a large cluster. Parallelism is left to the cluster:
#: AQE coalesces small shuffles and splits skewed join partitions at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: AQE merges shuffle partitions but never adds any, so a cluster starts from many small ones.
CLUSTER = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000"}


def build_session(app: str = "tabulary", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # Where it runs is known by the context: under spark-submit no master is passed here.
    if not spark.sparkContext.master.startswith("local"):
        for key, value in CLUSTER.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder is lost with
    its machine.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known:
        # SparkContext appends one unique folder to the directory it was given.
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(own)
    return own


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared folder (not created here)."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that :func:`work_path` named, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores before heavy per-row work, if the scan has fewer parts.

    A large table already has more parts than the cluster has cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A few driver-side rows as a relation of known size, which the planner can broadcast."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    pdf = pd.DataFrame(list(rows), columns=fields.names, dtype=object)
    return spark.createDataFrame(pdf, fields)
