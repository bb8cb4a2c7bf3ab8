"""Run a stream over what is available now into a Parquet table, by appending or by upserts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.session import work_path
from tabulary.sources.request_log import FILES_PER_BATCH


def stream_table(
    spark: SparkSession, folder: str, name: str, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """A stream over Parquet files ``name`` (a glob) in ``folder``, schema as stored."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, as timers and maps need.

    A query takes over the session's settings when it starts; one that goes on from earlier runs
    keeps the store it began with.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_available(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Process all input there is, append to a table, and return the table.

    Progress and state belong to the table at ``path`` and lie beside it, so a later run, or
    one after a failure, goes on where the last one stopped: each row of the input is
    appended once over all runs. Without ``path`` the table is a new one in the shared folder.
    """
    spark = stream.sparkSession
    out = (path or work_path(spark, f"{label}-out")).rstrip("/")
    with _state_on_disk(spark):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{out}-progress")
            .trigger(availableNow=True)
            .start(out)
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: Batches after which the whole table is written once more, so that reading stays cheap.
SNAPSHOT = 50


def run_upserts(
    stream: DataFrame, label: str, keys: Sequence[str], path: str | None = None, snapshot: int = SNAPSHOT
) -> DataFrame:
    """Process all input there is, keep the last state of each row by ``keys``, and return the table.

    The stream runs in update mode, so a window that is still open counts with what it has so far.
    Each batch's changed rows are written under the batch's number, and a batch that is tried again
    after a failure replaces what it wrote: every row's last state is there once. Every ``snapshot``
    batches the whole table is written, and only what came since is read with it. Progress and state
    are kept as in :func:`run_available`.
    """
    spark = stream.sparkSession
    out = (path or work_path(spark, f"{label}-out")).rstrip("/")
    schema = stream.schema
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def upsert(changed: DataFrame, number: int) -> None:
        whole = number % snapshot == snapshot - 1
        if whole:
            before = _batches(changed.sparkSession, out, schema).filter(F.col("_batch") < number)
            changed = _last(before.unionByName(changed.withColumns({"_batch": F.lit(number), "_whole": F.lit(1)})), keys)
        place = f"{out}/_whole={int(whole)}/_batch={number}"
        changed.select(*schema.names).write.mode("overwrite").parquet(place)

    with _state_on_disk(spark):
        query = (
            stream.writeStream.outputMode("update")
            .foreachBatch(upsert)
            .option("checkpointLocation", f"{out}-progress")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return _last(_batches(spark, out, schema), keys).select(*schema.names)


def _batches(spark: SparkSession, out: str, schema) -> DataFrame:
    """The rows of the last whole table and of the batches after it."""
    numbered = T.StructType([*schema.fields, T.StructField("_whole", T.IntegerType()), T.StructField("_batch", T.LongType())])
    rows = spark.read.schema(numbered).option("basePath", out).parquet(out)
    newest = rows.filter("_whole = 1").agg(F.max("_batch")).first()[0]
    return rows if newest is None else rows.filter(F.col("_batch") >= newest)


def _last(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "_batch", "_whole")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return newest.select(*keys, "_row.*")
