"""Row numbers over data too large for one window: range-sorted parts plus offsets."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulary.session import work_path

# The functions here travel to the Python workers whole, so executors need no copy of the
# package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PART_BITS = 33  # monotonically_increasing_id keeps the row's index in its low 33 bits


def number_rows(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row in ``order``, within ``keys`` if given.

    ``order`` must be total. Rows are range-partitioned by (keys, order), so one key that
    holds a large share of all rows is spread over many parts like any other range; this is the
    one exchange of the rows. Within a sorted part the rows of a key are next to each other, so
    their places are counted as they pass. The parts are written to the shared folder once;
    their identity is then a stored column and a lost executor cannot move a row to another part.
    """
    spark = df.sparkSession
    columns, keys = df.columns, list(keys)
    sort = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    path = work_path(spark, "numbered")
    placed = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    if keys:
        placed = _counted_in_runs(placed, keys)
    placed.write.parquet(path)
    stored = spark.read.parquet(path)
    index = F.col("_id").bitwiseAND((1 << _PART_BITS) - 1)
    parts = stored.withColumns(
        {
            "_part": F.shiftright("_id", _PART_BITS),
            "_index": index,
            "_local": F.col("_local") if keys else index + 1,
        }
    )
    # Of each part the first and the last key count: only its first one can have begun earlier,
    # and in earlier parts that key came last.
    ends = parts.groupBy("_part").agg(
        F.min_by(F.struct(F.lit(0), *keys), "_index").alias("_first"),
        F.max_by(F.struct(F.lit(0), *keys), "_index").alias("_last"),
        F.max_by("_local", "_index").alias("_size"),
    )
    # one row per part
    so_far = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    by_part = Window.orderBy("_part")
    offsets = ends.withColumn("_upto", F.sum("_size").over(so_far)).select(
        F.col("_part").alias("_o_part"),
        F.col("_first").alias("_o_key"),
        F.lag("_last").over(by_part).alias("_key_before"),
        F.lag("_upto").over(by_part).alias("_before"),
    ).filter(F.col("_key_before").eqNullSafe(F.col("_o_key")))
    match = F.col("_part") == F.col("_o_part")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_key.{k}"))
    return parts.join(F.broadcast(offsets), match, "left").select(
        *columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(name)
    )


def _counted_in_runs(sorted_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_local``: the 1-based place of a row among the rows of its key within its part."""
    at = [sorted_rows.columns.index(k) for k in keys]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(i) for i in at]
            new = np.zeros(batch.num_rows, bool)
            for column in own:
                new[1:] |= _differs(column.slice(1), column.slice(0, len(column) - 1))
            head = [column.slice(0, 1) for column in own]
            new[0] = key is None or any(_differs(a, b)[0] for a, b in zip(head, key, strict=True))
            place = np.arange(batch.num_rows)
            start = np.where(new, place, -1)
            start = np.maximum.accumulate(start)
            local = np.where(start < 0, place + count, place - start) + 1
            key, count = [column.slice(len(column) - 1) for column in own], int(local[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(local, pa.int64())], names=[*batch.schema.names, "_local"]
            )

    schema = sorted_rows.withColumn("_local", F.lit(0).cast("long")).schema
    return sorted_rows.mapInArrow(run, schema)


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where values differ; nulls are equal to each other, and so are NaNs."""
    if pa.types.is_nested(a.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], bool)
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(a.type):
        unequal = pc.and_not(unequal, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
