"""Connected components of a graph held as a DataFrame of links.

Links are first contracted within each partition. Then, if there are several partitions,
large-star and small-star steps alternate until nothing changes; every step is a grouped minimum
and a join, stored by ``checkpoint()``, so a lost executor costs one step. Nothing but two
numbers per round comes to the driver. A minimum is stored before it is joined, so that the join
has a plain shuffle on either side and a node with very many links can be split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.session import ensure_checkpoint_dir


#: Links of one partition, or so: a small graph is not worth many tasks and files.
LINKS_PER_PART = 250_000


def _star(links: DataFrame, large: bool, parts: int) -> DataFrame:
    """One step over links (u, v) with u > v; the result has the same form."""
    if large:
        near = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least.coalesce(parts).checkpoint()
    moved = near.join(least, "u").select("u", "v", "m")
    if large:
        moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter("u <> v").distinct().coalesce(parts).checkpoint()


def _contracted(links: DataFrame) -> DataFrame:
    """The links of each partition as links of its nodes with the smallest one they reach there.

    This leaves what the partitions connect as it is and shortens all paths within them; a graph
    of one partition is solved by it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (above := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(above, above)
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
        nodes = [x for x in root if find(x) != x]
        yield pa.RecordBatch.from_pydict(
            {"u": pa.array(nodes, pa.int64()), "v": pa.array([find(x) for x in nodes], pa.int64())}
        )

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): every node that has a link, with the smallest node it can reach.

    ``links`` has two integer columns ``u`` and ``v`` in any order. Repeated links, both
    directions and links of a node with itself are allowed; null ends are ignored. A graph
    without links gives no rows.
    """
    ensure_checkpoint_dir(links.sparkSession)
    links = (
        links.filter("u is not null and v is not null and u <> v")
        .select(
            F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")
        )
        .distinct()
        .checkpoint()
    )
    before, now = None, _state(links)
    parts = 1 + now[0] // LINKS_PER_PART
    links = _contracted(links.coalesce(parts)).coalesce(parts).checkpoint()
    while parts > 1 and before != now:
        links = _star(_star(links, True, parts), False, parts)
        before, now = now, _state(links)
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
