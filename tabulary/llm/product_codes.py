"""Product codes of vectors: integer codebooks trained over a trie of distinct parts.

Each component x becomes the integer floor(``SCALE`` * x), and a vector is cut into ``PARTS`` equal
consecutive parts. A part position's codebook starts as that part of the ``ENTRIES`` smallest ids.
Each of ``ROUNDS`` rounds gives every part the nearest entry and moves each entry to the floored
mean of its parts; entries without parts stay. All arithmetic is on integers, so results do not
depend on how rows are partitioned.

Equal parts are gathered once, with their number, and sorted by range: every task then holds a
stretch of the lexicographic trie of a position's parts, one component a level. A depth-first walk
carries down the squared distances to all entries that the components so far add up to, so parts
with a common beginning share them. Where few parts are left below a node, their levels are taken
together. A leaf takes the nearest entry and adds its part, times its number, to that entry's sum.

Only the codebooks come to the driver, PARTS * ENTRIES entries a round. Rows that hold the same part,
however many, are one leaf. Rows whose vector is null or holds null or non-finite components are
dropped. Vectors of different lengths are filled up with zeros to the longest, and that to a multiple
of PARTS; integers beyond ``LARGEST`` in size are cut to it, so that no sum of squares overflows. Null
ids come after all others, repeated ids are ordered by their vectors, and with fewer rows than
ENTRIES a codebook has as many entries. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.operators.sizing import few_rows, hinted
from tabulary.session import ensure_checkpoint_dir, work_path

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LARGEST = 1 << 26
#: Parts below one node of the trie whose levels are taken together.
BLOCK = 512
#: Parts that one task sorts out at a time when rows are coded.
SLICE = 1 << 13

#: PARTS codebooks, each entries by components.
Codebooks = list[np.ndarray]


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integer components ``x`` of the rows that are kept."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(
        "vector",
        lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * SCALE))).cast("int"),
    )
    return rows.filter(F.col("vector").isNotNull() & finite).select("vec_id", "label", whole.alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of ``width``, filled up with zeros."""
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (length == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < length[:, None]] = flat
    return out


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each of the sorted, distinct ``parts``; ties to the lower index.

    A depth-first walk over the trie of the parts.
    """
    depth = parts.shape[1]
    entry, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    columns = np.ascontiguousarray(book.T)
    open_nodes = [(0, 0, len(parts), np.zeros(len(book), np.int64))] if len(parts) else []
    while open_nodes:
        level, lo, hi, sums = open_nodes.pop()
        if level == depth or hi - lo <= BLOCK:
            entry[lo:hi], far[lo:hi] = _below(parts[lo:hi, level:], columns[level:], sums)
            continue
        values = parts[lo:hi, level]
        starts = lo + np.flatnonzero(np.diff(values, prepend=values[0] - 1))
        children = list(zip(starts.tolist(), [*starts[1:].tolist(), hi], strict=True))
        # small neighbours are walked together, as one node that has not gone down yet
        at = 0
        while at < len(children):
            to = at
            while to < len(children) and children[to][1] - children[at][0] <= BLOCK:
                to += 1
            if to > at:
                a, b = children[at][0], children[to - 1][1]
                entry[a:b], far[a:b] = _below(parts[a:b, level:], columns[level:], sums)
                at = to
            else:
                a, b = children[at]
                open_nodes.append((level + 1, a, b, sums + (parts[a, level] - columns[level]) ** 2))
                at += 1
    return entry, far


def _below(parts: np.ndarray, columns: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaves below one node, level by level: parts that agree so far have one row of sums."""
    node = np.zeros(len(parts), np.int64)
    total = sums[None, :]
    for level in range(parts.shape[1]):
        new = np.ones(len(parts), bool)
        new[1:] = (node[1:] != node[:-1]) | (parts[1:, level] != parts[:-1, level])
        first = np.flatnonzero(new)
        step = parts[first, level][:, None] - columns[level]
        total = total[node[first]] + step * step
        node = np.cumsum(new) - 1
    best = total.argmin(axis=1)
    return best[node], total[np.arange(len(total)), best][node]


def _distinct_parts(rows: DataFrame, width: int) -> DataFrame:
    """(position, part, copies), range-partitioned and sorted as the tries are walked."""
    size = width // PARTS
    filled = F.concat("x", F.array_repeat(F.lit(0), F.greatest(F.lit(0), width - F.size("x"))))
    parts = rows.select(
        F.posexplode(F.array(*[F.slice(filled, 1 + k * size, size) for k in range(PARTS)])).alias("position", "part")
    )
    return (
        parts.groupBy("position", "part").agg(F.count("*").alias("copies"))
        .repartitionByRange("position", "part").sortWithinPartitions("position", "part")
    )


def _first_books(rows: DataFrame, width: int, entries: int) -> Codebooks:
    chosen = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    x = np.zeros((len(chosen), width), np.int64)
    for i, r in enumerate(chosen):
        x[i, : len(r.x)] = r.x
    return [part.copy() for part in np.split(x, PARTS, axis=1)]


def _moved(parts: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round; each task sends one row for each entry that it used."""
    shared = parts.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES entries
    size = books[0].shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = [np.zeros_like(b) for b in own]
        counts = [np.zeros(len(b), np.int64) for b in own]
        for batch in batches:
            position = batch.column(0).to_numpy()
            x, copies = _matrix(batch.column(1), size), batch.column(2).to_numpy()
            for k in np.unique(position):
                here = position == k
                entry, _ = nearest(x[here], own[k])
                np.add.at(sums[k], entry, x[here] * copies[here][:, None])
                counts[k] += np.bincount(entry, copies[here], len(own[k])).astype(np.int64)
        for k, count in enumerate(counts):
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({
                "position": pa.array(np.full(len(used), k), pa.int32()),
                "entry": pa.array(used, pa.int32()),
                "count": count[used],
                "sums": pa.array(list(sums[k][used]), pa.list_(pa.int64())),
            })

    used = parts.mapInArrow(run, "position int, entry int, count long, sums array<long>")
    added = used.groupBy("position", "entry").agg(
        F.sum("count").alias("count"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]
    )
    moved = [b.copy() for b in books]
    for r in added.collect():
        moved[r.position][r.entry] = [r[f"s{i}"] // r["count"] for i in range(size)]
    shared.destroy()
    return moved


def train(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``rows`` (see :func:`integers`); none if there are no rows."""
    ensure_checkpoint_dir(rows.sparkSession)
    longest = rows.agg(F.max(F.size("x")).alias("n")).first().n
    if longest is None:
        return []
    width = -(-longest // PARTS) * PARTS
    books = _first_books(rows, width, entries)
    parts = _distinct_parts(rows, width).checkpoint()
    for _ in range(rounds):
        books = _moved(parts, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of every row; parts that a task meets again are coded once."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES entries
    fields = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        width = sum(b.shape[1] for b in own)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                x = _matrix(some.column(2), width)
                codes, error = np.zeros((len(x), len(own)), np.uint8), np.zeros(len(x), np.int64)
                for k, part in enumerate(np.split(x, len(own), axis=1)):
                    order = np.lexsort(part.T[::-1]) if width else np.arange(len(part))
                    new = np.ones(len(part), bool)
                    new[1:] = (part[order[1:]] != part[order[:-1]]).any(axis=1)
                    entry, far = nearest(part[order[new]], own[k])
                    which = np.empty(len(part), np.int64)
                    which[order] = np.cumsum(new) - 1
                    codes[:, k] = entry[which]
                    error += far[which]
                text = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(text, pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return rows.select("vec_id", "label", "x").mapInArrow(run, fields)


def digest(books: Codebooks) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the kept rows of ``vectors``.

    ``vectors`` has vec_id, embedding and label. ``label_error`` is the error of all rows of the same
    label, null labels together. The codes are stored once in the shared folder, where the result
    is read from.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part")
    spark = vectors.sparkSession
    rows = integers(vectors)
    books = train(rows, entries, rounds)
    path = work_path(spark, "codes")
    coded = encode(rows, books) if books else rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    coded.write.parquet(path)
    coded = spark.read.parquet(path)
    ensure_checkpoint_dir(spark)
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    total = total.select(F.col("label").alias("of_label"), "label_error").checkpoint()
    same = F.col("label").eqNullSafe(F.col("of_label"))
    return coded.join(hinted(total, few_rows(total)), same).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
