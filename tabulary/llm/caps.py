"""Near-duplicate vectors by spherical caps around the directions of a random product code.

Vectors are rotated by a seeded random orthogonal matrix and cut into ``BLOCKS`` blocks. Each
block has ``CODES`` random unit directions; every combination of one direction per block is a
filter, CODES^BLOCKS of them. A vector lies in a filter's cap when the scaled inner product with
the filter exceeds ``HEIGHT`` standard deviations. The filters a vector lies in are list-decoded:
block by block, partial sums that cannot reach the height with the best remaining blocks are
dropped. Vectors of equal label that share a cap are compared exactly, in double precision.

Vectors meet twice. First only their bytes meet, each component rounded to one byte, with the
length of the rounding error: these bound a cosine from above, and most vectors turn out to have
no partner in a cap. Those that may have one meet again in full.

No filter is capped. A cap with many vectors is cut into chunks, and every two chunks meet in a
task of their own. A pair that shares several caps counts in the first one only, so links are
counted without ever being listed; of a block only each vector's link count and a root of its
component leave the task. Equal vectors are one node throughout.

With the values below a vector of 64 components lies in about 90 of 1,048,576 caps; shorter ones are
filled up to that length. Of pairs at a cosine of 0.93 about 99 % share one, of closer pairs more
(measured in the tests, from 1 to 256 components).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.llm.components import connected_components
from tabulary.session import ensure_checkpoint_dir

COSINE = 0.93
BLOCKS = 2
CODES = 1024
HEIGHT = 3.6
#: Shorter vectors are filled up with zeros to this length before they are rotated. That changes no
#: cosine, and the height, which suits this length and longer ones, holds for them as well.
LEAST_DIM = 64
SEED = 20240229
#: Vectors of one cap that one task compares with each other at most, or so.
CHUNK = 1024
#: Pairs that a worker writes down at a time; more are taken by blocks of a table.
PAIRS = 1 << 18


def _code(dim: int, blocks: int, codes: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation, and the directions of each block, scaled so that a filter has length sqrt(dim)."""
    random = np.random.default_rng([seed, dim, blocks, codes])
    rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0]
    parts = []
    for width in (len(x) for x in np.array_split(np.arange(dim), blocks)):
        raw = random.standard_normal((codes, width)) if width else np.zeros((codes, 0))
        norm = np.linalg.norm(raw, axis=1, keepdims=True)
        parts.append(raw / np.where(norm == 0, 1, norm) * np.sqrt(width))
    return rotation, parts


def list_decode(
    units: np.ndarray,
    blocks: int = BLOCKS,
    codes: int = CODES,
    height: float = HEIGHT,
    seed: int = SEED,
) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of all filters whose cap it lies in."""
    rotation, parts = _code(units.shape[1], blocks, codes, seed)
    turned = units @ rotation
    scores, at = [], 0
    for part in parts:
        scores.append(turned[:, at : at + part.shape[1]] @ part.T)
        at += part.shape[1]
    best = np.cumsum([np.zeros(len(units)), *[s.max(axis=1) for s in scores[:0:-1]]], axis=0)[::-1]
    row, number, total = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units))
    for score, rest in zip(scores, best, strict=True):
        rows, numbers, totals = [], [], []
        for a in range(0, len(row), 1 << 14):
            r, t = row[a : a + (1 << 14)], total[a : a + (1 << 14)]
            reach = t[:, None] + score[r]
            i, c = np.nonzero(reach >= height - rest[r][:, None])
            rows.append(r[i])
            numbers.append(number[a : a + (1 << 14)][i] * codes + c)
            totals.append(reach[i, c])
        if not rows:
            break
        row, number, total = (np.concatenate(x) for x in (rows, numbers, totals))
    order = np.lexsort((number, row))
    return np.split(number[order], np.searchsorted(row[order], np.arange(1, len(units))))


def _usable(label: Column, vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & ~bad & ~zero, F.lit(False))


def _rounded(unit: np.ndarray) -> bytes:
    """A unit vector's scale, length of the rounding error, and components in one byte each."""
    scale = np.abs(unit).max() / 127
    small = np.rint(unit / scale).astype(np.int8)
    error = np.linalg.norm(unit - small * scale) + 1e-9
    return np.array([scale, error]).tobytes() + small.tobytes()


class _Bytes:
    """Rounded vectors of one task; a bound of the cosine of any two of equal length."""

    def __init__(self, rows: pa.ChunkedArray):
        data = rows.to_pylist()
        self.length = np.array([len(d) for d in data])
        self.head = np.array([np.frombuffer(d[:16], np.float64) for d in data])
        widest = int(self.length.max()) - 16
        self.body = np.zeros((len(data), widest), np.float32)
        for i, d in enumerate(data):
            self.body[i, : len(d) - 16] = np.frombuffer(d[16:], np.int8)

    def _bound(self, dots: np.ndarray, one: tuple, two: tuple) -> np.ndarray:
        (scale, error), (scale2, error2) = one, two
        return dots * scale * scale2 + error + error2 + error * error2

    def pairs(self, u: np.ndarray, v: np.ndarray, cosine: float) -> np.ndarray:
        out = np.zeros(len(u), bool)
        for a in range(0, len(u), 1 << 14):
            i, j = u[a : a + (1 << 14)], v[a : a + (1 << 14)]
            dots = np.einsum("ij,ij->i", self.body[i], self.body[j]).astype(float)
            bound = self._bound(dots, self.head[i].T, self.head[j].T)
            out[a : a + (1 << 14)] = (bound >= cosine) & (self.length[i] == self.length[j])
        return out

    def table(self, u: np.ndarray, v: np.ndarray, cosine: float) -> np.ndarray:
        dots = (self.body[u] @ self.body[v].T).astype(float)
        bound = self._bound(dots, self.head[u].T[:, :, None], self.head[v].T[:, None, :])
        return (bound >= cosine) & (self.length[u][:, None] == self.length[v])


def _decoded(nodes: DataFrame, settings: dict) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v) for v in batch.column("vector").to_pylist()]
            marks = batch.column("mark").to_pylist()
            caps: list = [None] * len(vectors)
            rounded: list = [None] * len(vectors)
            lengths = np.array([len(v) for v in vectors])
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                for a in range(0, len(at), 512):
                    some = at[a : a + 512]
                    units = _units([vectors[i] for i in some])
                    wide = np.pad(units, ((0, 0), (0, max(0, LEAST_DIM - length))))
                    for i, unit, found in zip(some, units, list_decode(wide, **settings), strict=True):
                        # labels that share these bits meet, and are told apart when compared
                        caps[i] = found + ((marks[i] & 0x7FFFFFFF) << 32)
                        rounded[i] = _rounded(unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("vector"), batch.column("copies"),
                 pa.array(rounded, pa.binary()), pa.array(caps, pa.list_(pa.int64())), batch.column("label")],
                names=["node", "vector", "copies", "rounded", "caps", "label"],
            )

    return nodes.select("node", "label", "vector", "copies", F.xxhash64("label").alias("mark")).mapInArrow(
        run, "node long, vector array<double>, copies long, rounded binary, caps array<long>, label string"
    )


def _units(vectors: list) -> np.ndarray:
    """Rows of length one; each is first scaled by its largest component, so nothing overflows."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _involved(met: DataFrame, cosine: float) -> DataFrame:
    """The rows of ``met`` that may have a partner in their cap, judged by rounded vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in (*batches, None):
            rows = held
            if batch is not None:
                if not batch.num_rows:
                    continue
                rows = pa.Table.from_batches([batch])
                rows = rows if held is None else pa.concat_tables([held, rows])
            if rows is None:
                return
            task = _task_numbers(rows)
            cut = len(rows) if batch is None else int(np.searchsorted(task, task[-1]))
            held = rows.slice(cut)
            if cut:
                rows = rows.slice(0, cut)
                kept = rows.filter(pa.array(_has_partner(rows, task[:cut], cosine)))
                yield from kept.drop_columns(["rounded"]).combine_chunks().to_batches()

    return met.mapInArrow(run, "cap long, lo int, hi int, chunk int, node long")


def _task_numbers(rows: pa.Table) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    for c in ("cap", "lo", "hi"):
        values = rows.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _has_partner(rows: pa.Table, task: np.ndarray, cosine: float) -> np.ndarray:
    lo, hi, chunk = (rows.column(c).to_numpy() for c in ("lo", "hi", "chunk"))
    own = _Bytes(rows.column("rounded"))
    start = np.flatnonzero(np.diff(task, prepend=-1))
    end = np.append(start[1:], len(task))
    after = np.repeat(end, end - start) - np.arange(len(task)) - 1  # partners behind each row
    total = np.concatenate([[0], np.cumsum(after)])
    out = np.zeros(len(task), bool)
    at = 0
    while at < len(start):
        to = int(np.searchsorted(total[end], total[start[at]] + PAIRS, side="right"))
        if to > at:  # some tasks with few pairs
            a, b = start[at], end[to - 1]
            u = np.repeat(np.arange(a, b), after[a:b])
            v = u + np.arange(len(u)) - np.repeat(total[a:b] - total[a], after[a:b]) + 1
            apart = (lo[u] == hi[u]) | (chunk[u] != chunk[v])
            u, v = u[apart], v[apart]
            near = own.pairs(u, v, cosine)
            out[u[near]] = out[v[near]] = True
            at = to
        else:
            whole = np.arange(start[at], end[at])
            for a in range(start[at], end[at], 256):
                some = np.arange(a, min(a + 256, end[at]))
                near = own.table(some, whole, cosine) & (some[:, None] != whole)
                if lo[a] != hi[a]:
                    near &= chunk[some][:, None] != chunk[whole]
                out[some] |= near.any(axis=1)
            at += 1
    return out


def _compare(group: list[tuple], cosine: float) -> Iterator[pa.RecordBatch]:
    """Links between the vectors of one cap, or between two of its chunks."""
    cap, lo, hi = group[0][:3]
    left = [r for r in group if r[3] == lo]
    right = left if lo == hi else [r for r in group if r[3] == hi]
    kinds = {(r[8], len(r[5])) for r in group}
    for kind in kinds:
        a, b = ([r for r in side if (r[8], len(r[5])) == kind] for side in (left, right))
        if not a or not b:
            continue
        if lo == hi:
            b = a
        linked = _units([r[5] for r in a]) @ _units([r[5] for r in b]).T >= cosine
        if lo == hi:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        linked &= ~_share_earlier([r[7] for r in a], [r[7] for r in b], cap)
        if not linked.any():
            continue
        copies_a, copies_b = (np.array([r[6] for r in side], np.int64) for side in (a, b))
        node_a, node_b = (np.array([r[4] for r in side], np.int64) for side in (a, b))
        most = np.iinfo(np.int64).max
        root_a, root_b = node_a.copy(), node_b.copy()
        while True:
            new_b = np.minimum(root_b, np.where(linked, root_a[:, None], most).min(axis=0))
            new_a = np.minimum(root_a, np.where(linked, new_b[None, :], most).min(axis=1))
            if lo == hi:
                new_a = new_b = np.minimum(new_a, new_b)
            if (new_a == root_a).all() and (new_b == root_b).all():
                break
            root_a, root_b = new_a, new_b
        # integer matrix products have no fast path; these sums are exact below 2^53
        yield _links(node_a, linked @ copies_b.astype(float), root_a)
        if lo != hi:
            yield _links(node_b, copies_a.astype(float) @ linked, root_b)


def _links(node: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    some = links > 0
    return pa.RecordBatch.from_pydict(
        {"node": node[some], "links": links[some].astype(np.int64), "root": root[some]}
    )


def _share_earlier(a: list, b: list, cap: int) -> np.ndarray:
    """Which pairs share a cap with a smaller number than this one."""
    flat_a, flat_b = (
        [(c, i) for i, caps in enumerate(side) for c in caps if c < cap] for side in (a, b)
    )
    common = {c for c, _ in flat_a} & {c for c, _ in flat_b}
    column = {c: k for k, c in enumerate(sorted(common))}
    if not column:
        return np.zeros((len(a), len(b)), bool)
    in_a, in_b = np.zeros((len(a), len(column)), np.float32), np.zeros((len(b), len(column)), np.float32)
    for matrix, flat in ((in_a, flat_a), (in_b, flat_b)):
        at = [(i, column[c]) for c, i in flat if c in column]
        matrix[tuple(np.array(at).T)] = 1
    return in_a @ in_b.T > 0


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("cap", "lo", "hi").sortWithinPartitions("cap", "lo", "hi", "node")


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    blocks: int = BLOCKS,
    codes: int = CODES,
    height: float = HEIGHT,
    seed: int = SEED,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and the cosine of their vectors is at
    least ``cosine``. A vector that is null, empty, zero, or has null or non-finite components
    links with nothing, nor do vectors of different length. ``component_id`` is the smallest
    vec_id that links lead to, itself included; null ids count only where there is no other.
    Repeated rows each count as a vector. Labels of any type are compared whole, by their text.
    Other columns are ignored; an empty table gives no rows.
    """
    if codes**blocks >= 1 << 32:
        raise ValueError("more filters than 2^32")
    ensure_checkpoint_dir(vectors.sparkSession)
    settings = {"blocks": blocks, "codes": codes, "height": height, "seed": seed}
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    rows = rows.withColumn(
        "node", F.when(_usable(F.col("label"), F.col("vector")), F.xxhash64("label", "vector"))
    )
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("vec_id"),
        F.first("label").alias("label"),
        F.first("vector").alias("vector"),
        F.count("*").alias("copies"),
    )
    decoded = _decoded(nodes, settings).checkpoint()
    placed = decoded.select("node", F.explode("caps").alias("cap"))
    shared = (
        placed.groupBy("cap").agg(F.count("*").alias("n")).filter("n > 1")
        .select("cap", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
        .checkpoint()
    )
    met = (
        placed.join(shared, "cap")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("cap", "node", "chunk", F.least("chunk", "other").alias("lo"),
                F.greatest("chunk", "other").alias("hi"))
        .join(decoded.select("node", "rounded"), "node")
        .select("cap", "lo", "hi", "chunk", "node", "rounded")
    )
    in_full = (
        _involved(_together(met), cosine).checkpoint()
        .join(decoded.drop("rounded"), "node")
        .select("cap", "lo", "hi", "chunk", "node", "vector", "copies", "caps", "label")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    yield from _compare(group, cosine)
                    group = []
                group.append(row)
        if group:
            yield from _compare(group, cosine)

    found = _together(in_full).mapInArrow(run, "node long, links long, root long").checkpoint()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(
        found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    ).checkpoint()
    ids = rows.filter("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")
    )
    ids = ids.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = ids.join(links, "node", "left").checkpoint()
    named = ids.groupBy("component").agg(F.min("vec_id").alias("component_id")).checkpoint()
    of_node = ids.join(named, "component").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    ).checkpoint()
    out = rows.select("vec_id", "node").join(of_node, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
