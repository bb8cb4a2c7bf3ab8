"""Document fingerprints: one-permutation MinHash, densified, cut to b bits per bin.

Every shingle of five words is hashed once. The high bits of a hash choose one of ``BINS`` bins
and each bin keeps its smallest hash. An empty bin copies the value of a filled bin, the
first in a random order of all bins that is fixed for the empty bin and alike for all documents:
the densification whose variance is optimal. Of each value ``BITS`` low bits are packed.

Two values of b bits agree by chance with probability 2^-b, so the share P of agreeing bins is
corrected to (P - 2^-b) / (1 - 2^-b) and kept within 0 and 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.llm.words import grouped, mix, shingle_hashes
from tabulary.session import local_frame

#: Bins of a fingerprint, a power of two; bits kept of each bin; words of a shingle.
BINS = 512
BITS = 4
WIDTH = 5


_orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Documents with at most so many filled bins look a bin's source up by rank, not by trial.
_FEW = 24


def _probe_orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin a fixed random order of all bins, and each bin's rank in that order."""
    if bins not in _orders:
        keys = mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x5DEECE66D)).reshape(bins, bins)
        order = np.argsort(keys, axis=1)
        _orders[bins] = order, np.argsort(order, axis=1).astype(np.int32)
    return _orders[bins]


def _densify(values: np.ndarray, filled: np.ndarray) -> None:
    """Give every empty bin the value of the first filled bin in its probe order."""
    bins = values.shape[1]
    order, rank = _probe_orders(bins)
    count = filled.sum(axis=1)
    for row in np.flatnonzero((count > 0) & (count <= _FEW)):
        has = np.flatnonzero(filled[row])
        values[row] = np.where(
            filled[row], values[row], values[row, has[np.argmin(rank[:, has], axis=1)]]
        )
    row, column = np.nonzero(~filled & (count > _FEW)[:, None])
    for attempt in range(bins):
        if not len(row):
            break
        source = order[column, attempt]
        found = filled[row, source]
        values[row[found], column[found]] = values[row[found], source[found]]
        row, column = row[~found], column[~found]


def signatures(
    texts: Sequence[str | None], bins: int = BINS, bits: int = BITS, width: int = WIDTH
) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of all bins, a row per text, and whether the text has any shingle."""
    hashes, offsets = shingle_hashes(texts, width)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    values = np.full((len(offsets) - 1, bins), np.iinfo(np.uint64).max)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cell = row * bins + (hashes >> shift).astype(np.int64)
    np.minimum.at(values.reshape(-1), cell, hashes)
    filled = np.zeros(values.shape, bool)
    filled.reshape(-1)[cell] = True
    _densify(values, filled)
    # a bin's own constant keeps the bits of a value that fills several bins independent
    values += mix(np.arange(1, bins + 1, dtype=np.uint64))
    low = (mix(values) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return low, np.diff(offsets) > 0


def packed(low: np.ndarray, present: np.ndarray, bits: int = BITS) -> list[str]:
    """Hexadecimal fingerprints; a text without words has the empty one."""
    planes = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :]
    rows = np.packbits(planes.reshape(len(low), -1), axis=1)
    return [r.tobytes().hex() if p else "" for r, p in zip(rows, present, strict=True)]


def likenesses(
    one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], bits: int = BITS
) -> np.ndarray:
    """Estimated Jaccard similarities, row by row, of the shingle sets behind two signature sets.

    Two texts without words are alike (1.0); one without and one with words are not (0.0).
    """
    (a, has_a), (b, has_b) = one, two
    share = (a == b).mean(axis=1) if len(a) else np.zeros(0)
    chance = 2.0**-bits
    estimate = np.clip((share - chance) / (1.0 - chance), 0.0, 1.0)
    return np.where(has_a & has_b, estimate, (has_a == has_b).astype(float))


def likeness(one: str, two: str, bits: int = BITS) -> float:
    """The same estimate from two packed fingerprints."""
    def unpack(text: str) -> tuple[np.ndarray, np.ndarray]:
        raw = np.unpackbits(np.frombuffer(bytes.fromhex(text), np.uint8)).reshape(1, -1, bits)
        return raw @ (1 << np.arange(bits)[::-1]), np.array([bool(text)])

    if not one or not two:
        return float(one == two)
    return float(likenesses(unpack(one), unpack(two), bits)[0])


def fingerprint_column(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the hexadecimal fingerprint of ``text`` as a further column ``out``."""
    if out in docs.columns:
        raise ValueError(f"the table already has a column {out}")
    schema = docs.select("*", F.lit("").alias(out)).schema
    at = docs.columns.index(text)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[str] = []
            for part in grouped(batch.column(at).to_pylist(), lambda t: len(t or "")):
                made += packed(*signatures(part))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, out]
            )

    return docs.mapInArrow(add, schema)


def edited(text: str, following: str) -> str:
    """``text`` whose last floor(n/2) characters give way to as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_sequence(docs: DataFrame, key: str, parts: int) -> DataFrame:
    """Deal rows out to ``parts`` ranges of ``key``, each followed by the row that comes next.

    The sequence runs by descending key, null keys last, equal keys by text. Columns of the
    result: ``part``, ``next_part`` (true for the copy of a neighbouring part's first row), the
    key and the text. Cut points are computed once on the driver, from keys alone, so that a
    recomputed task meets the same rows; one row per part comes to the driver. After the last
    row of all comes the first.
    """
    # spelled out as text: thousands of parts are then still one literal each, not as many calls
    shares = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    cuts = docs.select(F.expr(f"percentile_approx({key}, array({shares}), {20 * parts})")).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    part: Column = F.lit(0)
    if cuts:
        known = F.expr("array(" + ", ".join(f"bigint({c})" for c in cuts) + ")")
        part = F.coalesce(F.size(F.filter(known, lambda c: c <= F.col(key))), F.lit(0))
        part = F.when(F.col(key).isNull(), 0).otherwise(part)
    placed = docs.withColumn("part", part)
    tops = sorted(placed.groupBy("part").agg(F.max(key).alias("top")).collect(), reverse=True,
                  key=lambda r: r.part)
    # for the first part: the last one, which it follows in a ring; one row a part
    ring = local_frame(
        docs.sparkSession, [(r.part, r.top, tops[i - 1].part) for i, r in enumerate(tops)],
        "_part int, _top long, _before int",
    )
    here = F.struct(F.col("part"), F.lit(False).alias("next_part"))
    there = F.struct(F.col("_before").alias("part"), F.lit(True).alias("next_part"))
    first = F.col(key).eqNullSafe(F.col("_top"))
    dealt = placed.join(F.broadcast(ring), F.col("part") == F.col("_part")).select(
        F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))).alias("at"), *docs.columns
    )
    return (
        dealt.select("at.part", "at.next_part", *docs.columns)
        .repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("part", "next_part", F.col(key).desc_nulls_last(), "text")
    )


EDITED_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited_fingerprints(docs: DataFrame, parts: int) -> DataFrame:
    """Fingerprints of every text and of its edited form (see :func:`edited`).

    Null texts count as empty. A table of one row is its own successor. Rows with equal keys
    follow each other by text; repeated rows each give a row. An empty table gives no rows.
    Other columns of ``docs`` are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int | None, str]] = []  # the last row waits for its successor

        def done(pairs):
            texts = [row[3] for row, _ in pairs]
            after = [text for _, text in pairs]
            changed = [edited(t, a) for t, a in zip(texts, after, strict=True)]
            n = len(pairs)
            # within a run the successor is the next row; where a run ends it comes by itself
            apart = [i for i in range(n) if i == n - 1 or after[i] is not texts[i + 1]]
            low, present = signatures([*texts, *changed, *[after[i] for i in apart]])
            at = np.arange(1, n + 1)
            at[apart] = 2 * n + np.arange(len(apart))
            own, other = (low[:n], present[:n]), (low[n : 2 * n], present[n : 2 * n])
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([row[2] for row, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    "edited_sha256": [
                        hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed
                    ],
                    "fingerprint": packed(*own),
                    "edited_fingerprint": packed(*other),
                    "near_edited": likenesses(own, other),
                    "near_next": likenesses(own, (low[at], present[at])),
                }
            )

        for batch in batches:
            rows = held + list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            pairs = []
            for row, following in zip(rows, rows[1:], strict=False):
                if not row[1] and row[0] == following[0]:
                    pairs.append((row, following[3]))
            held = rows[-1:]
            for some in grouped(pairs, lambda p: 2 * len(p[0][3]) + len(p[1])):
                yield done(some)

    return in_sequence(rows, "doc_id", parts).mapInArrow(run, EDITED_SCHEMA)
