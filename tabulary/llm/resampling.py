"""Importance resampling of documents towards a target distribution.

Texts are read as bags of hashed features: all runs of 1 to ``NGRAM`` consecutive words, each in the
bucket that the CRC-32 of its UTF-8 bytes gives. A bucket's gain says how much likelier the target
texts use it than the documents at large; a document's weight is the sum of its features' gains.
Gains are one array, indexed by bucket, and weights are taken from it for whole texts at once.
Adding a Gumbel variate to each weight and keeping the highest scores draws without replacement in
proportion to the likelihood ratio; the variate comes from a hash of the id, so a draw repeats.

The lowest drawn score is found by distributed quickselect: each round draws random pivots among the
keys still in question, counts exactly how many keys lie below, at and between them, and goes on
with the one part that holds the k-th key. Keys are unique, so the search always ends with one.
Only the winners are then sorted and ranked, by range parts.

Only bounded things come to the driver: two counts a bucket, and ``PIVOTS`` keys a round. Texts are
read in blocks of ``BLOCK`` bytes, so a very long one takes no more memory. A null text is empty: no
features, weight 0. A null id hashes as the empty text and comes last among equal scores. Repeated
rows each take part in the draw. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.operators.numbering import number_rows
from tabulary.session import drop_path, ensure_checkpoint_dir, work_path

BUCKETS = 10_000
NGRAM = 3
SEED = 42
#: Documents with fewer words are not drawn; of the others so many in a hundred are.
LEAST_WORDS = 20
PERCENT = 5
#: Keys that one round of the selection divides by; so few candidates are all drawn, which ends it.
PIVOTS = 256
#: Bytes of a text whose words are held at a time.
BLOCK = 1 << 18

#: Byte by byte: A-Z in lower case, and a space for ASCII that is neither letter nor digit.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or chr(b).islower() else 32
    for b in range(256)
)


def _blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in order, a block at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + BLOCK)
        to = len(data) if to < 0 else to
        words = data[at:to].split()
        if words:
            yield words
        at = to


def feature_buckets(text: str | None, buckets: int = BUCKETS, ngram: int = NGRAM) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of a text: how many words it has, and the buckets of the features that end in it.

    A CRC goes on from the CRC of what came before, so a longer run costs no more than its last word.
    """
    before: list[bytes] = []
    for words in _blocks(text):
        run = before + words
        sums = list(map(crc32, run))
        found = [sums[len(before):]]
        spaced = [b" " + w for w in run]
        for n in range(1, min(ngram, len(run))):
            sums = list(map(crc32, spaced[n:], sums))
            found.append(sums[max(0, len(before) - n):])
        yield len(words), np.concatenate([np.array(f, np.int64) for f in found]) % buckets
        before = run[len(run) - min(len(run), ngram - 1):]


def bucket_counts(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """How many features of all ``docs`` and of all ``target`` texts lie in each bucket.

    Each task adds up a bucket's features before anything is shuffled.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"), F.lit(0).alias("side")).unionAll(
        target.select(F.col("text").cast("string").alias("text"), F.lit(1).alias("side"))
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, side in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for _, at in feature_buckets(text.as_py(), buckets, ngram):
                    total[side] += np.bincount(at, minlength=buckets)
        side, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"side": side.astype(np.int32), "bucket": bucket.astype(np.int32), "n": total[side, bucket]}
        )

    out = np.zeros((2, buckets), np.int64)
    counted = texts.mapInArrow(count, "side int, bucket int, n long")
    for r in counted.groupBy("side", "bucket").agg(F.sum("n").alias("n")).collect():
        out[r.side, r.bucket] = r.n
    return out[0], out[1]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the smoothed shares of each bucket, floored."""
    s_all, t_all, size = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [
            math.floor(1000 * math.log(float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weigh(docs: DataFrame, gain: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column(1)):
                for words, at in feature_buckets(text.as_py(), len(table), ngram):
                    out[i] += words, len(at), int(table.take(at).sum())
            names = ("n_words", "n_features", "weight")
            made = [pa.array(np.ascontiguousarray(column)) for column in out.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long"
    )


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel variate, floored, from the first 32 bits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


#: The order of the draw, smallest first, as stored with the scores.
_KEY = ("low", "no_id", "id", "row")


def _literal(pivot: tuple) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {v}L" for n, v in zip(_KEY, pivot, strict=True)) + ")"


def _key() -> Column:
    return F.struct(*[F.col(n).cast("long").alias(n) for n in _KEY])


def _upto(pivot: tuple) -> Column:
    """Whether a row's key is at most the pivot; the bare comparison lets a scan skip by it."""
    return (F.col(_KEY[0]) <= pivot[0]) & (_key() <= F.expr(_literal(pivot)))


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple:
    """The k-th smallest of the unique keys of ``rows``, which has at least k.

    Each round's candidates are stored, so a round reads what the one before has left, and the
    random choice of pivots cannot change when a lost part is computed again.
    """
    spark = rows.sparkSession
    left, before, turn = rows.select(*_KEY), None, 0
    while True:
        order = [F.xxhash64(*_KEY, F.lit(turn)), *_KEY]
        drawn = sorted(tuple(r) for r in left.orderBy(*order).limit(pivots).collect())
        # three ways a pivot: below it (and above the one before), at it, and the rest above all
        marks = F.expr(f"array({', '.join(map(_literal, drawn))})")
        below = F.size(F.filter(marks, lambda p: p < _key()))
        part = 2 * below + F.exists(marks, lambda p: p == _key()).cast("int")
        counted = dict(left.groupBy(part.alias("part")).count().collect())
        number = 0
        while k > counted.get(number, 0):
            k -= counted.get(number, 0)
            number += 1
        if number % 2:
            if before:
                drop_path(spark, before)
            return drawn[number // 2]
        inside = F.lit(True)
        if number < 2 * len(drawn):
            inside &= _upto(drawn[number // 2]) & (_key() != F.expr(_literal(drawn[number // 2])))
        if number:
            inside &= ~_upto(drawn[number // 2 - 1])
        path = work_path(spark, "select")
        left.filter(inside).write.parquet(path)
        left = spark.read.schema(left.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before, turn = path, turn + 1


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    ngram: int = NGRAM,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text).

    Of the N documents with at least ``least_words`` words, floor(percent * N / 100) are drawn; they
    have ranks from 1 by falling score, equal scores by doc_id, and the others have none. The scores
    are stored once in the shared folder, where the result is read from.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    gain = gains(*bucket_counts(docs, target, buckets, ngram))
    path = work_path(spark, "scores")
    (
        weigh(docs, gain, ngram)
        .withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
        .withColumn("low", -F.col("score"))
        .withColumn("no_id", F.col("doc_id").isNull().cast("int"))
        .withColumn("id", F.coalesce("doc_id", F.lit(0)))
        .withColumn("row", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    scored = spark.read.parquet(path)
    out = ["doc_id", "n_features", "weight", "score"]
    free = F.col("n_words") >= least_words
    k = percent * scored.filter(free).count() // 100
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last = kth_key(scored.filter(free), k)
    drawn = free & _upto(last)
    ranked = number_rows(scored.filter(drawn), [F.col(name).asc() for name in _KEY], name="rank")
    rest = scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out, "rank").unionAll(rest.select(*out, "rank"))
