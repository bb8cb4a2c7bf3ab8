"""Packing of documents into training sequences by non-negative least squares.

A document's tokens, with an end token, are cut into pieces of the window's length and a rest.
Full pieces are sequences by themselves. For the rests, combinations of two or three lengths
that fill the window exactly are enumerated, and repeat counts for these are found whose use of
each length comes nearest to the histogram in least squares, none of them negative. The counts
are rounded, largest first, within what is left of each length; what then remains is packed
greedily, each time the longest length with the longest that still fits.

All of this sees only the histogram, at most one number per length. Pieces find their place by
their rank among the pieces of their length: a task counts its own, and one running sum per
length over the tasks makes the ranks global. No piece moves between tasks for it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulary.llm.words import kept_in_worker, text_groups
from tabulary.session import ensure_checkpoint_dir

#: Tokens of a sequence; the token that ends a document; steps of the least-squares solution.
WINDOW = 1024
END_ID = 0
STEPS = 200

#: length, first rank, rank after the last, first sequence, offset in the sequence
Slot = tuple[int, int, int, int, int]


def combinations(lengths: Sequence[int], window: int) -> list[tuple[int, ...]]:
    """All pairs and triples of the given lengths, in falling order, that add up to the window."""
    own = sorted(set(lengths), reverse=True)
    known = set(own)
    out: list[tuple[int, ...]] = [(a, window - a) for a in own if 2 * a >= window and window - a in known]
    for a in own:
        for b in own:
            if b <= a and (c := window - a - b) <= b and c in known:
                out.append((a, b, c))
    return out


def solve_counts(combos: Sequence[tuple[int, ...]], histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts whose use of each length is nearest to the histogram.

    Projected gradient descent with momentum. A combination touches three lengths at most, so
    the normal equations are never formed.
    """
    if not combos:
        return np.zeros(0)
    slot = np.array([(*c, 0)[:3] for c in combos])
    weight = (slot > 0).astype(float)
    size = len(histogram)

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(slot.reshape(-1), (weight * x[:, None]).reshape(-1), minlength=size)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[slot] * weight).sum(axis=1)

    target = histogram.astype(float).copy()
    target[0] = 0
    # the largest eigenvalue is at most the largest row sum of the squared matrix
    limit = back(use(np.ones(len(combos)))).max()
    x = y = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(use(y) - target) / limit)
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[Slot]:
    """Where the pieces of each length go, by rank; sequences are numbered from 0."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    rank = np.zeros(window + 1, np.int64)
    slots: list[Slot] = []
    sequence = 0

    def place(pattern: Sequence[int], times: int) -> None:
        nonlocal sequence
        at = 0
        for length in pattern:
            slots.append((length, int(rank[length]), int(rank[length]) + times, sequence, at))
            rank[length] += times
            left[length] -= times
            at += length
        sequence += times

    def most(pattern: Sequence[int]) -> int:
        return int(min(left[length] // pattern.count(length) for length in set(pattern)))

    if left[window]:
        place([window], int(left[window]))
    combos = combinations(np.flatnonzero(left).tolist(), window)
    counts = solve_counts(combos, left)
    for k in np.argsort(-counts, kind="stable"):
        times = min(int(np.floor(counts[k] + 0.5)), most(combos[k]))
        if counts[k] < 0.5:
            break
        if times > 0:
            place(combos[k], times)
    while left.any():
        pattern: list[int] = []
        room = window
        free = left.copy()
        while room and (fits := np.flatnonzero(free[: room + 1])).size:
            length = int(fits[-1])
            pattern.append(length)
            free[length] -= 1
            room -= length
        place(pattern, most(pattern))
    return slots


# Fixed value: the split of byte-level BPE vocabularies of this family.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of so many characters of one kind, spaces or others, is left to the tokenizer.
_LONG_RUN = 10_000


def _settled() -> str:
    """A character class of what has had its present category since Unicode 3.2, as ranges."""
    old, ranges = unicodedata.ucd_3_2_0, []
    for code in range(0x20000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co") or kind != old.category(c) or 0x1C <= code <= 0x1F or code == 0x180E:
            continue
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as its library gives them without special tokens.

    A vocabulary whose merges come in order of their ids is also run by a second library that is
    several times faster. It takes the texts for which the two are known to agree: those whose
    characters have had their category for long, without special tokens or very long words.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in added}
        self.fast = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special = sorted(added)
        self.unsettled = re.compile(f"[^{_settled()}]")
        self.separators = re.compile(r"[\x1c-\x1f]")
        self.long_run = re.compile(rf"\S{{{_LONG_RUN}}}|\s{{{_LONG_RUN}}}")

    def is_odd(self, text: str) -> bool:
        """Whether a text is left to the tokenizer's own library."""
        return (
            (self.separators if text.isascii() else self.unsettled).search(text) is not None
            or any(t in text for t in self.special)
            or (len(text) >= _LONG_RUN and self.long_run.search(text) is not None)
        )

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        odd = [self.is_odd(t) for t in texts]
        own = [t for t, o in zip(texts, odd, strict=True) if o]
        rest = iter(self.tokenizer.encode_batch_fast(own, add_special_tokens=False) if own else ())
        for text, o in zip(texts, odd, strict=True):
            ids = next(rest).ids if o else self.fast.encode_ordinary(text)
            yield np.array(ids, "<u4")


def _piece_rows(
    batches: Iterable[pa.RecordBatch], encoder: Encoder, task: int, window: int, end_id: int
) -> Iterator[pa.RecordBatch]:
    """The pieces of one task's batches (doc_id, text)."""
    met = np.zeros(window + 1, np.int64)
    for batch in batches:
        for some in text_groups(batch.column(1)):
            doc_ids, texts = (c[some].to_pylist() for c in batch.columns)
            rows: dict[str, list] = {
                c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank")
            }
            for doc_id, ids in zip(doc_ids, encoder.encode([t or "" for t in texts]), strict=True):
                ids = np.append(ids, np.array([end_id], "<u4"))
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    values = (
                        doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), task,
                        int(met[len(part)]),
                    )
                    met[len(part)] += 1
                    for column, value in zip(rows.values(), values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in rows.items()})


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents (doc_id, text), with task and rank in the task by length.

    A null text is empty and has the end token alone.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("encoder", path), lambda: Encoder(path))
        return _piece_rows(batches, encoder, TaskContext.get().partitionId(), window, end_id)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long",
    )


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text), with its sequence and its offset there.

    ``path`` is a tokenizer file that all workers can read. Each token of a document, the end
    token included, lies in one piece; a sequence is padded up to the window. Repeated rows are
    documents of their own, null texts are empty, other columns are ignored, and an empty table
    gives no rows.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    # stored, because ranks within a task must not change when a task runs again
    cut = pieces(docs, path, window, end_id).checkpoint()
    each = cut.groupBy("length", "task").agg(F.count("*").alias("n")).checkpoint()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = each.select(
        "length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    histogram = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = np.array(plan(histogram, window), np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    # ranks of one length are consecutive, so one sorted key finds a piece's slot
    key = slots[:, 0] * (1 << 48) + slots[:, 1]

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = slots[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            columns = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    ranked = cut.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        settle,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long",
    )
