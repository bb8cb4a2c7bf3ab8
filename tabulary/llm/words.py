"""Words and word shingles of texts as 64-bit hashes, computed for a whole batch at once.

Words are maximal runs of bytes other than space and the five ASCII controls 0x09-0x0D, with
A-Z folded to lower case. A word's hash is a polynomial over per-byte random constants, taken
from prefix sums, so that no word is ever built as an object. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; a longer word is taken whole.
BLOCK = 1 << 18
#: Characters of text that one group of documents may add up to before it is handed on.
GROUP_CHARS = 1 << 22
#: Bytes of text that are taken out of an Arrow batch at a time.
GROUP_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_LETTER[65:91] = _LETTER[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[name] = table
    return _powers["up"], _powers["down"]


def block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of a block that cuts no word."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and each text's first word (one more at the end)."""
    encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(encoded), dtype=np.uint8)
    first_byte = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(e) + 1 for e in encoded], out=first_byte[1:])
    starts, hashes, at = [], [], 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        if to < len(data):
            back = np.flatnonzero(_SPACE[data[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:  # one word fills the block: go on to its end
                while to < len(data) and not _SPACE[data[to]]:
                    step = np.flatnonzero(_SPACE[data[to : to + BLOCK]])
                    to = to + int(step[0]) if len(step) else min(to + BLOCK, len(data))
        s, h = block_words(data[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    offsets = np.searchsorted(start, first_byte)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), offsets


def shingle_hashes(texts: Sequence[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, repeats included, and their offsets.

    A text with fewer words than ``width`` has one shingle, its whole word sequence; a text
    without words has none.
    """
    words, offsets = word_hashes(texts)
    count = np.diff(offsets)
    whole = np.maximum(count - width + 1, 0)
    length = np.where((count > 0) & (count < width), 1, whole)
    out_offsets = np.concatenate([[0], np.cumsum(length)])
    rolled = np.zeros(len(words), np.uint64)
    for j in range(min(width, len(words))):
        rolled[: len(words) - j] += words[j:] * np.uint64(pow(int(_STEP), j, 1 << 64))
    first = np.repeat(offsets[:-1], whole) + _ranks(whole)
    out = np.empty(int(out_offsets[-1]), np.uint64)
    long_rows = np.repeat(whole > 0, length)
    out[long_rows] = mix(rolled[first])
    for k in np.flatnonzero((count > 0) & (count < width)):
        few = words[offsets[k] : offsets[k + 1]]
        total = len(few)
        for w in few.tolist():
            total = (total * int(_STEP) + w) % (1 << 64)
        out[out_offsets[k]] = mix(np.array([total], np.uint64))[0]
    return out, out_offsets


def _ranks(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the consecutive runs of the given lengths."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def kept_in_worker(key: tuple, build: Callable[[], Any]) -> Any:
    """What ``build`` returns, built once in a worker process rather than once a task.

    Functions travel by value and so bring no module state along; this is the one place where
    a worker keeps something (a loaded vocabulary with its bounded cache) between tasks.
    """
    home = sys.modules.setdefault("_tabulary_kept", ModuleType("_tabulary_kept"))
    kept = home.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def text_groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[slice]:
    """Consecutive texts of ``limit`` bytes at most together, or one; nulls have none."""
    start = total = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > start and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(column):
        yield slice(start, len(column))


def grouped(rows: Sequence, size_of) -> Iterator[Sequence]:
    """Consecutive slices whose sizes add up to about GROUP_CHARS at most (or one row)."""
    start = total = 0
    for i, row in enumerate(rows):
        size = size_of(row)
        if i > start and total + size > GROUP_CHARS:
            yield rows[start:i]
            start, total = i, 0
        total += size
    if start < len(rows):
        yield rows[start:]
