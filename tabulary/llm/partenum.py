"""Exact Jaccard similarity join of documents on word shingles, by PartEnum signatures.

A document's set is its distinct shingles, as 64-bit hashes. Two sets of sizes a <= b whose
Jaccard similarity is at least t differ in at most k = floor((a + b)(1 - t)/(1 + t)) elements.
Sets meet in size bands [2^j, 2^(j+1)): every set signs for its own band and, if a similar larger
set may lie in the next one, for that band too. In a band the hash domain is cut into partitions
of equal length, as two-level PartEnum with n2 = 2 and k2 = 1: floor(k/2) + 1 or more first-level
partitions, each cut in two, and of the two halves every subset of one signs. More subsets would
make a signature more selective, but the number of signatures grows with them.

A signature is a hash of the elements in one such half. Halves without elements are not signed,
since an empty half says nothing. The guarantee then needs k + 1 halves *with* elements: a set
signs its first k + 1 non-empty halves. Of two similar sets take the one whose k + 1st such half
comes first: the k differences leave one of these halves alone, the other set has the same
elements there and signs it as well. A set with fewer non-empty halves signs them all and also
signs for a domain cut twice as fine, and so on until it has enough; two sets that both go on
meet at the finer cut.

Candidates are never listed as all pairs of a signature's documents. The smallest node that has a
signature leads it; the nodes of a leader are compared in blocks. Two that share a signature are
candidates if they pass two exact tests: sizes within a factor t, and at most k differences
between sketches, bit sets that cannot differ in more places than the sets themselves. First each node's nearest candidate
is verified on the sets themselves, and components are built; then all candidates that are still in
different components, nearest first, until links found connect them. Exact copies are one node
throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.llm.components import connected_components
from tabulary.llm.words import mix, shingle_hashes, text_groups
from tabulary.session import ensure_checkpoint_dir

#: Words of a shingle; least similarity in percent.
WIDTH = 5
PERCENT = 75
#: Bits of a sketch for each element of its set, at least.
BITS = 3
#: Documents of one leader that one task compares with each other at most, or so.
CHUNK = 2048
#: Candidates of a document that a task names, nearest first; all are tested in the end.
NEAREST = 3
#: Pairs that a worker writes down at a time; a task with more marks them in a table.
PAIRS = 1 << 19
#: Rows of that table held at a time.
BLOCK_ROWS = 256
#: Bytes of text whose signatures go into one row for each part.
SIGNED_BYTES = 1 << 22
#: Ids that are sent to all tasks at most; more of them are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000


def _sets(texts: list, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text."""
    hashes, offsets = shingle_hashes(texts, width)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        one = np.sort(hashes[a:b])
        out.append(one[np.diff(one, prepend=one[:1] + np.uint64(1)) != 0] if b > a else one)
    return out


def _node(one: np.ndarray) -> int:
    """A 64-bit name of a set. Among n distinct sets about n^2 / 2^65 pairs share a name."""
    total = (int(mix(one).sum(dtype=np.uint64)) * 2862933555777941757 + len(one) * 3037000493) % (1 << 64)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _most_differences(size: np.ndarray, percent: int) -> np.ndarray:
    """The largest possible distance of a set of this size and any set similar to it."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


def set_signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of all sets; empty sets have none."""
    sizes = np.array([len(s) for s in sets], np.int64)
    index = np.flatnonzero(sizes)
    band = np.frexp(sizes[index].astype(float))[1]  # the size lies in [2^(band-1), 2^band)
    beyond = sizes[index] * 100 // percent >= 1 << band
    index = np.concatenate([index, index[beyond]])
    band = np.concatenate([band, band[beyond] + 1])
    level = 0
    made, owners = [], []
    flat = [np.asarray(s, np.uint64) for s in sets]
    while len(index):
        size = sizes[index]
        k = _most_differences(size, percent)
        largest = (1 << band.astype(np.int64)) - 1
        first_level = (_most_differences(largest, percent) * 3) // 5 + 1
        halves = (2 * first_level).astype(np.uint64) << np.uint64(level)
        row = np.repeat(np.arange(len(index)), size)
        element = np.concatenate([flat[i] for i in index])
        # the finest cut has each element in a part of its own
        half = np.where(
            halves[row] < 1 << 31,
            _times_high(element, np.minimum(halves[row], np.uint64(1 << 31))),
            element,
        )
        start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(half, prepend=0) != 0))
        content = np.add.reduceat(mix(element ^ np.uint64(0xA5A5A5A55A5A5A5A)), start)
        run_row = row[start]
        first_run = np.searchsorted(run_row, np.arange(len(index)))
        rank = np.arange(len(start)) - first_run[run_row]
        occupied = np.diff(np.append(first_run, len(start)))
        signs = rank <= k[run_row]
        place = (band[run_row].astype(np.uint64) << np.uint64(8)) + np.uint64(level)
        made.append(mix(content + mix(half[start] * np.uint64(0x100000001B3) + place))[signs])
        owners.append(index[run_row][signs])
        short = (occupied <= k) & (halves < 1 << 31)
        index, band, level = index[short], band[short], level + 1
    if not made:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(made), np.concatenate(owners)


def _times_high(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """floor(x * n / 2^64), for n below 2^32."""
    low = (x & np.uint64(0xFFFFFFFF)) * n
    return ((x >> np.uint64(32)) * n + (low >> np.uint64(32))) >> np.uint64(32)


def _sketch(one: np.ndarray) -> bytes:
    """For each of 2^m ranges of hashes, modulo 2^m, whether it holds an odd number of elements.

    An element that only one of two sets has flips one bit, so two sets are at least as far
    apart as their sketches. 2^m is ``BITS`` times the size or more, 64 at least. Folding a
    sketch's halves onto each other gives the sketch of half the length.
    """
    bits = 1 << max(6, int(BITS * len(one) - 1).bit_length())
    odd = np.bincount((one & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _set_rows(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """What :func:`shingle_sets` gives of batches (doc_id, text_hash, text)."""
    met: set[int] = set()
    for batch in batches:
        for some in text_groups(batch.column(2)):
            ids, text_hashes, texts = (c[some] for c in batch.columns)
            sets = _sets(texts.to_pylist(), width)
            nodes = [_node(s) if len(s) else None for s in sets]
            sketches: list[bytes | None] = []
            for node, one in zip(nodes, sets, strict=True):
                fresh = node is not None and node not in met
                sketches.append(_sketch(one) if fresh else None)
                if fresh:
                    met.add(node)
            if len(met) > 1 << 20:
                met.clear()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids,
                    "text_hash": text_hashes,
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array(nodes, pa.int64()),
                    "sketch": pa.array(sketches, pa.binary()),
                }
            )


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, n_shingles, node and sketch of its set.

    Rows without shingles have no node. Only the first of equal sets in a task has a sketch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _set_rows(batches, width)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, node long, sketch binary"
    )


def _signed_rows(
    batches: Iterable[pa.RecordBatch], width: int, percent: int, parts: int
) -> Iterator[pa.RecordBatch]:
    """The signatures of batches (text), packed by part.

    Sets are built for a few texts at a time; what goes into one row comes from more of them,
    since rows with few signatures would cost more to shuffle.
    """
    met: set[int] = set()
    for batch in batches:
        for group in text_groups(batch.column(0), SIGNED_BYTES):
            texts = batch.column(0)[group]
            nodes: list[int] = []
            signatures, owners = [], []
            for some in text_groups(texts):
                fresh, first = [], len(nodes)
                for one in _sets(texts[some].to_pylist(), width):
                    if len(one) and (node := _node(one)) not in met:
                        met.add(node)
                        fresh.append(one)
                        nodes.append(node)
                signature, owner = set_signatures(fresh, percent)
                signatures.append(signature)
                owners.append(owner + first)
            if len(met) > 1 << 20:
                met.clear()
            if not nodes:
                continue
            signature, owner = np.concatenate(signatures), np.concatenate(owners)
            part = (signature % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            signature, owner, part = signature[order], owner[order], part[order]
            names = np.array(nodes, np.int64)
            start = np.flatnonzero(np.diff(part, prepend=-1))
            rows: dict[str, list] = {"part": [], "signatures": [], "owners": [], "nodes": []}
            for a, b in zip(start, np.append(start[1:], len(part)), strict=True):
                used, own = np.unique(owner[a:b], return_inverse=True)
                rows["part"].append(int(part[a]))
                rows["signatures"].append(signature[a:b].tobytes())
                rows["owners"].append(own.astype(np.uint32).tobytes())
                rows["nodes"].append(names[used].tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(rows["part"], pa.int32()),
                    **{c: pa.array(rows[c], pa.binary()) for c in ("signatures", "owners", "nodes")},
                }
            )


def _shared_signatures(docs: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """(leader, node, signatures): the signatures that two or more different sets have.

    The leader of a signature is the smallest node that has it; a leader is listed with itself
    as node. Signatures travel packed: a group of documents gives one row per part, with its
    signatures, the owner of each, and the nodes of these owners. A task sends each set once.
    """

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _signed_rows(batches, width, percent, parts)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names = [], []
        for batch in batches:
            for s, o, n in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                keys.append(np.frombuffer(s, np.uint64))
                names.append(np.frombuffer(n, np.int64)[np.frombuffer(o, np.uint32)])
        if not keys:
            return
        key, name = np.concatenate(keys), np.concatenate(names)
        del keys, names
        order = np.argsort(key)
        key = key[order]
        again = key[1:] == key[:-1]
        often = np.zeros(len(key), bool)
        often[1:] |= again
        often[:-1] |= again
        key, name = key[often], name[order[often]]
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name = key[fresh], name[fresh]
        start = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))
        length = np.diff(np.append(start, len(key)))
        leader = np.repeat(name[start], length)
        many = np.repeat(length > 1, length)
        key, leader, name = key[many].view(np.int64), leader[many], name[many]
        order = np.lexsort((name, leader))
        key, leader, name = key[order], leader[order], name[order]
        first = (np.diff(leader, prepend=0) != 0) | (np.diff(name, prepend=0) != 0)
        first[:1] = True
        start = np.flatnonzero(first)
        for a in range(0, len(start), 1 << 14):
            some = start[a : a + (1 << 14)]
            end = start[a + (1 << 14)] if a + (1 << 14) < len(start) else len(key)
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(some, end) - some[0], pa.int32()), pa.array(key[some[0] : end])
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(leader[some]), pa.array(name[some]), lists],
                names=["leader", "node", "signatures"],
            )

    signed = docs.select("text").mapInArrow(
        sign, "part int, signatures binary, owners binary, nodes binary"
    )
    met = signed.repartitionById(parts, "part").mapInArrow(
        meet, "leader long, node long, signatures array<long>"
    )
    return met.groupBy("leader", "node").agg(F.flatten(F.collect_list("signatures")).alias("signatures"))


def _sets_of(nodes: DataFrame, docs: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """(node, items): the sets of the given nodes, from the text of one row of each."""
    ids = known.join(nodes.distinct(), "node").select("doc_id").distinct().checkpoint()
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = texts.join(few, texts.doc_id.eqNullSafe(few.doc_id), "left_semi").select("text")

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_groups(batch.column(0)):
                sets = [s for s in _sets(batch.column(0)[some].to_pylist(), width) if len(s)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array([_node(s) for s in sets], pa.int64()),
                        "items": pa.array([s.tobytes() for s in sets], pa.binary()),
                    }
                )

    built = wanted.mapInArrow(build, "node long, items binary")
    return built.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.max("items").alias("items"))


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar, exactly."""
    if len(one) > len(two):
        one, two = two, one
    at = np.searchsorted(two, one)
    both = int((two[np.minimum(at, len(two) - 1)] == one).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are similar."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))
    sets = _sets_of(nodes, docs, known, width).checkpoint()
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v").join(
        sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u"
    )

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # views of the batch: no set is copied
            keep = [
                _similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), percent)
                for pair in zip(batch.column("a"), batch.column("b"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v")], names=["u", "v"]
            ).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(test, "u long, v long")


class _Sketches:
    """Sketches of different lengths, as 64-bit words one after another."""

    def __init__(self, sketches: pa.BinaryArray):
        data = [s.as_py() for s in sketches]
        self.length = np.array([len(d) // 8 for d in data], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.words = np.frombuffer(b"".join(data), np.uint64)

    def _rows(self, index: np.ndarray, length: int, width: int) -> np.ndarray:
        rows = self.words[self.start[index][:, None] + np.arange(length)]
        while length > width:  # fold a longer sketch
            length //= 2
            rows = rows[:, :length] ^ rows[:, length:]
        return rows

    def distances(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """In how many places the sketches of each pair differ, at the shorter one's length."""
        out = np.zeros(len(one), np.int64)
        if not len(one):
            return out
        kind = self.length[one] * (1 << 32) + self.length[two]
        order = np.argsort(kind, kind="stable")
        start = np.flatnonzero(np.diff(kind[order], prepend=-1))
        for a, b in zip(start, np.append(start[1:], len(order)), strict=True):
            la, lb = int(self.length[one[order[a]]]), int(self.length[two[order[a]]])
            width = min(la, lb)
            block = max(1, (1 << 18) // max(la, lb))
            for k in range(a, b, block):
                some = order[k : min(b, k + block)]
                differ = self._rows(one[some], la, width) ^ self._rows(two[some], lb, width)
                out[some] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        return out


class _Rows:
    """Rows of whole tasks, and the places at which they have signatures, by task and signature."""

    def __init__(self, rows: pa.Table):
        self.lo, self.hi, self.chunk, self.label, self.size = (
            rows.column(c).to_numpy().astype(np.int64)
            for c in ("lo", "hi", "chunk", "component", "n_shingles")
        )
        self.task = _task_numbers(rows)
        lists = rows.column("signatures").combine_chunks()
        owner = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
        key = lists.flatten().to_numpy()
        order = np.lexsort((owner, key, self.task[owner]))
        key, self.owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (self.task[self.owner[1:]] != self.task[self.owner[:-1]])
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(key))
        # partners behind each place
        self.after = np.repeat(self.end, self.end - self.start) - np.arange(len(key)) - 1
        self.sketches = _Sketches(rows.column("sketch").combine_chunks())

    def written(self, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of rows that share a signature at the given places, once."""
        after = self.after[at:to]
        first = np.repeat(np.arange(at, to), after)
        step = np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after) + 1
        pair = np.unique(self.owner[first] * len(self.size) + self.owner[first + step])
        return pair // len(self.size), pair % len(self.size)

    def marked(self, at: int, to: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for one task with many pairs, by blocks of a table of its rows by its rows."""
        runs = np.arange(np.searchsorted(self.start, at), np.searchsorted(self.start, to))
        low, high = int(self.owner[at:to].min()), int(self.owner[at:to].max()) + 1
        for a in range(low, high, BLOCK_ROWS):
            shares = np.zeros((min(BLOCK_ROWS, high - a), high - low), bool)
            for r in runs:
                own = self.owner[self.start[r] : self.end[r]]
                inside = own[np.searchsorted(own, a) : np.searchsorted(own, a + BLOCK_ROWS)]
                if len(inside):
                    shares[np.ix_(inside - a, own - low)] = True
            shares &= np.arange(low, high) > np.arange(a, a + len(shares))[:, None]
            u, v = np.nonzero(shares)
            yield u + a, v + low

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs that share a signature; each pair is in one block."""
        if not len(self.owner):
            return
        task = self.task[self.owner]
        first = np.flatnonzero(np.diff(task, prepend=-1))  # the places where tasks begin
        total = np.concatenate([[0], np.cumsum(self.after)])
        ends = np.append(first[1:], len(task))
        at = 0
        while at < len(first):
            begin = first[at]
            to = int(np.searchsorted(total[ends], total[begin] + PAIRS, side="right"))
            if to > at:
                yield self.written(begin, ends[to - 1])
                at = to
            else:
                yield from self.marked(begin, ends[at])
                at += 1


def _candidates(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows that may be similar, each once, with a lower bound of their relative distance.

    They are rows of one task (leader, lo, hi), share a signature, lie in different chunks if the
    task has two, and are not known to be in one component.
    """
    own = _Rows(rows)
    size, label = own.size, own.label
    for u, v in own.pairs():
        small, large = np.minimum(size[u], size[v]), np.maximum(size[u], size[v])
        keep = (label[u] != label[v]) & (100 * small >= percent * large)
        keep &= (own.lo[u] == own.hi[u]) | (own.chunk[u] != own.chunk[v])
        u, v = u[keep], v[keep]
        apart = own.sketches.distances(u, v)
        both = size[u] + size[v]
        close = apart <= both * (100 - percent) // (100 + percent)
        if close.any():
            yield u[close], v[close], apart[close] / both[close]


def _nearest(one: np.ndarray, two: np.ndarray, apart: np.ndarray) -> tuple:
    """Of each row in ``one`` the nearest partners, in order, ``NEAREST`` at most."""
    order = np.lexsort((two, apart, one))
    one, two, apart = one[order], two[order], apart[order]
    start = np.flatnonzero(np.diff(one, prepend=-1))
    first = np.arange(len(one)) - np.repeat(start, np.diff(np.append(start, len(one)))) < NEAREST
    return one[first], two[first], apart[first]


def _task_numbers(rows: pa.Table) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    for c in ("leader", "lo", "hi"):
        values = rows.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _by_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows in tables that cut no (leader, lo, hi)."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        task = _task_numbers(rows)
        cut = int(np.searchsorted(task, task[-1]))
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        held = rows.slice(cut)
    if held is not None:
        yield held.combine_chunks()


_ROW = (
    "leader long, lo int, hi int, chunk int, node long, component long, n_shingles long, "
    "sketch binary, signatures array<long>"
)
_COLUMNS = [f.split()[0] for f in _ROW.split(", ")]


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi", "node")


def _dealt(shared: DataFrame, known: DataFrame) -> DataFrame:
    """The nodes of each leader, in chunks of which every two meet once.

    A set and its sketch travel once for each leader it has, and no task holds more than two
    chunks of a leader or so.
    """
    sizes = shared.groupBy("leader").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    return _together(
        shared.join(sizes.checkpoint(), "leader")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("lo", F.least("chunk", "other"))
        .withColumn("hi", F.greatest("chunk", "other"))
        .withColumn("component", F.col("node"))
        .join(known.select("node", "n_shingles", "sketch"), "node")
        .select(*_COLUMNS)
    )


def _involved(rows: DataFrame, percent: int) -> DataFrame:
    """Only the rows that have a candidate in their task, with the nearest ones as ``near``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_task(batches):
            found = [
                _nearest(np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([apart, apart]))
                for u, v, apart in _candidates(group, percent)
            ]
            if not found:
                continue
            one, two, apart = _nearest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            start = np.flatnonzero(np.diff(one, prepend=-1))
            near = pa.StructArray.from_arrays(
                [pa.array(apart), pa.array(group.column("node").to_numpy()[two])], names=["apart", "other"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(one)), pa.int32()), near)
            kept = group.take(pa.array(one[start])).append_column("near", lists)
            yield from kept.to_batches()

    return rows.mapInArrow(run, f"{_ROW}, near array<struct<apart:double,other:long>>")


def _links_within(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between rows of a task that were not known to be in one component.

    ``rows`` carry their sets. Nearest candidates are tested first, and two rows that links
    found so far connect are not tested again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (above := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(above, above)
            return x

        for group in _by_task(batches):
            root.clear()
            node, label = (group.column(c).to_pylist() for c in ("node", "component"))
            items = group.column("items")
            links: dict[str, list[int]] = {"u": [], "v": []}
            for u, v, bound in _candidates(group, percent):
                for k in np.argsort(bound, kind="stable"):
                    one, two = int(u[k]), int(v[k])
                    a, b = find(label[one]), find(label[two])
                    if a != b and _similar(
                        np.frombuffer(items[one].as_buffer(), np.uint64),
                        np.frombuffer(items[two].as_buffer(), np.uint64), percent,
                    ):
                        root[a] = b
                        links["u"].append(node[one])
                        links["v"].append(node[two])
            if links["u"]:
                yield pa.RecordBatch.from_pydict(links)

    return rows.mapInArrow(run, "u long, v long")


def _all_links(
    shared: DataFrame, docs: DataFrame, known: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links that connect all nodes that links connect; of a component's links enough, not all."""
    involved = _involved(_dealt(shared, known), percent).checkpoint()
    nearest = (
        involved.select("node", F.explode("near").alias("n"))
        .groupBy("node", "n.other").agg(F.min("n.apart").alias("apart"))
        .groupBy("node").agg(F.min_by("other", F.struct("apart", "other")).alias("other"))
        .select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"))
        .distinct().checkpoint()
    )
    near = _verified(nearest, docs, known, width, percent).checkpoint()
    labels = connected_components(near).checkpoint()
    labelled = (
        involved.drop("component", "near").join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node")).select(*_COLUMNS)
    )
    open_ = _involved(_together(labelled), percent).drop("near").checkpoint()
    sets = _sets_of(open_.select("node"), docs, known, width)
    far = _links_within(_together(open_.join(sets, "node").select(*_COLUMNS, "items")), percent)
    return near.union(far)


def jaccard_components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, parts: int | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id, group and text_hash of every row of ``docs`` (doc_id, text).

    Two rows link when 100 * |A and B| >= percent * |A or B| for their shingle sets; a text with
    fewer words than ``width`` has its whole word sequence as its one shingle. A null or wordless
    text has the empty set and links with nothing. ``component_id`` is the smallest doc_id that
    can be reached by links, itself included; ids that are null count only where there is no
    other. ``group`` names the component, also where ids repeat; it is null for empty sets.
    ``text_hash`` is xxhash64 of the text. Repeated rows each give a row. Other columns of ``docs`` are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    rows = shingle_sets(docs, width).checkpoint()
    known = (
        rows.filter("node is not null")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.max("sketch").alias("sketch"),
        )
        .checkpoint()
    )
    shared = _shared_signatures(docs, width, percent, parts).checkpoint()
    labels = connected_components(_all_links(shared, docs, known, width, percent)).checkpoint()
    ids = known.select("node", "doc_id").join(labels, "node")
    named = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = ids.join(named, "component").select("node", "component", "component_id")
    of_node = (
        known.select("node", "doc_id")
        .join(linked, "node", "left")
        .select(
            "node",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce("component", "node").alias("group"),
        )
        .checkpoint()
    )
    return rows.select("doc_id", "text_hash", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "group",
        "text_hash",
    )
