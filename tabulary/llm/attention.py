"""Quality of documents by attention over their passages (multiple-instance learning).

A document is a bag of passages of ``WORDS`` words; only the document has a label. Every passage is
encoded from its characters and words: a vector of frequencies goes through one learned layer. Gated
attention, a product of a tanh and a sigmoid of the encoding, gives each passage a weight within
its document, so that the passages that tell most about the label count most; the weighted mean of the
encodings is the document's representation, and its logistic score is the probability of label 1.
Encoder, attention and score are learned together from document labels alone.

Training takes at most ``SAMPLE`` labelled documents, the first by a hash of their id. A longer text has
longer passages, ``MOST`` at most, which cover all of it: so a sampled document has a bounded size,
and the fit, done on the driver, too. Texts are read in blocks of ``BLOCK`` bytes.

A null text is empty. A text without words is one passage without any frequency, which is scored like
all others. Null labels and ids teach nothing; an id with several labels has that of the majority
(ties: 1), one with several texts teaches one of them. Without labels all scores are 0.5. Repeated rows
are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.llm.words import block_words

WORDS = 48
MOST = 64
BLOCK = 1 << 20
#: Labelled documents that are learned from at most.
SAMPLE = 4000
#: Width of the encoding and of the attention; steps of the fit; documents a step.
HIDDEN = 32
GATES = 16
STEPS = 900
STEP = 32
RATE = 3e-3
DECAY = 1e-4
SEED = 13
#: A document is predicted to have label 1 from this score on.
LEAST = 0.3

#: Slots of a word's hash, and of pairs of neighbouring characters by kind.
_SLOTS = 64
_KINDS = 16


def _kinds() -> np.ndarray:
    """The kind of each byte: letters, digits, white space, and groups of punctuation."""
    out = np.full(256, 15, np.int32)
    groups = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t",
              ".", ",;:", "!?", "'\"`", "-_", "()[]{}<>", "|/\\", "#$%&*@~^+=")
    for kind, group in enumerate(groups):
        out[list(group.encode())] = kind
    out[128:] = 14
    return out


_KIND = _kinds()
_OTHER = 5
FEATURES = _KINDS * _KINDS + _SLOTS + _OTHER


def _cut(data: bytes) -> list[bytes]:
    """A text in blocks that cut no word."""
    out, at = [], 0
    while len(data) - at > BLOCK:
        to = max(data.rfind(b" ", at, at + BLOCK), data.rfind(b"\n", at, at + BLOCK))
        if to <= at:  # a word as long as a block: on to its end
            ends = [e for e in (data.find(b" ", at + BLOCK), data.find(b"\n", at + BLOCK)) if e >= 0]
            to = min(ends, default=len(data))
        out.append(data[at:to])
        at = to
    return [*out, data[at:]]


def _block_counts(data: bytes, rank: int, width: int, out: np.ndarray) -> None:
    """Add what a block holds to the counts of its document's passages; ``rank`` words are before it."""
    raw = np.frombuffer(data, np.uint8)
    starts, hashes = block_words(raw)
    if not len(starts):
        return
    passage = (rank + np.arange(len(starts))) // width
    kind = _KIND[raw[starts[0]:]]
    length = np.diff(starts, append=len(raw))
    owner = np.repeat(passage.astype(np.int32), length)
    pairs = _KINDS * _KINDS
    size = len(out)
    pair = owner[1:] * pairs + kind[:-1] * _KINDS + kind[1:]
    out[:, :pairs] += np.bincount(pair, minlength=size * pairs).reshape(size, pairs)
    slot = (hashes % np.uint64(_SLOTS)).astype(np.int64)
    out[:, pairs : pairs + _SLOTS] += np.bincount(passage * _SLOTS + slot, minlength=size * _SLOTS).reshape(size, _SLOTS)
    other = out[:, pairs + _SLOTS :]
    other[:, 0] += np.bincount(passage, minlength=size)
    same = passage[1:][hashes[1:] == hashes[:-1]]
    other[:, 1] += np.bincount(same, minlength=size)
    order = np.lexsort((hashes, passage))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (passage[order[1:]] != passage[order[:-1]])
    other[:, 2] += np.bincount(passage[order[new]], minlength=size)
    other[:, 3] += np.bincount(owner, minlength=size)
    other[:, 4] += np.bincount(owner, kind >= 14, minlength=size)


def passages(text: str | None) -> np.ndarray:
    """The features of a text's passages, a row each and one at least."""
    blocks = _cut((text or "").encode("utf-8", "surrogatepass"))
    counts = [len(b.split()) if len(blocks) > 1 else 0 for b in blocks]
    words = sum(counts) if len(blocks) > 1 else len(blocks[0].split())
    width = max(WORDS, -(-words // MOST))
    out = np.zeros((max(1, -(-words // width)), FEATURES))
    rank = 0
    for block, n in zip(blocks, counts, strict=True):
        _block_counts(block, rank, width, out)
        rank += n
    pairs = _KINDS * _KINDS
    for part in (out[:, :pairs], out[:, pairs : pairs + _SLOTS]):
        np.sqrt(part / np.maximum(part.sum(axis=1, keepdims=True), 1), out=part)
    n, repeated, different, size, odd = out[:, pairs + _SLOTS :].T.copy()
    some = np.maximum(n, 1)
    out[:, pairs + _SLOTS :] = np.column_stack(
        [np.log1p(n) / 8, repeated / some, different / some, np.minimum(size / some / 16, 2), odd / np.maximum(size, 1)]
    )
    return out.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Model:
    """Encoder (w, b), gates (tanh: v, bv; sigmoid: u, bu), attention (a), score (c, d)."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.weights
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"] + p["bv"]), _sigmoid(h @ p["u"] + p["bu"])
        e = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(x)))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        share = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(share[:, None] * h, starts)
        return h, t, g, bag, share, z, _sigmoid(z @ p["c"] + p["d"])

    def scores(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each document, and the weight of each passage within its document."""
        if not self.weights:
            size = np.diff(starts, append=len(x))
            return np.full(len(starts), 0.5), np.repeat(1 / size, size)
        *_, share, _, score = self._forward(x, starts)
        return score.astype(float), share.astype(float)

    def gradients(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of some documents, by back-propagation."""
        p = self.weights
        h, t, g, bag, share, z, score = self._forward(x, starts)
        out = ((score - label) / len(label)).astype(np.float32)
        dz = out[:, None] * p["c"]
        dshare = (h * dz[bag]).sum(axis=1)
        de = share * (dshare - np.add.reduceat(share * dshare, starts)[bag])
        dgate = de[:, None] * p["a"]
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        dh = share[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T
        dh *= 1 - h * h
        return {
            "w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "bv": dt.sum(axis=0), "u": h.T @ dg,
            "bu": dg.sum(axis=0), "a": (t * g).T @ de, "c": z.T @ out, "d": out.sum(keepdims=True),
        }


def fit(bags: Sequence[np.ndarray], labels: Sequence[int], steps: int = STEPS, seed: int = SEED) -> Model:
    """A model of documents, given as their passages' features, by Adam on the log loss."""
    if not bags:
        return Model()
    random = np.random.default_rng(seed)
    shapes = {"w": (FEATURES, HIDDEN), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "a": (GATES,), "c": (HIDDEN,)}
    p = {n: (random.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) for n, s in shapes.items()}
    # so a wide layer of small frequencies starts with encodings that differ
    p["w"] *= 8
    share = np.clip(np.mean(labels), 0.01, 0.99)
    p |= {"b": np.zeros(HIDDEN, np.float32), "bv": np.zeros(GATES, np.float32), "bu": np.zeros(GATES, np.float32)}
    p["d"] = np.array([np.log(share / (1 - share))], np.float32)
    model = Model(p)
    mean = {n: np.zeros_like(x) for n, x in p.items()}
    power = {n: np.zeros_like(x) for n, x in p.items()}
    target = np.asarray(labels, np.float32)
    order = np.empty(0, np.int64)
    for turn in range(1, steps + 1):
        if not len(order):
            order = random.permutation(len(bags))
        some, order = order[:STEP], order[STEP:]
        rate = RATE * (1 - turn / steps) + RATE / 20
        starts = np.cumsum([0, *[len(bags[i]) for i in some[:-1]]])
        grad = model.gradients(np.concatenate([bags[i] for i in some]).astype(np.float32), starts, target[some])
        for n, x in p.items():
            step = grad[n] + DECAY * x
            mean[n] += 0.1 * (step - mean[n])
            power[n] += 0.001 * (step * step - power[n])
            x -= rate * (mean[n] / (1 - 0.9**turn)) / (np.sqrt(power[n] / (1 - 0.999**turn)) + 1e-8)
    return model


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows, the first by a hash of their unique id.

    Most rows are left out by a bound on the hash before any is sorted.
    """
    n = labelled.count()
    share = min(1.0, (sample + 8 * sample**0.5 + 64) / max(n, 1))
    place = F.xxhash64("id")
    few = labelled.filter(place <= min(int(share * 2.0**64), 2**64 - 1) - 2**63)
    return few.orderBy(place, "id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label), at most ``sample`` documents."""
    labelled = labels.filter("doc_id is not null and label is not null").groupBy(
        F.col("doc_id").cast("long").alias("id")
    ).agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    # labels without a document would use up the sample
    here = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"))
    ids = _sampled(labelled.join(here, "id", "left_semi"), sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # the sample is bounded, so its ids can go everywhere; of a repeated id one text is taken
    chosen = texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [passages(t.as_py()).astype(np.float16).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())],
                                             names=["id", "label", "bag"])

    rows = chosen.mapInArrow(run, "id long, label int, bag binary").toArrow().sort_by("id")
    bags = [np.frombuffer(b.as_buffer(), np.float16).reshape(-1, FEATURES) for b in rows.column("bag")]
    return fit(bags, rows.column("label").to_pylist(), steps)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``n_passages`` and the passages' ``attention``, from the text alone."""
    added = {"score": pa.float64(), "n_passages": pa.int64(), "attention": pa.list_(pa.float64())}
    for name in added:
        if name in docs.columns:
            raise ValueError(f"the table already has a column {name}")
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)  # a fixed number of weights
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(shared.value)
        for batch in batches:
            scores: list[float] = []
            weights: list[np.ndarray] = []
            held: list[np.ndarray] = []
            for i, value in enumerate(batch.column(at)):
                held.append(passages(value.as_py()))
                if len(held) == 256 or i + 1 == batch.num_rows:
                    starts = np.cumsum([0, *[len(h) for h in held[:-1]]])
                    s, w = known.scores(np.concatenate(held), starts)
                    scores += np.round(s, 6).tolist()
                    weights += np.split(w, starts[1:])
                    held = []
            size = [len(w) for w in weights]
            made = [pa.array(scores, pa.float64()), pa.array(size, pa.int64()), pa.array(weights, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *added])

    empty = [F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_passages"), F.array(F.lit(0.0)).alias("attention")]
    return docs.mapInArrow(run, docs.select("*", *empty).schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold kept from training; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
