"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of the byte
that followed. A byte seen in the longest known context costs -log2(n / (T + q)) bits there (T
bytes seen, q of them different); any other byte costs the escape, -log2(q / (T + q)), and is then
looked up in the next shorter context, down to a uniform choice. Statistics are frozen after
training, so these code lengths are exact sums and need no state: the language with the shortest
code wins. However badly a text fits, one language stands out when it is long enough; whether it
fits at all is told by the code lengths themselves. Each word is read in the language that fits it
best, against that language's limit: ``FIT`` times the bits per byte of its own documents that
training has not seen. So texts in two learned languages fit, and those in others do not.

The trees share their nodes, and all code lengths are tabulated per node and byte, so texts are
scored by array lookups. Texts are read in lower case, with runs of ASCII bytes that are not
letters as one space. Training takes at most ``SAMPLE`` documents of a language, whole, the first by
a hash of their id; the trees keep at most ``NODES`` contexts, the most frequent ones, and fewer
where that many would take more than ``MODEL_BYTES`` for all languages. Every label is learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulary.llm.words import text_groups
from tabulary.session import ensure_checkpoint_dir, local_frame

#: Bytes of the longest context; documents of a language read in training; contexts kept.
ORDER = 3
SAMPLE = 400
NODES = 12_000
#: Bytes of code lengths at most; with many languages fewer contexts are kept.
MODEL_BYTES = 1 << 26
#: Sampled ids that are sent to all tasks at most; more are joined by a shuffle.
SENT_IDS = 1 << 18
#: A text may cost so many times the bits per byte that are usual in its language.
FIT = 2.0
#: What counts as usual at least and at most: fewer bits come from repeated texts alone, and twice
#: as many as the last are nearly the 8 bits of a uniform choice.
USUAL = (1.5, 3.5)
#: A text may have so many bytes more at the limit, so that one odd word in a short text is no fault.
ODD_BYTES = 4
#: Words with digits (keys, numbers) are left out of a text that does not fit, if so much remains.
WORDS_LEFT = 0.25

#: Bytes of text that are taken together, and walked at a time; a longer word counts as several.
GROUP_BYTES = 1 << 18
WALK_BYTES = 1 << 17

#: From a word's start on only, so that a long word is read once.
_WITH_DIGITS = re.compile(r"(?<!\S)[^\s\d]*+\d\S*+")
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def _prepared(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, ORDER spaces before each, and where each text starts."""
    pieces, starts, at = [], [], 0
    gap = np.full(ORDER, 32, np.uint8)
    for text in texts:
        raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
        plain = _PLAIN[raw]
        space = plain == 32
        space[1:] &= space[:-1]
        if len(space):
            space[0] = plain[0] == 32
        plain = plain[~space]
        pieces += [gap, plain]
        starts.append(at + ORDER)
        at += ORDER + len(plain)
    return (np.concatenate(pieces) if pieces else np.empty(0, np.uint8)), np.array([*starts, at + ORDER])


def _grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences of ORDER + 1 bytes that end within a text, as numbers, with their counts."""
    data, starts = _prepared(texts)
    wide = data.astype(np.int64)
    number = np.zeros(len(wide), np.int64)
    for back in range(ORDER + 1):
        number[back:] += wide[: len(wide) - back] << (8 * back)
    inside = np.ones(len(wide), bool)
    for start in starts[:-1]:
        inside[start - ORDER : start] = False
    return np.unique(number[inside], return_counts=True)


@dataclass(frozen=True)
class Model:
    """Tabulated trees: node 0 is the empty context, node ``dead`` stands for an unknown one."""

    languages: tuple[str, ...]
    symbol: np.ndarray  # byte -> symbol
    child: np.ndarray  # (node, symbol before the context) -> longer context or dead
    bits: np.ndarray  # (language, node, symbol) -> code length

    def _cells(self, data: np.ndarray) -> np.ndarray:
        """Where each byte's code lengths are tabulated."""
        s = self.symbol[data].astype(np.int32)
        dead = len(self.child) - 1
        width = self.child.shape[1]
        child = self.child.reshape(-1)
        context = np.zeros(len(s), np.int32)
        deepest = context
        for back in range(1, ORDER + 1):
            cell = deepest * np.int32(width)
            cell[back:] += s[: max(len(s) - back, 0)]
            deepest = child.take(cell)
            context = np.where(deepest == dead, context, deepest)
        return context * np.int32(width) + s

    def _walk(
        self, texts: Sequence[str | None], limits: Sequence[float] | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each text under each language, bits by limit with each word in its best language,
        and bytes of each text, from one walk over the words."""
        data, starts = _prepared(texts)
        size = np.diff(starts) - ORDER
        bits, share = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        first = np.zeros(len(data), bool)
        first[1:] = (data[1:] != 32) & (data[:-1] == 32)
        first[starts[:-1][starts[:-1] < len(data)]] = True
        first[:1] = True
        word = np.flatnonzero(first)
        length = np.diff(word, append=len(data))
        wide = np.flatnonzero(length > WALK_BYTES)
        cuts = [np.arange(word[i] + WALK_BYTES, word[i] + length[i], WALK_BYTES) for i in wide]
        word = np.sort(np.concatenate([word, *cuts]))
        # the spaces before each text cost nothing
        gap = np.zeros(len(data), bool)
        for back in range(1, ORDER + 1):
            gap[starts[:-1] - back] = True
        owner = np.maximum(np.searchsorted(starts[:-1], word, side="right") - 1, 0)
        at = 0
        while at < len(word):
            to = max(at + 1, int(np.searchsorted(word, word[at] + WALK_BYTES)))
            a, b = int(word[at]), int(word[to]) if to < len(word) else len(data)
            before = min(a, ORDER)
            cell = self._cells(data[a - before : b])[before:]
            silent = np.flatnonzero(gap[a:b])
            some, whose = word[at:to] - a, owner[at:to]
            low = whose[0]
            best = np.full(len(some), np.inf)
            for k in range(len(self.languages)):
                cost = self.bits[k].reshape(-1).take(cell).astype(np.float64)
                cost[silent] = 0.0
                of_word = np.add.reduceat(cost, some)
                summed = np.bincount(whose - low, of_word)
                bits[low : low + len(summed), k] += summed
                if limits is not None:
                    np.minimum(best, of_word / limits[k], out=best)
            if limits is not None:
                summed = np.bincount(whose - low, best)
                share[low : low + len(summed)] += summed
            at = to
        return bits, share / (size + ODD_BYTES), size

    def code_lengths(self, texts: Sequence[str | None]) -> np.ndarray:
        """Bits of each text under each language, a row per text."""
        return self._walk(texts)[0]

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its share of the probability under equal priors.

        A text that is null or has no letter, and any text if nothing was learned, is ``und``
        with score 0. Equal code lengths go to the language that comes first by name.
        """
        return self.judge(texts)[:2]

    def judge(
        self, texts: Sequence[str | None], limits: Sequence[float] | None = None
    ) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What :meth:`predict` and, with limits, :meth:`fits` give, from one walk."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits, share, size = self._walk(texts, limits)
        lead = bits - bits.min(axis=1, keepdims=True)
        score = 1.0 / np.exp2(-np.minimum(lead, 1000)).sum(axis=1)
        names = [self.languages[k] for k in bits.argmin(axis=1)]
        for i, text in enumerate(texts):
            if not has_letter(text):
                names[i], score[i] = "und", 0.0
        return names, score, share if limits is None else self._without_digits(texts, limits, share, size)

    def fits(self, texts: Sequence[str | None], limits: Sequence[float]) -> np.ndarray:
        """Bits of each text as a share of the limit, at most 1 if it fits.

        ``limits`` are bits per byte, one for each language. Of a text that does not fit the words
        with digits are left out, if enough remains.
        """
        _, out, size = self._walk(texts, limits)
        return self._without_digits(texts, limits, out, size)

    def _without_digits(
        self, texts: Sequence[str | None], limits: Sequence[float], out: np.ndarray, size: np.ndarray
    ) -> np.ndarray:
        again = [i for i in np.flatnonzero(out > 1) if _WITH_DIGITS.search(texts[i])]
        if again:
            plain = [_WITH_DIGITS.sub(" ", texts[i]) for i in again]
            _, share, left = self._walk(plain, limits)
            for i, text, x, n in zip(again, plain, share, left, strict=True):
                if has_letter(text) and n >= WORDS_LEFT * size[i]:
                    out[i] = min(out[i], x)
        return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def build_model(counts: dict[str, dict[int, int]], nodes: int = NODES) -> Model:
    """Trees and code lengths from the counts of byte sequences of each language."""
    languages = tuple(sorted(counts))
    used = sorted({(g >> (8 * k)) & 255 for grams in counts.values() for g in grams for k in range(ORDER + 1)})
    follow: list[dict[bytes, dict[int, int]]] = []
    weight: dict[bytes, int] = {}
    for language in languages:
        tree: dict[bytes, dict[int, int]] = {}
        for gram, n in counts[language].items():
            raw = gram.to_bytes(ORDER + 1, "big")
            for k in range(ORDER + 1):
                seen = tree.setdefault(raw[ORDER - k : ORDER], {})
                seen[raw[ORDER]] = seen.get(raw[ORDER], 0) + n
        follow.append(tree)
        for context, seen in tree.items():
            weight[context] = weight.get(context, 0) + sum(seen.values())
    kept = sorted(weight, key=lambda c: (-weight[c], len(c), c))[: _room(nodes, used, languages)]
    seen_there = (
        (k, context, byte, n)
        for k, tree in enumerate(follow) for context in kept for byte, n in tree.get(context, {}).items()
    )
    return _tabulated(languages, used, kept, seen_there)


def _room(nodes: int, used: Sequence[int], languages: Sequence[str]) -> int:
    """How many contexts are kept: with the root, one at least."""
    return max(1, min(nodes, MODEL_BYTES // (4 * (len(used) + 1) * max(1, len(languages)))))


def _tabulated(
    languages: tuple[str, ...], used: list[int], contexts: Iterable[bytes], seen: Iterable[tuple]
) -> Model:
    """The model of some contexts from (number of the language, context, byte that followed, count)."""
    symbol = np.zeros(256, np.int64)  # 0: a byte never seen in training
    symbol[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    # a context is at most as frequent as its own shorter ones, so the kept set has them too
    kept = sorted({*contexts, b""}, key=lambda c: (len(c), c))
    place = {c: i for i, c in enumerate(kept)}
    dead = len(kept)
    child = np.full((dead + 1, width), dead, np.int32)
    count = np.zeros((len(languages), dead, width))
    for k, context, byte, n in seen:
        count[k, place[context], symbol[byte]] = n
    bits = np.empty((len(languages), dead + 1, width), np.float32)
    for context, node in place.items():
        if context and context[1:] in place:
            child[place[context[1:]], symbol[context[0]]] = node
    for k in range(len(languages)):
        for context, node in place.items():
            shorter = bits[k, place[context[1:]]] if context else np.full(width, 8.0, np.float32)
            at = np.flatnonzero(count[k, node])
            if not len(at):
                bits[k, node] = shorter
                continue
            total, different = count[k, node].sum(), len(at)
            bits[k, node] = shorter + np.log2((total + different) / different)
            bits[k, node, at] = np.log2((total + different) / count[k, node, at])
        bits[k, dead] = 8.0
    return Model(languages, symbol, child, bits)


def _sampled(usable: DataFrame, sample: int) -> DataFrame:
    """lang and text of at most ``sample`` documents of each language, the first by a hash of their id.

    Of each language so many ids are left out by a bound on the hash, before any are ranked, that
    with near certainty enough remain; what meets in a task is about the sample of a language.
    """
    spark = usable.sparkSession
    place = F.xxhash64("doc_id")
    sizes = usable.groupBy("lang").count().collect()
    wide = [
        (r.lang, min(int(min(1.0, (sample + 8 * sample**0.5 + 64) / r["count"]) * 2.0**64), 2**64 - 1) - 2**63)
        for r in sizes
    ]
    bound = local_frame(spark, wide, "lang string, bound long")  # one row a language
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    ids = (
        usable.select("doc_id", "lang").join(F.broadcast(bound), "lang").filter(place <= F.col("bound"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample)
        .select(F.col("doc_id").alias("wanted")).distinct()
    )
    if len(sizes) * sample <= SENT_IDS:
        ids = F.broadcast(ids)
    texts = usable.filter(F.col("text").isNotNull()).join(ids, F.col("doc_id") == F.col("wanted"), "left_semi")
    return texts.select("lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE, nodes: int = NODES) -> Model:
    """Learn from ``docs`` (doc_id, text, lang): rows with null text, lang or id are left out.

    At most ``sample`` documents of a language are read. Contexts are counted and chosen on
    Spark; the driver gets no more counts than the model has cells.
    """
    spark = docs.sparkSession
    usable = docs.filter("lang is not null and doc_id is not null")
    labels = usable.select("lang").distinct().count()
    if not labels:
        return build_model({}, nodes)
    ensure_checkpoint_dir(spark)
    texts = _sampled(usable, sample)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_groups(batch.column(1), GROUP_BYTES):
                part = batch.slice(some.start, some.stop - some.start)
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, own in by_lang.items():
                    gram, n = _grams(own)
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(gram), "gram": gram, "n": n})

    counted = (
        texts.mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).checkpoint()
    )
    last = F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("byte")
    languages = tuple(sorted(r.lang for r in counted.select("lang").distinct().collect()))
    used = sorted({r.byte for r in counted.select(last).distinct().collect()} | ({32} if languages else set()))
    size = F.explode(F.sequence(F.lit(0), F.lit(ORDER)))
    before = F.expr("shiftright(gram, 8) & (shiftleft(1L, 8 * size) - 1)")
    followed = (
        counted.select("lang", "gram", "n", last, size.alias("size")).withColumn("before", before)
        .groupBy("lang", "size", "before", "byte").agg(F.sum("n").alias("n")).checkpoint()
    )
    top = (
        followed.groupBy("size", "before").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "size", "before").limit(_room(nodes, used, languages)).select("size", "before")
    )
    chosen = [(r.size, r.before) for r in top.collect()]
    there = spark.createDataFrame(chosen, "size int, before long")
    number = {lang: k for k, lang in enumerate(languages)}
    seen = (
        (number[r.lang], r.before.to_bytes(r.size, "big"), r.byte, r.n)
        for r in followed.join(F.broadcast(there), ["size", "before"]).toLocalIterator()
    )
    return _tabulated(languages, used, (b.to_bytes(k, "big") for k, b in chosen), seen)


def _shared(docs: DataFrame, model: Model):
    # plain values: MODEL_BYTES of code lengths, or two contexts for each language
    return docs.sparkSession.sparkContext.broadcast((model.languages, model.symbol, model.child, model.bits))


def fit_limits(docs: DataFrame, model: Model, sample: int = SAMPLE) -> list[float] | None:
    """Bits per byte that a text of each language may cost, from labelled documents not trained on.

    The median of at most ``sample`` documents of a language counts, within ``USUAL``, times
    ``FIT``. A language without such documents has the highest limit of the others; if no
    language has any, there are no limits.
    """
    usable = docs.filter("lang is not null and doc_id is not null")
    shared = _shared(docs, model)

    def cost(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        number = {lang: k for k, lang in enumerate(known.languages)}
        for batch in batches:
            names, rates = [], []
            for some in text_groups(batch.column(1), GROUP_BYTES):
                part = batch.slice(some.start, some.stop - some.start)
                rows = zip(*(c.to_pylist() for c in part.columns), strict=True)
                own = [r for r in rows if r[0] in number and has_letter(r[1])]
                bits, _, size = known._walk([text for _, text in own])
                for (lang, _), cost, n in zip(own, bits, size, strict=True):
                    names.append(lang)
                    rates.append(cost[number[lang]] / max(n, 1))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(names, pa.string()), "rate": pa.array(rates, pa.float64())})

    rates = _sampled(usable, sample).mapInArrow(cost, "lang string, rate double")
    usual = rates.groupBy("lang").agg(F.percentile_approx("rate", 0.5).alias("rate"))
    limits = {r.lang: FIT * float(np.clip(r.rate, *USUAL)) for r in usual.collect()}
    shared.destroy()
    if not limits:
        return None
    return [limits.get(lang, max(limits.values())) for lang in model.languages]


def identify(
    docs: DataFrame, model: Model, text: str = "text", limits: Sequence[float] | None = None
) -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``score``, from the text alone.

    With ``limits`` also ``fit``, the text's bits as a share of the limit (see ``Model.fits``).
    """
    added = ["lang_pred", "score"] + (["fit"] if limits is not None else [])
    for name in added:
        if name in docs.columns:
            raise ValueError(f"the table already has a column {name}")
    shared = _shared(docs, model)
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            fits: list[float] = []
            for some in text_groups(batch.column(at), GROUP_BYTES):
                n, x, f = known.judge(batch.column(at)[some].to_pylist(), limits)
                names += n
                scores += x.tolist()
                fits += f.tolist()
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made[: len(added)]], names=[*batch.schema.names, *added]
            )

    empty = [F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("fit")]
    return docs.mapInArrow(run, docs.select("*", *empty[: len(added)]).schema)


def held_out(doc_id: str = "doc_id"):
    """The fold kept from training; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fold_model(docs: DataFrame) -> Model:
    """A model of the documents that are not held out."""
    return train(docs.filter(~held_out()).select("doc_id", "text", "lang"))


def fold_limits(docs: DataFrame, model: Model) -> list[float] | None:
    """The limits of such a model, from the documents that are held out."""
    return fit_limits(docs.filter(held_out()).select("doc_id", "text", "lang"), model)
