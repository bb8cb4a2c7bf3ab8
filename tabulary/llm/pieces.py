"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

A text is read once. The automaton's output links name all pieces that end at a position, and
each of them relaxes the best score there; the best way to a position is final once the pieces
that end at it have been seen. Equal scores go to the longest piece. A character that no piece
covers is encoded as its UTF-8 bytes by the model's byte pieces, so that every text can be
decoded to itself.

Spaces become the word mark, and one is put before the text, as the model was trained. A word
mark that stands in the text itself is encoded as bytes, so that it is not taken for a space. No
piece crosses from a word into the mark of the next one (checked when the model is loaded), so
the best way through a text is the best way through each marked word; ways through words met
before are kept, at most ``CACHE`` of them or those of one text.

A piece's score is the logarithm of its probability. A unigram model has its own; the scores of a
BPE model are merge ranks, and probabilities follow Zipf's law in these.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.llm.words import kept_in_worker

MARK = "\N{LOWER ONE EIGHTH BLOCK}"
CACHE = 1 << 19
#: A byte piece is so much less likely than the least likely ordinary piece.
BYTE_PENALTY = 10.0


class Pieces:
    """Pieces with their scores, and the encoder and decoder over them.

    ``scores`` maps a piece to its id and log-probability; ``byte_ids`` are the ids of the 256
    byte pieces in order, ``byte_score`` the log-probability of each.
    """

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: Sequence[int], byte_score: float):
        self.byte_ids = list(byte_ids)
        self.byte_score = byte_score
        self.automaton = ahocorasick.Automaton()
        self.single = {p for p in scores if len(p) == 1}
        for piece, (number, score) in scores.items():
            if piece:
                self.automaton.add_word(piece, (number, len(piece), score))
        self.automaton.make_automaton()
        words_apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in scores)
        self.units = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if words_apart else "(?s:.+)")
        self.raw: dict[int, bytes] = {number: p.encode() for p, (number, _) in scores.items()}
        self.raw |= {number: bytes([b]) for b, number in enumerate(self.byte_ids)}
        self.spaced = {n: r.replace(MARK.encode(), b" ") for n, r in self.raw.items()}
        for number in self.byte_ids:
            self.spaced[number] = self.raw[number]
        self._known: dict[str, bytes] = {}
        self._mark = np.array([self.byte_ids[b] for b in MARK.encode()], np.int32).tobytes()

    def _bytes_of(self, character: str) -> list[int]:
        """Byte pieces of a character of a unit; the mark there is a space."""
        plain = " " if character == MARK else character
        return [self.byte_ids[b] for b in plain.encode("utf-8", "surrogatepass")]

    def best(self, unit: str) -> list[int]:
        """The best ids of a string without outside context."""
        n = len(unit)
        score = [-math.inf] * (n + 1)
        score[0] = 0.0
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0

        def settle(upto: int) -> None:
            # positions that no piece reached are reached by one character's bytes
            nonlocal done
            while done < upto:
                done += 1
                if unit[done - 1] not in self.single:
                    other = score[done - 1] + len(self._bytes_of(unit[done - 1])) * self.byte_score
                    if other > score[done]:
                        score[done], came[done] = other, (1, -1)

        for last, (number, length, own) in self.automaton.iter(unit):
            if done < last:
                settle(last)
            end = last + 1
            total = score[end - length] + own
            if total > score[end]:
                score[end], came[end] = total, (length, number)
        settle(n)
        out: list[int] = []
        at = n
        while at:
            length, number = came[at]
            out += [number] if number >= 0 else self._bytes_of(unit[at - 1])[::-1]
            at -= length
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty text has none."""
        return self.encoded(text).tolist()

    def encoded(self, text: str | None) -> np.ndarray:
        """The same as an array."""
        if not text:
            return np.empty(0, np.int32)
        out: list[bytes] = []
        known = self._known
        for k, plain in enumerate(text.split(MARK)):
            if k:
                out.append(self._mark)
            marked = plain.replace(" ", MARK)
            units = self.units.findall(marked if k else MARK + marked)
            fresh = [u for u in set(units) if u not in known]
            if len(known) + len(fresh) > CACHE:
                known.clear()
                fresh = set(units)
            for unit in fresh:
                known[unit] = np.array(self.best(unit), np.int32).tobytes()
            out += map(known.__getitem__, units)
        if len(known) > CACHE:
            known.clear()
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a sequence of ids; unknown and control ids stand for nothing."""
        try:
            raw = b"".join(map(self.spaced.__getitem__, ids))
        except KeyError:
            raw = b"".join([self.spaced.get(i, b"") for i in ids])
        return raw.removeprefix(b" ").decode("utf-8", "surrogatepass")


def load(path: str) -> Pieces:
    """Pieces of a SentencePiece model file with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = [i for i in range(size) if model.is_byte(i)]
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte pieces")
    usual = [
        i for i in range(size)
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    given = {i: model.get_score(i) for i in usual}
    if all(s == round(s) for s in given.values()):
        ranked = sorted(usual, key=lambda i: (-given[i], i))
        whole = math.log(sum(1.0 / (r + 1) for r in range(len(ranked))))
        given = {i: -math.log(r + 1) - whole for r, i in enumerate(ranked)}
    scores = {model.id_to_piece(i): (i, given[i]) for i in usual}
    return Pieces(scores, byte_ids, min(given.values()) - BYTE_PENALTY)


def encode_column(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` without their text, with its ids as ``out``.

    ``path`` is a model that all workers can read. A null or empty text has no ids. Other
    columns pass unchanged; a column named like ``out`` is refused.
    """
    kept = [c for c in docs.columns if c != text]
    if out in kept:
        raise ValueError(f"the table already has a column {out}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_in_worker(("pieces", path), lambda: load(path))
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            for a in range(0, len(texts), 512):
                ids = [pieces.encoded(t) for t in texts[a : a + 512]]
                others = [c.slice(a, 512) for c in batch.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays(
                    [*others, pa.array(ids, pa.list_(pa.int32()))], names=[*kept, out]
                )

    schema = docs.select(*kept, F.array().cast("array<int>").alias(out)).schema
    return docs.select(*kept, text).mapInArrow(run, schema)


def decode_column(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the text of ``ids`` as ``out``; null ids have the empty text."""
    if out in encoded.columns:
        raise ValueError(f"the table already has a column {out}")
    at = encoded.columns.index(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_in_worker(("pieces", path), lambda: load(path))
        for batch in batches:
            column = batch.column(at)
            texts = []
            for k in range(len(column)):
                one = column[k]
                texts.append(pieces.decode(one.values.to_numpy(zero_copy_only=False).tolist()) if one.is_valid else "")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out]
            )

    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias(out)).schema)
