"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary's word-initial pieces form a trie, its continuation pieces a second one. A node's
failure link leads to where matching goes on once the longest pieces of what was read are taken
off; how many pieces that takes is computed beforehand. A word is then read once, character by
character, adding up these numbers: no piece is ever built, and no character is read twice.

A word that cannot be covered counts as one unknown token. Words are runs of characters other
than white space. Counts of words met before are kept, at most ``CACHE`` of them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.llm.words import kept_in_worker

CACHE = 1 << 19
_NONE = -1
_MARK = "\N{LOWER ONE EIGHTH BLOCK}"


class Automaton:
    """Node 0 is the root of word-initial pieces, node 1 that of continuation pieces."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.step: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.step[node]:
                        self.step[node][c] = len(self.step)
                        self.step.append({})
                        ends.append(False)
                    node = self.step[node][c]
                if piece:
                    ends[node] = True
        self.link = [_NONE] * len(self.step)
        self.popped = [0] * len(self.step)
        queue = deque([0, 1])
        while queue:
            above = queue.popleft()
            for c, node in self.step[above].items():
                if ends[node]:
                    self.link[node], self.popped[node] = 1, 1
                else:
                    at, taken = self.link[above], self.popped[above]
                    while at != _NONE and c not in self.step[at]:
                        taken += self.popped[at]
                        at = self.link[at]
                    if at != _NONE:
                        self.link[node], self.popped[node] = self.step[at][c], taken
                queue.append(node)
        self._known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Number of pieces of a word, or -1 if it cannot be covered."""
        step, link, popped = self.step, self.link, self.popped
        node = total = 0
        for c in word:
            while c not in step[node]:
                if link[node] == _NONE:
                    return -1
                total += popped[node]
                node = link[node]
            node = step[node][c]
        while node > 1:
            if link[node] == _NONE:
                return -1
            total += popped[node]
            node = link[node]
        return total

    def counts(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and unknown words of a text."""
        known, tokens, unknown = self._known, 0, 0
        words = (text or "").split()
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.count(word)
                if len(known) >= CACHE:
                    known.clear()
                if len(word) <= 64:
                    known[word] = n
            if n < 0:
                unknown += 1
                tokens += 1
            else:
                tokens += n
        return len(words), tokens, unknown


def load(path: str) -> Automaton:
    """The automaton of a SentencePiece model's vocabulary.

    Pieces that begin with the word mark are word-initial, without it; all others but control
    and byte pieces continue a word.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
    ]
    return Automaton(
        [p[1:] for p in pieces if p.startswith(_MARK) and _MARK not in p[1:]],
        [p for p in pieces if _MARK not in p],
    )


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without their text, with ``n_words``, ``n_tokens`` and ``n_unknown``.

    ``path`` is a vocabulary that all workers can read. A null, empty or blank text has no words
    and no tokens. Other columns pass unchanged; a column of one of the new names is refused.
    """
    new = ("n_words", "n_tokens", "n_unknown")
    kept = [c for c in docs.columns if c != text]
    if clash := set(new) & set(kept):
        raise ValueError(f"the table already has columns {sorted(clash)}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept_in_worker(("wordpiece", path), lambda: load(path))
        for batch in batches:
            found = [automaton.counts(t) for t in batch.column(len(kept)).to_pylist()]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *columns], names=[*kept, *new]
            )

    schema = docs.select(*kept, *[F.lit(0).cast("long").alias(c) for c in new]).schema
    return docs.select(*kept, text).mapInArrow(run, schema)
