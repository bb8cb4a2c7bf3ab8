"""Chat formatting with loss masks that are aligned by character offsets.

A conversation is rendered whole: per turn a start mark, the role, a separator, the text and an
end mark. It is encoded once, with the character offsets of every token; the marks are tokens of
their own, so no token reaches across a turn's border. The tokens of a turn are found by binary
search of its span in the sorted offsets.

Control strings inside roles and texts, those of this template and of other common ones, are
escaped: a backslash goes after the string's first character, after any backslashes that stand
there already. Taking one backslash out again restores the text, whatever it held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that some model reads as control; none may stand unescaped in a text.
CONTROL = (START, SEPARATOR, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ROLES = ("assistant",)


def _escapes(control: Sequence[str]) -> tuple[re.Pattern, re.Pattern]:
    ordered = sorted(control, key=len, reverse=True)
    return tuple(
        re.compile("|".join(f"(?<={re.escape(c[0])})({slashes}){re.escape(c[1:])}" for c in ordered))
        for slashes in (r"\\*", r"\\+")
    )


_PLAIN, _ESCAPED = _escapes(CONTROL)
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEPARATOR)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][1:], text)


@dataclass(frozen=True)
class Formatted:
    """A rendered conversation, its token ids, and which tokens the loss covers."""

    text: str
    ids: list[int]
    starts: np.ndarray
    ends: np.ndarray
    loss: np.ndarray

    def loss_texts(self) -> list[str]:
        """The texts under the mask, unescaped: one for each run of loss tokens between marks."""
        spans: list[list[int]] = []
        previous = None
        for i in np.flatnonzero(self.loss):
            a, b = int(self.starts[i]), int(self.ends[i])
            if previous == i - 1:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
            previous = i
        return [unescape(self.text[a:b]) for a, b in spans]


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, with the template's marks as tokens of their own."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens(
        [AddedToken(m, special=True, normalized=False) for m in (START, SEPARATOR, END)]
    )
    return tokenizer


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole text, and the span of each turn's text in it."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEPARATOR, escape(text)
        pieces += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(END)
    return "".join(pieces), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def format_conversation(
    turns: Sequence[tuple[str, str]], tokenizer: Tokenizer, roles: Sequence[str] = ROLES
) -> Formatted:
    """Render, encode once, and mark the tokens of the turns whose role is in ``roles``."""
    text, spans = render(turns)
    encoded = tokenizer.encode(text, add_special_tokens=False)
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    starts, ends = offsets[:, 0], offsets[:, 1]
    loss = np.zeros(len(offsets), bool)
    own = np.array([s for s, (role, _) in zip(spans, turns, strict=True) if role in roles], np.int64)
    if len(own):
        first = np.searchsorted(ends, own[:, 0], side="right")
        after = np.searchsorted(starts, own[:, 1], side="left")
        for a, b in zip(first, after, strict=True):
            loss[a:b] = True
    return Formatted(text, encoded.ids, starts, ends, loss)


SCHEMA = (
    "conv_id long, formatted string, ids array<int>, loss array<boolean>, "
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def format_conversations(rows: DataFrame, path: str, roles: Sequence[str] = ROLES) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text), in order of turn.

    Null roles and texts are empty; rows of equal turn are ordered by role and text, null turns
    come first; rows with a null conv_id form one conversation. Repeated rows are turns of their
    own. The digest columns are read back from the formatted text and the mask. Rows of a
    conversation meet sorted in one task, as its text is one value; other columns are ignored,
    and an empty table gives no rows.
    """
    ordered = (
        rows.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )

    def finish(conversations: list[tuple], tokenizer: Tokenizer) -> pa.RecordBatch:
        out: dict[str, list] = {f.split()[0]: [] for f in SCHEMA.split(", ")}
        for conv_id, turns in conversations:
            made = format_conversation(turns, tokenizer, roles)
            back = parse(made.text)
            digest = hashlib.sha256()
            for role, text in back:
                digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            loss = "".join(made.loss_texts())
            values = (
                conv_id, made.text, made.ids, made.loss, len(back), digest.hexdigest(), len(loss),
                hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(made.text),
            )
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        types = dict(
            conv_id=pa.int64(), ids=pa.list_(pa.int32()), loss=pa.list_(pa.bool_()),
            n_turns=pa.int64(), loss_chars=pa.int64(), formatted_chars=pa.int64(),
        )
        return pa.RecordBatch.from_pydict(
            {c: pa.array(v, types.get(c, pa.string())) for c, v in out.items()}
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        turns: list[tuple[str, str]] = []
        current: object = None
        done: list[tuple] = []
        size = 0
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and conv_id != current:
                    done.append((current, turns))
                    turns = []
                    if size > 1 << 20:
                        yield finish(done, tokenizer)
                        done, size = [], 0
                current = conv_id
                turns.append((role, text))
                size += len(text)
        if turns:
            done.append((current, turns))
        if done:
            yield finish(done, tokenizer)

    return ordered.mapInArrow(run, SCHEMA)
