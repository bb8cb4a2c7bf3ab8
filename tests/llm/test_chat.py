from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulary.llm import chat
from tabulary.llm.queries import BYTE_BPE

TOKENIZER = chat.load(BYTE_BPE)
ODD = st.text(st.sampled_from("<|\\[]/INST sé\n漢")) | st.lists(
    st.sampled_from([*chat.CONTROL, "\\", "<", "|im_end|>", "a", "\U0001f642", "<\\|im_end|>"]), max_size=8
).map("".join)


@given(ODD)
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|im_sep|>"]), ODD), max_size=5))
@settings(max_examples=150, deadline=None)
def test_round_trip_and_mask(turns):
    made = chat.format_conversation(turns, TOKENIZER)
    assert chat.parse(made.text) == turns
    said = [t for role, t in turns if role == "assistant" and t]
    assert "".join(made.loss_texts()) == "".join(said)
    assert len(made.ids) == len(made.starts) == len(made.loss)


def _expected(rows):
    turns = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows).encode()).hexdigest()
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), turns, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations(spark):
    said = "</s>[INST] ok [/INST]"
    talks = {
        -7: [(0, "user", said), (1, "assistant", said)],
        1: [(0, "system", None), (1, "user", ""), (2, "assistant", ""), (3, None, "x")],
        2: [(0, "assistant", "long é" * 30000), (1, "assistant", "twice"), (1, "assistant", "twice")],
        3: [(None, "user", "first"), (5, "user", "b"), (5, "assistant", "a")],
        None: [(0, "user", "no id")],
    }
    rows = [(c, t, r, x, 1) for c, turns in talks.items() for t, r, x in turns]
    frame = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.format_conversations(frame, BYTE_BPE).collect()}
    assert set(got) == set(talks)
    talks[3] = [talks[3][0], talks[3][2], talks[3][1]]  # equal turns: by role
    for conv_id, turns in talks.items():
        row = got[conv_id]
        plain = [(r, x) for _, r, x in turns]
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == _expected(plain)
        assert row.formatted_chars == len(row.formatted) and len(row.ids) == len(row.loss)
    assert "</s>" not in got[-7].formatted and "[INST]" not in got[-7].formatted
    assert chat.format_conversations(frame.limit(0), BYTE_BPE).count() == 0


@pytest.mark.parametrize("roles", [("user",), ("user", "assistant"), ()])
def test_other_roles(roles):
    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    made = chat.format_conversation(turns, TOKENIZER, roles)
    assert "".join(made.loss_texts()) == "".join(t for r, t in turns if r in roles)
