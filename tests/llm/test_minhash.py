from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest

from tabulary.llm import minhash
from tabulary.llm.words import BLOCK, shingle_hashes, word_hashes
from tests.llm.brute import jaccard, shingles, words

LETTERS = ["alpha", "Beta", "gamma", "délta", "e", "ZETA!", "eta7", "Θ"]


def _text(random_, n):
    return "".join(
        random_.choice(LETTERS) + random_.choice([" ", "\t", "\n ", "\x0b", "\r\n"]) for _ in range(n)
    )


def test_word_and_shingle_hashes_agree_with_words():
    chance = random.Random(3)
    texts = [None, "", "   ", "one", " a b ", "A b", "\x1c x", "é\xa0è y"] + [_text(chance, n) for n in range(12)]
    hashes, offsets = word_hashes(texts)
    seen = {}
    for k, text in enumerate(texts):
        own = hashes[offsets[k] : offsets[k + 1]].tolist()
        assert len(own) == len(words(text))
        for h, w in zip(own, words(text), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    hashes, offsets = shingle_hashes(texts)
    named = {}
    for k, text in enumerate(texts):
        assert len(set(hashes[offsets[k] : offsets[k + 1]].tolist())) == len(shingles(text))
        for h in hashes[offsets[k] : offsets[k + 1]].tolist():
            named.setdefault(h, set()).add(k)
    assert offsets[-1] == len(hashes)


def test_words_longer_than_a_block_and_at_block_edges():
    long = "x" * (3 * BLOCK + 17)
    text = "a " * (BLOCK // 2 - 1) + "edgeword " + long + " tail"
    hashes, offsets = word_hashes([text, "edgeword", long, "tail"])
    assert len(hashes) == offsets[1] + 3
    assert hashes[offsets[1] - 3 : offsets[1]].tolist() == hashes[offsets[1] :].tolist()


def test_estimates_follow_jaccard():
    chance = random.Random(5)
    errors = []
    for _ in range(60):
        base = [f"w{chance.randrange(500)}" for _ in range(chance.choice([40, 300, 2000]))]
        other = [w if chance.random() > 0.03 else "new" for w in base]
        one, two = " ".join(base), " ".join(other)
        prints = minhash.packed(*minhash.signatures([one, two]))
        errors.append(minhash.likeness(*prints) - jaccard(shingles(one), shingles(two)))
    assert abs(np.mean(errors)) < 0.015
    assert np.max(np.abs(errors)) < 0.15


def test_tiny_sets_do_not_agree_by_chance():
    texts = [f"only{i}" for i in range(200)]
    low, present = minhash.signatures(texts)
    assert present.all()
    near = minhash.likenesses((low[:-1], present[:-1]), (low[1:], present[1:]))
    assert near.max() < 0.1
    assert minhash.likeness(*minhash.packed(*minhash.signatures(["a b", "A  B"]))) == 1.0


def test_empty_texts():
    prints = minhash.packed(*minhash.signatures([None, "", " \n", "a"]))
    assert prints[:3] == ["", "", ""] and prints[3]
    assert minhash.likeness("", "") == 1.0
    assert minhash.likeness("", prints[3]) == 0.0


def _expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, [-ord(c) for c in r[1] or ""]), reverse=True)
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), changed, after))
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edited_fingerprints_follow_the_sequence(spark, many_parts, parts):
    chance = random.Random(9)
    rows = [(7 * i % 101, _text(chance, chance.randrange(30))) for i in range(60)]
    rows += [(200, None), (201, ""), (None, "no id here"), (300, "é" * 5000), (-5, "last words of all")]
    frame = spark.createDataFrame(
        [(i, t, "x", "y") for i, t in rows], "doc_id long, text string, part string, n_chars string"
    )
    got = {r.doc_id: r for r in minhash.edited_fingerprints(frame, parts).collect()}
    expected = _expected(rows)
    assert len(got) == len(expected)
    for doc_id, n, digest, changed, after in expected:
        row = got[doc_id]
        own = next(t or "" for i, t in rows if i == doc_id)
        assert (row.n_chars, row.edited_sha256) == (n, digest)
        prints = minhash.packed(*minhash.signatures([own, changed, after]))
        assert [row.fingerprint, row.edited_fingerprint] == prints[:2]
        assert row.near_edited == pytest.approx(minhash.likeness(prints[0], prints[1]))
        assert row.near_next == pytest.approx(minhash.likeness(prints[0], prints[2]))


def test_repeated_rows_single_rows_and_empty_tables(spark):
    schema = "doc_id long, text string"
    same = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(1, "z")], schema)
    rows = minhash.edited_fingerprints(same, 4).collect()
    assert sorted(r.n_chars for r in rows) == [1, 11, 11, 11]
    one = minhash.edited_fingerprints(spark.createDataFrame([(4, "abcd")], schema), 4).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert minhash.edited_fingerprints(spark.createDataFrame([], schema), 4).count() == 0
    none = minhash.edited_fingerprints(spark.createDataFrame([(None, None)] * 2, schema), 4).collect()
    assert [r.near_next for r in none] == [1.0, 1.0]


def test_fingerprint_column_keeps_other_columns(spark):
    frame = spark.createDataFrame([("a b", 1), (None, 2)], "text string, fingerprints int")
    rows = minhash.fingerprint_column(frame).orderBy("fingerprints").collect()
    assert rows[0].fingerprint and rows[1].fingerprint == "" and rows[1].text is None
    with pytest.raises(ValueError, match="already has"):
        minhash.fingerprint_column(frame, out="fingerprints")


def test_the_plan_of_thousands_of_parts(spark):
    """Planned only: so many ranges make one small join, not one condition each."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    started = time.perf_counter()
    plan = minhash.in_sequence(docs, "doc_id", 5000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and time.perf_counter() - started < 60
