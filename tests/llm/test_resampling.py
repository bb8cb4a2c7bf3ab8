"""Importance resampling: features and gains by a plain version, the selection against a sort."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tabulary.llm import resampling

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    words = _WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % resampling.BUCKETS for r in runs]


def _plain(docs, target, percent=5, least=20):
    s, t = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    for table, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in _features(text)[1]:
                table[b] += 1
    size = resampling.BUCKETS
    gain = [
        math.floor(1000 * math.log((b + 1) * (s.sum() + size) / ((a + 1) * (t.sum() + size))))
        for a, b in zip(s, t, strict=True)
    ]
    rows = []
    for doc_id, text in docs:
        n, own = _features(text)
        weight = sum(gain[b] for b in own)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append((n, doc_id, len(own), weight, score))
    free = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    ranks = [i + 1 if i < percent * len(free) // 100 else None for i in range(len(free))]
    out = [(*r[1:], k) for r, k in zip(free, ranks, strict=True)]
    return sorted([*out, *[(*r[1:], None) for r in rows if r[0] < least]], key=repr)


def _ours(spark, docs, target, **settings):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as weight", "'x' as rank", "2 as side")
    goal = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    made = resampling.resample(frame, goal, **settings)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in made.collect()), key=repr)


def _texts(n, seed):
    draw = random.Random(seed)
    pool = ["the", "Of", "ÉCOLE", "x1", "日本語", "a-b", "I'm", "ﬁ", "Ж", "zeta", "token", " "]
    return [" ".join(draw.choices(pool, k=draw.randrange(0, 60))) for _ in range(n)]


def test_draw_equals_the_plain_version(spark, many_parts):
    docs = [(i, t) for i, t in enumerate(_texts(300, 1))]
    docs += [(None, docs[7][1]), (None, None), (500, None), (501, ""), (502, "!?\x00 \x7f")]
    docs += [(7, docs[7][1])] * 5 + [(600, "word " * 400_000)]
    target = [*_texts(20, 2), None, ""]
    assert _ours(spark, docs, target) == _plain(docs, target)


def test_most_documents_drawn_and_none_drawn(spark):
    docs = [(i, t) for i, t in enumerate(_texts(60, 3))]
    assert _ours(spark, docs, _texts(3, 4), percent=95) == _plain(docs, _texts(3, 4), percent=95)
    assert _ours(spark, docs[:5], [], percent=5) == _plain(docs[:5], [])
    assert _ours(spark, [], ["some target text"]) == []


def test_selection_finds_every_place_with_many_ties(spark):
    rows = spark.range(400).selectExpr("id % 3 as low", "0 as no_id", "id % 7 as id", "id as row").checkpoint()
    expected = sorted(tuple(r) for r in rows.collect())
    for k in (1, 2, 133, 134, 399, 400):
        assert resampling.kth_key(rows, k, pivots=5) == expected[k - 1]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_do_not_change_the_features(monkeypatch, block):
    text = " ".join(_texts(5, 9))
    monkeypatch.setattr(resampling, "BLOCK", block)
    found = list(resampling.feature_buckets(text))
    words, expected = _features(text)
    assert sum(n for n, _ in found) == words
    assert sorted(np.concatenate([b for _, b in found]).tolist()) == sorted(expected)
