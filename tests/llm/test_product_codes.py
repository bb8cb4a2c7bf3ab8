"""Product codes against a plain version on all rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from tabulary.llm import product_codes


def _plain(rows, entries=256, rounds=4):
    kept = [
        (v, [math.floor(1024 * c) for c in x], label)
        for v, x, label in rows
        if x is not None and all(c is not None and math.isfinite(c) for c in x)
    ]
    width = -(-max((len(x) for _, x, _ in kept), default=0) // 4) * 4
    size = width // 4
    parts = [
        [tuple((x + [0] * (width - len(x)))[k * size : (k + 1) * size]) for k in range(4)] for _, x, _ in kept
    ]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[parts[i][k] for i in first] for k in range(4)]

    def near(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for k in range(4):
            mine = [near(p[k], books[k])[0] for p in parts]
            for e in set(mine):
                own = [p[k] for p, m in zip(parts, mine, strict=True) if m == e]
                books[k][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    found = [[near(p[k], books[k]) for k in range(4)] for p in parts]
    error = [sum(d for _, d in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(
        ((v, bytes(e for e, _ in f).hex(), d, by_label[label], digest)
         for (v, _, label), f, d in zip(kept, found, error, strict=True)),
        key=repr,
    )


def _ours(spark, rows, **settings):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    made = product_codes.compress(frame.selectExpr("*", "1 as code", "2 as x", "3 as error"), **settings)
    assert made.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in made.collect()), key=repr)


def _vectors(n, dim, seed, steps=64):
    draw = random.Random(seed)
    return [[draw.randrange(-steps, steps) / 32 for _ in range(dim)] for _ in range(n)]


def test_codes_equal_the_plain_version(spark, many_parts):
    rows = [(i, x, i % 5 or None) for i, x in enumerate(_vectors(120, 8, 1))]
    rows += [(200 + i, rows[3][1], 3) for i in range(40)]
    rows += [(300, None, 1), (301, [None] * 8, 1), (302, [math.nan] + [0.0] * 7, 1), (303, [math.inf] * 8, 1)]
    rows += [(None, rows[5][1], None), (None, rows[4][1], None), (3, rows[8][1], 1), (-4, [0.0] * 8, 7)]
    assert _ours(spark, rows, entries=16) == _plain(rows, entries=16)


def test_fewer_rows_than_entries_short_vectors_and_none(spark):
    rows = [(i, x, 1) for i, x in enumerate(_vectors(9, 6, 2, steps=2))]
    rows += [(20, [0.5], 1), (21, [], 2), (22, [0.25] * 7, 2)]
    assert _ours(spark, rows) == _plain(rows)
    assert _ours(spark, [(1, [], 1), (2, [], None)]) == _plain([(1, [], 1), (2, [], None)])
    assert _ours(spark, []) == []
    assert _ours(spark, [(1, None, 1)]) == []


def test_huge_components_do_not_overflow(spark):
    rows = [(i, [3e38 * (-1) ** i, 1e30, 0.0, 1.0], 1) for i in range(6)]
    made = _ours(spark, rows, entries=2)
    assert len(made) == 6 and all(r[2] >= 0 for r in made)


def test_walk_finds_the_nearest_entry_of_every_part(monkeypatch):
    random_ = np.random.default_rng(5)
    book = random_.integers(-4, 4, (40, 5))
    parts = np.unique(random_.integers(-4, 4, (3000, 5)), axis=0)
    far = ((parts[:, None, :] - book) ** 2).sum(axis=2)
    for block in (1, 3, 50, 10_000):
        monkeypatch.setattr(product_codes, "BLOCK", block)
        entry, distance = product_codes.nearest(parts, book)
        assert (entry == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
