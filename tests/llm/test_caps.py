from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tabulary.llm import caps
from tests.llm.brute import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def _clustered(seed, dim=64, labels=3, centres=30, near=6):
    chance = np.random.default_rng(seed)
    rows = []
    for label in range(labels):
        for _ in range(centres):
            centre = chance.standard_normal(dim)
            for _ in range(int(chance.integers(1, near))):
                angle = chance.uniform(0.0, 0.75)
                rows.append((centre + angle * chance.standard_normal(dim) * np.linalg.norm(centre) / 8, label))
    order = chance.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in rows[k][0]], rows[k][1]) for i, k in enumerate(order)]


def _brute(rows, cosine=caps.COSINE):
    units = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if rows[i][2] == rows[j][2] and units[i] @ units[j] >= cosine
    ]
    return links, components(len(rows), links)


def test_recall_of_pairs_at_the_threshold():
    chance = np.random.default_rng(8)
    one = chance.standard_normal((1500, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other = chance.standard_normal((1500, 64))
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    two = caps.COSINE * one + np.sqrt(1 - caps.COSINE**2) * other
    met = [len(np.intersect1d(a, b)) for a, b in zip(caps.list_decode(one), caps.list_decode(two), strict=True)]
    assert np.mean(np.array(met) > 0) >= 0.97


def test_list_decoding_finds_every_filter_above_the_height():
    chance = np.random.default_rng(2)
    units = caps._units(list(chance.standard_normal((7, 10))))
    rotation, parts = caps._code(10, 3, 5, 1)
    got = caps.list_decode(units, blocks=3, codes=5, height=2.0, seed=1)
    turned = units @ rotation
    at = np.cumsum([0, *[p.shape[1] for p in parts]])
    for row, found in zip(turned, got, strict=True):
        s = [row[at[k] : at[k + 1]] @ parts[k].T for k in range(3)]
        total = s[0][:, None, None] + s[1][:, None] + s[2]
        assert found.tolist() == np.flatnonzero(total.reshape(-1) >= 2.0).tolist()


def test_rounded_vectors_bound_the_cosine_from_above():
    chance = np.random.default_rng(3)
    units = caps._units(list(chance.standard_normal((60, 64)) * chance.uniform(0.01, 9, 64)))
    own = caps._Bytes(pa.chunked_array([pa.array([caps._rounded(u) for u in units], pa.binary())]))
    for i, j in ((i, j) for i in range(60) for j in range(i)):
        true = float(units[i] @ units[j])
        assert own.pairs(np.array([i]), np.array([j]), true)[0]
        assert own.table(np.array([i]), np.array([j]), true)[0, 0]
        assert not own.pairs(np.array([i]), np.array([j]), true + 0.08)[0]


@pytest.mark.parametrize(("chunk", "pairs"), [(1024, 1 << 18), (4, 1 << 18), (1024, 1)])
def test_links_and_components_against_brute_force(spark, monkeypatch, chunk, pairs):
    monkeypatch.setattr(caps, "CHUNK", chunk)
    monkeypatch.setattr(caps, "PAIRS", pairs)
    rows = _clustered(5)
    links, labels = _brute(rows)
    got = {r.vec_id: r for r in caps.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    counted = np.bincount(np.array(links).reshape(-1), minlength=len(rows))
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= counted).all()
    assert found.sum() >= 0.97 * counted.sum()
    agree = np.mean([got[i].component_id == labels[i] for i in range(len(rows))])
    assert agree >= 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_copies_count_as_links_without_being_listed(spark):
    chance = np.random.default_rng(1)
    base = chance.standard_normal(64)
    near = base + 0.02 * chance.standard_normal(64)
    rows = [(10 + i, base.tolist(), 1) for i in range(50)] + [(5 + i, near.tolist(), 1) for i in range(3)]
    rows += [(100, base.tolist(), 2), (101, (base * 1000).tolist(), 2), (102, (-base).tolist(), 2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[10] == got[59] == (52, 5)
    assert got[5] == (52, 5)
    assert got[100] == got[101] == (1, 100)
    assert got[102] == (0, 102)


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0] * 64
    rows = [
        (1, v, None), (2, v, None), (3, None, 1), (4, None, 1), (5, [0.0] * 64, 1), (6, [0.0] * 64, 1),
        (7, [nan] + v[1:], 1), (8, [nan] + v[1:], 1), (9, [inf] + v[1:], 1), (10, [None] + v[1:], 1),
        (11, [], 1), (12, [], 1), (13, v, 1), (14, v[:32], 1), (None, v, 1), (15, [1e-30] * 64, 1),
    ]
    got = caps.near_vectors(spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA + ", node int, caps int"))
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    for i in [*range(1, 13), 14]:
        assert rows[i] == (0, i, True)
    assert rows[13] == (2, 13, True) and rows[15] == (2, 13, False) and rows[None] == (2, 13, False)


def test_repeated_rows_and_empty_table(spark):
    v = [float(i) for i in range(64)]
    got = caps.near_vectors(spark.createDataFrame([(1, v, 1)] * 3, SCHEMA)).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [(2, 1, True)] * 3
    assert caps.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def _at_threshold(chance, n, dim):
    one = caps._units(list(chance.standard_normal((n, dim))))
    other = chance.standard_normal((n, dim))
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other = caps._units(list(other))
    return one, (caps.COSINE + 1e-9) * one + np.sqrt(1 - (caps.COSINE + 1e-9) ** 2) * other


@pytest.mark.parametrize("dim", [4, 8, 12, 16, 24, 32, 48, 64, 256])
def test_recall_at_the_threshold_in_every_dimension(dim):
    one, two = _at_threshold(np.random.default_rng(dim), 400, dim)
    wide = [np.pad(x, ((0, 0), (0, max(0, caps.LEAST_DIM - dim)))) for x in (one, two)]
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(*map(caps.list_decode, wide), strict=True)]
    assert np.mean(met) >= 0.95


@pytest.mark.parametrize("dim", [1, 2, 8])
def test_short_vectors_link(spark, dim):
    chance = np.random.default_rng(dim)
    centres = chance.standard_normal((6, dim))
    rows = [
        (10 * c + i, [float(x) for x in centres[c] * (1 + 0.1 * i) + 0.002 * chance.standard_normal(dim)], c)
        for c in range(6) for i in range(4)
    ]
    got = caps.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    links, _ = _brute(rows)
    count = {}
    for i, j in links:
        for k in (i, j):
            count[rows[k][0]] = count.get(rows[k][0], 0) + 1
    assert {r.vec_id: r.n_links for r in got} == {v: count.get(v, 0) for v, _, _ in rows}


def test_labels_are_compared_whole_and_may_be_large(spark, monkeypatch):
    vector = [float(x) for x in np.random.default_rng(1).standard_normal(64)]
    near = [x + 0.001 for x in vector]
    labels = [-1, 2147483647, 3_000_000_000, 3_000_000_000, 3_000_000_000 + 2**31, -(2**63), 2**63 - 1]
    rows = [(i, vector if i % 2 else near, label) for i, label in enumerate(labels)]
    for kind in ("long", "string"):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")
        frame = frame.withColumn("label", frame.label.cast(kind))
        got = {r.vec_id: (r.n_links, r.component_id) for r in caps.near_vectors(frame).collect()}
        assert got == {i: (1, 2) if i in (2, 3) else (0, i) for i in range(len(labels))}


def test_labels_that_share_a_cap_number_do_not_link():
    """Rows of one task whose labels differ, as when bits of their hashes agree."""
    vector = [float(x) for x in np.random.default_rng(1).standard_normal(64)]
    group = [(5, 0, 0, 0, node, vector, 1, [5], label) for node, label in ((1, "a"), (2, "b"), (3, "b"))]
    made = [tuple(r.values()) for batch in caps._compare(group, 0.93) for r in batch.to_pylist()]
    assert sorted(made) == [(2, 1, 2), (3, 1, 2)]
