from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tabulary.llm import components, partenum
from tabulary.llm.components import connected_components
from tabulary.llm.words import text_groups
from tests.llm.brute import jaccard_rows, peak_of

SCHEMA = "doc_id long, text string"


def _linked(a, b, percent=75):
    both = len(np.intersect1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _set(random_, n):
    return np.unique(random_.integers(0, 1 << 64, n, dtype=np.uint64))


@pytest.mark.parametrize("percent", [75, 90])
def test_similar_sets_always_share_a_signature(percent):
    chance = np.random.default_rng(1)
    for trial in range(400):
        size = int(chance.integers(1, 60) if trial % 2 else chance.integers(60, 700))
        one = _set(chance, size)
        drop = int(chance.integers(0, len(one) * (100 - percent) // 100 + 1))
        rest = one[chance.permutation(len(one))[drop:]]
        most = max(0, (len(rest) * 100) // percent - len(one))
        two = np.unique(np.concatenate([rest, _set(chance, int(chance.integers(0, most + 1)))]))
        if not _linked(one, two, percent):
            continue
        signature, owner = partenum.set_signatures([one, two], percent)
        assert set(signature[owner == 0]) & set(signature[owner == 1]), (len(one), len(two))


def test_clustered_elements_fall_back_to_finer_cuts():
    near = np.arange(1, 41, dtype=np.uint64) << np.uint64(20)  # all in one part of the domain
    other = np.concatenate([near[:-5], near[-5:] + np.uint64(1)])
    signature, owner = partenum.set_signatures([near, np.sort(other)])
    assert _linked(near, np.sort(other))
    assert set(signature[owner == 0]) & set(signature[owner == 1])


def test_number_of_signatures_is_in_proportion():
    chance = np.random.default_rng(2)
    for size in (1, 5, 100, 1500, 20000):
        signature, _ = partenum.set_signatures([_set(chance, size)])
        assert len(signature) <= 2 * (size / 3 + 1) + 1


def _family(chance, words, edits):
    base = [f"w{chance.randrange(900)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(edits):
        base = list(base)
        for _ in range(max(1, words // 60)):
            base[chance.randrange(words)] = f"e{chance.randrange(10**6)}"
        out.append(" ".join(base))
    return out


def _corpus():
    chance = random.Random(11)
    texts = [None, "", "  \n", "one", "ONE", "two words", "two  words", "one"]
    for words in (5, 6, 9, 25, 60, 200, 700):
        for _ in range(3):
            texts += _family(chance, words, 4)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{chance.randrange(10**6)}" for _ in range(150)) for _ in range(25)]
    texts += [texts[20]] * 6
    chance.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("chunk", "pairs"), [(2048, 1 << 19), (3, 1 << 19), (2048, 5), (6, 3)])
def test_components_equal_brute_force(spark, monkeypatch, chunk, pairs):
    monkeypatch.setattr(partenum, "CHUNK", chunk)
    monkeypatch.setattr(partenum, "PAIRS", pairs)
    monkeypatch.setattr(partenum, "BLOCK_ROWS", 4)
    rows = _corpus()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = partenum.jaccard_components(frame, parts=7).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(jaccard_rows(rows))


def test_links_that_no_leader_has_are_found(spark):
    """Chains: the ends are far from the leader, and only neighbours link."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        at = 16 * i % 190
        words = [*words[:at], *(f"n{i}.{j}" for j in range(14)), *words[at + 14 :]]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = partenum.jaccard_components(frame, parts=3).collect()
    expected = jaccard_rows(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(expected)
    assert len({e[2] for e in expected}) < len(rows)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (9, text), (None, "lonely words are here now"), (3, "x"), (3, "y"), (3, "x")]
    frame = spark.createDataFrame(
        [(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, sketch int"
    )
    got = partenum.jaccard_components(frame, parts=2).collect()
    assert sorted(map(str, [(r.doc_id, r.component_id) for r in got])) == sorted(
        map(str, [(None, 9), (9, 9), (None, None), (3, 3), (3, 3), (3, 3)])
    )
    assert len({r.group for r in got}) == 4


def test_empty_table(spark):
    assert partenum.jaccard_components(spark.createDataFrame([], SCHEMA), parts=2).count() == 0


@pytest.mark.parametrize("size", [250_000, 9])
def test_components_of_paths_stars_and_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(components, "LINKS_PER_PART", size)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)] + [(i, 100) for i in range(101, 110)]
    odd = [(200, 200), (None, 3), (301, 300), (300, 301), (-7, 301)]
    frame = spark.createDataFrame(path + star + odd, "u long, v long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    expected = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {-7: -7, 300: -7, 301: -7}
    assert got == expected
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_tests_never_lose_a_link():
    chance = np.random.default_rng(4)
    sets = [_set(chance, 300)]
    for _ in range(30):
        keep = chance.permutation(len(sets[0]))[int(chance.integers(0, 80)) :]
        sets.append(np.unique(np.concatenate([sets[0][keep], _set(chance, int(chance.integers(0, 60)))])))
    sets += [_set(chance, n) for n in (1, 2, 20, 21, 22, 340, 345, 5000)]
    sketches = partenum._Sketches(pa.array([partenum._sketch(s) for s in sets], pa.binary()))
    for i, j in combinations(range(len(sets)), 2):
        apart = sketches.distances(np.array([i]), np.array([j]))[0]
        assert apart <= len(np.setxor1d(sets[i], sets[j]))
        assert partenum._similar(sets[i], sets[j], 75) == _linked(sets[i], sets[j])


def _many_texts():
    chance = np.random.default_rng(5)
    return [" ".join(f"w{x}" for x in chance.integers(0, 50_000, 400)) for _ in range(8000)]


def test_a_batch_of_many_texts_takes_little_memory():
    texts = pa.array(_many_texts(), pa.string())
    assert texts.nbytes > 16_000_000
    ids = pa.array(np.arange(len(texts)))
    rows = pa.RecordBatch.from_arrays([ids, ids, texts], names=["doc_id", "text_hash", "text"])
    only = pa.RecordBatch.from_arrays([texts], names=["text"])
    # with whole batches as Python strings, in groups of 4 Mi characters: 86 and 117 MB
    assert peak_of(lambda: sum(b.num_rows for b in partenum._set_rows([rows], 5))) < 25_000_000
    assert peak_of(lambda: sum(b.num_rows for b in partenum._signed_rows([only], 5, 75, 51))) < 40_000_000


def test_signatures_do_not_depend_on_how_texts_are_grouped():
    texts = [*_many_texts()[:700], None, "", "two words", "x" * 600_000]
    assert len(list(text_groups(pa.array(texts, pa.string())))) > 3
    sets = [s for s in partenum._sets(texts, 5) if len(s)]
    signature, owner = partenum.set_signatures(sets)
    nodes = np.array([partenum._node(s) for s in sets])[owner]
    got = []
    for batch in partenum._signed_rows([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})], 5, 75, 7):
        for part, s, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = np.frombuffer(s, np.uint64)
            assert (keys % np.uint64(7) == part).all()
            got += zip(keys.tolist(), np.frombuffer(n, np.int64)[np.frombuffer(o, np.uint32)].tolist(), strict=True)
    assert sorted(got) == sorted(zip(signature.tolist(), nodes.tolist(), strict=True))


def test_text_groups_hold_every_text_once():
    for texts in ([], [None], ["aa", None, "ж" * 3, "b" * 9, "", "c", "dd"], ["a"] * 20):
        column = pa.array(texts, pa.string())
        groups = [column[s].to_pylist() for s in text_groups(column, 5)]
        assert [t for g in groups for t in g] == texts
        assert all(len(g) == 1 or sum(len((t or "").encode()) for t in g) <= 5 for g in groups)
