"""The attention classifier: gradients by differences, held-out accuracy, odd inputs."""

from __future__ import annotations

import numpy as np
import pytest

from tabulary.llm import attention


def test_gradients_are_those_of_the_log_loss():
    random = np.random.default_rng(3)
    bags = [random.random((n, attention.FEATURES)) for n in (1, 4, 2)]
    label = np.array([1.0, 0.0, 1.0])
    p = {n: x.astype(float) for n, x in attention.fit(bags, [1, 0, 1], steps=1).weights.items()}
    x, starts = np.concatenate(bags), np.array([0, 1, 5])

    def loss():
        s, _ = attention.Model(p).scores(x, starts)
        return -np.mean(label * np.log(s) + (1 - label) * np.log(1 - s))

    grad = attention.Model(p).gradients(x, starts, label)
    for name, value in p.items():
        at = tuple(random.integers(0, n) for n in value.shape)
        old = value[at]
        value[at] = old + 1e-5
        up = loss()
        value[at] = old - 1e-5
        slope = (up - loss()) / 2e-5
        value[at] = old
        assert grad[name][at] == pytest.approx(slope, rel=1e-3, abs=1e-7)


def test_attention_goes_to_the_passages_that_tell():
    """Bags of clean passages, some with one bad passage: the model finds it without passage labels."""
    random = np.random.default_rng(4)
    bags, labels = [], []
    for _ in range(300):
        bag = random.random((6, attention.FEATURES)) * 0.02
        bad = random.random() < 0.5
        if bad:
            bag[random.integers(0, 6), 7] = 1.0
        bags.append(bag)
        labels.append(int(not bad))
    model = attention.fit(bags[:200], labels[:200], steps=150)
    starts = np.arange(0, 600, 6)
    score, weight = model.scores(np.concatenate(bags[200:]).astype(np.float32), starts)
    assert np.mean((score >= 0.5) == np.array(labels[200:])) > 0.95
    marked = np.concatenate(bags[200:])[:, 7] == 1.0
    # an even share would be a sixth
    assert weight[marked].mean() > 0.3


def test_passages_cover_whole_texts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(1000))
    whole = attention.passages(text)
    assert len(whole) == -(-1000 // attention.WORDS)
    assert len(attention.passages("x " * 100_000)) <= attention.MOST
    assert len(attention.passages(None)) == len(attention.passages("")) == len(attention.passages(" \n")) == 1
    tail = attention.passages(text[: -len("w999")] + "###")
    assert (tail[:-1] == whole[:-1]).all() and (tail[-1] != whole[-1]).any()
    monkeypatch.setattr(attention, "BLOCK", 100)
    assert np.abs(attention.passages(text) - whole).max() < 0.2
    assert len(attention.passages("y" * 5000)) == 1


def test_scores_of_odd_rows_and_columns(spark):
    docs = spark.createDataFrame(
        [(1, "plain words here"), (1, "plain words here"), (2, None), (None, ""), (3, "z" * 300_000), (4, "long text " * 200_000)],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (9, 0), (3, 0)], "doc_id long, label int")
    model = attention.train(docs, labels, steps=20)
    rows = attention.score(docs.selectExpr("*", "'a' as label", "1 as id"), model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and len(r.attention) == r.n_passages for r in rows)
    same = [r.score for r in rows if r.doc_id == 1]
    assert same[0] == same[1]
    assert attention.score(docs.limit(0), model).collect() == []
    none = attention.train(docs, labels.limit(0))
    assert {r.score for r in attention.score(docs, none).collect()} == {0.5}
    with pytest.raises(ValueError, match="score"):
        attention.score(docs.selectExpr("*", "1 as score"), model)


def test_the_sample_is_bounded(spark):
    ids = spark.range(5000).selectExpr("id", "1 as label")
    some = attention._sampled(ids, 100).collect()
    assert len(some) == 100 and len(attention._sampled(ids.limit(30), 100).collect()) == 30


def test_held_out_documents(spark):
    from tabulary.llm import queries

    base = "/root/testdata/sf0.01"
    made = queries.QUERIES["op13_quality_classifier"](spark, base)
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "quality")
    rows = made.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
