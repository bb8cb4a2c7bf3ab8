from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulary.llm import ppm, queries

TEXTS = {
    "en": "The quick brown fox jumps over the lazy dog and the other animals of the wood. " * 3,
    "fr": "Le renard brun saute par-dessus le chien paresseux et les autres bêtes du bois. " * 3,
    "de": "Der schnelle braune Fuchs springt über den faulen Hund und die anderen Tiere im Wald. " * 3,
}


def _slow_bits(text, grams):
    """Code length by walking the contexts of one language, byte by byte."""
    data, starts = ppm._prepared([text])
    counts = {}
    for gram, n in grams.items():
        raw = gram.to_bytes(ppm.ORDER + 1, "big")
        for k in range(ppm.ORDER + 1):
            seen = counts.setdefault(raw[ppm.ORDER - k : ppm.ORDER], {})
            seen[raw[-1]] = seen.get(raw[-1], 0) + n
    total = 0.0
    for i in range(starts[0], len(data)):
        for k in range(ppm.ORDER, -1, -1):
            seen = counts.get(data[i - k : i].tobytes())
            if seen is None:
                continue
            whole, different = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (whole + different))
                break
            total -= math.log2(different / (whole + different))
        else:
            total += 8.0
    return total


def _counts():
    return {lang: dict(zip(*(x.tolist() for x in ppm._grams([t])), strict=True)) for lang, t in TEXTS.items()}


def test_tabulated_code_lengths_are_exact():
    counts = _counts()
    model = ppm.build_model(counts)
    texts = ["the dog and the fox", "le chien du bois", "Zzyzx 123 ÿ", "", "q", "  The  -- lazy!! Hund "]
    got = model.code_lengths(texts)
    for i, text in enumerate(texts):
        for k, lang in enumerate(model.languages):
            assert got[i, k] == pytest.approx(_slow_bits(text, counts[lang]), abs=1e-3)


def test_a_text_scores_alike_alone_and_in_a_batch():
    model = ppm.build_model(_counts())
    texts = [*TEXTS.values(), None, "x"]
    whole = model.code_lengths(texts)
    alone = np.concatenate([model.code_lengths([t]) for t in texts])
    assert np.allclose(whole, alone, atol=1e-3)


def test_few_contexts_still_give_a_model():
    model = ppm.build_model(_counts(), nodes=5)
    assert len(model.child) <= 7
    assert model.predict([TEXTS["fr"]])[0] == ["fr"]


def test_prediction_uses_text_only_and_handles_odd_rows(spark):
    rows = [(i, t, lang, "s") for i in range(40) for lang, t in TEXTS.items()]
    rows += [(500, None, "en", None), (501, "", "en", None), (502, "12 $$ --", "fr", None), (None, TEXTS["de"], None, None)]
    rows += [(503, TEXTS["en"] * 3000, None, None), (504, TEXTS["de"], None, None), (504, TEXTS["de"], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = ppm.train(docs)
    assert model.languages == ("de", "en", "fr")
    got = ppm.identify(docs.withColumnRenamed("source", "names"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (500, 501, 502):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert 0.9 < r.score <= 1.0
            assert r.lang_pred == {None: "de", 503: "en", 504: "de"}.get(r.doc_id, r.lang)
    with pytest.raises(ValueError, match="already has"):
        ppm.identify(docs.withColumn("score", F.lit(1)), model)


def test_every_label_is_learned(spark):
    chance = random.Random(5)
    rows = []
    for k in range(300):
        words = ["".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(6)]
        rows += [(2 * k + i, " ".join(chance.choices(words, k=60)), f"l{k:03}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ppm.train(docs)
    assert len(model.languages) == 300
    got = ppm.identify(docs, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.98


def test_training_equals_a_plain_count(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(TEXTS.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for nodes in (ppm.NODES, 40):
        got, plain = ppm.train(docs, nodes=nodes), ppm.build_model(_counts(), nodes)
        assert got.languages == plain.languages
        for x, y in ((got.symbol, plain.symbol), (got.child, plain.child), (got.bits, plain.bits)):
            assert np.array_equal(x, y)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    for frame in (docs, docs.limit(0)):
        model = ppm.train(frame)
        assert [(r.lang_pred, r.score) for r in ppm.identify(frame, model).collect()] == [("und", 0.0)] * frame.count()


def test_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op5_language_id"](spark, sf)
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(langs, "doc_id").collect()
    assert len(rows) == langs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    own = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in own]) >= 0.98


def _peak_of(work):
    """Bytes that ``work`` allocates at most, numpy's arrays included."""
    import tracemalloc

    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


@pytest.mark.parametrize("text", ["plain words of a long text " * 200_000, "天地玄黄宇宙洪荒日月盈昃" * 140_000, "a" * 5_000_000])
def test_a_text_of_five_megabytes_takes_little_memory(text):
    model = ppm.build_model(_counts())
    limits = [3.0] * len(model.languages)
    size = len(text.encode())
    assert _peak_of(lambda: model.judge([text, "the dog"], limits)) < 12 * size + 30_000_000
    alone = model.judge([text], limits)
    both = model.judge(["the dog", text, "der Hund"], limits)
    assert (alone[0][0], alone[1][0], alone[2][0]) == (both[0][1], both[1][1], both[2][1])


def test_one_walk_gives_predictions_and_fit(monkeypatch):
    model = ppm.build_model(_counts())
    texts = ["the dog and the fox", "le chien du bois", "", None, "Zzyzx 123 key42", "x" * 900, " der Hund  im Wald "] * 3
    limits = [2.0, 2.5, 3.0]
    names, score, fit = model.judge(texts, limits)
    assert names == model.predict(texts)[0] and (score == model.predict(texts)[1]).all()
    assert (fit == model.fits(texts, limits)).all()
    monkeypatch.setattr(ppm, "WALK_BYTES", 64)
    assert np.allclose(model.code_lengths(texts), model._walk(texts)[0])
    assert model.judge(texts, limits)[0] == names


def test_a_language_with_very_many_documents_is_sampled_by_its_hash(spark):
    rows = spark.range(30_000).selectExpr(
        "id as doc_id", "concat('text ', id) as text", "if(id % 100 = 0, 'rare', 'common') as lang"
    )
    got = {r.lang: r["count"] for r in ppm._sampled(rows, 50).groupBy("lang").count().collect()}
    assert got == {"rare": 50, "common": 50}
    order = rows.filter("lang = 'common'").orderBy(F.xxhash64("doc_id"), "doc_id").limit(50)
    assert {r.text for r in order.collect()} == {r.text for r in ppm._sampled(rows, 50).filter("lang = 'common'").collect()}
