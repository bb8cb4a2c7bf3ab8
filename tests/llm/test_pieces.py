from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulary.llm import pieces
from tabulary.llm.queries import PIECES, QUERIES

REAL = pieces.load(PIECES)


def _best_score(unit, scores, byte_score):
    best = [0.0] + [-math.inf] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(end):
            if unit[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[unit[start:end]][1])
        if unit[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + byte_score * len(unit[end - 1].replace("▁", " ").encode()))
    return best[-1]


def _toy(chance):
    names = {"".join(chance.choices("ab▁", k=chance.randrange(1, 5))) for _ in range(8)}
    scores = {p: (256 + i, -chance.uniform(0.5, 6)) for i, p in enumerate(sorted(names))}
    return scores, pieces.Pieces(scores, range(256), -9.0)


def test_viterbi_equals_dynamic_programming():
    chance = random.Random(4)
    for _ in range(80):
        scores, own = _toy(chance)
        value = {i: s for i, s in scores.values()} | dict.fromkeys(range(256), -9.0)
        for _ in range(20):
            unit = "".join(chance.choices("ab▁é", k=chance.randrange(1, 12)))
            ids = own.best(unit)
            assert b"".join(own.spaced[i] for i in ids).decode() == unit.replace("▁", " ")
            assert sum(value[i] for i in ids) == pytest.approx(_best_score(unit, scores, -9.0))


def test_whole_text_is_best_too():
    """Cutting a text at its marks loses nothing."""
    chance = random.Random(6)
    for _ in range(60):
        scores, own = _toy(chance)
        value = {i: s for i, s in scores.values()} | dict.fromkeys(range(256), -9.0)
        text = "".join(chance.choices("ab ", k=chance.randrange(1, 15)))
        ids = own.encode(text)
        marked = "▁" + text.replace(" ", "▁")
        assert sum(value[i] for i in ids) == pytest.approx(_best_score(marked, scores, -9.0))
        assert own.decode(ids) == text


@given(st.text(max_size=60) | st.text(st.sampled_from(" ▁ab\n\té漢\U0001f642\x00"), max_size=30))
@settings(max_examples=400, deadline=None)
def test_round_trip(text):
    ids = REAL.encode(text)
    assert REAL.decode(ids) == text
    assert bool(ids) == bool(text)


def test_ties_go_to_the_longest_piece():
    own = pieces.Pieces({"a": (256, -1.0), "aa": (257, -2.0)}, range(256), -9.0)
    assert own.best("aa") == [257]


def test_columns(spark):
    long = "Unbelievably long words " * 20000
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, long), (4, long), (5, " ▁ ")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, piece int")
    coded = pieces.encode_column(frame, PIECES)
    back = pieces.decode_column(coded, PIECES).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t in rows)
    assert pieces.encode_column(frame.limit(0), PIECES).count() == 0
    nulls = spark.createDataFrame([(None,)], "ids array<int>")
    assert pieces.decode_column(nulls, PIECES).first().text == ""
    with pytest.raises(ValueError, match="already has"):
        pieces.encode_column(frame.withColumnRenamed("piece", "ids"), PIECES)


def test_query_decodes_every_document(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op7_sentencepiece"](spark, sf).join(
        docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("own")), "doc_id"
    )
    assert got.filter("own = decoded_sha256").count() == docs.count()
