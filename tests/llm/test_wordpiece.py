from __future__ import annotations

import random

import pytest

from tabulary.llm import wordpiece
from tabulary.llm.queries import PIECES


def _greedy(word, initial, continuing):
    count, at = 0, 0
    while at < len(word):
        own = initial if at == 0 else continuing
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), None)
        if end is None:
            return -1
        count, at = count + 1, end
    return count


def test_counts_equal_greedy_longest_match():
    chance = random.Random(1)
    for _ in range(150):
        initial = {"".join(chance.choices("abc", k=chance.randrange(1, 6))) for _ in range(chance.randrange(1, 9))}
        continuing = {"".join(chance.choices("abc", k=chance.randrange(1, 6))) for _ in range(chance.randrange(0, 9))}
        automaton = wordpiece.Automaton(sorted(initial), sorted(continuing))
        for _ in range(60):
            word = "".join(chance.choices("abcd", weights=[9, 9, 9, 1], k=chance.randrange(1, 14)))
            assert automaton.count(word) == _greedy(word, initial, continuing), (initial, continuing, word)


def test_real_vocabulary_equals_greedy_longest_match():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    usual = [model.id_to_piece(i) for i in range(259, model.get_piece_size())]
    initial = {p[1:] for p in usual if p[0] == "▁" and "▁" not in p[1:]}
    continuing = {p for p in usual if "▁" not in p}
    automaton = wordpiece.load(PIECES)
    for word in "the unbelievableness antidisestablishment straße été 12345 x▁y Ω漢字 thththe".split():
        assert automaton.count(word) == _greedy(word, initial, continuing)


def test_texts(spark):
    long = "unbelievable " * 20000
    rows = [(1, "the the"), (2, None), (3, ""), (4, " \n"), (5, long), (5, long), (6, "\U0001f9ff\U0001f9ff the")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, words int")
    got = wordpiece.token_counts(frame, PIECES).collect()
    by_id = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in got}
    one = wordpiece.load(PIECES).count("unbelievable")
    assert len(got) == 7
    assert by_id[1] == (2, 2, 0) and by_id[2] == by_id[3] == by_id[4] == (0, 0, 0)
    assert by_id[5] == (20000, 20000 * one, 0)
    assert by_id[6][0] == 2 and by_id[6][2] in (0, 1)
    assert wordpiece.token_counts(frame.limit(0), PIECES).count() == 0
    with pytest.raises(ValueError, match="already has"):
        wordpiece.token_counts(frame.withColumnRenamed("words", "n_words"), PIECES)
