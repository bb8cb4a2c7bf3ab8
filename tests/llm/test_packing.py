from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabulary.llm import packing
from tabulary.llm.queries import BYTE_BPE
from tests.llm.brute import peak_of

TOKENIZER = Tokenizer.from_file(BYTE_BPE)
SCHEMA = "doc_id long, text string"


def _check_plan(histogram, window):
    slots = packing.plan(histogram, window)
    filled = defaultdict(list)
    for length, first, after, sequence, offset in slots:
        for rank in range(first, after):
            filled[sequence + rank - first].append((offset, length))
    used = defaultdict(int)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
            used[length] += 1
        assert at <= window
    assert dict(used) == {k: v for k, v in histogram.items() if v}
    assert sorted(filled) == list(range(len(filled)))
    for length in histogram:  # ranks of a length are covered without gaps
        own = sorted((a, b) for k, a, b, _, _ in slots if k == length)
        assert [a for a, _ in own] == [0, *[b for _, b in own[:-1]]][: len(own)]
    return 1 - sum(k * v for k, v in histogram.items()) / (window * len(filled)) if filled else 0.0


def test_plans_hold_every_piece_once():
    chance = random.Random(2)
    for window in (8, 64, 1024):
        for n in (1, 5, 300, 20000):
            histogram = defaultdict(int)
            for _ in range(n):
                histogram[min(window, 1 + int(chance.expovariate(3 / window)))] += 1
            waste = _check_plan(dict(histogram), window)
            if n == 20000 and window == 1024:
                assert waste < 0.002


def test_awkward_histograms():
    assert packing.plan({}, 16) == []
    _check_plan({16: 3}, 16)
    _check_plan({1: 1}, 16)
    assert len(packing.plan({700: 10**12, 324: 10**12}, 1024)) == 2
    assert len(packing.plan({700: 10**12, 324: 10**12 - 1, 5: 9}, 1024)) <= 12


def test_counts_are_least_squares():
    """Against normal equations on a histogram that combinations can meet exactly."""
    combos = packing.combinations([3, 5, 2, 6, 1], 8)
    assert set(combos) == {(5, 3), (6, 2), (5, 2, 1), (6, 1, 1), (3, 3, 2)}
    wanted = np.array([10.0, 4, 0, 3, 7])
    histogram = np.zeros(9)
    for x, c in zip(wanted, combos, strict=True):
        for k in c:
            histogram[k] += x
    got = packing.solve_counts(combos, histogram, steps=3000)
    use = np.zeros(9)
    for x, c in zip(got, combos, strict=True):
        for k in c:
            use[k] += x
    assert (got >= 0).all() and np.abs(use - histogram).max() < 1e-2


ODD_TEXTS = [
    "", " ", "  \n\n x", "don't they'll we've I'm it's", "été Straße ÄÖ", "x² ½ Ⅷ", "a\x1cb\x1fc\x85d\xa0e",
    "漢字かな 한국어", "🙂🙂 👍🏽", "<|endoftext|>", "a<|endoftext|>b < | <|x", "12345 6.7 -8", "a" * 5000, " " * 3000 + "x",
    "é ‍   z", "Ελληνικά Русский", "﻿bom \x00 nul", "_under_score_ __ __x", "\t\ttabs \r\n",
    "İıſK", "͸԰", "ͅ ҈",
]


def test_ids_are_those_of_the_tokenizer(spark, sf):
    texts = ODD_TEXTS + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    encoder = packing.Encoder(BYTE_BPE)
    for some in (texts, texts[::-1]):
        for text, ids in zip(some, encoder.encode(some), strict=True):
            assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, text[:60]


def test_every_settled_character_is_split_alike():
    encoder = packing.Encoder(BYTE_BPE)
    plain = [chr(c) for c in range(0x20000) if not encoder.is_odd(chr(c))]
    assert len(plain) > 50_000
    texts = [f"{a}{c}b 1{c}2 {c}{c}  {c}!{c}" for a, c in zip("a1 !" * len(plain), plain, strict=False)]
    own = TOKENIZER.encode_batch(texts, add_special_tokens=False)
    for text, ids, expected in zip(texts, encoder.encode(texts), own, strict=True):
        assert ids.tolist() == expected.ids, ascii(text)


@pytest.mark.parametrize("window", [16, 1024])
def test_pieces_tile_documents_and_sequences(spark, many_parts, window):
    chance = random.Random(1)
    rows = [(i, " ".join(chance.choices(["one", "two", "three", "été"], k=chance.randrange(400)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "word " * 9000), (203, "twin"), (203, "twin"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA + ", rank int").repartition(6)
    got = packing.pack(frame, BYTE_BPE, window).collect()
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in rows:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id]})
        at = 0
        for start, length, crc, total in own:
            assert (start, total) == (at, len(ids))
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert len(by_doc[203]) == 2
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTE_BPE).count() == 0


def test_a_batch_of_many_texts_takes_little_memory():
    texts = pa.array([f"some words of text {i} " * 100 for i in range(10_000)], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], names=["doc_id", "text"])
    encoder = packing.Encoder(BYTE_BPE)
    # with the whole batch as Python strings: 26 MB
    assert peak_of(lambda: next(packing._piece_rows([batch], encoder, 0, 1024, 0))) < 12_000_000
