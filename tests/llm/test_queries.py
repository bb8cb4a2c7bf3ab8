"""The registered queries against their oracles, and their contracts' columns."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tabulary.llm import queries
from tests.compare import canonical, connect, difference, oracle

COLUMNS = {
    "op1": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2": "doc_id n_shingles component_id",
    "op3": "vec_id n_links component_id kept",
    "op5": "doc_id held_out lang_pred score",
    "op6": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op8": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9": "page_id url text n_chars",
    "op10": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op11": "doc_id n_features weight score rank",
    "op12": "vec_id code error label_error codebooks_sha256",
    "op13": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_oracle(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    columns, expected, _ = oracle(connect(sf), queries.SQL[name])
    assert difference(canonical(df.columns, rows), canonical(columns, expected)) is None


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    numbers = sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in names
    assert set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_results_have_the_agreed_columns(spark, sf, name):
    wanted = COLUMNS.get(name.split("_")[0], "").split()
    if wanted and name.split("_")[0] not in ("op2", "op3"):  # these are compared above
        assert queries.QUERIES[name](spark, sf).columns[: len(wanted)] == wanted
