"""Operators that SQL can express against DuckDB, and every registered query over whole tables."""

import os

import pytest

from tests.oracle import compare, connect
from weftline.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", ["op1_token_counts", "op2_sentence_pieces", "op3_license_scan", "op4_language_id", "op9_token_store", "op12_quality_classifier"])
def test_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = QUERIES[name](spark, SF)
    assert out.count() == docs.count() and out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
