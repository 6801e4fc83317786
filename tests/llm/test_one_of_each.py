"""Null and reused ids: the decision is made by row."""

import pytest

from sparkveil.llm import near_copies, simhash

A = " ".join(f"a{i}" for i in range(80))
B, C, D = (A.replace("a", x) for x in "bcd")
ROWS = [(1, A), (None, A + " "), (None, B), (5, C), (5, D), (3, D + " "), (None, "x y z"), (None, "x y z ")]


@pytest.mark.parametrize("module", [simhash, near_copies])
def test_null_and_reused_ids(spark, module):
    out = module.one_of_each(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text.strip()) for r in out) == sorted([("1", A), ("None", B), ("5", C), ("3", D), ("None", "x y z")])
