"""Registered queries against their SQL on the smallest tables."""

import pytest
from oracle_check import compare, duck

from cohortflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    out = compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert out["cols_match"] and out["hash_match"], out


def test_toxicity_held_out_accuracy(spark):
    """Held-out accuracy on the small table, well above always answering clean."""
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_toxicity"](spark, sf).filter("held_out").join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.9
    assert got["predicted"][got["toxic"] == 0].mean() < 0.03
