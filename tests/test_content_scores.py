"""A content score is made without what only other scores need."""

import pytest

from reviewrec.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", ["con1_helpful_log", "con1_verified_rate", "con2_satisfaction", "con4_popularity"])
def test_no_price_or_date_is_shuffled(spark, sf, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the three tables are read in this plan, not in one that was written before
    assert all(key in plan for key in ("l_orderkey", "o_orderkey", "p_partkey"))
    assert "median(" not in plan and "max(l_shipdate" not in plan and "Cross" not in plan
    assert df.columns == ["item_id", name.split("_", 1)[1]] and not df.isEmpty()
