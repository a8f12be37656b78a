import os

import pytest

from murmura.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_no_product_of_tables_and_pruned_scans(spark):
    found = registry.queries()
    for name in ("g1_reputation_score", "g4_competitor_benchmark", "x13_doc_feed", "al2_alert_evidence", "k1_newest_documents"):
        text = plan(found[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "l_comment" not in text and "l_shipinstruct" not in text
    text = plan(found["o3_retired_minus_active"](spark, SF))
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(l_shipdate" in text


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_top_lists_prune_before_the_shuffle(spark):
    text = plan(registry.queries()["k1_newest_documents"](spark, SF))
    assert "WindowGroupLimit" in text
