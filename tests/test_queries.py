import os

import duckdb
import pytest

from murmura.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["g1_reputation_score", "g4_competitor_benchmark", "r6_risk_score", "al2_alert_evidence", "g18_risk_heatmap", "p4_split_slices", "j1_keyword_match", "t6_source_health_state"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [list(want.columns).index(c) for c in columns]
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(x[i]) for i in order)) for x in want.fetchall())
