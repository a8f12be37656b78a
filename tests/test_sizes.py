"""Plans at size: what grows with the rows is neither broadcast nor carried through shuffles it isn't needed in."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from murmura import scratch
from murmura.functions import text
from murmura.operators import components, incidents, lookups, terms
from murmura.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written_plans(monkeypatch, *modules):
    """Plans of the tables that ``modules`` write between jobs, as they go."""
    seen = []

    def materialize(df, name, **options):
        seen.append((name, plan(df)))
        return scratch.materialize(df, name, **options)

    for m in modules:
        monkeypatch.setattr(m, "materialize", materialize)
    return seen


def broadcasts(text):
    return [line for line in text.split("\n") if "BroadcastHashJoin" in line]


def incident_rows(spark):
    titles = ["harbour bridge tunnel ledger closes", "harbour bridge tunnel ledger signal", "orchard voucher reactor turbine opens"]
    rows = [(i, i % 2, "Zzz", titles[i % 3], None, datetime(2024, 1, 1 + i), float(i)) for i in range(12)]
    return spark.createDataFrame(rows, "item_id long, entity_id long, entity_name string, title string, event string, published_at timestamp, score double")


def test_incidents_broadcast_no_table_of_items(spark, monkeypatch):
    seen = written_plans(monkeypatch, incidents, components)
    groups = incidents.incidents(incident_rows(spark))
    assert {"story-keys", "links", "stars"} & {name for name, _ in seen} >= {"story-keys", "links"}
    # Heavy keys, fewer than a row in BLOCK, are the only table that is broadcast.
    assert [line for name, text in [*seen, ("groups", plan(groups))] for line in broadcasts(text) if "LeftAnti" not in line] == []
    assert {r.item_id: r.incident_id for r in groups.collect()} == {i: {0: 0, 1: 1}[i % 2] if i % 3 < 2 else (2 if i % 2 == 0 else 5) for i in range(12)}


def test_components_broadcast_no_table_of_nodes(spark, monkeypatch):
    seen = written_plans(monkeypatch, components)
    edges = scratch.materialize(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"), "chain")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == dict.fromkeys(range(10), 0) and len(seen) > 2
    assert [line for _, text in seen for line in broadcasts(text)] == []


def test_segments_keep_digits_at_the_ends_of_paragraphs(spark):
    whole = "001 first 0\n  1 second 11 \n22 third harbour 2\n3 fourth 33"
    df = spark.createDataFrame([(whole,)], "t string").select(text.high_value_segments(F.lit("001 first 0"), F.col("t"), ["harbour"]).alias("s"))
    assert df.first().s == "Title: 001 first 0\n\n001 first 0\n\n1 second 11\n\n22 third harbour 2"


def test_competitor_gate_copies_no_text(spark):
    terms = [(1, " the re ", []), (3, " ertion ", [" onre ", " eaux ", None]), (4, " the ", None), (5, " the ", [" re "]), (6, " re x ", None), (7, None, [])]
    leads = [(10, " the re x ", " the re x "), (11, " ertion ", " ertion and eaux "), (12, " ertion ", " ertion eauxs "), (13, " there ", " there re "), (14, None, " the "), (15, " the ", None), (10, " the re ", " a ")]
    got = lookups.competitor_documents(spark.createDataFrame(leads, "document_id long, lead string, text string"), spark.createDataFrame(terms, "entity_id int, name string, context array<string>"))
    assert sorted((r.entity_id, r.document_id) for r in got.collect()) == [(1, 10), (3, 11), (5, 10), (6, 10)]
    # Only ids are shuffled.
    text_plan = plan(got)
    assert "Join" not in text_plan and "Generate" not in text_plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_document_feed_shuffles_texts_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = registry.queries()["x13_doc_feed"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The joins in the branch that holds the texts: with the (client, document) rows, extracted entities, topic and source.
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(nodes) if "AS normalized_content" in line)
    above, least = [], depth(nodes[at])
    for line in reversed(nodes[:at]):
        if depth(line) < least:
            least = depth(line)
            above.append(line)
    assert sum("Join" in line for line in above) == 4


def test_names_and_review_broadcast_nothing(spark, monkeypatch):
    names = spark.createDataFrame([(1, f"harbour works {i}", "brand") for i in range(4)], "client_id long, name string, kind string")
    got = incidents.near_duplicate_names(names, names)
    assert broadcasts(plan(got)) == [] and got.count() == 16
    seen = written_plans(monkeypatch, terms)
    rows = spark.createDataFrame([("c", f"harbour works {i}", 0, 0.5, i) for i in range(4)], "client_id string, name string, tier int, confidence double, mentions long")
    led = terms.candidate_review(rows)
    assert {r.leader for r in led.collect()} == {"harbour works 3"} and len(seen) > 3
    assert [line for text in [*(t for _, t in seen), plan(led)] for line in broadcasts(text)] == []
