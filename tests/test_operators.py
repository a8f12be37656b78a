import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from murmura.operators import alerts, gates, incidents, ingest, matching, planning, ranks
from murmura.operators.components import components


def test_two_key_dedupe_equals_arrival_order(spark):
    rng = random.Random(5)
    rows = [(i, f"u{rng.randrange(40)}", f"h{rng.randrange(40)}", datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(500))) for i in range(120)]
    rows += [(900, None, None, datetime(2024, 1, 1)), (901, None, "", datetime(2024, 1, 2))]
    urls, hashes, stored = set(), set(), set()
    for i, u, h, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if u not in urls and h not in hashes:
            urls.add(u), hashes.add(h), stored.add(i)
    got = ingest.ingest_dedupe(spark.createDataFrame(rows, "id long, url_key string, hash_key string, collected_at timestamp"))
    assert {r.id for r in got.collect()} == stored


def test_components_equal_closure(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 240)]
    root = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_steps_of_a_hub_stay_small_plans(spark, monkeypatch):
    from murmura.operators import components as module

    plans, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name, **o: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name, **o))
    edges = [(500, 501 + i) for i in range(1500)] + [(i, i + 1) for i in range(1990, 2030)] + [(7, 2030), (3, 2010)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 3 for e in edges for n in e}
    assert max(p.count("Join") for p in plans) == 4
    plans.clear()
    stars = [(r, n) for n, r in got.items() if n != r] + [(9000, 9001)]
    assert components(spark.createDataFrame(stars, "a long, b long")).count() == len(got) + 2
    assert len(plans) == 1  # what is settled takes no step


def test_components_with_tasks_joining_links_first(spark, monkeypatch):
    from murmura.operators import components as module

    monkeypatch.setattr(module, "LOCAL_NODES", 7)  # tasks put out their stars again and again
    rng = random.Random(3)
    edges = [((g, rng.randrange(25)), (g, rng.randrange(25)), g) for g in range(6) for _ in range(22)]
    root = {n: n for a, b, _ in edges for n in (a, b)}
    for _ in range(40):
        for a, b, _ in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a struct<g:int,i:int>, b struct<g:int,i:int>, g int")
    got = {tuple(r.node): tuple(r.root) for r in components(df, near="g").distinct().collect()}
    assert got == {n: r for n, r in root.items() if any(n in e[:2] and e[0] != e[1] for e in edges)}
    assert components(df.where("false"), near="g").count() == 0


def item(i, entity, title, at, event=None, name="EaseTravel"):
    return (i, entity, name, title, event, at, 60.0)


def test_incidents(spark):
    d = datetime(2024, 3, 1)
    rows = [
        item(1, 1, "ED raids EaseTravel office over betting app money - Outlet A", d),
        item(2, 1, "EaseTravel office searched by ED in betting app money probe - Outlet B", d + timedelta(days=3)),
        item(3, 1, "ED raids EaseTravel office over betting app money - Outlet C", d + timedelta(days=500)),
        item(4, 2, "ED raids EaseTravel office over betting app money - Outlet D", d),
        item(5, 1, "Texte sans rapport", d, "enforcement raid betting app office"),
        item(6, 1, "Autre texte", d + timedelta(days=1), "raid betting app office"),
        item(7, 1, "Airline adds routes to northern hills", None),
    ]
    names = "item_id long, entity_id long, entity_name string, title string, event string, published_at timestamp, score double"
    df = spark.createDataFrame(rows, names)
    got = {r.item_id: r.incident_id for r in incidents.incidents(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    summary = {r.incident_id: r for r in incidents.incident_summary(df, incidents.incidents(df)).collect()}
    assert summary[1]["items"] == 2 and summary[1].outlets == 2


def test_keyword_spans_are_longest_and_whole_words(spark):
    df = spark.createDataFrame([(1, "New York Times in new york; newyork york_x York"), (2, None)], "doc_id long, text string")
    got = sorted((r.keyword, r.start_idx) for r in matching.keyword_spans(df, ["New York", "york", "new york times"]).collect())
    assert got == [("new york", 18), ("new york times", 0), ("york", 43)]


def test_brand_gate_leaves_clients_without_brand(spark):
    entities = spark.createDataFrame([(1, 10, "brand"), (2, 10, "person"), (3, 20, "person"), (4, 20, None)], "entity_id long, client_id long, entity_type string")
    facts = spark.createDataFrame([(10, 100), (10, 101), (20, 101)], "client_id long, document_id long")
    mentions = spark.createDataFrame([(100, 1), (101, 2), (101, 3)], "document_id long, entity_id long")
    got = gates.brand_gate(facts, gates.brand_documents(mentions, entities), entities)
    assert sorted(map(tuple, got.collect())) == [(10, 100), (20, 101)]
    typed = spark.createDataFrame([("competitor",), (None,), ("brand",)], "entity_type string")
    assert gates.without_competitors(typed).count() == 2


def test_slices_tile_the_range(spark):
    ranges = spark.createDataFrame([(1, date(2024, 1, 17), date(2024, 4, 3)), (2, date(2024, 1, 1), date(2024, 1, 1))], "k int, start_date date, end_date date")
    for rows in (planning.calendar_slices(ranges, 1), planning.fixed_day_slices(ranges, 10)):
        got = sorted((r.slice_start, r.slice_end) for r in rows.collect())
        assert got[0][0] == date(2024, 1, 17) and got[-1][1] == date(2024, 4, 3)
        assert all(a[1] == b[0] for a, b in zip(got, got[1:]))
    halves = planning.split_slices(planning.fixed_day_slices(ranges, 200).withColumn("n", F.lit(100)), "n", 100)
    assert sorted((r.slice_start, r.slice_end) for r in halves.collect()) == [(date(2024, 1, 17), date(2024, 2, 24)), (date(2024, 2, 24), date(2024, 4, 3))]
    day = spark.createDataFrame([(1, date(2024, 1, 1), date(2024, 1, 2), 500)], "k int, slice_start date, slice_end date, n int")
    assert planning.split_slices(day, "n", 100).count() == 1


def test_alert_merge(spark):
    kind = "client_id long, alert_type string, entity_id long, severity string, documents array<bigint>, evidence_score double, confidence_score double"
    stored = spark.createDataFrame([(1, "A", 1, "HIGH", [5], 50.0, 60.0, "CLOSED", ["x"]), (1, "A", 2, "WARNING", [6], 10.0, 20.0, "ACTIVE", ["x"])], kind + ", lifecycle_status string, history array<string>")
    new = spark.createDataFrame([(1, "A", 1, "WARNING", [7, 5], 40.0, 70.0), (1, "A", 3, "CRITICAL", [8], 90.0, 90.0)], kind)
    got = {r.entity_id: r for r in alerts.merge_alerts(stored, new).collect()}
    assert got[1].severity == "HIGH" and got[1].documents == [5, 7] and got[1].lifecycle_status == "ACTIVE" and got[1].history == ["x", "CLOSED>ACTIVE"]
    assert got[2].lifecycle_status == "ACTIVE" and got[2].history == ["x"] and got[3].history == ["NEW"] and got[3].lifecycle_status == "NEW"
    assert got[1].confidence_score == 70.0


def test_upsert_twice_is_once(spark):
    a = spark.createDataFrame([(1, 5), (None, 3)], "k long, v int")
    b = spark.createDataFrame([(1, 7), (2, 1), (None, 2)], "k long, v int")
    once = ingest.merge_upsert(a, b, ["k"], [F.desc("v")])
    twice = ingest.merge_upsert(once, b, ["k"], [F.desc("v")])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.count() == 3


def test_cumulative_cap(spark):
    rows = spark.createDataFrame([(1, k, 4) for k in range(5)], "e int, s int, n int")
    got = ranks.cumulative_cap(rows, ["e"], ["s"], "n", 10)
    assert [r.status for r in got.orderBy("s").collect()] == ["KEPT"] * 3 + ["SKIPPED"] * 2
