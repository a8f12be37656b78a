"""JSON merges and upserts, keyword rosters, relevance, intervals, slices, tiers: against brute force or hand-made cases."""

import json
import random
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmura.functions import jsons
from murmura.functions.udtfs import CalendarSlices
from murmura.operators import alerts, domains, ingest, lookups, matching, planning, relevance, risk
from murmura.operators.automaton import Keywords
from murmura.operators.intervals import interval_totals


def test_merged_and_stripped_json(spark):
    rows = [
        ('{"a":1,"b":{"x":1,"y":[1,"2",null]},"s":"t","n":5}', '{"b":{"z":2,"x":"n"},"c":12,"n":null}'), (None, '{"q":true}'), ('{"a":1}', None), ("[1]", '"x"'), ("bad", "{}"),
        ('{"a":{"b":{"c":1}}}', '{"a":{"b":{"d":2}}}'),
    ]
    df = spark.createDataFrame(rows, "o string, n string")
    got = df.select(jsons.merged_json(F.col("o"), F.col("n")).alias("flat"), jsons.merged_json(F.col("o"), F.col("n"), 3).alias("deep")).collect()
    read = lambda t: json.loads(t) if t is not None else None
    assert [read(r.flat) for r in got] == [{"a": 1, "b": {"x": "n", "z": 2}, "c": 12, "n": None, "s": "t"}, {"q": True}, {"a": 1}, None, {}, {"a": {"b": {"d": 2}}}]
    assert read(got[0].deep)["b"] == {"x": "n", "y": [1, "2", None], "z": 2} and read(got[5].deep) == {"a": {"b": {"c": 1, "d": 2}}}


def random_json(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, 2.5, None, True, "trend", 'q"}{,', [], {}])
    if rng.random() < 0.4:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["trend", "myTrendX", "a", "b", 'k"', "tr\\end", "TREND_w", "c,d"]) + str(rng.randrange(3)): random_json(rng, depth - 1) for _ in range(rng.randrange(5))}


def test_stripped_json_at_any_depth(spark):
    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if "trend" not in k.lower()}
        return [strip(v) for v in x] if isinstance(x, list) else x

    rng = random.Random(1)
    for _ in range(500):
        x = random_json(rng, 6)
        assert json.loads(jsons.without_keys(json.dumps(x, indent=rng.choice([None, 2])), "trend")) == strip(x)
    deep = '{"a":' * 3000 + '{"trend_weight":1,"kept":1.50}' + "}" * 3000
    assert jsons.without_keys(deep, "trend") == deep.replace('"trend_weight":1,', "")
    df = spark.createDataFrame([('{"a":{"trend_weight":1}}',), (None,), ("no json",)], "p string")
    assert [r[0] for r in df.select(jsons.stripped_json(F.col("p"), "trend")).collect()] == ['{"a":{}}', None, None]


def test_upserts_equal_arrivals_in_order(spark):
    rng = random.Random(4)
    stored, new = [], []
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    for key in range(40):
        if rng.random() < 0.7:
            stored.append((key, key, None, rng.choice(["llm", "rule"]), at(rng.randrange(30)), json.dumps({rng.choice("abcd"): f"s{key}", "own": key})))
        for i in range(rng.randrange(6)):
            new.append((key, key, None, rng.choice(["llm", "rule", "rule", None]), at(40 * rng.randrange(2) + i), json.dumps({c: f"n{key}.{i}" for c in "abcd" if rng.random() < 0.5})))
    names = "client_id int, document_id int, entity_id int, role_source string, computed_at timestamp, explainability string"
    want = {r[0]: (r[3], r[4], json.loads(r[5])) for r in stored}
    for r in sorted(new, key=lambda r: (r[4], r[3] == "llm")):
        rank = lambda x: (x[0] == "llm", x[1])
        old = want.get(r[0])
        if old is None or rank((r[3], r[4])) >= rank(old):
            want[r[0]] = (r[3], r[4], (old[2] if old else {}) | json.loads(r[5]))
    got = risk.upsert_events(spark.createDataFrame(stored, names), spark.createDataFrame(new, names), "explainability").collect()
    for r in got:
        source, when, merged = want[r.client_id]
        assert (r.role_source, r.computed_at, json.loads(r.explainability or "{}")) == (source, when, merged), r
    assert len(got) == len(want)


def test_alert_and_row_merges_keep_stored_keys(spark):
    names = "client_id int, alert_type string, entity_id int, severity string, documents array<bigint>, evidence_score double, confidence_score double"
    stored = spark.createDataFrame([(1, "t", 1, "HIGH", [1], 1.0, 1.0, "ACTIVE", ["seed"], '{"ai_summary":{"x":1},"why":"old"}')], names + ", lifecycle_status string, history array<string>, explainability string")
    new = spark.createDataFrame([(1, "t", 1, "HIGH", [2], 2.0, 2.0, '{"why":"new"}'), (1, "t", 2, "HIGH", [2], 2.0, 2.0, '{"why":"first"}')], names + ", explainability string")
    got = {r.entity_id: json.loads(r.explainability) for r in alerts.merge_alerts(stored, new).collect()}
    assert got == {1: {"ai_summary": {"x": 1}, "why": "new"}, 2: {"why": "first"}}
    a = spark.createDataFrame([(1, 5, '{"x":1,"y":1}'), (None, 1, '{"n":1}')], "k int, v int, j string")
    b = spark.createDataFrame([(1, 9, '{"y":2,"z":[2]}'), (None, 0, None), (2, 1, None)], "k int, v int, j string")
    rows = {r.k: (r.v, r.j) for r in ingest.merge_upsert(a, b, ["k"], [F.desc("v")], "j").collect()}
    assert rows == {1: (9, '{"x":1,"y":2,"z":[2]}'), None: (1, '{"n":1}'), 2: (1, None)}


# -- keywords and relevance ---------------------------------------------------------------------------------------------


def brute_spans(low, keywords):
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    out, at = [], 0
    while at < len(low):
        best = None
        for k in keywords:
            end = at + len(k)
            if low.startswith(k, at) and not (word(k[0]) and at and word(low[at - 1])) and not (word(k[-1]) and end < len(low) and word(low[end])):
                best = k if best is None or len(k) > len(best) else best
        if best:
            out.append((at, at + len(best), best))
            at += len(best)
        else:
            at += 1
    return out


def test_keyword_automaton_equals_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        make = lambda n: "".join(rng.choice("ab é-_ 1") for _ in range(n))
        keywords = sorted({k for k in (make(rng.randrange(1, 6)) for _ in range(12)) if k})
        text = make(rng.randrange(60)) + rng.choice(["", "￿ ab"])
        assert Keywords(keywords).spans(text) == brute_spans(text.replace("￿", "￾"), keywords), (keywords, text)


def test_keyword_work_does_not_grow_with_the_roster():
    text = " ".join(["the", "house"] * 20_000)
    took = []
    for n in (1_000, 200_000):
        known = Keywords([f"the w{i}" for i in range(n)] + ["the house the house"])
        began = time.process_time()
        assert len(known.spans(text)) == 10_000
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0] + 0.5


def test_keyword_spans_of_an_empty_roster(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert matching.keyword_spans(df, []).count() == 0 and matching.keyword_spans(df.where("false"), ["a"]).count() == 0


def test_relevance_rules_split_bare_aliases_and_need_context(spark):
    entities = spark.createDataFrame([(1, 1, "Orris Limited", "brand"), (1, 2, "Orris Homes", "competitor"), (2, 3, "Nova Grid", "brand")], "client_id int, entity_id int, entity_name string, entity_type string")
    words = [(1, "Orris Limited"), (1, "orris limited"), (1, "OrrisLimited"), (1, "Orris"), (2, "Orris Homes"), (3, "Nova Grid"), (3, "NG")]
    terms = spark.createDataFrame(words, "entity_id int, term string")
    settings = spark.createDataFrame([(1, None, ["dubai", "orris realty"])], "client_id int, context array<string>, exclude array<string>")
    rules = relevance.relevance_rules(entities, terms, settings)
    named = {(r.client_id, r.term, r.kind) for r in rules.where("kind IN ('full', 'bare', 'exclude')").collect()}
    assert named == {(1, "orris limited", "full"), (1, "orrislimited", "full"), (1, "orris", "bare"), (2, "nova grid", "full"), (1, "dubai", "exclude"), (1, "orris realty", "exclude")}
    cases = [
        ("Results of Orris Limited", "", "google_news", True), ("Orris opens a quay", "", "google_news", False), ("A dividend from Orris", "", "google_news", True),
        ("Orris tower in Bangalore", "", "youtube", True), ("Orris tower", "in Bangalore", "youtube", False), ("Orris tower in Bangalore", "our Dubai office", "youtube", False),
        ("Orris in Bangalore", "our Dubai office", "google_news", True), ("Orris Realty hires", "Dubai developer", "google_news", False), ("Orrisson in India", "", None, False),
        ("ORRIS-Ltd.", None, None, True), (None, None, None, False), ("Dubai and Bangalore", "", "google_news", False), ("Orris LIMITED", "dubai", "youtube", True),
    ]
    docs = spark.createDataFrame([(i, t, c, s) for i, (t, c, s, _) in enumerate(cases)], "doc_id int, title string, content string, source string")
    got = {r.doc_id for r in relevance.relevant(docs, rules).where("client_id = 1").collect()}
    assert got == {i for i, c in enumerate(cases) if c[3]}


def test_risk_words_and_phrases(spark):
    df = spark.createDataFrame([("A rera-order", None), (None, "FRAUD!"), ("fraudulent courts", ""), ("", None), ("no", "a consumer_complaint")], "t string, c string")
    assert [r[0] for r in df.select(relevance.has_risk_word(F.col("t"), F.col("c"))).collect()] == [True, True, False, False, True]
    held = lambda p: [r[0] for r in df.select(relevance.mentions_phrase(p, [F.col("t"), F.col("c")])).collect()]
    assert held("RERA order") == [True, False, False, False, False] and held("order fraud") == [False] * 5 and all(held("-"))


def test_generated_keywords_follow_the_rules(spark):
    df = spark.createDataFrame([(1, "Ease My Trip Ltd"), (2, "sobha"), (3, "Co Ltd"), (4, None)], "entity_id int, entity_name string")
    rows = [(r.entity_id, r.keyword, r.category, r.priority) for r in matching.generated_keywords(df).collect()]
    assert [r for r in rows if r[2] not in ("RISK",)] == [
        (1, "Ease My Trip Ltd", "PRIMARY", 10), (1, "ease my trip ltd", "ALIAS", 5), (1, "EaseMyTripLtd", "ALIAS", 5), (1, "Ease My Trip", "ALIAS", 8), (1, "EaseMyTrip", "ALIAS", 8),
        (1, "CEO of Ease My Trip Ltd", "EXECUTIVE", 7), (2, "sobha", "PRIMARY", 10), (2, "CEO of sobha", "EXECUTIVE", 7), (3, "Co Ltd", "PRIMARY", 10), (3, "co ltd", "ALIAS", 5), (3, "CoLtd", "ALIAS", 5), (3, "CEO of Co Ltd", "EXECUTIVE", 7),
    ]
    assert len([r for r in rows if r[2] == "RISK"]) == 12 and {r[3] for r in rows if r[2] == "RISK"} == {9}


def test_surnames_of_own_brands_are_refused(spark):
    single = spark.createDataFrame([(1, "Godrej"), (1, "Rao"), (1, "Lee"), (1, "Mono"), (2, "Godrej")], "client_id int, word string")
    people = spark.createDataFrame([(1, 1, "Adi Godrej"), (1, 2, "Ann Rao"), (1, 3, "A Lee"), (1, 4, "B Lee"), (1, 5, "Mono"), (2, 6, " Adi  Godrej ")], "client_id int, entity_id int, entity_name string")
    own = spark.createDataFrame([(1, "Godrej-Properties Ltd", "brand"), (1, "Rao Person", "person")], "client_id int, entity_name string, entity_type string")
    got = {(r.client_id, r.word, r.entity_id) for r in lookups.surname_attach(single, people, lookups.own_words(own)).collect()}
    assert got == {(1, "Rao", 2), (2, "Godrej", 6)}


# -- intervals, slices, tiers, peers ------------------------------------------------------------------------------------


def test_interval_totals_equal_a_join(spark):
    rng = random.Random(8)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(400))
    calls = [(rng.choice([1, 2, 3, None]), at(), rng.choice([1, 2, None])) for _ in range(400)]
    runs = [(rng.choice([1, 2, 3, 4]), i, *(sorted((at(), at())) if i % 9 else (at(), None))) for i in range(60)] + [(1, 100, datetime(2023, 1, 1), datetime(2025, 1, 1)), (2, 101, datetime(2024, 2, 1), datetime(2024, 1, 1))]
    want = {}
    for k, i, a, b in runs:
        inside = [n for c, t, n in calls if c == k and b is not None and a <= t <= b]
        if inside:
            want[i] = (len(inside), sum(n or 0 for n in inside))
    got = interval_totals(
        spark.createDataFrame(calls, "k int, at timestamp, n int"), spark.createDataFrame(runs, "k int, run int, a timestamp, b timestamp"), "k", at="at", start="a", end="b", by=["run"], sums={"tokens": "n"}
    ).collect()
    assert {r.run: (r.n, r.tokens) for r in got} == want


def brute_slices(start, end, months):
    out = []
    while start < end:
        k = ((start.month - 1) // months + 1) * months
        after = date(start.year + k // 12, k % 12 + 1, 1)
        out.append((start, min(after, end)))
        start = after
    return out


@pytest.mark.parametrize("months", [1, 3, 6, 12])
def test_calendar_slices_start_at_multiples_of_the_year(spark, months):
    ranges = [(date(2015, 5, 17), date(2017, 2, 3)), (date(2015, 12, 31), date(2016, 1, 1)), (date(2015, 1, 1), date(2015, 1, 1))]
    got = planning.calendar_slices(spark.createDataFrame(ranges, "start_date date, end_date date"), months).collect()
    assert sorted((r.slice_start, r.slice_end) for r in got) == sorted(s for a, b in ranges for s in brute_slices(a, b, months))
    assert [s for a, b in ranges for s in CalendarSlices().eval(a, b, months)] == [s for a, b in ranges for s in brute_slices(a, b, months)]


def test_plan_slices_clips_by_source(spark):
    rows = [(1, "brand", 1, False, "g", "y", "d", "h"), (1, "seed_risk", 2, True, "g2", "", "d2", None), (1, "odd", 3, False, "g3", "y3", None, "h3")]
    specs = spark.createDataFrame(rows, "client_id int, kind string, entity_id int, seeded boolean, google_news string, youtube string, gdelt string, hn string")
    end = date(2020, 7, 10)
    got = planning.plan_slices(specs, start="2015-02-03", end=str(end), youtube_year=2019)
    want = {("google_news", "g", *s) for s in brute_slices(date(2015, 2, 3), end, 1)} | {("youtube", "y", *s) for s in brute_slices(date(2019, 1, 1), end, 1)}
    want |= {("hn", "h", *s) for s in brute_slices(date(2015, 2, 3), end, 12)} | {("google_news", "g2", *s) for s in brute_slices(end - timedelta(days=730), end, 12)}
    day = end - timedelta(days=89)
    while day < end:
        want |= {("gdelt", q, day, min(day + timedelta(days=15), end)) for q in ("d", "d2")}
        day += timedelta(days=15)
    rows = {(r.source, r.query, r.slice_start, r.slice_end) for r in got.collect()}
    assert rows == want and got.count() == len(want)
    left = planning.plan_slices(specs, start="2015-02-03", end=str(end), youtube_year=2019, planned=got.where("source <> 'hn'"))
    assert {r.source for r in left.collect()} == {"hn"}


def test_domain_tiers(spark):
    from murmura.plans.q_rules import _HOSTS

    rows = [(h, None) for h, _, _ in _HOSTS] + [("www.acmetowers.co.in", "Acme Towers"), ("acmegroup.com", "Acmegroup and Sons"), ("acme.com", "Acme"), (None, "x"), ("", None), ("http://u:p@Reuters.com:80/x", None)]
    df = spark.createDataFrame(rows, "url string, client_name string").withColumn("host", domains.host_of(F.col("url")))
    got = {(r.host, r.client_name): (r.tier, r.proposed, r.low_reliability) for r in domains.domain_tiers(df).collect()}
    for _, host, tier in _HOSTS:
        want = "unrated" if ":" in tier else "medium" if tier == "proposed" else tier
        assert got[host, None] == (want, tier == "proposed", want in ("low", "user_generated", "unrated")), host
    assert got["acmetowers.co.in", "Acme Towers"][:2] == ("own", False) and got["acmegroup.com", "Acmegroup and Sons"][0] == "own"
    assert got["acme.com", "Acme"][0] == "unrated" and got[None, "x"][0] == "unrated" and got["reuters.com", None][0] == "high"


def test_peers_and_sources(spark):
    rows = [("b", True, 1, [], 5), ("a", True, 1, None, 5), ("c", False, 9, [1], 0), ("d", False, 9, [1, 2], 7), ("e", None, None, [3], None), ("f", False, 9, [1], 3)]
    df = spark.createDataFrame(rows, "name string, tracked boolean, seen_in int, positions array<int>, news_count int").withColumn("client_id", F.lit(1))
    assert [r.name for r in lookups.ranked_peers(df).orderBy("place").collect()] == ["a", "b", "f", "c", "d", "e"]
    cases = [
        (False, 0.9, True, "rss", "", 0.65), (True, None, False, "rss", "", 0.65), (True, None, True, "gdelt", "", 1.0), (True, 0.9, True, "RSS", "x.com", 0.8), (True, 0.7, True, "rss", None, 0.7),
        (True, 0.2, True, "rss", "https://FT.com/a", 1.0), (True, 0.9, True, "Reddit", "reuters.com", 0.6), (True, 0.5, True, "forum", "", 0.5), (True, 0.9, True, None, None, 0.9),
    ]
    df = spark.createDataFrame(cases, "known boolean, score double, category boolean, kind string, url string, want double")
    base = F.when(F.col("category"), F.struct("score"))
    assert all(abs(r[0] - r[1]) < 1e-9 for r in df.select(lookups.source_reliability(F.col("known"), base, F.col("kind"), F.col("url")), "want").collect())


def test_trailing_legal_words(spark):
    cases = {
        "Orris Limited": "Orris", "Acme Pvt. Ltd.": "Acme", "L.L.C. Foo": None, "Foo Bar, Inc": "Foo Bar", "Foo  Bar Inc.": "Foo Bar", "Incredible": None, "Co": None, "ABC Ltd": None,
        "Company of Heroes": None, "limited": None, "Nord & Co. Ltd": "Nord", "x Ltd Group": None, " Padded Corp ": "Padded",
    }
    from murmura.functions.text import without_legal_words

    df = spark.createDataFrame([(n,) for n in cases], "n string")
    assert [r[0] for r in df.select(without_legal_words(F.col("n"))).collect()] == list(cases.values())


def test_spellings_of_one_company(spark):
    names = ["Prestige", "Prestige Estates Projects Limited", "Prestige Ltd", "PRESTIGE, Inc", "Yatra.com", "Yatra Online Limited", "Reliance", "Reliance Retail", "Ltd", "A & B", "A and B Group", "Prestige Projects Estates Online", "Estates"]
    df = spark.createDataFrame([(1, n) for n in names] + [(2, "Prestige"), (1, None), (1, "Prestige")], "client_id int, name string")
    got = {(r.a, r.b, r.basis) for r in lookups.same_company(df).collect()}
    assert got == {
        ("PRESTIGE, Inc", "Prestige", "core"), ("PRESTIGE, Inc", "Prestige Ltd", "core"), ("A & B", "A and B Group", "core"), ("PRESTIGE, Inc", "Prestige Estates Projects Limited", "extra"),
        ("PRESTIGE, Inc", "Prestige Projects Estates Online", "extra"), ("Prestige Estates Projects Limited", "Prestige Projects Estates Online", "extra"), ("Yatra Online Limited", "Yatra.com", "extra"),
    }


def test_name_lookup(spark):
    tracked = spark.createDataFrame([("Ann Rao",), ("ann rao",), ("Joanna Lee",), ("Bo",), (None,)], "name string")
    got = {r["query"]: (r.how, r.name) for r in lookups.name_lookup(["ANN RAO ", "lee", "ann", "zz", "bo"], spark, tracked).collect()}
    assert got == {"ANN RAO ": ("exact", "Ann Rao"), "lee": ("partial", "Joanna Lee"), "ann": ("ambiguous", None), "zz": ("none", None), "bo": ("exact", "Bo")}
    assert {r.how for r in lookups.name_lookup(["x"], spark, tracked.where("false")).collect()} == {"none"} and lookups.name_lookup([], spark, tracked).count() == 0


def test_scratch_tables_can_be_cleared(spark, monkeypatch, tmp_path):
    import os

    from murmura import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    held = scratch.materialize(spark.range(3), "numbers")
    assert held.count() == 3 and os.listdir(tmp_path / "murmura")
    scratch.clear(spark)
    assert not os.listdir(tmp_path / "murmura")
    scratch.clear(spark)
