"""Operators without SQL, against brute force or hand-built cases."""

import itertools
import os
import random
import re
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from murmura import rules as R
from murmura.functions import text, udtfs
from murmura.operators import incidents, labels, matching, names, risk, terms


def values(spark, column, rows, kinds):
    return [r[0] for r in spark.createDataFrame(rows, kinds).select(column).collect()]


def test_boilerplate_goes_and_forms_are_compatible(spark):
    rows = [("Ｆull ﬁgures.\n\nThis website uses cookies to ensure you get the best experience on it. More   text\nAdvertisement\nCopyright © 2024 Some Post. End",), (None,), ("",)]
    column = text.tidy_spaces(text.nfkc(text.without_boilerplate(F.col("t"))))
    assert values(spark, column, rows, "t string") == ["Full figures.\n More text\n \n End", None, ""]


def test_segments(spark):
    paragraphs = [f"Paragraph {i} of the text." for i in range(12)] + ["It names the harbour.", "And the harbour again."]
    column = text.high_value_segments(F.col("title"), F.col("t"), ["harbour"])
    rows = [("Head", "\n".join(paragraphs)), ("", "\n".join(paragraphs[:12])), ("Head", "x. " * 1500), ("", "y" * 3000), ("Head", "")]
    got = values(spark, column, rows, "title string, t string")
    assert got[0] == "\n\n".join(["Title: Head", *paragraphs[:2], *paragraphs[12:]])
    assert got[1] == "\n\n".join(paragraphs[:5])
    assert len(got[2]) <= 2000 and got[2].endswith(".") and got[3] == "y" * 2000 + "..." and got[4] == "Title: Head"


def test_short_answer(spark):
    long = "First sentence of it. " + "word " * 100
    rows = [("**Bold** and [a link](http://x) `code`\n# Head",), (long,), ("w" * 400,)]
    assert values(spark, text.short_answer(F.col("t")), rows, "t string") == ["Bold and a link code Head", "First sentence of it.", "w" * 320 + "…"]


def test_supporting_sentence(spark):
    column = text.supporting_sentence(F.col("t"), F.array(F.lit("harbour")))
    rows = [("One here. The Harbour is open! And the harbour.",), ("No word. At all.",), ("",)]
    assert values(spark, column, rows, "t string") == ["The Harbour is open!", "No word.", None]


def test_grounding(spark):
    answers = spark.createDataFrame([("a", "The harbour opens"), ("b", "Nothing common"), ("c", " "), ("d", "Alone")], "answer_id string, text string")
    cited = spark.createDataFrame([("a", "new HARBOUR."), ("a", "x"), ("b", "other words"), ("c", "word")], "answer_id string, record string")
    assert {r.answer_id: r.grounded for r in names.grounded(answers, cited).collect()} == {"a": True, "b": False, "c": True, "d": False}


def random_names(n, seed):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        base = rng.choice(made) if made and rng.random() < 0.6 else "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(4, 14))).strip() or "abcd"
        cut = list(base)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(cut))
            cut[i] = rng.choice("abcdefg")
            if rng.random() < 0.3:
                cut.insert(i, rng.choice("abcdefg"))
        made.append("".join(cut).strip() or "abcd")
    return made


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_near_duplicate_names_lose_no_pair(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), n, rng.choice(["person", "competitor"])) for n in random_names(150, 1)]
    tracked = [(rng.randrange(2), n.title(), rng.choice(["person", "competitor"])) for n in random_names(150, 1)[::2] + random_names(30, 2)]
    df = lambda r: spark.createDataFrame(r, "client_id long, name string, kind string")
    got = {(r.client_id, r.kind, r.name, r.tracked): (r.basis, r.ratio) for r in incidents.near_duplicate_names(df(rows), df(tracked)).collect()}
    want = {}
    for (c, n, k), (d, t, j) in itertools.product(set(rows), set(tracked)):
        if (c, k) != (d, j):
            continue
        a, b = n.lower(), t.lower()
        if ratio(a, b) >= (0.93 if k == "person" else 0.88) and (k == "person" or min(len(a), len(b)) >= 5):
            want[c, k, n, t] = "name"
        elif k != "person" and (h := a.split(" ")[0]) != (g := b.split(" ")[0]) and min(len(h), len(g)) >= 5 and ratio(h, g) >= 0.85:
            want[c, k, n, t] = "head"
    assert {k: v[0] for k, v in got.items()} == want and {"name", "head"} == set(want.values())


def test_review_equals_the_greedy_order(spark):
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(2)}", n, rng.randrange(3), rng.randrange(5) / 10, rng.randrange(4)) for n in sorted(set(random_names(160, 5)))]
    df = spark.createDataFrame(rows, "client_id string, name string, tier int, confidence double, mentions long")
    got = {(r.client_id, r.name): r.leader for r in terms.candidate_review(df).collect()}
    want = {}
    for client in ("c0", "c1"):
        kept = []
        for c, n, *_ in sorted((r for r in rows if r[0] == client), key=lambda r: (r[2], -r[3], -r[4], r[1])):
            leader = next((k for k in kept if ratio(k, n) >= 0.88), None)
            if leader is None:
                kept.append(n)
            want[c, n] = leader or n
    assert got == want and any(k[1] != v for k, v in want.items())
    alone = spark.createDataFrame([("c", "abc", 0, 0.5, 1)], df.schema)
    assert [r.leader for r in terms.candidate_review(alone).collect()] == ["abc"]


def test_hidden_candidates_and_tiers(spark):
    rows = [("Ann Rao",), ("Today Adani",), ("Varun Foods",), ("GodrejGautam Singh",), ("Ann R4o",), ("Jean-Luc de la Tour",), ("X" * 90 + " Rao",), (None,)]
    assert values(spark, terms.hidden_candidate(F.col("n")), rows, "n string") == [False, True, True, True, True, False, True, True]
    rows = [(True, False, False, 1), (True, True, True, 0), (False, True, False, 2), (False, False, False, 1), (True, False, True, 0)]
    assert values(spark, terms.review_tier(), rows, "carries_client_name boolean, title_near boolean, client_near boolean, brand_documents int") == [0, 1, 2, 3, 4]


def plain_form(t):
    return " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " "


def test_role_and_owner_windows(spark):
    rng = random.Random(6)
    words = ["Ann Rao", "ceo", "director", "Acme", "Orris Homes", "owned by", "a subsidiary of", "xx", "y" * 40, "z" * 90, "ceos", "Annes"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))),) for _ in range(400)]

    def near(t):
        n, needle, at = plain_form(t), " ann rao ", -1
        while (at := n.find(needle, at + 1)) >= 0:
            if any(f" {r} " in n[max(0, at - 300) : at + len(needle) + 300] for r in ("ceo", "director")):
                return True
        return False

    def owned(t):
        n = plain_form(t)
        for p in names.OWNER_PHRASES:
            at = -1
            while (at := n.find(f" {p} ", at + 1)) >= 0:
                if " orris homes " in n[max(0, at - 160) : at + 1] and " acme " in n[at : at + len(p) + 160]:
                    return True
        return False

    got = values(spark, names.near_role(F.col("t"), F.lit("Ann Rao"), ["ceo", "director"]), rows, "t string")
    assert got == [near(t) for (t,) in rows] and 20 < sum(got) < 380
    got = values(spark, names.ownership(F.col("t"), F.lit("Orris Homes"), F.lit("Acme")), rows, "t string")
    assert got == [owned(t) for (t,) in rows] and 20 < sum(got) < 380


def test_names_by_layer(spark):
    rows = ["Ann Rao", "Ann", "A" * 101 + " B", "Ann rao", "Ann Rao Jr", "Jr Ann", "Ann van Rao", "van Rao Ann", "J. R. Rao", "Ann Rao-", "Ann- Rao x", "Ann R4o", "Ann <b>Rao", "Yahoo Rao", "Ann Iphone", "Ann NDTV", "Varun Beverages", "Godrej Plots", "Élan Çelik", "", None]
    got = values(spark, names.person_name(F.col("n"), F.array(F.lit("godrej")))[1], [(n,) for n in rows], "n string")
    assert got == [None, "parts", "length", "case", None, None, None, "case", None, "punctuation", "hyphen", "characters", "markup", "publisher", "product", "generic", "corporate", "self reference", None, "length", "length"]
    rows = ["Acme Co", "Orris", "orris.com", "Orris's", "The 6th Official Orris Inc", "6th Orris", "Ltd", "ab", "BYD", "$40", "HK$205,000", "Tata", "Tata Motors Pune", "New Tata Motors", "Evening Post", "Nasdaq", "Orris Shares", "The Verge", "Mistral AI", "Orris Wired", ""]
    got = values(spark, names.company_name(F.col("n"), F.array(F.lit("tata motors")))[1], [(n,) for n in rows], "n string")
    assert got == ["placeholder", None, "domain", "possessive", "words", "ordinal", "legal form", "shape", None, "shape", "price", "self reference", "self reference", "self reference", "media", "exchange", "market", "generic", None, "generic", "shape"]


def test_titles_near_names(spark):
    rows = [("Ann Rao, director of Acme", "Ann Rao"), ("Orris MD said", "Orris MD"), ("ann rao " + "x" * 101 + " CEO", "Ann Rao"), ("md Ann Rao", "Ann Rao"), ("MD Ann Rao", "Ann Rao"), ("Ann Rao x Ann Rao CEO", "Ann Rao"), (None, "x"), ("text", "")]
    assert values(spark, names.title_near_name(F.col("t"), F.col("n")), rows, "t string, n string") == [True, False, False, False, True, True, False, False]


def matched(spark):
    kinds = "doc_id long, start_idx int, end_idx int, keyword string, entity_id long, entity_name string, category string, context string, has_domain boolean, has_industry boolean, has_executive boolean, has_product boolean, negative_context boolean"
    no = (False,) * 5
    rows = [
        (1, 0, 4, "Acme", 1, "Acme Ltd", "PRIMARY", "plain", *no), (1, 0, 4, "Acme", 2, "Acme Homes", "ALIAS", "plain", *no), (1, 9, 13, "Acme", 1, "Acme Ltd", "PRIMARY", "plain", *no),
        (2, 0, 8, "acme ltd", 1, "Acme Ltd", "ALIAS", "company", *no), (3, 0, 4, "fsd", 3, "Tesla", "ALIAS", "plain", *no), (3, 20, 24, "fsd", 3, "Tesla", "ALIAS", "plain", False, False, True, False, False),
        (4, 0, 5, "tesla", 3, "Tesla Inc", "ALIAS", "coil", False, False, False, False, True),
        (5, 0, 9, "Longalias", 4, "Other", "ALIAS", "plain", *no), (5, 0, 9, "Longalias", 5, "Another", "ALIAS", "plain", True, False, False, False, False),
    ]
    return matching.match_confidence(spark.createDataFrame(rows, kinds))


def test_match_confidence(spark):
    got = {(r.doc_id, r.start_idx, r.entity_id): r for r in matched(spark).collect()}
    confidence = {k: r.confidence for k, r in got.items()}
    # Short names are risky aliases unless they are primary; whole names and long aliases start higher.
    assert confidence == {(1, 0, 1): 0.55, (1, 0, 2): 0.10, (1, 9, 1): 0.55, (2, 0, 1): 0.90, (3, 0, 3): 0.10, (3, 20, 3): 0.60, (4, 0, 3): 0.20, (5, 0, 4): 0.70, (5, 0, 5): 0.95}
    assert {k for k, r in got.items() if r.accepted} == {k for k, c in confidence.items() if c >= 0.60}
    assert [(b.type, b.value) for b in got[3, 20, 3].bonuses] == [("executive", 0.2)] and [p.type for p in got[1, 0, 2].penalties] == ["risky_alias"]


def test_ambiguity_state_and_mentions(spark):
    rows = matching.resolve_ambiguity(matched(spark))
    assert {(r.doc_id, r.start_idx, r.entity_id): r.status for r in rows.collect()} == {
        (1, 0, 1): "rejected", (1, 0, 2): "rejected", (1, 9, 1): "rejected", (2, 0, 1): "accepted", (3, 0, 3): "rejected", (3, 20, 3): "accepted", (4, 0, 3): "rejected",
        (5, 0, 4): "accepted", (5, 0, 5): "accepted",
    }
    tie = spark.createDataFrame([(1, 0, 4, 1, 0.8, True), (1, 0, 4, 2, 0.65, True), (1, 0, 4, 3, 0.1, False), (2, 0, 4, 1, 0.8, True), (2, 0, 4, 2, 0.6, True)], "doc_id long, start_idx int, end_idx int, entity_id long, confidence double, accepted boolean")
    assert sorted((r.doc_id, r.entity_id, r.status) for r in matching.resolve_ambiguity(tie).collect()) == [(1, 1, "ambiguous"), (1, 2, "ambiguous"), (1, 3, "ambiguous"), (2, 1, "accepted"), (2, 2, "accepted")]
    both = rows.select("doc_id", "status").union(matching.resolve_ambiguity(tie).select(F.col("doc_id") + 10, "status"))
    assert {r.doc_id: r.state for r in matching.document_state(both).collect()} == {1: "SKIPPED", 2: "MATCHED", 3: "MATCHED", 4: "SKIPPED", 5: "MATCHED", 11: "AMBIGUOUS", 12: "MATCHED"}
    assert {(r.doc_id, r.entity_id): (r.first_at, r.mention_count) for r in matching.accepted_mentions(rows).collect()} == {(2, 1): (0, 1), (3, 3): (20, 1), (5, 4): (0, 1), (5, 5): (0, 1)}
    assert {(r.doc_id, r.entity_id): r.start_idx for r in matching.best_match_per_entity(rows).collect()} == {(1, 1): 0, (1, 2): 0, (2, 1): 0, (3, 3): 20, (4, 3): 0, (5, 4): 0, (5, 5): 0}


def test_keywords_of_any_script(spark):
    df = spark.createDataFrame([(1, "Élan opens; élan İstanbul Élan Гудок"), (2, "Élancer")], "doc_id long, text string")
    got = sorted((r.doc_id, r.keyword, r.start_idx, r.end_idx) for r in matching.keyword_spans(df, ["Élan", "гудок"]).collect())
    assert got == [(1, "élan", 0, 4), (1, "élan", 12, 16), (1, "élan", 26, 30), (1, "гудок", 31, 36)]


def test_final_score_applies_rules_in_order(spark):
    kinds = "title string, entity_type string, risk_score double, document_type string, sentiment string, role string, entity_name string, case_status string, author string, view_count long, published_at timestamp"
    new, old = datetime(2024, 5, 1), datetime(2020, 1, 1)
    row = lambda title, score=80.0, kind="rss", role=None, status=None, who="brand", at=new: (title, who, score, kind, "Negative", role, "Acme Homes", status, "someone", 50, at)
    rows = [
        row("Stocks of Acme fall 4%"), row("ED probe into Acme Homes", 10.0), row("ED probe into Acme Homes", 10.0, role="BYSTANDER"), row("Acme news", role="EXONERATED"), row("Acme news", status="settled"),
        row("RERA fines Acme Rs 12 lakh", status="penalty_or_order"), row("SEBI fines Acme Rs 12 lakh", status="penalty_or_order"), row("Acme fined", status="penalty_or_order", at=old), row("Acme alleged", kind="youtube", status="allegation"),
        row("Acme alleged", status="allegation"), row("Stocks of Acme fall 4%", who="person"),
    ]
    df = spark.createDataFrame(rows, kinds)
    score = lambda **kw: [r.final_score for r in risk.final_score(df, as_of="2024-06-01 00:00:00", **kw).collect()]
    assert score(floor=True, case_status=True) == [25.0, 51.0, 10.0, 0.0, 50.0, 50.0, 80.0, 50.0, 50.0, 80.0, 80.0]
    assert score(floor=False, case_status=False) == [80.0, 10.0, 10.0, 0.0, 80.0, 80.0, 80.0, 80.0, 80.0, 80.0, 80.0]


def test_stream_dedupe_equals_one_pass_over_all_arrivals(spark, tmp_path):
    from murmura.streaming import jobs

    rng = random.Random(9)
    rows = [(i, rng.choice([f"u{rng.randrange(60)}", None] if i % 10 == 0 else [f"u{rng.randrange(60)}"]), f"h{rng.randrange(60)}", datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(200)]
    names = "id long, url_key string, hash_key string, collected_at timestamp"
    urls, hashes, want = set(), set(), []
    for i, u, h, _ in rows:
        if u not in urls and h not in hashes:
            urls.add(u), hashes.add(h), want.append(i)
    home = str(tmp_path / "home")
    source = str(tmp_path / "in")
    run = lambda: jobs.ingest_dedupe(spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(source), home, buckets=4)
    for k in range(0, 120, 40):  # three batches of one run
        spark.createDataFrame(rows[k : k + 40], names).coalesce(1).write.mode("append").parquet(source)
        os.utime(newest(source), (1_700_000_000 + k, 1_700_000_000 + k))
    assert sorted(r.id for r in run().collect()) == [i for i in want if i < 120]
    spark.createDataFrame(rows[120:], names).coalesce(1).write.mode("append").parquet(source)  # the job starts again
    assert sorted(r.id for r in run().collect()) == want


def newest(folder):
    return max((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getmtime)


def test_keyed_table_rewrites_only_buckets_that_a_batch_touches(spark, tmp_path):
    from pyspark.sql.types import StructType

    from murmura.streaming import jobs

    path = str(tmp_path / "table")
    schema = StructType.fromDDL("k long, v long")
    made = lambda: jobs.KeyedTable(spark, path, schema, ["k"], 16)
    table = made()
    top = lambda held, batch: held.unionByName(batch).groupBy("k").agg(F.max("v").alias("v"))
    table.merge(spark.createDataFrame([(k, k) for k in range(200)], schema), 0, top)
    assert len(table.versions()) == 16 and made().read().count() == 200
    table.merge(spark.createDataFrame([(7, 999)], schema), 1, top)
    assert [f for f in os.listdir(f"{path}/batch=1") if f.startswith("bucket=")].__len__() == 1
    held = {r.k: r.v for r in made().read().collect()}  # a new run finds the table
    assert held == {k: 999 if k == 7 else k for k in range(200)}
    total = lambda held, batch: held.unionByName(batch).groupBy("k").agg(F.sum("v").alias("v"))
    for _ in range(2):  # a batch that runs again changes nothing
        table.merge(spark.createDataFrame([(7, 1)], schema), 2, total)
    assert {r.v for r in table.read().where("k = 7").collect()} == {1000}
    table.merge(spark.createDataFrame([(7, 1)], schema), 3, total)
    bucket = next(b for b, v in table.versions().items() if v[0] == 3)
    assert table.versions()[bucket] == [3, 2] and table.read().count() == 200
    table.merge(spark.createDataFrame([], schema), 4, total)
    assert table.read().count() == 200 and jobs.KeyedTable(spark, str(tmp_path / "none"), schema, ["k"]).read().count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_incidents_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(incidents, "BLOCK", block)  # 3: nearly every key is dealt as pairs of blocks
    rng = random.Random(1)
    words = ["harbour", "bridge", "tunnel", "ledger", "signal", "orchard", "voucher", "reactor", "turbine", "pipeline"]
    rows = []
    for i in range(110):
        title = " ".join(rng.sample(words, rng.randrange(3, 8)))
        event = " ".join(rng.sample(words, rng.randrange(1, 6))) if rng.random() < 0.4 else None
        at = None if rng.random() < 0.1 else datetime(2024, 1, 1) + timedelta(days=rng.randrange(500), minutes=rng.randrange(999))
        rows.append((i, rng.randrange(2), "Zzz", title, event, at, float(rng.randrange(100))))
    rows += [(200 + i, 0, "Zzz", rows[0][3], None, datetime(2024, 1, 1) + timedelta(days=30 * i), 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "item_id long, entity_id long, entity_name string, title string, event string, published_at timestamp, score double").repartition(4)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def alike(x, y):
        if x[1] != y[1] or (x[5] and y[5] and abs(x[5] - y[5]) > timedelta(days=R.INCIDENT_DAYS)):
            return False
        (t, e), (u, f) = ((set(r[3].split()), set((r[4] or "").split())) for r in (x, y))
        title = len(t & u) >= 4 and len(t & u) / min(len(t), len(u)) >= 0.5
        n = len(e & f)
        return title or n > 0 and (n / len(e | f) >= 0.5 or n >= 3 and n / min(len(e), len(f)) >= 0.6)

    for a, b in itertools.combinations(range(len(rows)), 2):
        if alike(rows[a], rows[b]):
            root[find(b)] = find(a)
    first = {}
    for k, r in enumerate(rows):
        first[find(k)] = min(first.get(find(k), r[0]), r[0])
    want = {r[0]: first[find(k)] for k, r in enumerate(rows)}
    groups = incidents.incidents(df)
    assert {r.item_id: r.incident_id for r in groups.collect()} == want
    assert 3 < len(set(want.values())) < len(rows)
    by = {}
    for r in rows:
        by.setdefault(want[r[0]], []).append((-r[6], r[0]))
    got = {r.incident_id: (r.lead, r.score, r.others, r.shown) for r in incidents.collapsed_by_incident(df, groups).collect()}
    assert got == {k: (sorted(v)[0][1], -sorted(v)[0][0], len(v) - 1, [i for _, i in sorted(v)[1:21]]) for k, v in by.items()}
    menu = incidents.incident_menu(incidents.incident_summary(df, groups), 5).collect()
    assert [(r.score, r["items"]) for r in menu] == sorted(((-sorted(v)[0][0], len(v)) for v in by.values()), key=lambda x: (-x[0], -x[1]))[:5]


def test_table_functions():
    from datetime import date

    got = list(udtfs.CalendarSlices().eval(date(2023, 11, 17), date(2024, 2, 3), 1))
    assert got == [(date(2023, 11, 17), date(2023, 12, 1)), (date(2023, 12, 1), date(2024, 1, 1)), (date(2024, 1, 1), date(2024, 2, 1)), (date(2024, 2, 1), date(2024, 2, 3))]
    assert list(udtfs.Sentences().eval("One. Two!  Three")) == [(0, "One."), (1, "Two!"), (2, "Three")] and list(udtfs.Sentences().eval(None)) == []


def test_models_load_once_a_worker(spark):
    def load():
        seen = {"n": 0}

        def model(texts):
            seen["n"] += 1
            return [float(len(t)) for t in texts]

        return model

    df = spark.createDataFrame([(1, "abc"), (2, None)], "k int, t string")
    assert {r.k: r.score for r in labels.score_batches(df, "t", load).collect()} == {1: 3.0, 2: 0.0}
