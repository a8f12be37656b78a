import hashlib
import itertools
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from murmura.llm import hard_negatives, license_scan, queries, repair
from murmura.llm.license_templates import PHRASES, default_templates

SF = "/root/testdata/sf0.001"


# -- hard negatives -----------------------------------------------------------------------------------------------------


def brute_negatives(rows, positives=5, negatives=10):
    """The contract over all pairs; rows (vec_id, label, vector), in order of the table."""
    live = [(i, v, k, q) for i, (v, k, q) in enumerate(rows) if k is not None and q is not None and None not in q]
    dot = lambda a, b: sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for i, v, k, q in live:
        if v is None or v % 100:
            continue
        near = sorted(((dot(q, x), u, j) for j, u, m, x in live if m == k and j != i), key=order)[:positives]
        for p, pid, _ in near:
            far = sorted(((dot(q, x), u, j) for j, u, m, x in live if m != k and 30 * p <= 100 * dot(q, x) <= 90 * p), key=order)[:negatives]
            out += [(v, pid, r, u, p, s) for r, (s, u, _) in enumerate(far, 1)]
    return out


def clusters(seed, n, width=8, heavy=0.3):
    """Unit vectors around few centres, a third of them near copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    x = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.15, size=(n, width))
    x[rng.random(n) < heavy] = centres[0]
    x += rng.normal(scale=0.002, size=x.shape)
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(int)
    return [(i * 10, int(rng.integers(0, 3)), q.tolist()) for i, q in enumerate(x)]


def test_negatives_equal_brute_force(spark):
    rows = clusters(1, 700)
    rows += [(100, 1, rows[3][2]), (100, 1, rows[3][2]), (None, 1, rows[0][2]), (7, None, rows[0][2]), (200, 1, None), (300, 1, [1, None]), (400, 2, []), (500, 2, [9, 9])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, q array<long>, leaf string, place int").coalesce(1)
    out = hard_negatives.mined_negatives(df, F.col("vec_id") % 100 == 0, leaf_rows=32, row_block=64)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, brute_negatives(rows)))
    assert hard_negatives.mined_negatives(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_ranges_eliminate_subtrees_and_lose_nothing(spark):
    rows = clusters(2, 2000)
    df = spark.createDataFrame(rows, "vec_id long, label int, q array<long>")
    index = hard_negatives.indexed(df, leaf_rows=32)
    x = np.array([r[2] for r in rows], float)
    queries_ = x[::40]
    scores = queries_ @ x.T
    leaves = hard_negatives.leaf_of(index.tree, x)
    low = np.quantile(scores, 0.97, axis=1)[:, None]
    kept = hard_negatives.surviving(index.tree, queries_, low, np.full_like(low, np.inf))
    needed = np.zeros_like(kept)
    for i in range(len(queries_)):
        needed[i, leaves[scores[i] >= low[i]]] = True
    assert not (needed & ~kept).any()
    assert index.tree.leaves > 20 and kept.mean() < 0.5  # more than half of all visits fall to the ranges
    # Windows far below a query's own cluster eliminate that cluster.
    far = hard_negatives.surviving(index.tree, queries_, np.full_like(low, -np.inf), np.quantile(scores, 0.2, axis=1)[:, None])
    assert far.mean() < 0.9


def test_large_components_take_no_elimination(spark):
    rows = [(0, 1, [2**30, 1]), (1, 1, [2**30, 0]), (2, 2, [2**29, 5]), (3, 2, [2**28, 0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, q array<long>")
    out = hard_negatives.mined_negatives(df, F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in out] == brute_negatives(rows)


def test_floored(spark):
    rows = [([0.5, -0.001],), ([float("nan")],), ([float("inf")],), ([None],), (None,), ([],)]
    out = [r.q for r in spark.createDataFrame(rows, "e array<float>").select(hard_negatives.floored("e").alias("q")).collect()]
    assert out == [[128, -1], None, None, None, None, []]


# -- conversation repair ------------------------------------------------------------------------------------------------


def brute_repair(turns):
    """Least (cost, edits) by dynamic programming over prefixes."""
    best = {"": (0, "")}
    grammar = re.compile(r"s?(ua)*u?\Z")  # prefixes of s?(ua)+

    def put(table, key, way):
        if grammar.match(key) and (key not in table or way < table[key]):
            table[key] = way

    # The pattern only tells states by what was read last; longer words collapse to these.
    short = lambda w: "s" * w.startswith("s") + ("ua" if w.endswith("a") else "u" if w.endswith("u") else "")

    def inserted(table):
        for _ in range(3):
            for w, (c, e) in list(table.items()):
                for r in "ua":
                    if grammar.match(w + r):
                        put(table, short(w + r), (c + 2, e + "I"))
        return table

    best = inserted(best)
    for initial, fault in turns:
        after: dict = {}
        for w, (c, e) in best.items():
            put(after, w, (c + 3, e + "D"))
            if fault not in (1, 2):
                more = int(fault == 3)
                if len(initial) == 1 and initial in "sua" and grammar.match(w + initial):
                    put(after, short(w + initial), (c + more, e + "K"))
                for r in "ua":
                    if grammar.match(w + r):
                        put(after, short(w + r), (c + 2 + more, e + "R"))
        best = inserted(after)
    return min(v for w, v in best.items() if w == "" or w.endswith("a"))


def test_auction_equals_dynamic_programming():
    rng = random.Random(3)
    for n in range(9):
        for _ in range(150):
            turns = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
            assert repair.repaired(turns) == brute_repair(turns), turns
    long = [(rng.choice("sua"), rng.choice([0, 0, 1, 3])) for _ in range(20_000)]
    cost, audit = repair.repaired(long)
    assert (cost, audit) == brute_repair(long)


def brute_conversation(rows):
    """All columns of one conversation from its rows after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(repair.BLANKS)
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    known = sorted({t for t, _, _ in rows if t is not None})
    gaps = known[-1] - known[0] + 1 - len(known) if known else 0
    pairs = zip(rows, rows[1:])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    cost, audit = brute_repair([(r[1][:1], f) for r, f in zip(rows, faults)])
    said, place, expect = [], 0, "u"
    for e in audit:
        if e == "D":
            place += 1
            continue
        role, text = ("", "") if e == "I" else rows[place][1:]
        place += e != "I"
        role = role if e == "K" else {"u": "user", "a": "assistant"}[expect]
        said.append(f"{role}:{text}")
        expect = "a" if role.startswith("u") else "u"
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def test_repair_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randrange(7)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["system", "user", "assistant", "user", "tool", "", None]), rng.choice(["Hi.", "So?", "", " \t", "no end", "x. ", None])))
    rows += [(100, 0, "user", "a" * 300_000 + "."), (101, None, None, None)]
    rows += [(102, t, ("user", "assistant")[t % 2], "same.") for t in range(300)]
    table = spark.createDataFrame([(*r, "clash", 3) for r in rows], "conv_id long, turn long, role string, text string, pos string, fault int").repartition(5)
    want = {}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = want.setdefault(conv, [])
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            kept += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = repair.repaired_conversations(repair.damaged(table), table)
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert got == {c: brute_conversation(r) for c, r in want.items()}
    empty = table.where("false")
    assert repair.repaired_conversations(repair.damaged(empty), empty).count() == 0
    none = repair.repaired_conversations(empty, table.where("conv_id = 101")).collect()
    assert [tuple(r) for r in none] == [(101, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    rows_ = repair.with_faults(repair.damaged(table))
    turns = repair.edited(rows_, repair.audits(rows_)).where("conv_id = 100").orderBy("place").collect()
    assert [t.role for t in turns][-2:] == ["user", "assistant"] and max(len(t.text) for t in turns) >= 300_000


# -- licences -----------------------------------------------------------------------------------------------------------


def test_matching_statistics_equal_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        templates = [("t%d" % k, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))) for k in range(4)]
        phrases = {"a b": "ab", "b": "b", "c a b": "cab"}
        scan = license_scan.Scanner(templates, phrases, license_scan.Rules(shortest=1))
        words = [rng.choice("abcabcz") for _ in range(60)]
        sides = [t.split() for _, t in templates] + [p.split() for p in phrases]
        inside = lambda run: any(run == s[i : i + len(run)] for s in sides for i in range(len(s)))
        for first, codes in scan.runs(words):
            for i, state, length in scan.statistics(first, codes):
                assert length == max(k for k in range(i - first + 2) if k == 0 or inside(words[i - k + 1 : i + 1]))
                if length:
                    run = words[i - length + 1 : i + 1]
                    places = {(k, e) for k, s in enumerate(sides[:4]) for e in range(len(s)) if s[max(0, e - length + 1) : e + 1] == run and e - length + 1 >= 0}
                    assert set(scan.automaton.places[state]) == places
        base, _ = scan.scan([*words, "z"])
        want = [(i, k) for k, p in enumerate(phrases) for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert sorted(base) == sorted(want)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_license_scan(spark, SF).collect()}
    templates = [(label, license_scan.words_of(t)) for label, t in default_templates()]
    named = 0
    for r in docs.collect():
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        found = got[r.doc_id]
        starts = [i for i, _ in places]
        base = {label for _, label in places}
        assert (found.n_words, found.n_base, found.first_word, found.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert found.base_labels == ",".join(sorted(base))
        joined = f" {' '.join(words)} "
        whole = [(label, t) for label, t in templates if f" {' '.join(t)} " in joined]
        longest = {label for label, t in whole if not any(len(u) > len(t) and f" {' '.join(t)} " in f" {' '.join(u)} " for _, u in whole)}
        assert set(filter(None, found.labels.split(","))) == base | longest
        assert 0 <= found.score <= 1 and (found.score == 1) == bool(whole)
        named += bool(longest)
    assert len(got) == docs.count() and named


MIT = next(t for label, t in default_templates() if label == "mit" and len(t) > 500)


def test_spans_chain_over_edits(spark):
    words = MIT.split()
    edited = " ".join([*words[:40], "(reworded", "here)", *words[43:100], *words[108:]])
    rows = [
        (1, f"Some prose first. {edited} And prose after it."), (2, " ".join(words[:12]) + " but then it is about something else"), (3, None), (None, ""), (4, "CC  BY, cc-by: cc by"),
        (4, "CC  BY, cc-by: cc by"), (5, "word " * 100_000 + "Licensed under the Apache License, Version 2.0. " + "word " * 10), (6, "Redistribution of the software is permitted provided that you ask"),
        (7, "Released under the MIT License. " * 3000),
    ]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, labels string, score int")
    out = sorted(license_scan.licence_scans(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    by = {r.doc_id: r for r in out}
    assert by[1].labels == "mit" and len(by[1].spans) == 1 and 0.85 < by[1].score < 1
    span = by[1].spans[0]
    assert (span.first, span.last) == (3, 3 + len(license_scan.words_of(edited)) - 1)
    assert by[2].labels == "" and 0 < by[2].score < 0.2 and by[6].labels == ""
    assert (by[3].n_words, by[3].n_base, by[3].first_word, by[3].labels, by[3].score) == (0, 0, None, "", 0.0)
    assert [r.n_base for r in out if r.doc_id == 4] == [3, 3] and by[4].base_labels == "cc-by"
    assert (by[5].first_word, by[5].labels) == (100_003 - 0, "apache,apache-2.0") and by[5].score == 1
    assert (by[7].n_base, by[7].labels, by[7].last_word - by[7].first_word) == (3000, "mit", 5 * 2999)
    assert len(out) == len(rows) and license_scan.licence_scans(docs.where("false")).count() == 0
