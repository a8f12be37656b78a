import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from murmura.llm import imatch, kd_sharding, mixing, quality, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["size", "level", "fp", "kept", "n_words", "q_words", "f_lang", "high_symbol_ratio", "mix_draw", "murmura_row", "row", "node", "same", "place"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)


def made(n=160, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        rows.append((i, " ".join(words) + ("\n" + " ".join(words[:8])) * rng.randrange(3)))
    for i in range(20):  # near copies and copies of text 3
        words = rows[3][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = f"zz{i}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, ""), (301, None), (302, " \n "), (303, "one two"), (304, "ONE  two"), (305, "a b c d e " * 4000), (3, rows[3][1]), (306, "### *** one two three four five six seven eight nine ten &&& $$$ %%% |||")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 11 == 0 else ("en", "de")[i % 2], None if i % 13 == 0 else f"s{i % 4 if i % 3 else 0}", *CLASHES) for i, t in made()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def frame(docs):
    return docs.toPandas()


def grouped(n, alike):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if alike(a, b):
                root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def brute_counts(text):
    words = WORD.findall(text or "")
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(docs, frame):
    got = quality.quality_verdicts(docs).toPandas()
    assert len(got) == len(frame)
    texts = dict(zip(frame.doc_id, frame.text))
    for r in got.itertuples():
        n = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
    assert not got[got.doc_id == 306].kept.any()
    assert got[~got.base_failed & (got.doc_id != 306)].kept.mean() > 0.9
    kept = quality.keep_good(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and sorted(r.doc_id for r in rows) == sorted(got[got.kept].doc_id)
    assert all([r[c] for c in CLASHES] == CLASHES for r in rows)
    assert quality.quality_verdicts(docs.where("false")).count() == 0


def test_fences_are_tails_of_sound_documents(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):  # two groups of their own, a thin one, and a thin one of a language without a group
        lang, source = ("en", "a") if i < 400 else ("en", "b") if i < 800 else ("en", "thin") if i < 850 else ("xx", "thin")
        n = rng.randrange(60, 300)
        dense = 3 if source == "b" else 1
        bad = i % 17 == 0
        rows.append((lang, source, n, round(n * rng.gauss(5, 0.2)) + (3 * n if bad else 0), rng.randrange(4) * dense + (n if bad else 0), rng.randrange(8, 30), rng.randrange(3) if i % 5 == 0 else 0, rng.randrange(20) if i % 4 == 0 else 0))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    frame = pd.DataFrame(rows, columns=["lang", "source", *names])
    got = quality.fences(spark.createDataFrame(frame, "lang string, source string, " + ", ".join(f"{c} long" for c in names))).toPandas().set_index(["f_lang", "f_source"])
    w, c = frame.n_words, frame.word_chars
    measure = {"symbol_ratio": frame.n_symbols / c, "dup_line_ratio": frame.n_dup_lines / frame.n_lines, "repeat_ratio": frame.n_repeat_words / w, "mean_word_chars": c / w}
    passed = (w >= 10) & (100 * frame.n_repeat_words <= 20 * w)
    exact = lambda x, q: np.sort(x)[max(0, int(np.ceil(q * len(x))) - 1)]

    def standing_for(some, lang, source):
        for part in (some & (frame.lang == lang) & (frame.source == source), some & (frame.lang == lang)):
            if part.sum() >= quality.LEAST_GROUP:
                return part
        return some

    sound = passed.copy()
    for (lang, source), _ in frame.groupby(["lang", "source"]):
        own = (frame.lang == lang) & (frame.source == source)
        for k in ("symbol_ratio", "mean_word_chars"):
            x = measure[k]
            lo, mid, hi = (exact(x[standing_for(passed, lang, source)], q) for q in (0.1, 0.5, 0.9))
            sound &= ~own | ((x <= mid * 1.002 + 3 * (hi - mid)) & (x >= mid * 0.998 - 3 * (mid - lo)))
    assert 0.8 < sound.sum() / passed.sum() < 0.97
    for (lang, source), _ in frame.groupby(["lang", "source"]):
        for k, (low, high, _) in quality.MEASURES.items():
            x = measure[k][standing_for(sound, lang, source)]
            near = lambda a, b: abs(a - b) <= 0.00101 * b
            assert not high or near(got.loc[lang, source][f"high_{k}"], exact(x, 0.99)), (lang, source, k)
            assert not low or near(got.loc[lang, source][f"low_{k}"], exact(x, 0.01))
    for k in ("high_symbol_ratio", "high_dup_line_ratio", "high_repeat_ratio", "high_mean_word_chars", "low_mean_word_chars"):
        assert got.loc["en", "a"][k] != got.loc["en", "b"][k]  # fences differ between groups
    assert (got.high_repeat_ratio < 0.2).all()  # and stand within the base rule
    for (lang, source), _ in frame.groupby(["lang", "source"]):  # rates and deviations by their definitions
        part = frame[standing_for(sound, lang, source)]
        mean = part.word_chars.sum() / part.n_words.sum()
        spread = np.sqrt((part.n_words * (part.word_chars / part.n_words - mean) ** 2).mean())
        row = got.loc[lang, source]
        assert abs(row.deviation - spread) < 0.02 * spread and abs(row.rate_symbol_ratio - (part.n_symbols.sum() + 3) / part.word_chars.sum()) < 0.02 * row.rate_symbol_ratio
        assert abs(row.rate_repeat_ratio - (part.n_repeat_words.sum() / 10 + 3) / part.n_words.sum()) < 0.02 * row.rate_repeat_ratio


def test_what_a_fence_allows_depends_on_group_and_size(spark):
    cut = {}
    for rate in (1e-6, 1e-3):
        rows = [(n, size, 0.0, rate) for size in (300, 30_000) for n in range(80)]
        df = spark.createDataFrame(rows, "n_symbols long, word_chars long, high_symbol_ratio double, rate_symbol_ratio double")
        for r in df.withColumn("above", quality._above("symbol_ratio", F.col("high_symbol_ratio"), 3.0)).where("above").groupBy("word_chars").agg(F.min("n_symbols").alias("n")).collect():
            cut[rate, r.word_chars] = r.n
    assert cut[1e-6, 300] == cut[1e-6, 30_000] == 4 and 4 < cut[1e-3, 300] < 10 and cut[1e-3, 30_000] > 45


def test_each_fence_rejects_what_its_group_does_not_hold(spark):
    rng = random.Random(6)
    word = lambda n=5: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    lines = lambda k=10, n=5, mark="": [" ".join(word(n + rng.randrange(-1, 2)) + mark * (rng.random() < 0.5) for _ in range(10)) for _ in range(k)]
    planted = {
        1: lines(mark="|"),  # symbols
        2: lines() + ["ab cd ef"] * 5,  # duplicate lines, under a fifth of the words
        3: (x := lines(20)) + [x[0] + " " + word() + " " + x[1]],  # repeated windows in lines that differ
        4: lines(n=8),  # long words
        5: lines(n=2),  # short words
    }
    rows = [(k, "\n".join(t), "en", "web") for k, t in planted.items()]
    rows += [(100 + i, "\n".join(lines()), "en", "web") for i in range(150)]
    rows += [(1000 + i, "\n".join(lines(mark="|", n=8)), "en", "tables") for i in range(150)]  # usual in its own group
    rows += [(2000 + i, "\n".join(lines(n=8, mark="" if i else "|")), "de", "thin") for i in range(3)]  # judged by their language
    rows += [(3000 + i, "\n".join(lines(n=8)), "de", None) for i in range(120)]
    got = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id").sort_index()
    assert not got.base_failed.any()
    assert not got.kept.loc[1:5].any(), got.loc[1:5]
    assert got.kept.loc[100:249].all() and got.kept.loc[1000:1149].all() and got.kept.loc[2001:].all() and not got.kept.loc[2000]


def test_mix_meets_targets(docs, frame):
    got = mixing.mixed_documents(docs).toPandas()
    again = mixing.mixed_documents(docs.repartition(2)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert sorted(got["size"]) == sorted(len(WORD.findall(t or "")) for t in frame.text)
    assert (got.taken <= 2 * got["size"]).all() and ((got.taken > 0) == (got.positions.map(len) > 0)).all()
    per = got.fillna({"source": "~"}).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    weights = dict(zip(sorted(per.index), [5, 2, 1] * 3))  # "~" stands last, as null does
    goal, left, fixed = 1.5 * per["size"].sum(), set(per.index), {}
    while True:  # reshare by weight until no target is above twice its source
        share = {s: (goal - sum(fixed.values())) * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * per["size"][s]]
        if not over:
            break
        for s in over:
            fixed[s] = 2.0 * per["size"][s]
            left.discard(s)
    assert (got[got.source == "s0"].positions.map(lambda p: list(p) == sorted(p))).all()
    for s in per.index:
        assert abs(per.target[s] - (fixed | share)[s]) < 1e-6 and abs(per.taken[s] - per.target[s]) < 1
    want = got[got["size"] > 0].assign(times=lambda x: (x.taken / x["size"] + 0.5).astype(int)).groupby("doc_id").times.max()
    read = mixing.repeated_documents(docs)
    assert read.columns == docs.columns
    assert all([r[c] for c in CLASHES] == CLASHES for r in read.collect())
    n = read.toPandas().groupby("doc_id").doc_id.count()
    assert {k: v for k, v in n.items() if k != 3} == {k: v for k, v in want.items() if v and k != 3}
    order = mixing.training_order(mixing.mixed_documents(docs)).toPandas()
    assert order.position.is_monotonic_increasing and order.position.between(0, 1).all()
    assert mixing.mixed_documents(docs.where("false")).count() == 0


def test_imatch(docs, frame):
    got = imatch.edited_fingerprints(docs, low=0.01, high=0.3).toPandas()
    assert len(got) == len(frame)
    rows = sorted(((i, t or "") for i, t in zip(frame.doc_id, frame.text)), key=lambda r: -r[0])
    sums = {}
    import hashlib

    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        sums.setdefault(i, set()).add((len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()))
    assert {(r.n_chars, r.edited_sha256) for r in got.itertuples() if r.doc_id != 3} == {x for i, xs in sums.items() if i != 3 for x in xs}
    prints = dict(zip(got.doc_id, got.fingerprint))
    texts = {}
    for i, t in rows:
        assert texts.setdefault(t, prints[i]) == prints[i]  # equal texts, equal fingerprints
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all() and got.near_edited.mean() > got.near_next.mean()
    # Fingerprints and likeness by a plain reading of the method.
    import math

    import xxhash

    terms = {i: set((t or "").encode().lower().split()) for i, t in rows if i != 3}
    df = {}
    for _, t in rows:
        for w in set(t.encode().lower().split()):
            df[w] = df.get(w, 0) + 1
    band = {w for w, n in df.items() if math.ceil(0.01 * len(rows)) <= n <= math.floor(0.3 * len(rows))}
    mask = 2**64 - 1

    def plain(text):
        h = sorted(xxhash.xxh64_intdigest(w) for w in set(text.encode().lower().split()) & band)
        if not h:
            return "=" + hashlib.sha256(text.encode()).hexdigest()[:32]
        parts = [xxhash.xxh64_hexdigest(b"".join(x.to_bytes(8, "little") for x in h))]
        first = max(0, round(math.log2(len(h))))
        for level in (first, first + 1):
            subsets = []
            for seed in range(1, 33):
                drawn = [((x ^ (seed * 0x9E3779B97F4A7C15 & mask)) * 0x9E3779B97F4A7C15) & mask for x in h]
                drawn = [((d ^ (d >> 29)) * 0xBF58476D1CE4E5B9) & mask for d in drawn]
                some = [x for x, d in zip(h, drawn) if d < 2 ** (64 - level)]
                subsets.append(xxhash.xxh64_hexdigest(b"".join(x.to_bytes(8, "little") for x in some))[:8] if some else "")
            parts.append(f"{level}:{'.'.join(subsets)}")
        return "|".join(parts)

    def alike(a, b):
        if a == b or "=" in (a[0], b[0]):
            return float(a == b)
        x, y = (dict(p.split(":") for p in f.split("|")[1:]) for f in (a, b))
        pairs = [(p, q) for k in x.keys() & y.keys() for p, q in zip(x[k].split("."), y[k].split(".")) if p or q]
        return sum(p == q for p, q in pairs) / max(1, len(pairs))

    by = {r.doc_id: r for r in got.itertuples() if r.doc_id != 3}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        if i in by and i != 4:  # the row after 4 is one of the two rows 3
            k = len(t) // 3
            edited = t[: len(t) - k] + after[:k]
            assert by[i].fingerprint == plain(t) and by[i].edited_fingerprint == plain(edited), i
            assert by[i].near_edited == alike(plain(t), plain(edited)) and by[i].near_next == alike(plain(t), plain(after))
    assert len(terms) == len(by)
    one = docs.where("doc_id = 5")
    assert imatch.edited_fingerprints(one).count() == 1 and imatch.edited_fingerprints(docs.where("false")).count() == 0


def test_imatch_splits_heavy_keys_and_keeps_the_order():
    rng = np.random.default_rng(3)
    key = np.where(rng.random(4000) < 0.4, -(2**63), rng.integers(0, 900, 4000))
    tie = rng.integers(-(2**63), 2**63 - 1, 4000)
    cuts = np.quantile(key.astype(np.float64), np.arange(1, 16) / 16, method="lower").astype(np.int64)
    at = imatch._ranges(cuts, key, tie)
    order = np.lexsort((tie, -key.astype(np.float64)))
    assert (np.diff(at[order]) <= 0).all() and at.min() >= 0 and at.max() < 16
    assert np.bincount(at).max() < 4000 / 16 * 2


def test_imatch_with_many_rows_without_id(spark):
    rows = [(None if i % 3 == 0 else i, f"word{i} alpha beta " * (i % 7)) for i in range(90)] + [(None, None)] * 3
    got = imatch.edited_fingerprints(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, key string").repartition(3), low=0.01, high=1.0)
    got = got.toPandas()
    assert len(got) == len(rows) and sorted(got.n_chars) == sorted(len(t or "") for _, t in rows) and got.doc_id.isna().sum() == 33


def test_kd_tree_equals_brute_force(docs, frame):
    meta = kd_sharding.metadata(docs, kd_sharding.default_dimensions()).toPandas()
    dims = [c for c in meta if c.startswith("dim_")]
    for d in dims:
        lo, width = meta[d].min(), (meta[d].max() - meta[d].min()) or 1.0
        meta[d] = np.floor((meta[d] - lo) / width * (2**24 - 1)).astype(np.int64)
    shard = {}

    def split(part, first, k):
        if k == 1 or not len(part):
            shard.update((r.doc_id, first) for r in part.itertuples())
            return
        widest = max(dims, key=lambda d: (part[d].max() - part[d].min(), -dims.index(d)))
        part = part.assign(key=part[widest] * 2**24 + part.tie).sort_values("key")
        sums = part.groupby("key")["size"].sum().cumsum()
        goal = part["size"].sum() * (k // 2) / k
        at = sums[sums >= goal].index[0]
        under = sums[at] - part[part.key == at]["size"].sum()
        left = part.key <= at if sums[at] - goal <= goal - under else part.key < at
        split(part[left], first, k // 2), split(part[~left], first + k // 2, k - k // 2)

    split(meta, 0, 7)
    got = kd_sharding.kd_shards(docs, shards=7).toPandas()
    assert len(got) == len(frame) and {r.doc_id: r.shard for r in got.itertuples()} == shard


def test_kd_shards_part_runs_of_equal_rows(spark):
    rows = [(None, "same text", "en", "s")] * 300 + [(i, f"text {i}", "en", "s") for i in range(100)] + [(7, None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, shard int").repartition(4)
    placed = kd_sharding.with_slots(kd_sharding.kd_shards(df, shards=4, run=50)).toPandas()
    sizes = placed.groupby("shard")["size"].sum()
    assert len(placed) == 401 and sizes.max() - sizes.min() < 0.1 * sizes.sum()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in placed.groupby("shard"))


def test_kd_shards(docs, frame):
    placed = kd_sharding.with_slots(kd_sharding.kd_shards(docs, shards=5)).toPandas()
    assert len(placed) == len(frame) and set(placed.shard) <= set(range(5))
    sizes = placed.groupby("shard")["size"].sum()
    largest = placed["size"].max()
    assert (sizes - placed["size"].sum() / 5).abs().max() <= 3 * largest
    for _, s in placed.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert kd_sharding.kd_shards(docs, target_bytes=10**9).toPandas().shard.unique().tolist() == [0]
    assert kd_sharding.with_slots(kd_sharding.kd_shards(docs.where("false"), shards=4)).count() == 0


def test_simhash_components(docs, frame):
    got = simhash.near_duplicates(docs).toPandas()
    texts = dict(zip(frame.doc_id, frame.text.fillna("")))
    assert all(r.fp == np.uint64(simhash.simhash(texts[r.doc_id], 3)).astype(np.int64) for r in got.itertuples())
    got = got.sort_values("doc_id").reset_index(drop=True)
    bits = got.fp.to_numpy().view(np.uint64)
    root = grouped(len(got), lambda a, b: (int(bits[a]) ^ int(bits[b])).bit_count() <= 3)
    want = got.assign(root=root).groupby("root").doc_id.transform("min")
    assert (want == got.component_id).all()
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("plan", [[(range(32), 1), (range(32, 64), 1)], [(range(21), 0), (range(21, 42), 0), (range(42, 64), 1)], [(range(64), 3)]])
@pytest.mark.parametrize("block", [8192, 40])
def test_every_plan_loses_no_link(spark, monkeypatch, plan, block):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, 500)]
    for _ in range(3):
        x = x ^ np.where(rng.random(500) < 0.7, np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64), np.uint64(0))
    x = np.unique(x)
    monkeypatch.setattr(simhash, "probe_plan", lambda nodes, tau: [(list(b), t) for b, t in plan])
    nodes = spark.createDataFrame(pd.DataFrame({"fp": x.view(np.int64)}))
    edges = [(r.a, r.b) for r in simhash.links(nodes, 3, block=block).collect()]
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    linked = {(at[a], at[b]) for a, b in edges} | {(at[b], at[a]) for a, b in edges}
    assert grouped(len(x), lambda a, b: (a, b) in linked) and all((int(x[a]) ^ int(x[b])).bit_count() <= 3 for a, b in linked)
    real = grouped(len(x), lambda a, b: (int(x[a]) ^ int(x[b])).bit_count() <= 3)
    got = grouped(len(x), lambda a, b: (a, b) in linked)
    assert len({*zip(real, got)}) == len(set(real)) == len(set(got))


def test_thresholds_follow_the_pigeonhole(spark):
    p = np.full(64, 0.5)
    for n in (1_000, 10_000_000):
        for m in (2, 3, 4):
            _, ts = simhash.thresholds(n, p, [list(range(64 * i // m, 64 * (i + 1) // m)) for i in range(m)], 3)
            assert sum(ts) == 3 - m + 1


@pytest.mark.parametrize("block", [2048, 8])
def test_similar_texts_equal_brute_force(docs, frame, block):
    sets = [set(simhash.shingle_bytes(t or "", 5)) for t in frame.text]
    texts = frame.text.fillna("").tolist()
    alike = lambda a, b: texts[a] == texts[b] or bool(sets[a] & sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = frame.assign(root=grouped(len(frame), alike)).groupby("root").doc_id.transform("min")
    got = simhash.similar_texts(docs, block=block).toPandas().drop_duplicates()
    assert dict(zip(got.doc_id, got.component_id)) == dict(zip(frame.doc_id, want))
    kept = simhash.without_near_duplicates(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and sorted(r.doc_id for r in rows) == sorted(set(want))
    assert all([r[c] for c in CLASHES] == CLASHES for r in rows)


def test_short_texts_at_the_threshold_share_a_key():
    rng = np.random.default_rng(4)
    bits = lambda h: int("".join("1" if x else "0" for x in 2 * np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0) > len(h)), 2)
    for n in [*range(1, 51), 77, 154, 200]:
        more, common = n * 5 // 4 - n, -(-8 * n // 9)  # n inside n / 0.8, and two sets of n
        for a, b, shared in ((0, more, n), (n - common, n - common, common)):
            found = 0
            for _ in range(100 if n < 51 else 40):
                x = rng.integers(0, 2**64, shared + a + b, dtype=np.uint64)
                one, two = np.sort(x[: shared + a]), np.sort(np.concatenate([x[:shared], x[shared + a :]]))
                shared_key = bool(set(simhash.part_keys(one)) & set(simhash.part_keys(two)))
                found += shared_key and (bits(one) ^ bits(two)).bit_count() <= simhash.LOOSE
            assert found > (95 if n < 51 else 38), (n, a, b, found)


def test_only_texts_join_groups(spark):
    rng = random.Random(5)
    text = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(40)) for _ in range(6)]
    near = text[3] + " more"
    # Null ids with the texts of 7 and 9, a third text and a near copy; id 20 twice with unlike texts, one of them 21's.
    rows = [(7, text[0]), (None, text[0]), (9, text[1]), (None, text[1]), (None, text[2]), (None, text[2]), (None, near), (30, text[3])]
    rows += [(20, text[4]), (20, text[5]), (21, text[5]), (None, None), (None, "")]
    kept = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = [(7, text[0]), (9, text[1]), (None, text[2]), (30, text[3]), (20, text[4]), (20, text[5])]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(repr, ((i, t) for i, t in got if t))) == sorted(map(repr, want)) and sum(not t for _, t in got) == 1


def test_pipeline_stages_keep_the_columns(spark, tmp_path, frame):
    spark.createDataFrame(frame.astype(object).where(frame.notna(), None), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.replace(",", "").split(" ")[::2]
        assert all([r[c] for c in CLASHES] == CLASHES for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 0


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(1, "a", "en", "s"), (1, "b", "en", "s"), (None, "c", None, "s"), (None, "c", None, "s"), (3, None, "de", None)] + [(10 + i, "text " * (i % 9), "en", f"s{i % 3}") for i in range(200)]
    df = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, shard string, node int")
    name = kd_sharding.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "_shard" and sorted(back.columns) == sorted([*df.columns, "_shard"])
    assert sorted(map(repr, (tuple(r) for r in back.select(*df.columns).collect()))) == sorted(map(repr, (tuple(r) for r in df.collect())))
    sizes = [r.b for r in back.groupBy("_shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b")).collect()]
    assert len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)


def test_a_lexicon_above_its_bound_is_refused(spark):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} common") for i in range(70)], "doc_id long, text string")
    assert len(imatch.lexicon(docs, low=0.1, high=0.3)) == 12
    with pytest.raises(ValueError, match="12 terms"):
        imatch.lexicon(docs, low=0.1, high=0.3, most=11)


def test_null_ids_in_mixing_and_verdicts(spark):
    rows = [(None, "one two three four five six seven eight nine ten eleven.", "en", "a"), (None, "one two three four five six seven eight nine ten twelve.", "en", "a"), (None, None, None, None), (5, "x", "en", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, taken int")
    mixed = mixing.mixed_documents(df).collect()
    assert sorted((r.doc_id is None, r["size"]) for r in mixed) == [(False, 1), (True, 0), (True, 11), (True, 11)] and all(0 <= r.taken <= 2 * r["size"] for r in mixed)
    verdicts = quality.quality_verdicts(df).collect()
    assert sorted(r.n_words for r in verdicts) == [0, 1, 11, 11] and sum(r.doc_id is None for r in verdicts) == 3
    found = simhash.near_duplicates(df).collect()
    assert len(found) == 4 and sum(r.doc_id is None for r in found) == 3
