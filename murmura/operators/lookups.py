"""Lookups, attribution, candidates and coverage: joins around names, hits, runs and feeds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from murmura.operators.automaton import Parts, of_worker
from murmura.operators.terms import self_reference_terms


def hit_lookup(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Each hit (hit_id, url_key, hash_key) with the held document of its url, else of its content hash; smallest id on ties."""
    by = lambda k: documents.groupBy(k).agg(F.min("document_id").alias(f"by_{k}"))
    both = hits.join(by("url_key"), "url_key", "left").join(by("hash_key"), "hash_key", "left")
    return both.select("hit_id", F.coalesce("by_url_key", "by_hash_key").alias("document_id"), F.when(F.col("by_url_key").isNotNull(), "url").when(F.col("by_hash_key").isNotNull(), "hash").otherwise("none").alias("basis"))


def uncounted_hits(hits: DataFrame, mentions: DataFrame) -> DataFrame:
    """Hits (document_id, entity_id) whose document has no mention of their entity."""
    return hits.join(mentions.select("document_id", "entity_id"), ["document_id", "entity_id"], "left_anti")


def hit_attribution(hits: DataFrame, mentions: DataFrame, guard: Column) -> DataFrame:
    """outcome of each hit: already mentioned, attached, or refused by the guard."""
    known = mentions.select("document_id", "entity_id").distinct().withColumn("known", F.lit(True))
    outcome = F.when(F.col("known"), "already").when(guard, "attached").otherwise("refused")
    return hits.join(known, ["document_id", "entity_id"], "left").withColumn("outcome", outcome).drop("known")


#: Names or terms asked for at a time; they are broadcast and compiled once a worker.
MOST_ASKED = 1_000_000


def name_lookup(asked: list[str], spark: SparkSession, tracked: DataFrame) -> DataFrame:
    """query -> found name and how: exact (any case), the only partial match, ambiguous or none.

    The asked names, at most MOST_ASKED, are one automaton, through which each tracked name goes once: it says which asked ones it
    contains, whatever their number, and only counts meet. An empty query is in every name."""
    if len(asked) > MOST_ASKED:
        raise ValueError(f"{len(asked)} names asked; ask for {MOST_ASKED} at a time")
    roster, token = spark.sparkContext.broadcast(sorted({a.strip().lower() for a in asked})), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = of_worker(Parts, token, roster.value)
        for b in batches:
            names, found, exact = [], [], []
            for name in b.column("name").to_pylist():
                low = (name or "").lower()
                for q in known.held(low) if name is not None else ():
                    names.append(name), found.append(q), exact.append(q == low)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string()), pa.array(exact, pa.bool_())], names=["name", "q", "exact"])

    hits = tracked.select("name").mapInArrow(run, "name string, q string, exact boolean")
    found = hits.groupBy("q").agg(F.min(F.when(F.col("exact"), F.col("name"))).alias("exact"), F.count("*").alias("n"), F.min("name").alias("partial"))
    rows = spark.createDataFrame([(a, a.strip().lower()) for a in asked], "query string, q string").join(found, "q", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "partial").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return rows.select("query", how.alias("how"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("partial"))).alias("name"))


def cooccurring(mentions: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """(client_id, entity_id, document_id) of entities of a kind in documents that also mention the client's brand or product."""
    rows = mentions.join(entities.select("entity_id", "client_id", "entity_type"), "entity_id")
    theirs = rows.where(F.col("entity_type") == kind).select("client_id", "entity_id", "document_id").distinct()
    own = rows.where("entity_type IN ('brand', 'product')").select("client_id", "document_id")
    return theirs.join(own, ["client_id", "document_id"], "left_semi")


def competitor_documents(leads: DataFrame, terms: DataFrame) -> DataFrame:
    """(entity_id, document_id) of documents about a competitor itself: ``leads`` (document_id, lead, text, in phrase form),
    ``terms`` (entity_id, name and context, phrase forms; context may be empty). A name of one word needs a context word
    somewhere in the text.

    Terms are curated names, at most MOST_ASKED, compiled into one automaton a worker; each lead goes through it once, a text
    only where a name of one word stands in its lead, and no text is copied or shuffled."""
    spark, entity = leads.sparkSession, terms.schema["entity_id"].dataType
    asked = terms.select("entity_id", "name", "context").where("name IS NOT NULL").limit(MOST_ASKED + 1).collect()
    if len(asked) > MOST_ASKED:
        raise ValueError(f"more than {MOST_ASKED} competitor terms; ask for {MOST_ASKED} at a time")
    roster: dict[str, list] = {}
    for t in asked:
        roster.setdefault(t.name, []).append((t.entity_id, {c for c in t.context or () if c is not None}))
    shared, token, kind = spark.sparkContext.broadcast(roster), uuid.uuid4().hex, to_arrow_type(entity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = of_worker(Parts, f"{token}-names", list(shared.value))
        words = of_worker(Parts, f"{token}-context", sorted({c for ts in shared.value.values() for _, context in ts for c in context}))
        for b in batches:
            at, found = [], []
            for i, (lead, text) in enumerate(zip(b.column("lead").to_pylist(), b.column("text").to_pylist())):
                met = names.held(lead) if lead is not None else ()
                stand, seen = set(lead.strip(" ").split(" ")) if met else set(), None
                for name in met:
                    parts = name.strip(" ").split(" ")
                    if parts[0] not in stand:
                        continue
                    for e, context in shared.value[name]:
                        if len(parts) < 2:
                            if seen is None:
                                seen = words.held(text) if text is not None else set()
                            if seen.isdisjoint(context):
                                continue
                        at.append(i), found.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(found, kind), b.column("document_id").take(pa.array(at, pa.int64()))], names=["entity_id", "document_id"])

    rows = leads.select("document_id", "lead", "text")
    return rows.mapInArrow(run, f"entity_id {entity.simpleString()}, document_id {leads.schema['document_id'].dataType.simpleString()}").distinct()


def match_gap(documents: DataFrame, mentions: DataFrame, entities: DataFrame, matches: DataFrame) -> DataFrame:
    """(client_id, document_id) with a mention of the client's own entities but no stored match of that client."""
    own = mentions.join(entities.where("entity_type IN ('brand', 'product')").select("entity_id", "client_id"), "entity_id")
    return own.select("client_id", "document_id").distinct().join(matches.select("client_id", "document_id"), ["client_id", "document_id"], "left_anti").join(documents.select("document_id"), "document_id", "left_semi")


def own_words(entities: DataFrame) -> DataFrame:
    """(client_id, word): the words of a client's brand and product names, and its self-reference terms, lower case."""
    own = entities.where(F.lower("entity_type").isin("brand", "product"))
    words = own.select("client_id", F.explode(F.split(F.lower("entity_name"), r"(?U)\W+")).alias("word"))
    return words.unionByName(self_reference_terms(own).withColumnRenamed("key", "word")).where("word <> ''").distinct()


def surname_attach(single: DataFrame, people: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """One-word names (client_id, word) with the only tracked person of that surname; people of one word have none.

    ``refused`` (client_id, word) are words of the client's own names (see `own_words`): coverage of the firm would land on
    a person who bears its name."""
    parts = F.filter(F.split(F.trim("entity_name"), r"\s+"), lambda w: w != "")
    surnames = people.where(F.size(parts) > 0).select("client_id", "entity_id", F.lower(F.element_at(parts, -1)).alias("surname"), (F.size(parts) > 1).alias("whole"))
    lone = surnames.groupBy("client_id", "surname").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id"), F.max("whole").alias("whole")).where("n = 1 AND whole")
    rows = single.withColumn("surname", F.lower(F.trim("word")))
    if refused is not None:
        rows = rows.join(refused.withColumnRenamed("word", "surname"), ["client_id", "surname"], "left_anti")
    return rows.join(lone.drop("n", "whole"), ["client_id", "surname"]).select("client_id", "word", "entity_id")


def discovered(names: DataFrame, tracked: DataFrame) -> DataFrame:
    """Candidates out of extracted names (client_id, document_id, name_key, seen_at) that are not tracked (client_id, name_key):
    documents, mentions, first and last seen."""
    fresh = names.join(tracked, ["client_id", "name_key"], "left_anti")
    per = fresh.groupBy("client_id", "name_key", "document_id").agg(F.count("*").alias("n"), F.min("seen_at").alias("first"), F.max("seen_at").alias("last"))
    return per.groupBy("client_id", "name_key").agg(
        F.count("*").alias("documents"), F.sum("n").alias("mentions"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen")
    )


def claim_status(claims: DataFrame, incidents: DataFrame) -> DataFrame:
    """Claims (document_id) with the number of incidents that hold their document, and status: matched or open."""
    held = incidents.select("document_id", "incident_id").distinct().groupBy("document_id").agg(F.count("*").alias("incidents"))
    n = F.coalesce("incidents", F.lit(0))
    return claims.join(held, "document_id", "left").withColumns({"incidents": n, "status": F.when(n > 0, "matched").otherwise("open")})


def person_confidence(candidates: DataFrame) -> DataFrame:
    """Confidence of person candidates from mentions, documents, a title nearby and a tracked surname with a title."""
    c = F.lit(0.5) + F.when(F.col("parts") == 2, 0.10).otherwise(0.0) + F.least((F.col("mentions") - 1) * 0.05, F.lit(0.15)) + F.least((F.col("documents") - 1) * 0.05, F.lit(0.20))
    c = c + F.when(F.col("title_nearby"), 0.15).otherwise(0.0) + F.when(F.col("title_nearby") & F.col("tracked_surname"), 0.20).otherwise(0.0)
    return candidates.withColumn("confidence", F.least(c, F.lit(1.0)))


# Promotion thresholds.
PROMOTE_MENTIONS, PROMOTE_DOCUMENTS, PROMOTE_CONFIDENCE, PROMOTE_RELATED = 2, 2, 0.65, 2


def promotion_gate(candidates: DataFrame) -> DataFrame:
    """promoted, or the first reason that holds a candidate back."""
    reason = F.when(F.col("mentions") < PROMOTE_MENTIONS, "mentions").when(F.col("documents") < PROMOTE_DOCUMENTS, "documents")
    reason = reason.when(F.col("confidence") < PROMOTE_CONFIDENCE, "confidence").when(F.col("related_documents") < PROMOTE_RELATED, "related documents")
    reason = reason.when(~F.col("title_nearby"), "title evidence")
    return candidates.withColumns({"held_reason": reason, "promoted": reason.isNull()})


def alias_measure(sample: DataFrame) -> DataFrame:
    """Per alias: documents, false matches, rate, enabled (20 documents or more and at most a tenth false)."""
    per = sample.groupBy("alias").agg(F.count("*").alias("documents"), F.count_if("false_match").alias("false_matches"))
    rate = F.col("false_matches") / F.col("documents")
    return per.withColumns({"rate": rate, "enabled": (F.col("documents") >= 20) & (rate <= 0.10)})


# Words that are no part of a company's core name, and words that a longer spelling of it may add.
NOISE_WORDS = ["limited", "ltd", "pvt", "private", "public", "inc", "corp", "corporation", "company", "co", "group", "holdings", "projects", "developers", "com"]
EXTRA_WORDS = ["estates", "projects", "online", "group", "developers", "realty", "properties", "enterprises", "limited", "ltd", "com"]


def core_words(name: Column) -> Column:
    """Words of a company's name without NOISE_WORDS, "&" read as and."""
    words = F.regexp_extract_all(F.lower(F.replace(name, F.lit("&"), F.lit(" and "))), F.lit(r"(?U)[\p{IsAlphabetic}\p{IsDigit}]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*NOISE_WORDS))


def same_company(names: DataFrame) -> DataFrame:
    """client_id, a, b, basis: spellings (client_id, name) of one company.

    basis core: b has the core of a, the least name of that core. basis extra: a and b are the least names of two cores, of which one
    is the other and EXTRA_WORDS behind it. So a core of many names gives one row a name and not all pairs; a core meets
    the shorter ones it may stem from by equality, some per core, and nothing else."""
    rows = names.select("client_id", "name", core_words(F.col("name")).alias("core")).where(F.size("core") > 0).distinct()
    cores = rows.groupBy("client_id", "core").agg(F.min("name").alias("a"))
    core = rows.join(cores, ["client_id", "core"]).where("name <> a").select("client_id", "a", F.col("name").alias("b"), F.lit("core").alias("basis"))
    extras = F.filter(F.sequence(F.lit(1), F.size("core")), lambda k: F.forall(F.slice("core", k + 1, F.size("core")), lambda w: w.isin(*EXTRA_WORDS)))
    shorter = cores.select("client_id", F.col("core").alias("whole"), F.col("a").alias("longer"), F.explode(F.filter(extras, lambda k: k < F.size("core"))).alias("k"))
    stems = shorter.select("client_id", "longer", F.slice("whole", F.lit(1), F.col("k")).alias("core"))
    extra = stems.join(cores, ["client_id", "core"]).select("client_id", F.least("a", "longer").alias("a"), F.greatest("a", "longer").alias("b"), F.lit("extra").alias("basis"))
    return core.unionByName(extra)


def due_feeds(feeds: DataFrame, jobs: DataFrame, as_of: str, batch: int = 5) -> DataFrame:
    """Active feeds past their interval without an active job, numbered into batches."""
    late = F.col("last_polled").isNull() | (F.col("last_polled") < F.expr(f"TIMESTAMP '{as_of}' - INTERVAL 1 DAY"))
    free = feeds.where(F.col("active") & late).join(jobs.where("status = 'RUNNING'").select("source_id"), "source_id", "left_anti")
    # One row for each feed; batches follow the feeds' order within their client.
    w = Window.partitionBy("client_id").orderBy(F.col("last_polled").asc_nulls_first(), "source_id")
    return free.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch).cast("int"))


def revival_feeds(feeds: DataFrame, as_of: str, days: int) -> DataFrame:
    late = F.col("last_polled").isNull() | (F.col("last_polled") < F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS"))
    return feeds.where(~F.col("active") & late)


def fresh_enough(scores: DataFrame, mentions: DataFrame, as_of: str, hours: int) -> DataFrame:
    """skip: the client's last score is younger than ``hours`` and no mention is newer."""
    last = scores.groupBy("client_id").agg(F.max("at").alias("last_score")).join(mentions.groupBy("client_id").agg(F.max("at").alias("last_mention")), "client_id", "left")
    young = F.col("last_score") >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {hours} HOURS")
    return last.withColumn("skip", young & ~F.coalesce(F.col("last_mention") > F.col("last_score"), F.lit(False)))


def client_rank(clients: DataFrame, competitors: DataFrame) -> DataFrame:
    """1 plus the competitors ahead of the client (ties by id)."""
    both = clients.alias("c").join(competitors.alias("o"), "client_id", "left")
    ahead = (F.col("o.score") > F.col("c.score")) | ((F.col("o.score") == F.col("c.score")) & (F.col("o.entity_id") < F.col("c.entity_id")))
    return both.groupBy("client_id").agg((F.count_if(F.coalesce(ahead, F.lit(False))) + 1).alias("rank"))


def priority_queue(rows: DataFrame, key: str, urgent: Column, at: str, room: int) -> DataFrame:
    """First ``room`` rows of each key: urgent ones, then the newest, undated last."""
    w = Window.partitionBy(key).orderBy(urgent.desc(), F.col(at).desc_nulls_last(), "document_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= room)


def acceptance(counts: DataFrame, needed: dict[str, tuple[int, int]]) -> DataFrame:
    """check rows (PASS, WARN, FAIL) of each client; needed: name -> (least to warn, least to pass)."""
    rows = F.array(*(F.struct(F.lit(k).alias("check_name"), F.when(F.col(k) >= good, "PASS").when(F.col(k) >= fair, "WARN").otherwise("FAIL").alias("result")) for k, (fair, good) in needed.items()))
    out = counts.select("client_id", F.explode(rows).alias("r")).select("client_id", "r.*")
    worst = F.max(F.when(F.col("result") == "FAIL", 2).when(F.col("result") == "WARN", 1).otherwise(0)).over(Window.partitionBy("client_id"))
    return out.withColumn("overall", F.when(worst == 2, "FAIL").when(worst == 1, "WARN").otherwise("PASS"))


def verdict(rows: DataFrame) -> DataFrame:
    """One verdict for each client by priority: alert, danger, flagged, no data, clear."""
    v = F.when(F.col("alerts") > 0, "alert").when(F.col("critical") > 0, "danger").when(F.col("flagged") > 0, "flagged").when(F.col("documents") == 0, "no data")
    return rows.withColumn("verdict", v.otherwise("clear"))


def advised(clients: DataFrame, events: DataFrame) -> DataFrame:
    """The document that a client's plan advises on: the worst of an executive, else the worst, smallest id on ties."""
    worst = F.struct(-F.col("risk_score"), "document_id")
    of = events.groupBy("client_id").agg(F.min_by("document_id", F.when(F.col("entity_type") == "person", worst)).alias("executive"), F.min_by("document_id", worst).alias("any"))
    return clients.select("client_id").join(of, "client_id", "left").select("client_id", F.coalesce("executive", "any").alias("document_id"))


def ranked_peers(peers: DataFrame, key: str = "client_id") -> DataFrame:
    """Proposed peers (key, name, tracked, seen_in, positions, news_count) with place: tracked ones first, then by the answers that
    name them, the mean of the positions they gave it (99 if none), the news count, and the name."""
    mean = F.when(F.size("positions") > 0, F.aggregate("positions", F.lit(0.0), lambda s, x: s + x) / F.size("positions")).otherwise(99.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    order = [F.desc(F.coalesce("tracked", F.lit(False))), F.desc(zero("seen_in")), mean, F.desc(zero("news_count")), F.lower("name"), "name"]
    return peers.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


# Reliability of sources of unknown kind, of social ones at most, of feeds at most, and news hosts that are sure.
UNKNOWN_SOURCE, SOCIAL_MOST, FEED_MOST = 0.65, 0.60, 0.80
SOCIAL_TYPES = ["reddit", "forum", "social"]
SURE_NEWS = ["reuters.com", "bloomberg.com", "wsj.com", "nytimes.com", "ft.com"]


def source_reliability(known: Column, base: Column, source_type: Column, url: Column) -> Column:
    """Reliability of a source: its category's ``base`` (1.0 if that is null or 0; UNKNOWN_SOURCE without a category), capped for social
    sources and feeds; a feed of a sure news host is 1.0. ``known``: whether the source exists; ``base``: a struct with score, null
    without a category."""
    kind, where = F.lower(F.coalesce(source_type, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    holds = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    score = base["score"].cast("double")
    start = F.when(base.isNull(), UNKNOWN_SOURCE).otherwise(F.when(F.coalesce(score, F.lit(0.0)) == 0, 1.0).otherwise(score))
    feed = F.when(holds(where, SURE_NEWS), 1.0).otherwise(F.least(start, F.lit(FEED_MOST)))
    return F.when(~known, UNKNOWN_SOURCE).when(holds(kind, SOCIAL_TYPES), F.least(start, F.lit(SOCIAL_MOST))).when(kind.contains("rss"), feed).otherwise(start)
