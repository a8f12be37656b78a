"""Registered queries: enrichment, status, menus, gates of curated competitors, title rules one by one, sinks and SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura import rules as R
from murmura.functions import common, text, udtfs
from murmura.operators import alerts, gates, incidents, ingest, labels, lookups, names, ranks, reports, risk, scores
from murmura.plans.q_reports import RUNS_SQL, VISIBLE_SQL, calls, daily_runs, stored_alerts, visible
from murmura.plans.q_scores import _EXECUTIVE_SQL, TS, _REL, _events, gated_sql, rounded, star_sql
from murmura.plans.q_text import SUMMARY_SQL, TITLES, _ids, docs, incident_items, incidents_sql, titled
from murmura.plans.star import AS_OF, Star, _case, with_star
from murmura.scratch import scratch_path
from murmura.streaming import jobs


def enrichment(s: Star) -> DataFrame:
    own = gates.without_competitors(_events(s))
    named = s.mentions.join(s.entities.select("entity_id", "entity_name"), "entity_id")
    rows = reports.document_enrichment(visible(s), s.documents, s.sources, own, s.topics, named, risk.entity_sentiment(s.mentions).select("document_id", "entity_id", "label"))
    return rounded(rows.withColumn("mentions", F.array_join("mentions", ",")))


def status(s: Star) -> DataFrame:
    rows = s.mentions.join(s.entities.select("entity_id", "client_id"), "entity_id").select("client_id", "document_id")
    gated = gates.brand_gate(rows, gates.brand_documents(s.mentions, s.entities), s.entities)
    runs = daily_runs(s).select((F.col("user_id") % 25).alias("client_id"), "status")
    return reports.collection_status(s.clients, gated, s.documents, runs, F.col("collected_at") >= F.expr(f"{TS} - INTERVAL 1 DAY"))


def leads(s: Star) -> DataFrame:
    d = docs(s)
    return d.select(F.col("doc_id").alias("document_id"), common.phrase_form(F.concat_ws(" ", "title", F.substring("text", 1, 600))).alias("lead"), common.phrase_form(F.col("text")).alias("text"))


RIVALS = [(1, " the re ", []), (3, " ertion ", [" onre ", " eaux "]), (4, " und die ", []), (5, " the ", [" zzz "])]


def rivals(s: Star) -> DataFrame:
    terms = s.spark.createDataFrame(RIVALS, "entity_id int, name string, context array<string>")
    return lookups.competitor_documents(leads(s), terms)


_RIVALS_SQL = r"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(split_part(text, chr(10), 1) || ' ' || substr(text, 1, 600)), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) || ' ' AS lead,
  ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT 1 AS entity_id, doc_id AS document_id FROM d WHERE contains(lead, ' the re ') UNION ALL SELECT 3, doc_id FROM d WHERE contains(lead, ' ertion ') AND (contains(t, ' onre ') OR contains(t, ' eaux '))
UNION ALL SELECT 4, doc_id FROM d WHERE contains(lead, ' und die ') UNION ALL SELECT 5, doc_id FROM d WHERE contains(lead, ' the ') AND contains(t, ' zzz ')"""

COMPANIES = ["Orris Corp.", "orris homes", "Orris Homes of Pune 2", "Orris's Best", "Orris", "The World's most valuable"]


def title_pages(s: Star) -> DataFrame:
    """Texts with a title so many letters after the entity's name, whose own last word is a title too."""
    rows = s.mentions.join(s.entities.select("entity_id", "entity_name"), "entity_id").select("document_id", "entity_id", "line", "entity_name")
    tail = F.repeat(F.lit("x"), (F.col("document_id") % 150).cast("int"))
    return rows.withColumn("name", F.concat("entity_name", F.lit(" MD"))).withColumn("text", F.concat(F.lit("said "), F.lower("name"), F.lit(" "), tail, F.lit(" director and")))


def alert_state(s: Star) -> DataFrame:
    """Living alerts of a stream of signals, merged batch by batch into those that are stored."""
    e = jobs.read_events(s.spark, s.sf_dir)
    level = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "purchase", "HIGH").otherwise("WARNING")
    signals = e.select((F.col("user_id") % 25).alias("client_id"), F.lit("Multi-Signal Incident").alias("alert_type"), F.col("user_id").alias("entity_id"), level.alias("severity"), F.col("event_id").alias("document_id"), F.round("value", 3).alias("evidence_score"), (F.col("event_id") % 100).cast("double").alias("confidence_score"))
    held = s.table("events").select("user_id").distinct().where("user_id % 2 = 0").select(
        (F.col("user_id") % 25).alias("client_id"), F.lit("Multi-Signal Incident").alias("alert_type"), F.col("user_id").alias("entity_id"), F.lit("HIGH").alias("severity"), F.array(F.lit(-1).cast("long")).alias("documents"),
        F.lit(10.0).alias("evidence_score"), F.lit(20.0).alias("confidence_score"), F.when(F.col("user_id") % 4 == 0, "RESOLVED").otherwise("ACTIVE").alias("lifecycle_status"), F.array(F.lit("seed")).alias("history"))
    out = jobs.run_available(signals, mode="append", merge=lambda old, batch: alerts.merge_alerts(old, alerts.alert_batch(batch)), start=held, keys=["client_id", "alert_type", "entity_id"])
    return rounded(out.select("client_id", "entity_id", "severity", F.size("documents").alias("documents"), "evidence_score", "confidence_score", "lifecycle_status", F.element_at("history", -1).alias("last_step")))


def title_scores(s: Star) -> DataFrame:
    """The title rules of every risk event, each in a column of its own."""
    t = titled(s)
    fields = risk.penalty_fields(F.col("title"))
    rows = t.withColumns(fields).withColumn("age", (F.lit(AS_OF).cast("timestamp").cast("double") - F.col("published_at").cast("timestamp").cast("double")) / 86400)
    cap, why = risk.penalty_cap(F.col("age"))
    return rows.select(
        "document_id", "entity_id", "k", "entity_type", "risk_score", risk.noise_reason(F.col("title"), F.col("document_type")).alias("noise"),
        risk.serious_floor(F.col("title"), F.col("document_type"), F.col("sentiment"), F.col("role"), F.col("entity_name"), F.lit("")).alias("floor"),
        ((F.col("risk_score") > R.ROLE_MIN) & F.coalesce(F.col("role").isin("BYSTANDER", "EXONERATED"), F.lit(False))).alias("zeroed"),
        "amount_lakh", "authority", "criminal", "restricts", cap.alias("penalty_capped"), why.alias("penalty_reason"),
        risk.ugc_cap(F.col("document_type"), F.col("view_count"), F.col("author"), F.col("case_status")).alias("ugc"),
    )


def picked(*columns: str) -> Callable[[Star], DataFrame]:
    return lambda s: title_scores(s).select("document_id", "entity_id", *columns)


def counted(texts: list[str]) -> list[float]:
    return [float(t.count("e")) for t in texts]


def archived(s: Star) -> DataFrame:
    """Payloads archived in two loads that overlap."""
    path = scratch_path(s.spark, "archive")
    rows = s.documents.select("content_hash", F.concat(F.lit("payload of "), "content_hash").alias("payload"), "document_id")
    ingest.archive_once(rows.where("document_id % 3 <> 0"), path)
    ingest.archive_once(rows.where("document_id % 2 = 0"), path)
    return s.spark.read.schema("content_hash string, payload string, prefix string").parquet(path).select("content_hash", "payload", "prefix")


def sliced(s: Star) -> DataFrame:
    udtfs.register(s.spark)
    s.documents.groupBy("source_id").agg(F.min("collected_at").cast("date").alias("a"), F.max("collected_at").cast("date").alias("b")).createOrReplaceTempView("murmura_ranges")
    return s.spark.sql("SELECT source_id, slice_start, slice_end FROM murmura_ranges, LATERAL calendar_slices(a, b, 12)")


def sentence_rows(s: Star) -> DataFrame:
    udtfs.register(s.spark)
    s.table("conversations").createOrReplaceTempView("murmura_turns")
    return s.spark.sql("SELECT conv_id, turn, count(*) AS sentences, sum(length(sentence)) AS chars FROM murmura_turns, LATERAL sentences(text) GROUP BY 1, 2")


#: Facts of the titles, by their number: what the rules read out of them.
_K = "(f.document_id + f.entity_id) % 8"
_T = f"""t AS (SELECT f.*, {_K} AS k, CASE WHEN (f.document_id + f.entity_id) % 19 = 0 THEN 'BYSTANDER' END AS role, (['allegation', 'penalty_or_order', 'settled', 'probe'])[CAST((f.document_id + f.entity_id) % 4 + 1 AS INT)] AS case_status,
  CASE WHEN (f.document_id + f.entity_id) % 3 = 0 THEN 'NDTV India' ELSE 'someone' END AS author, (f.document_id + f.entity_id) * 101 % 200000 AS views FROM events f),
p AS (SELECT *, CASE k WHEN 0 THEN 12.0 WHEN 3 THEN 4000.0 END::DOUBLE AS amount_lakh, CASE k WHEN 0 THEN 'small' WHEN 3 THEN 'senior' WHEN 5 THEN 'senior' ELSE 'unknown' END AS authority, k = 3 AS criminal, FALSE AS restricts,
  (epoch({TS}) - epoch(published_at)) / 86400 > 730 AS old FROM t)"""

_NOISE = "CASE WHEN k = 1 THEN 'market_move' WHEN k = 2 THEN 'financial_results' WHEN k = 6 AND document_type IN ('youtube', 'instagram') THEN 'promotional' END"
_FLOOR = "(k IN (0, 3, 5) AND document_type IN ('rss', 'gdelt') AND sentiment <> 'Positive' AND role IS NULL)"
_CAPPED = "(k NOT IN (3, 5) AND (coalesce(old, FALSE) OR k = 0))"
_UGC = "(case_status = 'allegation' AND document_type IN ('youtube', 'instagram', 'reddit') AND author = 'someone' AND views < 100000)"


def _title_sql(columns: str) -> str:
    return star_sql(f"{_T} SELECT document_id, entity_id, {columns} FROM p")


QUERIES = {
    "j7_document_enrichment": (enrichment, star_sql(f"""{VISIBLE_SQL},
tt AS (SELECT document_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY topic_confidence DESC, line, topic) AS k FROM topics) WHERE k = 1),
rr AS (SELECT client_id, document_id, risk_score, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY client_id, document_id ORDER BY risk_score DESC, entity_id) AS k FROM events WHERE entity_type IS DISTINCT FROM 'competitor') WHERE k = 1),
nn AS (SELECT document_id, array_to_string(list_sort(list(DISTINCT entity_name)), ',') AS mentions FROM mentions JOIN entities USING (entity_id) GROUP BY 1)
SELECT v.client_id, v.document_id, source_name, round(rr.risk_score, 6) AS risk_score, rr.entity_id, coalesce(fl.label, d.sentiment_label) AS label, coalesce(tt.topic, 'General') AS topic, mentions
FROM visible v JOIN docs d ON d.document_id = v.document_id LEFT JOIN sources so ON so.source_id = d.source_id LEFT JOIN rr ON rr.client_id = v.client_id AND rr.document_id = v.document_id
LEFT JOIN first_label fl ON fl.document_id = v.document_id AND fl.entity_id = rr.entity_id LEFT JOIN tt ON tt.document_id = v.document_id LEFT JOIN nn ON nn.document_id = v.document_id""")),
    "j13_intersect_gate": (lambda s: lookups.cooccurring(s.mentions, s.entities, "competitor"),
        star_sql("SELECT DISTINCT client_id, entity_id, document_id FROM mentions JOIN entities USING (entity_id) WHERE entity_type = 'competitor' AND (client_id, document_id) IN (SELECT (client_id, document_id) FROM brand_docs)")),
    "j15_seeded_competitor_gate": (rivals, _RIVALS_SQL),
    "m13_org_confidence": (
        lambda s: s.entities.select("entity_id", names.company_confidence(F.element_at(F.array(*map(F.lit, COMPANIES)), (F.col("entity_id") % len(COMPANIES) + 1).cast("int"))).alias("confidence")),
        with_star("x AS (SELECT 1) SELECT entity_id, CASE entity_id % 6 WHEN 0 THEN 0.85 WHEN 1 THEN 0.55 WHEN 2 THEN 0.5 WHEN 3 THEN 0.65 WHEN 4 THEN 0.75 ELSE 0.3 END::DOUBLE AS confidence FROM entities")),
    "m14_title_near_name": (
        lambda s: title_pages(s).select("document_id", "entity_id", "line", names.title_near_name(F.col("text"), F.col("name")).alias("near")),
        with_star("x AS (SELECT 1) SELECT document_id, entity_id, line, document_id % 150 <= 90 AS near FROM mentions JOIN entities USING (entity_id)")),
    "g21_source_contribution": (lambda s: s.documents.join(s.sources.select("source_id", "source_name"), "source_id", "left").groupBy(F.coalesce("source_name", F.lit("RSS Feed")).alias("source")).agg(F.count("*").alias("documents")),
        with_star("x AS (SELECT 1) SELECT coalesce(source_name, 'RSS Feed') AS source, count(*) AS documents FROM docs LEFT JOIN sources USING (source_id) GROUP BY 1")),
    "g21_alert_severity": (lambda s: reports.alert_severity(alerts.merge_alerts(*stored_alerts(s)).withColumn("severity", F.when(F.col("entity_id") % 7 != 0, F.initcap("severity")))),
        with_star("""d AS (SELECT DISTINCT entity_id FROM mentions), x AS (SELECT entity_id, greatest(CASE WHEN entity_id % 3 <> 0 THEN entity_id % 3 ELSE -1 END, CASE WHEN entity_id % 5 <> 0 THEN (entity_id + 1) % 3 ELSE -1 END) AS v FROM entities JOIN d USING (entity_id))
SELECT CASE WHEN entity_id % 7 = 0 OR v = 0 THEN 'MEDIUM' WHEN v = 1 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, count(*) AS alerts FROM x WHERE v >= 0 GROUP BY 1""")),
    "g32_matching_metrics": (lambda s: rounded(reports.matching_metrics(s.table("events"), "ts", F.col("event_type") == "purchase", "value")),
        "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS documents, count(*) FILTER (event_type = 'purchase') AS matches, round(avg(value), 6) AS mean_time FROM events GROUP BY 1"),
    "g40_collection_status": (status, with_star(f"""{RUNS_SQL}, brand_docs AS (SELECT DISTINCT client_id, document_id FROM mentions JOIN entities USING (entity_id) WHERE entity_type IN ('brand', 'product')),
own_clients AS (SELECT DISTINCT client_id FROM entities WHERE entity_type IN ('brand', 'product')), m AS (SELECT client_id, document_id FROM mentions JOIN entities USING (entity_id)), g AS (SELECT * FROM {gated_sql('m')}),
c AS (SELECT client_id, count(DISTINCT document_id) AS documents, count(*) AS matches, count(DISTINCT CASE WHEN collected_at >= {TS} - INTERVAL 1 DAY THEN document_id END) AS today FROM g JOIN docs USING (document_id) GROUP BY 1),
j AS (SELECT user_id % 25 AS client_id, count(*) AS jobs, count(*) FILTER (status = 'SUCCESS') AS completed, count(*) FILTER (status = 'FAILED') AS failed FROM runs GROUP BY 1),
a AS (SELECT client_id, coalesce(documents, 0) AS documents, coalesce(matches, 0) AS matches, coalesce(today, 0) AS today, coalesce(jobs, 0) AS jobs, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed FROM clients LEFT JOIN c USING (client_id) LEFT JOIN j USING (client_id))
SELECT *, CASE WHEN jobs = 0 OR failed = 0 THEN 100 ELSE CAST(round_even(completed / jobs::DOUBLE * 100, 0) AS INT) END AS queue_health, CASE WHEN failed = 0 THEN 'Healthy' ELSE 'Degraded' END AS platform FROM a""")),
    "w13_health_latest": (
        lambda s: rounded(ranks.health_latest(daily_runs(s), "user_id", ["day"], F.col("status") == "SUCCESS", "finished_at").select("user_id", "failures", "penalty", "last_success", "status")),
        f"""WITH {RUNS_SQL}, l AS (SELECT user_id, max(day) FILTER (status = 'SUCCESS') AS ok, max(finished_at) FILTER (status = 'SUCCESS') AS last_success FROM runs GROUP BY 1),
f AS (SELECT user_id, count(*) FILTER (ok IS NULL OR day > ok) AS failures, any_value(last_success) AS last_success FROM runs JOIN l USING (user_id) GROUP BY 1)
SELECT user_id, failures, round(least(failures * 0.2, 1.0)::DOUBLE, 6) AS penalty, last_success, CASE WHEN failures >= 5 THEN 'BROKEN' WHEN failures > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM f"""),
    "k8_incident_menu": (lambda s: rounded(_ids(incidents.incident_menu(incidents.incident_summary(i := incident_items(s), incidents.incidents(i))), "incident_id")),
        incidents_sql(SUMMARY_SQL.replace("round(max(score), 6) AS score", "round(max(score), 6) AS score, max(score) AS s0") + " ORDER BY s0 DESC, items DESC, lead_title, incident_document_id, incident_entity_id LIMIT 30").replace("SELECT incident_document_id", "SELECT * EXCLUDE (s0) FROM (SELECT incident_document_id", 1) + ")"),
    "k10_candidate_list": (
        lambda s: ranks.top_per_key(s.mentions.join(s.entities.select("entity_id", "client_id"), "entity_id").groupBy("client_id", "part_id").agg(F.count("*").alias("mentions"), F.max("confidence").alias("confidence"), F.countDistinct("document_id").alias("documents")), ["client_id"], [F.desc("mentions"), F.desc("confidence"), "part_id"], 500).select("client_id", "part_id", "mentions", "documents", "rn"),
        with_star("""c AS (SELECT client_id, part_id, count(*) AS mentions, max(confidence) AS confidence, count(DISTINCT document_id) AS documents FROM mentions JOIN entities USING (entity_id) GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY mentions DESC, confidence DESC, part_id) AS rn FROM c) SELECT client_id, part_id, mentions, documents, rn FROM t WHERE rn <= 500""")),
    "k12_top_tracked_executives": (
        lambda s: ranks.top_per_key(scores.executive_score(s.entities, s.documents, s.mentions, _events(s), as_of=AS_OF).withColumn("scored", F.col("health") != "INSUFFICIENT_EVIDENCE").withColumn("score", F.round("score", 6)), ["client_id"], [F.desc("scored"), F.when(F.col("scored"), F.col("score")).otherwise(0.0).desc(), F.desc("documents"), "entity_id"], 8).select("client_id", "entity_id", "rn"),
        _EXECUTIVE_SQL.rpartition("SELECT client_id, entity_id, documents")[0] + "SELECT * FROM (SELECT client_id, entity_id, row_number() OVER (PARTITION BY client_id ORDER BY enough DESC, CASE WHEN enough THEN round(score, 6) ELSE 0 END DESC, documents DESC, entity_id) AS rn FROM z) WHERE rn <= 8"),
    "c5_collapse_by_incident": (lambda s: rounded(_ids(incidents.collapsed_by_incident(i := incident_items(s), incidents.incidents(i)).drop("shown"), "incident_id", "lead")),
        incidents_sql("SELECT incident_document_id, incident_entity_id, arg_min(k, (-score, k, entity_id)) AS lead_document_id, arg_min(entity_id, (-score, k, entity_id)) AS lead_entity_id, round(max(score), 6) AS score, count(*) - 1 AS others FROM gi JOIN ro USING (root) GROUP BY 1, 2")),
    "c1_incident_tokens": (
        lambda s: incidents.incident_tokens(s.documents.select(F.col("document_id").alias("item_id"), F.lit(0).alias("entity_id"), F.lit("Storey Works").alias("entity_name"), F.replace("title", F.lit(" item "), F.lit(" raided links of ")).alias("title"), F.lit(None).cast("string").alias("event"))).select("item_id", "kind", "token"),
        with_star("""x AS (SELECT document_id AS item_id, title, CASE WHEN regexp_matches(title, ' - ') THEN regexp_extract(title, '^(.*) - (.*)$', 1) ELSE title END AS h FROM docs),
w AS (SELECT item_id, unnest(['raid', 'link', regexp_extract(h, '^Story ([0-9]+)', 1), regexp_extract(h, 'item ([0-9]+)$', 1)]) AS token FROM x) SELECT DISTINCT item_id, 'title' AS kind, token FROM w""")),
    "t7_alert_state": (alert_state, """WITH g AS (SELECT user_id, max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) AS v, count(DISTINCT event_id) AS n, max(round(value, 3)) AS e, max(event_id % 100)::DOUBLE AS c FROM events GROUP BY 1)
SELECT user_id % 25 AS client_id, user_id AS entity_id, CASE greatest(v, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'WARNING' END AS severity,
  CAST(n + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS documents, round(greatest(e, CASE WHEN user_id % 2 = 0 THEN 10.0 END), 6)::DOUBLE AS evidence_score, greatest(c, CASE WHEN user_id % 2 = 0 THEN 20.0 END)::DOUBLE AS confidence_score,
  CASE WHEN user_id % 2 = 0 THEN 'ACTIVE' ELSE 'NEW' END AS lifecycle_status, CASE WHEN user_id % 4 = 0 THEN 'RESOLVED>ACTIVE' WHEN user_id % 2 = 0 THEN 'seed' ELSE 'NEW' END AS last_step FROM g"""),
    "r3_reach_trust_eligible": (lambda s: s.documents.select("document_id", common.reach_trust_eligible(*(F.col(c) for c in ("document_type", "title", "view_count", "comment_count"))).alias("eligible")), star_sql("SELECT document_id, eligible FROM reach")),
    "r4_source_reliability_modifier": (lambda s: s.sources.select("source_id", common.reliability_modifier(F.concat("category", F.element_at(F.array(*map(F.lit, [" court news", " blog", " social forum", ""])), (F.col("source_id") % 4 + 1).cast("int")))).alias("modifier")),
        with_star("x AS (SELECT 1) SELECT source_id, CASE source_id % 4 WHEN 0 THEN 1.2 WHEN 1 THEN 0.85 WHEN 2 THEN 0.7 ELSE 1.0 END::DOUBLE AS modifier FROM sources")),
    "r7_title_rules": (picked("k", "noise"), _title_sql(f"k, {_NOISE} AS noise")),
    "r10_final_score": (
        lambda s: rounded(risk.final_score(titled(s), floor=True, case_status=True, as_of=AS_OF).select("document_id", "entity_id", "final_score")),
        star_sql(f"""{_T}, s1 AS (SELECT *, CASE WHEN entity_type = 'brand' AND risk_score > 25 AND {_NOISE} IS NOT NULL THEN 25.0 ELSE risk_score END AS a FROM p),
s2 AS (SELECT *, CASE WHEN entity_type = 'brand' AND {_FLOOR} AND a < 51 THEN 51.0 ELSE a END AS b FROM s1), s3 AS (SELECT *, CASE WHEN b > 25 AND role IS NOT NULL THEN 0.0 ELSE b END AS c FROM s2)
SELECT document_id, entity_id, round(CASE WHEN c > 50 AND (case_status = 'settled' OR (case_status = 'penalty_or_order' AND {_CAPPED}) OR {_UGC}) THEN 50.0 ELSE c END::DOUBLE, 6) AS final_score FROM s3""")),
    "r8_serious_floor": (picked("k", "floor"), _title_sql(f"k, {_FLOOR} AS floor")),
    "r9_role_zeroing": (picked("zeroed"), _title_sql("risk_score > 25 AND role IS NOT NULL AS zeroed")),
    "r11_penalty_parse": (picked("k", "amount_lakh", "authority", "criminal", "restricts"), _title_sql("k, amount_lakh, authority, criminal, restricts")),
    "r12_penalty_cap": (picked("k", "penalty_capped", "penalty_reason"), _title_sql(f"""k, {_CAPPED} AS penalty_capped,
  CASE WHEN k = 3 THEN 'criminal' WHEN k = 5 THEN 'senior authority' WHEN old THEN 'old' WHEN k = 0 THEN 'small amount' ELSE 'nothing found' END AS penalty_reason""")),
    "r13_ugc_cap": (picked("ugc"), _title_sql(f"{_UGC} AS ugc")),
    "r14_risk_level": (lambda s: _events(s).select("document_id", "entity_id", common.risk_level(F.col("risk_score")).alias("level")), star_sql("SELECT document_id, entity_id, CASE WHEN risk_score <= 25 THEN 'LOW' WHEN risk_score <= 50 THEN 'MEDIUM' WHEN risk_score <= 75 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM events")),
    "s8_write_tables": (lambda s: rounded(s.write(_events(s).select("client_id", "document_id", "entity_id", "risk_score", "risk_level"), "risk-events", ["client_id", "risk_level"])), star_sql("SELECT client_id, document_id, entity_id, round(risk_score, 6) AS risk_score, risk_level FROM events")),
    "s10_raw_payload_archive": (archived, with_star("x AS (SELECT 1) SELECT DISTINCT content_hash, 'payload of ' || content_hash AS payload, substr(content_hash, 1, 2) AS prefix FROM docs WHERE document_id % 3 <> 0 OR document_id % 2 = 0")),
    "x17_strip_legal_suffix": (lambda s: s.entities.select("entity_id", text.strip_legal_suffix(F.concat("entity_name", F.element_at(F.array(*map(F.lit, [" Ltd", " Pvt. Ltd.", ", Inc", ""])), (F.col("entity_id") % 4 + 1).cast("int")))).alias("name")),
        with_star("x AS (SELECT 1) SELECT entity_id, CASE WHEN entity_id % 4 <> 3 THEN entity_name END AS name FROM entities")),
    "u3_score_batch": (lambda s: labels.score_batches(docs(s).select("doc_id", "text"), "text", lambda: counted).select("doc_id", "score"), "SELECT doc_id, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS score FROM documents"),
    "u5_calendar_slices": (sliced, with_star("""rg AS (SELECT source_id, min(collected_at)::DATE AS a, max(collected_at)::DATE AS b FROM docs GROUP BY 1), m AS (SELECT source_id, a, b, CAST(unnest(generate_series(date_trunc('year', a)::TIMESTAMP, (b - 1)::TIMESTAMP, INTERVAL 12 MONTH)) AS DATE) AS d FROM rg WHERE a < b)
SELECT source_id, greatest(d, a) AS slice_start, least(CAST(d + INTERVAL 12 MONTH AS DATE), b) AS slice_end FROM m""")),
    "u5_sentences": (sentence_rows, r"""WITH r AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM conversations)
SELECT conv_id, turn, count(*) AS sentences, sum(length(s))::BIGINT AS chars FROM r WHERE regexp_matches(s, '\S') GROUP BY 1, 2"""),
}
