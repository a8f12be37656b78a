"""Registered queries: reports, ranks, top lists, alerts, planning and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.operators import alerts, gates, planning, ranks, reports, risk
from murmura.operators.intervals import interval_totals
from murmura.plans.q_scores import TS, _events, gated_sql, rounded, star_sql
from murmura.plans.star import AS_OF, Star, with_star

PRICES = {"click": 3.0, "view": 2.0, "purchase": 15.0}
EV_AS_OF = "2024-01-31 00:00:00"
_PRICE_SQL = "CASE call_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in PRICES.items()) + " END"

CALLS_SQL = """calls AS (SELECT event_id, ts, user_id % 50 AS client_id, event_type AS call_type, CAST(trunc(value) AS BIGINT) AS tokens, event_id % 13 <> 0 AS success,
  CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events)"""
VISIBLE_SQL = "visible AS (SELECT DISTINCT client_id, document_id FROM mentions JOIN entities USING (entity_id))"


def visible(s: Star) -> DataFrame:
    return s.mentions.join(s.entities, "entity_id").select("client_id", "document_id").distinct()


def calls(s: Star) -> DataFrame:
    return s.table("events").select(
        "event_id", "ts", (F.col("user_id") % 50).alias("client_id"), F.col("event_type").alias("call_type"), F.col("value").cast("long").alias("tokens"),
        (F.col("event_id") % 13 != 0).alias("success"), F.date_trunc("day", "ts").alias("day"),
    )


def calls_sql(sql: str) -> str:
    return f"WITH {CALLS_SQL}\n{sql}"


def labelled(s: Star) -> DataFrame:
    return risk.entity_sentiment(s.mentions).join(s.entities, "entity_id")


def alert_rows(s: Star) -> DataFrame:
    events = gates.without_competitors(_events(s))
    people = gates.brand_gate(events.where("entity_type = 'person' AND risk_score > 50"), gates.brand_documents(s.mentions, s.entities), s.entities)
    return rounded(alerts.alert_evidence(alerts.alert_candidates(events), people, alerts.evidence_threshold(_events(s))).drop("documents"))


_ALERT_SQL = star_sql(f"""
ev AS (SELECT * FROM events WHERE entity_type IS DISTINCT FROM 'competitor'),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, risk_score DESC, document_id, entity_id) AS k FROM ev WHERE risk_score > 50) WHERE k <= 15),
thr AS (SELECT client_id, CASE WHEN count(*) > 50 THEN 55.0 WHEN count(*) > 15 THEN 40.0 ELSE 15.0 END::DOUBLE AS threshold FROM events GROUP BY client_id),
ppl AS (SELECT DISTINCT client_id, entity_id, TRUE AS executive FROM {gated_sql("(SELECT * FROM ev WHERE entity_type = 'person' AND risk_score > 50)")}),
rk AS (SELECT client_id, entity_id, max(risk_score) AS max_risk, count(DISTINCT document_id) AS nd FROM cand GROUP BY ALL),
b AS (SELECT coalesce(rk.client_id, ppl.client_id) AS client_id, coalesce(rk.entity_id, ppl.entity_id) AS entity_id, coalesce(max_risk, 0) AS top, coalesce(nd, 0) AS n_documents, coalesce(executive, FALSE) AS executive
  FROM rk FULL JOIN ppl ON rk.client_id = ppl.client_id AND rk.entity_id = ppl.entity_id),
z AS (SELECT b.*, threshold, least((top * 0.45 + least(n_documents * 4.0, 20.0) + CASE WHEN executive THEN 15.0 ELSE 0.0 END) * 1.25, 100.0)::DOUBLE AS evidence_score,
  least(greatest(40.0 + least(n_documents * 6.0, 30.0) + top * 0.15, 10.0), 100.0)::DOUBLE AS confidence_score FROM b JOIN thr USING (client_id))
SELECT client_id, entity_id, threshold, executive, n_documents, round(evidence_score, 6) AS evidence_score, round(confidence_score, 6) AS confidence_score,
  CASE WHEN evidence_score > 70 OR executive THEN 'CRITICAL' WHEN evidence_score > 45 THEN 'HIGH' ELSE 'WARNING' END AS severity,
  CASE WHEN executive THEN 'Executive Risk' ELSE 'Multi-Signal Incident' END AS alert_type FROM z WHERE evidence_score >= threshold AND confidence_score >= 40
""")


def stored_alerts(s: Star) -> tuple[DataFrame, DataFrame]:
    """Two generations of alerts out of orders and lineitem keys."""
    e = s.entities.select("client_id", "entity_id")
    sev = lambda i: F.element_at(F.array(*map(F.lit, alerts.SEVERITIES)), (i % 3 + 1).cast("int"))
    kind = F.when(F.col("entity_id") % 2 == 0, "Executive Risk").otherwise("Multi-Signal Incident")
    doc = s.mentions.groupBy("entity_id").agg(F.min("document_id").alias("lo"), F.max("document_id").alias("hi"))
    rows = e.join(doc, "entity_id")
    life = F.element_at(F.array(*map(F.lit, ["ACTIVE", "RESOLVED", "CLOSED", "ACKNOWLEDGED"])), (F.col("entity_id") % 4 + 1).cast("int"))
    stored = rows.where("entity_id % 3 <> 0").select("client_id", kind.alias("alert_type"), "entity_id", sev(F.col("entity_id")).alias("severity"), F.array("lo").alias("documents"),
        (F.col("entity_id") % 60).cast("double").alias("evidence_score"), (F.col("entity_id") % 70).cast("double").alias("confidence_score"), life.alias("lifecycle_status"), F.array(F.lit("seed")).alias("history"))
    new = rows.where("entity_id % 5 <> 0").select("client_id", kind.alias("alert_type"), "entity_id", sev(F.col("entity_id") + 1).alias("severity"), F.array("hi", "lo").alias("documents"),
        (F.col("entity_id") % 80).cast("double").alias("evidence_score"), (F.col("entity_id") % 50).cast("double").alias("confidence_score"))
    return stored, new


def merged_alerts(s: Star) -> DataFrame:
    rows = alerts.merge_alerts(*stored_alerts(s))
    return rows.select("client_id", "alert_type", "entity_id", "severity", F.array_join(F.col("documents").cast("array<string>"), ",").alias("documents"), "evidence_score", "confidence_score", "lifecycle_status", F.array_join("history", ",").alias("history"))


_MERGE_SQL = with_star("""
d AS (SELECT entity_id, min(document_id) AS lo, max(document_id) AS hi FROM mentions GROUP BY 1),
r AS (SELECT client_id, entity_id, lo, hi, CASE WHEN entity_id % 2 = 0 THEN 'Executive Risk' ELSE 'Multi-Signal Incident' END AS alert_type FROM entities JOIN d USING (entity_id)),
st AS (SELECT *, entity_id % 3 AS sev, CASE entity_id % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'CLOSED' ELSE 'ACKNOWLEDGED' END AS life FROM r WHERE entity_id % 3 <> 0),
nw AS (SELECT *, (entity_id + 1) % 3 AS sev FROM r WHERE entity_id % 5 <> 0),
j AS (SELECT r.*, st.sev AS s_sev, nw.sev AS n_sev, st.life, st.entity_id IS NOT NULL AS has_s, nw.entity_id IS NOT NULL AS has_n FROM r LEFT JOIN st ON st.entity_id = r.entity_id LEFT JOIN nw ON nw.entity_id = r.entity_id
  WHERE st.entity_id IS NOT NULL OR nw.entity_id IS NOT NULL),
k AS (SELECT *, CASE WHEN NOT has_s THEN 'NEW' WHEN has_n AND life IN ('RESOLVED', 'CLOSED') THEN 'ACTIVE' ELSE life END AS lifecycle_status FROM j)
SELECT client_id, alert_type, entity_id, CASE greatest(coalesce(s_sev, -1), coalesce(n_sev, -1)) WHEN 0 THEN 'WARNING' WHEN 1 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  CASE WHEN has_n AND lo <> hi THEN lo || ',' || hi ELSE CAST(lo AS VARCHAR) END AS documents,
  greatest(CASE WHEN has_s THEN entity_id % 60 END, CASE WHEN has_n THEN entity_id % 80 END)::DOUBLE AS evidence_score,
  greatest(CASE WHEN has_s THEN entity_id % 70 END, CASE WHEN has_n THEN entity_id % 50 END)::DOUBLE AS confidence_score, lifecycle_status,
  CASE WHEN NOT has_s THEN 'NEW' WHEN life <> lifecycle_status THEN 'seed,' || life || '>' || lifecycle_status ELSE 'seed' END AS history FROM k
""")


def slices(s: Star, months: int | None = None, days: int | None = None) -> DataFrame:
    ranges = s.documents.groupBy("source_id").agg(F.min("collected_at").cast("date").alias("start_date"), F.max("collected_at").cast("date").alias("end_date"))
    return planning.calendar_slices(ranges, months) if months else planning.fixed_day_slices(ranges, days)


_RANGE_SQL = "rg AS (SELECT source_id, min(collected_at)::DATE AS a, max(collected_at)::DATE AS b FROM docs GROUP BY 1)"


def capped_slices(s: Star) -> DataFrame:
    per = s.documents.groupBy("source_id", F.date_trunc("year", "collected_at").alias("slice")).agg(F.count("*").alias("new_count"))
    return ranks.cumulative_cap(per, ["source_id"], [F.desc("slice")], "new_count", 5)


def kept_slices(s: Star) -> DataFrame:
    half = slices(s, days=90)
    n = half.withColumn("items", F.pmod(F.col("source_id") * 37 + F.dayofyear("slice_start"), F.lit(150)))
    return planning.split_slices(n, "items", 100)


def daily_runs(s: Star) -> DataFrame:
    """A run for each user and day of events: start, end, status."""
    e = s.table("events").select("user_id", "ts", F.date_trunc("day", "ts").alias("day"), "event_type")
    status = F.when(F.max(F.col("event_type") == "purchase"), "SUCCESS").when(F.count("*") > 1, "FAILED").otherwise("RUNNING")
    return e.groupBy("user_id", "day").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), status.alias("status"))


RUNS_SQL = """runs AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, min(ts) AS started_at, max(ts) AS finished_at,
  CASE WHEN bool_or(event_type = 'purchase') THEN 'SUCCESS' WHEN count(*) > 1 THEN 'FAILED' ELSE 'RUNNING' END AS status FROM events GROUP BY 1, 2)"""


def streaks(s: Star) -> DataFrame:
    return rounded(ranks.penalty_streak(daily_runs(s), "user_id", ["day"], F.col("status") == "SUCCESS"))


def due(s: Star) -> DataFrame:
    """Sources with a keyword whose last search is older than a day or missing."""
    last = s.documents.groupBy("source_id").agg(F.max("collected_at").alias("last_search"))
    rows = s.sources.select("source_id", "category").join(last, "source_id", "left")
    words = s.spark.createDataFrame([("automobile", "car"), ("building", "house"), ("machinery", "tool"), ("building", "site")], "category string, keyword string")
    late = F.col("last_search").isNull() | (F.col("last_search") < F.expr(f"{TS} - INTERVAL 30 DAYS"))
    return rows.join(words, "category").where(late).select("source_id", "keyword", "last_search")


def interval_costs(s: Star) -> DataFrame:
    """Calls inside runs of the same user: those of a day, and one of the user's whole time."""
    runs = daily_runs(s).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("run"), "started_at", "finished_at")
    whole = s.table("events").groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at")).withColumn("run", F.lit("whole"))
    calls = s.table("events").select("user_id", "ts", F.col("value").cast("long").alias("tokens"))
    return interval_totals(calls, runs.unionByName(whole), "user_id", at="ts", start="started_at", end="finished_at", by=["user_id", "run"], sums={"tokens": "tokens"}).withColumnRenamed("n", "calls")


def _seconds(name: str) -> Column:
    return F.col(name).cast("timestamp").cast("double")


QUERIES = {
    "j8_visible_documents": (
        lambda s: gates.brand_gate(visible(s), gates.brand_documents(s.mentions, s.entities), s.entities).groupBy("client_id").agg(F.count("*").alias("documents")),
        star_sql(f"{VISIBLE_SQL} SELECT client_id, count(*) AS documents FROM {gated_sql('visible')} GROUP BY 1"),
    ),
    "j9_unmatched_documents": (
        lambda s: s.documents.where("document_type = 'youtube'").select("document_id").join(s.mentions.select("document_id"), "document_id", "left_anti"),
        with_star("d AS (SELECT document_id FROM docs WHERE document_type = 'youtube') SELECT document_id FROM d WHERE document_id NOT IN (SELECT document_id FROM mentions)"),
    ),
    "j5_range_run_window": (interval_costs, f"""WITH {RUNS_SQL}, r AS (SELECT user_id, CAST(CAST(day AS DATE) AS VARCHAR) AS run, started_at, finished_at FROM runs UNION ALL SELECT user_id, 'whole', min(ts), max(ts) FROM events GROUP BY 1)
SELECT r.user_id, r.run, count(*) AS calls, sum(CAST(trunc(value) AS BIGINT))::BIGINT AS tokens FROM events e JOIN r ON e.user_id = r.user_id AND e.ts BETWEEN started_at AND finished_at GROUP BY 1, 2"""),
    "j23_orphan_rows": (
        lambda s: gates.orphans(s.documents.select("document_id"), s.mentions, "document_id").agg(F.count("*").alias("rows")).withColumn("check_name", F.lit("documents without mentions"))
        .unionByName(gates.orphans(s.mentions, s.documents, "document_id").agg(F.count("*").alias("rows")).withColumn("check_name", F.lit("mentions without document"))),
        with_star("x AS (SELECT 1) SELECT 'documents without mentions' AS check_name, count(*) AS rows FROM docs WHERE document_id NOT IN (SELECT document_id FROM mentions) UNION ALL SELECT 'mentions without document', count(*) FROM mentions WHERE document_id NOT IN (SELECT document_id FROM docs)"),
    ),
    "j27_due_searches": (due, with_star(f"""w(category, keyword) AS (VALUES ('automobile', 'car'), ('building', 'house'), ('machinery', 'tool'), ('building', 'site')),
l AS (SELECT source_id, max(collected_at) AS last_search FROM docs GROUP BY 1)
SELECT source_id, keyword, last_search FROM sources JOIN w USING (category) LEFT JOIN l USING (source_id) WHERE last_search IS NULL OR last_search < {TS} - INTERVAL 30 DAY""")),
    "l11_topic_of_document": (lambda s: reports.topic_of_document(s.topics), with_star("x AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY topic_confidence DESC, line, topic) AS k FROM topics) SELECT document_id, topic FROM x WHERE k = 1")),
    "g7_topic_distribution": (
        lambda s: reports.topic_distribution(gates.brand_gate(s.mentions.join(s.entities.where("entity_type = 'competitor'"), "entity_id"), gates.brand_documents(s.mentions, s.entities), s.entities), reports.topic_of_document(s.topics)),
        star_sql(f"""tt AS (SELECT document_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY topic_confidence DESC, line, topic) AS k FROM topics) WHERE k = 1),
d AS (SELECT DISTINCT client_id, entity_id, document_id FROM {gated_sql("(SELECT * FROM facts WHERE entity_type = 'competitor')")})
SELECT c.*, (sum(documents) OVER (PARTITION BY client_id, entity_id))::BIGINT AS entity_documents FROM (SELECT client_id, entity_id, coalesce(topic, 'General') AS topic, count(*) AS documents FROM d LEFT JOIN tt USING (document_id) GROUP BY 1, 2, 3) c"""),
    ),
    "g8_document_counts": (
        lambda s: reports.document_counts(visible(s).join(s.documents, "document_id", "left"), F.col("sentiment_score")),
        with_star(f"""{VISIBLE_SQL} SELECT client_id, count(*) AS total, count(*) FILTER (sentiment_score > 0.3) AS positive, count(*) FILTER (sentiment_score < -0.3) AS negative,
count(*) FILTER (sentiment_score BETWEEN -0.3 AND 0.3) AS neutral, count(*) FILTER (sentiment_score IS NULL) AS unscored FROM visible LEFT JOIN docs USING (document_id) GROUP BY 1"""),
    ),
    "g9_document_risk_summary": (
        lambda s: rounded(reports.document_risk_summary(gates.without_competitors(_events(s)), visible(s), F.col("created_at") >= F.expr(f"{TS} - INTERVAL 365 DAYS"))),
        star_sql(f"""{VISIBLE_SQL}, p AS (SELECT client_id, document_id, max(risk_score) AS score, max(created_at) AS created_at FROM events WHERE entity_type IS DISTINCT FROM 'competitor' GROUP BY ALL),
r AS (SELECT v.client_id, p.score, p.created_at FROM visible v LEFT JOIN p ON v.client_id = p.client_id AND v.document_id = p.document_id)
SELECT client_id, count(*) FILTER (score <= 25) AS low, count(*) FILTER (score > 25 AND score <= 50) AS medium, count(*) FILTER (score > 50 AND score <= 75) AS high, count(*) FILTER (score > 75) AS critical,
count(*) FILTER (score > 50 AND created_at >= {TS} - INTERVAL 365 DAY) AS recent_severe, round(avg(round_even(score, 0)), 6) AS average, round(max(score), 6) AS highest, count(*) FILTER (score IS NULL) AS unscored FROM r GROUP BY 1"""),
    ),
    "g10_event_risk_summary": (
        lambda s: gates.without_competitors(_events(s)).groupBy("client_id").agg(F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"), F.count_if(F.col("risk_level") == "HIGH").alias("high"),
            F.min_by("document_id", F.struct(-F.round("risk_score", 6), F.col("document_id"))).alias("worst_document")),
        star_sql("""e AS (SELECT * FROM events WHERE entity_type IS DISTINCT FROM 'competitor') SELECT client_id, count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high,
arg_min(document_id, (-round(risk_score, 6), document_id)) AS worst_document FROM e GROUP BY 1"""),
    ),
    "g11_sentiment_summary": (lambda s: reports.sentiment_summary(labelled(s)), star_sql("""c AS (SELECT client_id, count(*) FILTER (label = 'Positive') AS positive, count(*) FILTER (label = 'Neutral') AS neutral, count(*) FILTER (label = 'Negative') AS negative
FROM first_label JOIN entities USING (entity_id) GROUP BY 1), m AS (SELECT *, greatest(positive, neutral, negative) AS top FROM c)
SELECT client_id, positive, neutral, negative, CASE WHEN (positive = top)::INT + (neutral = top)::INT + (negative = top)::INT > 1 THEN 'mixed' WHEN positive = top THEN 'positive' WHEN neutral = top THEN 'neutral' ELSE 'negative' END AS dominant FROM m""")),
    "g12_recent_risk_summary": (
        lambda s: rounded(ranks.top_per_key(_events(s), ["client_id"], [F.desc("created_at"), "document_id", "entity_id"], 50).groupBy("client_id").agg(F.avg("risk_score").alias("average"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"), F.count_if(F.col("risk_level") == "HIGH").alias("high"))),
        star_sql("t AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, document_id, entity_id) AS k FROM events) SELECT client_id, round(avg(risk_score), 6) AS average, count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high FROM t WHERE k <= 50 GROUP BY 1"),
    ),
    "g13_executive_coverage": (
        lambda s: gates.brand_gate(gates.client_mentions(s.mentions, s.entities, s.documents).where("entity_type = 'person'"), gates.brand_documents(s.mentions, s.entities), s.entities).groupBy("client_id", "entity_id").agg(F.countDistinct("document_id").alias("documents"), F.max("effective_at").alias("latest")),
        star_sql(f"SELECT client_id, entity_id, count(DISTINCT document_id) AS documents, max(effective_at) AS latest FROM {gated_sql('(SELECT * FROM facts WHERE entity_type = {0}person{0})'.format(chr(39)))} GROUP BY ALL"),
    ),
    "g16_llm_cost_by_type": (
        lambda s: rounded(reports.llm_cost(calls(s).withColumn("run", F.col("client_id")), PRICES)),
        calls_sql(f"""SELECT client_id AS run, call_type, count(*) AS calls, count(*) FILTER (NOT success) AS failed, sum(tokens)::BIGINT AS tokens, round(sum(coalesce({_PRICE_SQL}, 0) * tokens / 1e6), 6) AS usd,
bool_and({_PRICE_SQL} IS NOT NULL) AS price_known FROM calls GROUP BY ROLLUP (client_id, call_type)"""),
    ),
    "g17_usage_accumulate": (
        lambda s: calls(s).groupBy("client_id", "day").agg(F.count("*").alias("calls"), F.round(F.sum(F.when(F.col("call_type") == "view", F.col("tokens") * 0.002).otherwise(0.0)), 6).alias("usd"), F.bool_or(F.col("call_type") != "view").alias("estimated")),
        calls_sql("SELECT client_id, day, count(*) AS calls, round(sum(CASE WHEN call_type = 'view' THEN tokens * 0.002::DOUBLE ELSE 0 END), 6) AS usd, bool_or(call_type <> 'view') AS estimated FROM calls GROUP BY ALL"),
    ),
    "g18_risk_heatmap": (
        lambda s: rounded(reports.risk_heatmap(_events(s))),
        star_sql("""t AS (SELECT topic FROM events WHERE topic IS NOT NULL GROUP BY 1 HAVING count(DISTINCT document_id) >= 5)
SELECT topic, risk_level, count(*) AS events, round(avg(risk_score), 6) AS avg_risk, grouping_id(topic, risk_level)::BIGINT AS totals FROM events JOIN t USING (topic) GROUP BY CUBE (topic, risk_level)"""),
    ),
    "g19_risk_matrix": (
        lambda s: reports.risk_matrix(_events(s).withColumn("confidence_score", F.round("confidence_score", 6))),
        star_sql("""m AS (SELECT risk_level, round(confidence_score, 6) * 100 AS c FROM events) SELECT risk_level, count(*) FILTER (c >= 67) AS high, count(*) FILTER (c >= 33 AND c < 67) AS medium, count(*) FILTER (c < 33) AS low FROM m GROUP BY 1"""),
    ),
    "g20_sentiment_daily": (lambda s: reports.daily(s.documents, "collected_at", "sentiment_score"), with_star("x AS (SELECT 1) SELECT CAST(date_trunc('day', collected_at) AS TIMESTAMP) AS day, count(*) AS n, round(avg(sentiment_score), 2) AS mean FROM docs GROUP BY 1")),
    "g20_volume_peak": (
        lambda s: rounded(reports.peak_day(reports.daily(s.documents, "collected_at", "sentiment_score"))),
        with_star("x AS (SELECT CAST(date_trunc('day', collected_at) AS TIMESTAMP) AS day, count(*) AS n FROM docs GROUP BY 1) SELECT arg_min(day, (-n, day)) AS peak, max(n) AS peak_rows, round(avg(n), 6) AS per_day FROM x"),
    ),
    "g21_severity_distribution": (lambda s: _events(s).groupBy("client_id", "risk_level").count(), star_sql("SELECT client_id, risk_level, count(*) AS count FROM events GROUP BY ALL")),
    "g22_overview_kpis": (lambda s: rounded(reports.overview(labelled(s))), star_sql("""c AS (SELECT client_id, count(*) AS n, count(*) FILTER (label = 'Positive') AS p, count(*) FILTER (label = 'Negative') AS g FROM first_label JOIN entities USING (entity_id) GROUP BY 1)
SELECT client_id, round(CASE WHEN n >= 5 THEN (p - g) / n::DOUBLE END, 6) AS net, round(p / n::DOUBLE, 6) AS positive_share FROM c""")),
    "g31_job_counters": (
        lambda s: reports.job_status(calls(s).groupBy("client_id", "day").agg(F.count("*").alias("total"), F.count_if(F.col("call_type") != "error").alias("processed"), F.count_if(~F.col("success")).alias("failed"))),
        calls_sql("SELECT client_id, day, count(*) AS total, count(*) FILTER (call_type <> 'error') AS processed, count(*) FILTER (NOT success) AS failed, CASE WHEN count(*) FILTER (call_type <> 'error') >= count(*) THEN CASE WHEN count(*) FILTER (NOT success) > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END ELSE 'RUNNING' END AS status FROM calls GROUP BY ALL"),
    ),
    "g33_evaluation_metrics": (
        lambda s: rounded(reports.precision_recall(s.table("labels").join(s.table("documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 800).alias("guess")))),
        """WITH p AS (SELECT quality = 1 AS t, n_chars > 800 AS g FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn, count(*) FILTER (NOT t AND NOT g) AS tn FROM p)
SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM c""",
    ),
    "g35_latency_profile": (
        lambda s: rounded(calls(s).groupBy("call_type").agg(F.min("tokens").alias("low"), F.avg("tokens").alias("mean"), F.percentile("tokens", 0.5).alias("median"), F.percentile("tokens", 0.95).alias("p95"), F.max("tokens").alias("high"))),
        calls_sql("SELECT call_type, min(tokens) AS low, round(avg(tokens), 6) AS mean, round(quantile_cont(tokens, 0.5), 6) AS median, round(quantile_cont(tokens, 0.95), 6) AS p95, max(tokens) AS high FROM calls GROUP BY 1"),
    ),
    "g39_source_document_counts": (
        lambda s: s.sources.select("source_id").join(s.documents.select("source_id", "document_id"), "source_id", "left").groupBy("source_id").agg(F.count("document_id").alias("documents")),
        with_star("x AS (SELECT 1) SELECT s.source_id, count(d.document_id) AS documents FROM sources s LEFT JOIN docs d USING (source_id) GROUP BY 1"),
    ),
    "g42_last_successful_run": (
        lambda s: (r := daily_runs(s)).select("user_id").distinct().join(r.where("status = 'SUCCESS'").groupBy("user_id").agg(F.max("finished_at").alias("last_success")), "user_id", "left"),
        f"WITH {RUNS_SQL} SELECT user_id, max(finished_at) FILTER (status = 'SUCCESS') AS last_success FROM runs GROUP BY 1",
    ),
    "g43_dedupe_rate": (
        lambda s: rounded(s.documents.groupBy("document_type").agg(F.count("*").alias("found"), F.countDistinct("content_hash").alias("saved")).withColumn("dedupe_rate", (F.col("found") - F.col("saved")) / F.col("found") * 100)),
        with_star("x AS (SELECT document_type, count(*) AS found, count(DISTINCT content_hash) AS saved FROM docs GROUP BY 1) SELECT *, round((found - saved) / found::DOUBLE * 100, 6) AS dedupe_rate FROM x"),
    ),
    "g44_run_duration_percentiles": (
        lambda s: rounded(daily_runs(s).groupBy("status").agg(F.percentile(_seconds("finished_at") - _seconds("started_at"), 0.5).alias("median"), F.percentile(_seconds("finished_at") - _seconds("started_at"), 0.95).alias("p95")), 3),
        f"WITH {RUNS_SQL}, d AS (SELECT status, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS x FROM runs) SELECT status, round(quantile_cont(x, 0.5), 3) AS median, round(quantile_cont(x, 0.95), 3) AS p95 FROM d GROUP BY 1",
    ),
    "w2_executive_history": (
        lambda s: ranks.top_per_key(_events(s).where("entity_type = 'person'"), ["entity_id"], [F.desc("created_at"), F.desc("document_id")], 30).select("entity_id", "document_id", "created_at", "rn"),
        star_sql("t AS (SELECT entity_id, document_id, created_at, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, document_id DESC) AS rn FROM events WHERE entity_type = 'person') SELECT * FROM t WHERE rn <= 30"),
    ),
    "w1_latest_per_key": (
        lambda s: gates.latest_per_key(s.documents, ["source_id"], [F.desc("collected_at"), F.desc("document_id")]).select("source_id", "document_id", "collected_at"),
        with_star("t AS (SELECT source_id, document_id, collected_at, row_number() OVER (PARTITION BY source_id ORDER BY collected_at DESC, document_id DESC) AS k FROM docs) SELECT source_id, document_id, collected_at FROM t WHERE k = 1"),
    ),
    "w5_shown_rank": (
        lambda s: ranks.shown_rank(s.sources.select("source_id", "category", F.col("base_reliability").cast("double").alias("score")).where("score IS NOT NULL"), ["category"], "score"),
        with_star("x AS (SELECT source_id, category, base_reliability::DOUBLE AS score FROM sources WHERE base_reliability IS NOT NULL) SELECT *, rank() OVER (PARTITION BY category ORDER BY round(score, 1) DESC) AS shown_rank FROM x"),
    ),
    "w6_first_per_document_entity": (
        lambda s: risk.entity_sentiment(s.mentions).select("document_id", "entity_id", "label"),
        star_sql("SELECT document_id, entity_id, label FROM first_label"),
    ),
    "w8_cumulative_cap": (capped_slices, with_star("""p AS (SELECT source_id, CAST(date_trunc('year', collected_at) AS TIMESTAMP) AS slice, count(*) AS new_count FROM docs GROUP BY ALL),
c AS (SELECT *, coalesce(sum(new_count) OVER (PARTITION BY source_id ORDER BY slice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier FROM p) SELECT *, CASE WHEN earlier >= 5 THEN 'SKIPPED' ELSE 'KEPT' END AS status FROM c""")),
    "w9_feed_cap": (
        lambda s: ranks.top_per_key(s.documents, ["source_id"], [F.desc("collected_at"), "document_id"], 3).groupBy("source_id").agg(F.count("*").alias("kept"), F.min("document_id").alias("least")),
        with_star("t AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY collected_at DESC, document_id) AS k FROM docs) SELECT source_id, count(*) AS kept, min(document_id) AS least FROM t WHERE k <= 3 GROUP BY 1"),
    ),
    "w11_score_change": (
        lambda s: ranks.score_change(s.documents, ["source_id"], ["collected_at", "document_id"], "view_count"),
        with_star("t AS (SELECT source_id, first(view_count ORDER BY collected_at, document_id) AS oldest, last(view_count ORDER BY collected_at, document_id) AS latest FROM docs GROUP BY 1) SELECT *, latest - oldest AS change FROM t"),
    ),
    "w12_penalty_streak": (streaks, f"""WITH {RUNS_SQL}, m AS (SELECT *, sum((status = 'SUCCESS')::INT) OVER (PARTITION BY user_id ORDER BY day) AS island FROM runs),
l AS (SELECT *, max(island) OVER (PARTITION BY user_id) AS last FROM m) SELECT user_id, count(*) FILTER (status <> 'SUCCESS')::BIGINT AS failures, round(least(count(*) FILTER (status <> 'SUCCESS') * 0.2::DOUBLE, 1.0), 6) AS penalty FROM l WHERE island = last GROUP BY 1"""),
    "w14_run_limits": (
        lambda s: ranks.run_limits(s.table("events"), "user_id", "ts", cooldown_hours=6, daily=2, as_of=EV_AS_OF),
        f"""WITH r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events WHERE ts >= TIMESTAMP '{EV_AS_OF}' - INTERVAL 24 HOUR),
n AS (SELECT user_id, min(ts) + INTERVAL 24 HOUR AS full_until FROM r WHERE k = 2 GROUP BY 1), l AS (SELECT user_id, max(ts) + INTERVAL 6 HOUR AS cool FROM events GROUP BY 1)
SELECT user_id, greatest(cool, coalesce(full_until, cool)) AS next_run FROM l LEFT JOIN n USING (user_id)""",
    ),
    "k1_newest_documents": (
        lambda s: ranks.top_per_key(visible(s).join(s.documents, "document_id"), ["client_id"], [F.col("published_at").desc_nulls_last(), F.desc("document_id")], 20).select("client_id", "document_id", "rn"),
        with_star(f"{VISIBLE_SQL}, t AS (SELECT client_id, document_id, row_number() OVER (PARTITION BY client_id ORDER BY published_at DESC NULLS LAST, document_id DESC) AS rn FROM visible JOIN docs USING (document_id)) SELECT * FROM t WHERE rn <= 20"),
    ),
    "k2_flagged_documents": (
        lambda s: rounded(_events(s).groupBy("client_id", "document_id").agg(F.max("risk_score").alias("score")).where("score > 25")),
        star_sql("SELECT client_id, document_id, round(max(risk_score), 6) AS score FROM events GROUP BY ALL HAVING max(risk_score) > 25"),
    ),
    "k3_stream_order": (
        lambda s: ranks.stream_order(s.sources.select(F.col("source_id"), (F.col("source_id") % 25).alias("client_id"), "penalty"), F.coalesce(F.col("penalty") > 0.1, F.lit(False)), ["source_id"]).select("client_id", "source_id", "position"),
        with_star("x AS (SELECT source_id, source_id % 25 AS client_id, coalesce(penalty > 0.1, FALSE) AS f FROM sources) SELECT client_id, source_id, row_number() OVER (PARTITION BY client_id ORDER BY f DESC, source_id) AS position FROM x"),
    ),
    "k5_alert_candidates": (
        lambda s: alerts.alert_candidates(gates.without_competitors(_events(s)).withColumn("risk_score", F.round("risk_score", 6))).select("client_id", "document_id", "entity_id", "rn"),
        star_sql("t AS (SELECT client_id, document_id, entity_id, row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, round(risk_score, 6) DESC, document_id, entity_id) AS rn FROM events WHERE entity_type IS DISTINCT FROM 'competitor' AND round(risk_score, 6) > 50) SELECT * FROM t WHERE rn <= 15"),
    ),
    "k9_signature_documents": (
        lambda s: ranks.top_per_key(ranks.top_per_key(s.mentions.join(s.documents, "document_id").select("entity_id", "document_id", "collected_at", "sentiment_score").distinct(), ["entity_id"], [F.desc("collected_at"), "document_id"], 300).drop("rn"), ["entity_id"], [F.abs("sentiment_score").desc(), "document_id"], 5).select("entity_id", "document_id", "rn"),
        with_star("""d AS (SELECT DISTINCT entity_id, document_id, collected_at, sentiment_score FROM mentions JOIN docs USING (document_id)), a AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY collected_at DESC, document_id) AS k FROM d),
b AS (SELECT entity_id, document_id, row_number() OVER (PARTITION BY entity_id ORDER BY abs(sentiment_score) DESC, document_id) AS rn FROM a WHERE k <= 300) SELECT * FROM b WHERE rn <= 5"""),
    ),
    "o2_doc_intersection": (
        lambda s: s.mentions.join(s.entities.where("entity_type = 'competitor'"), "entity_id").select("client_id", "document_id").intersect(gates.brand_documents(s.mentions, s.entities)),
        star_sql("SELECT DISTINCT client_id, document_id FROM facts WHERE entity_type = 'competitor' INTERSECT SELECT client_id, document_id FROM brand_docs"),
    ),
    "o3_retired_minus_active": (
        lambda s: s.entities.select("entity_id").subtract(s.mentions.where("created_at >= '2001-07-01'").select("entity_id")),
        with_star("x AS (SELECT 1) SELECT entity_id FROM entities EXCEPT SELECT entity_id FROM mentions WHERE created_at >= TIMESTAMP '2001-07-01'"),
    ),
    "o4_pending_union_new": (
        lambda s: s.documents.where("published_at IS NULL").select("document_id").union(s.documents.where("view_count IS NULL").select("document_id")).distinct(),
        with_star("x AS (SELECT 1) SELECT document_id FROM docs WHERE published_at IS NULL UNION SELECT document_id FROM docs WHERE view_count IS NULL"),
    ),
    "al1_evidence_threshold": (lambda s: alerts.evidence_threshold(_events(s)), star_sql("SELECT client_id, CASE WHEN count(*) > 50 THEN 55.0 WHEN count(*) > 15 THEN 40.0 ELSE 15.0 END::DOUBLE AS threshold FROM events GROUP BY 1")),
    "al2_alert_evidence": (alert_rows, _ALERT_SQL),
    "al3_alert_merge": (merged_alerts, _MERGE_SQL),
    "al5_lifecycle_valid": (
        lambda s: alerts.invalid_transitions(stored_alerts(s)[0].select("entity_id", F.col("lifecycle_status").alias("old_status"), F.when(F.col("entity_id") % 2 == 0, "ACKNOWLEDGED").otherwise("ACTIVE").alias("new_status"))).select("entity_id", "old_status", "new_status"),
        with_star("""x AS (SELECT entity_id, CASE entity_id % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'CLOSED' ELSE 'ACKNOWLEDGED' END AS old_status, CASE WHEN entity_id % 2 = 0 THEN 'ACKNOWLEDGED' ELSE 'ACTIVE' END AS new_status
FROM entities WHERE entity_id % 3 <> 0 AND entity_id IN (SELECT entity_id FROM mentions)) SELECT * FROM x WHERE (old_status, new_status) NOT IN (('ACTIVE', 'ACKNOWLEDGED'), ('ACTIVE', 'RESOLVED'), ('ACTIVE', 'CLOSED'), ('ACKNOWLEDGED', 'RESOLVED'), ('ACKNOWLEDGED', 'CLOSED'), ('RESOLVED', 'ACTIVE'), ('RESOLVED', 'CLOSED'), ('CLOSED', 'ACTIVE'))"""),
    ),
    "al6_summary_signature": (
        lambda s: alerts.summary_signature(s.entities, ["client_id", "entity_name", "entity_type"]).select("entity_id", "signature"),
        with_star("x AS (SELECT 1) SELECT entity_id, sha256(concat_ws(chr(31), CAST(client_id AS VARCHAR), entity_name, coalesce(entity_type, ''))) AS signature FROM entities"),
    ),
    "p1_calendar_slices": (lambda s: slices(s, months=3), with_star(f"""{_RANGE_SQL}, m AS (SELECT source_id, a, b, CAST(unnest(generate_series(date_trunc('quarter', a)::TIMESTAMP, (b - 1)::TIMESTAMP, INTERVAL 3 MONTH)) AS DATE) AS d FROM rg WHERE a < b)
SELECT source_id, greatest(d, a) AS slice_start, least(CAST(d + INTERVAL 3 MONTH AS DATE), b) AS slice_end FROM m""")),
    "p2_fixed_day_slices": (lambda s: slices(s, days=30), with_star(f"""{_RANGE_SQL}, m AS (SELECT source_id, a, b, CAST(unnest(generate_series(a::TIMESTAMP, (b - 1)::TIMESTAMP, INTERVAL 30 DAY)) AS DATE) AS d FROM rg WHERE a < b)
SELECT source_id, d AS slice_start, least(d + 30, b) AS slice_end FROM m""")),
    "p4_split_slices": (kept_slices, with_star(f"""{_RANGE_SQL}, m AS (SELECT source_id, a, b, CAST(unnest(generate_series(a::TIMESTAMP, (b - 1)::TIMESTAMP, INTERVAL 90 DAY)) AS DATE) AS d FROM rg WHERE a < b),
n AS (SELECT source_id, d AS x, least(d + 90, b) AS y, (source_id * 37 + dayofyear(d)) % 150 AS items FROM m), h AS (SELECT *, items >= 100 AND y - x > 1 AS cut, x + CAST(floor((y - x) / 2) AS INT) AS mid FROM n)
SELECT source_id, items, x AS slice_start, CASE WHEN cut THEN mid ELSE y END AS slice_end FROM h UNION ALL SELECT source_id, items, mid, y FROM h WHERE cut""")),
    "p6_stuck_rows": (
        lambda s: rounded(planning.stuck_rows(daily_runs(s), as_of=EV_AS_OF, minutes=300, final=["SUCCESS", "FAILED"]).select("user_id", "day", "new_status", "minutes"), 3),
        f"WITH {RUNS_SQL}, x AS (SELECT user_id, day, (epoch_us(TIMESTAMP '{EV_AS_OF}') - epoch_us(started_at)) / 6e7 AS minutes FROM runs WHERE status = 'RUNNING') SELECT user_id, day, 'FAILED' AS new_status, round(minutes, 3) AS minutes FROM x WHERE minutes > 300",
    ),
    "p7_row_age": (
        lambda s: s.documents.select("document_id", planning.row_age(F.col("collected_at"), AS_OF)[0].alias("age_days"), planning.row_age(F.col("collected_at"), AS_OF)[1].alias("stale")),
        with_star(f"x AS (SELECT document_id, date_diff('day', collected_at, {TS}) AS age_days FROM docs) SELECT *, age_days > 14 AS stale FROM x"),
    ),
    "q2_duplicates": (
        lambda s: s.documents.groupBy("content_hash").agg(F.count("*").alias("copies")).where("copies > 1"),
        with_star("x AS (SELECT 1) SELECT content_hash, count(*) AS copies FROM docs GROUP BY 1 HAVING count(*) > 1"),
    ),
    "q3_range_checks": (
        lambda s: reports.range_violations(s.mentions.join(s.documents, "document_id"), {"confidence": F.col("confidence").between(0, 0.9), "sentiment": F.col("sentiment_score").between(-1, 0.5), "mentions": F.col("mention_count") >= 2}),
        with_star("x AS (SELECT * FROM mentions JOIN docs USING (document_id)) SELECT 'confidence' AS check_name, count(*) FILTER (NOT confidence BETWEEN 0 AND 0.9) AS violations FROM x UNION ALL SELECT 'sentiment', count(*) FILTER (NOT sentiment_score BETWEEN -1 AND 0.5) FROM x UNION ALL SELECT 'mentions', count(*) FILTER (NOT mention_count >= 2) FROM x"),
    ),
    "q4_row_counts": (
        lambda s: s.clients.select("client_id").withColumn("table_name", F.lit("clients")).unionByName(s.entities.select("client_id").withColumn("table_name", F.lit("entities"))).groupBy("table_name", "client_id").agg(F.count("*").alias("rows")),
        with_star("x AS (SELECT client_id, 'clients' AS table_name FROM clients UNION ALL SELECT client_id, 'entities' FROM entities) SELECT table_name, client_id, count(*) AS rows FROM x GROUP BY ALL"),
    ),
    "q5_score_audit": (
        lambda s: rounded(risk.entity_sentiment(s.mentions).groupBy("label").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("low"), F.count_if(F.round("confidence", 6) < 0.6).alias("unsure"))),
        star_sql("SELECT label, count(*) AS n, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS low, count(*) FILTER (round(confidence, 6) < 0.6) AS unsure FROM first_label GROUP BY 1"),
    ),
    "q6_snapshot_diff": (
        lambda s: reports.snapshot_diff(s.documents.where("collected_at < '2000-01-01'").groupBy("document_type").agg(F.count("*").alias("n")), s.documents.groupBy("document_type").agg(F.count("*").alias("n")), "document_type", "n"),
        with_star("b AS (SELECT document_type, count(*) FILTER (collected_at < TIMESTAMP '2000-01-01') AS before, count(*) AS after FROM docs GROUP BY 1) SELECT * FROM b WHERE before <> after"),
    ),
}
