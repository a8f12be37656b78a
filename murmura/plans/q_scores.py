"""Registered queries: gates, risk events, scores and benchmarks over the star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura import rules as R
from murmura.operators import gates, risk, scores
from murmura.plans.star import AS_OF, Star, with_star

TS = f"TIMESTAMP '{AS_OF}'"


def _events(s: Star) -> DataFrame:
    return risk.risk_events(s.mentions, s.entities, s.documents, s.topics, s.sources)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to fixed places, so that sums in another order compare."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else c for c, t in df.dtypes))


_TIER = (
    "CASE regexp_extract(title, '^(.*) - (.*)$', 2) WHEN 'Reuters' THEN 'high' WHEN 'Livemint' THEN 'high' WHEN 'The Hindu' THEN 'medium' "
    "WHEN 'Devdiscourse' THEN 'low' ELSE 'unknown' END"
)
_REACH_X = "log10(CAST(greatest(view_count, 0) + greatest(coalesce(comment_count, 0), 0) * 10 + 1 AS DOUBLE))"
_STEPS = " ".join(
    f"WHEN {_REACH_X} <= {x1} THEN {y0}::DOUBLE + ({_REACH_X} - {x0}) / ({x1}::DOUBLE - {x0}::DOUBLE) * ({y1}::DOUBLE - {y0}::DOUBLE)"
    for (x0, y0), (x1, y1) in zip(R.REACH_ANCHORS, R.REACH_ANCHORS[1:])
)
_REACH = f"CASE WHEN view_count IS NULL THEN 1.0 WHEN {_REACH_X} <= 0 THEN 0.5 {_STEPS} ELSE 1.2 END"
_WEIGHT = "CASE topic " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.TOPIC_WEIGHTS.items() if v) + " ELSE 0 END"
_REL = "CASE " + " ".join(f"WHEN position('{w}' IN lower(category || ' ' || source_name)) > 0 THEN {v}" for w, v in R.RELIABILITY_BY_WORD) + " ELSE 1.0 END"


def _level(score: str) -> str:
    return f"CASE WHEN {score} IS NULL THEN NULL WHEN {score} <= 25 THEN 'LOW' WHEN {score} <= 50 THEN 'MEDIUM' WHEN {score} <= 75 THEN 'HIGH' ELSE 'CRITICAL' END"


def _grade(score: str) -> str:
    return (
        f"CASE WHEN {score} IS NULL THEN NULL WHEN {score} >= 90 THEN 'A+' WHEN {score} >= 80 THEN 'A' WHEN {score} >= 70 THEN 'B' "
        f"WHEN {score} >= 60 THEN 'C' WHEN {score} >= 40 THEN 'D' ELSE 'F' END"
    )


#: top_topic, first_label, reach, events, brand_docs, gate-able mention rows and source reliability.
EVENT_SQL = f"""
weighted AS (SELECT *, {_WEIGHT} AS topic_weight FROM topics WHERE topic_confidence >= 0.65),
top_topic AS (SELECT document_id, topic, topic_confidence, topic_weight FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY topic_weight DESC, line, topic, topic_confidence) AS k
  FROM weighted WHERE topic_weight > 0) WHERE k = 1),
first_label AS (SELECT document_id, entity_id, label, confidence FROM (SELECT *, row_number() OVER (PARTITION BY document_id, entity_id ORDER BY line, label, confidence) AS k FROM mentions) WHERE k = 1),
reach AS (SELECT d.*, coalesce(s.rel, 1.0)::DOUBLE AS reliability,
  (CASE WHEN document_type IN ('youtube', 'instagram', 'reddit') THEN {_REACH} WHEN document_type = 'rss' THEN
    CASE {_TIER} WHEN 'high' THEN 1.15 WHEN 'medium' THEN 0.95 WHEN 'low' THEN 0.85 ELSE 0.65 END ELSE 1.0 END)::DOUBLE AS modifier,
  CASE document_type WHEN 'rss' THEN {_TIER} IN ('medium', 'high') WHEN 'youtube' THEN coalesce(view_count, 0) >= 10000 OR coalesce(comment_count, 0) >= 50
    WHEN 'instagram' THEN coalesce(view_count, 0) >= 2900 OR coalesce(comment_count, 0) >= 20 WHEN 'reddit' THEN coalesce(view_count, 0) >= 50 OR coalesce(comment_count, 0) >= 10
    ELSE TRUE END AS eligible
  FROM docs d LEFT JOIN (SELECT source_id, {_REL} AS rel FROM sources) s USING (source_id)),
scored AS (SELECT e.client_id, f.document_id, f.entity_id, e.entity_name, e.entity_type, r.title, r.document_type, r.content_hash, t.topic, f.label AS sentiment,
  CASE WHEN (f.label = 'Negative' OR coalesce(t.topic_weight, 0) > 0) AND r.eligible THEN least(greatest(
    (coalesce(t.topic_weight, 0) + CASE f.label WHEN 'Positive' THEN 0 WHEN 'Neutral' THEN 10 ELSE 40 END) / 140.0::DOUBLE * 100.0::DOUBLE * r.reliability * r.modifier, 0.0), 100.0) ELSE 0.0 END::DOUBLE AS risk_score,
  (coalesce(t.topic_confidence, 0) + f.confidence) / 2 AS confidence_score, r.published_at, r.collected_at AS created_at, r.reliability, r.modifier
  FROM first_label f JOIN entities e USING (entity_id) JOIN reach r USING (document_id) LEFT JOIN top_topic t USING (document_id)),
events AS (SELECT *, {_level("risk_score")} AS risk_level FROM scored),
brand_docs AS (SELECT DISTINCT client_id, document_id FROM mentions JOIN entities USING (entity_id) WHERE entity_type IN ('brand', 'product')),
own_clients AS (SELECT DISTINCT client_id FROM entities WHERE entity_type IN ('brand', 'product')),
facts AS (SELECT m.*, e.client_id, e.entity_type, coalesce(d.published_at, m.created_at) AS effective_at FROM mentions m JOIN entities e USING (entity_id) LEFT JOIN docs d USING (document_id)),
src_rel AS (SELECT document_id, greatest(least((base_reliability::DOUBLE - coalesce(penalty::DOUBLE, 0)) * 100, 100), 0) AS source_reliability
  FROM docs JOIN sources USING (source_id) WHERE base_reliability IS NOT NULL)
"""


def gated_sql(rows: str) -> str:
    return (
        f"(SELECT x.* FROM {rows} x WHERE (x.client_id, x.document_id) IN (SELECT (client_id, document_id) FROM brand_docs) "
        f"OR x.client_id NOT IN (SELECT client_id FROM own_clients))"
    )


def star_sql(sql: str) -> str:
    """A query over the star and the risk events; ``sql`` is a SELECT, or more named parts and one."""
    sql = sql.strip()
    return with_star(f"{EVENT_SQL.strip()}{'' if sql.startswith('SELECT') else ','}\n{sql}")


def renorm_sql(parts: dict[str, float], least: float = R.MIN_WEIGHT) -> tuple[str, str]:
    weight = " + ".join(f"CASE WHEN {k} IS NULL THEN 0::DOUBLE ELSE {w}::DOUBLE END" for k, w in parts.items())
    total = " + ".join(f"coalesce({k} * {w}::DOUBLE, 0::DOUBLE)" for k, w in parts.items())
    return f"(CASE WHEN ({weight}) >= {least} - 1e-12 THEN ({total}) / ({weight}) END)", f"({weight})"


_REP, _REP_W = renorm_sql(R.REPUTATION_WEIGHTS)
_EXE, _EXE_W = renorm_sql(R.EXECUTIVE_WEIGHTS)


def _window(column: str, days: int) -> str:
    return f"{column} >= {TS} - INTERVAL {days} DAY"


DAYS_LONG = 365


def reputation(s: Star) -> DataFrame:
    return rounded(scores.reputation_score(s.clients, s.entities, s.documents, s.mentions, _events(s), s.sources, as_of=AS_OF, days=DAYS_LONG))


_REPUTATION_SQL = star_sql(f"""
g AS {gated_sql(f"(SELECT * FROM facts WHERE {_window('effective_at', DAYS_LONG)} AND entity_type IS DISTINCT FROM 'competitor')")},
d AS (SELECT client_id, document_id, sum(mention_count) AS n FROM g GROUP BY ALL),
p AS (SELECT client_id, sum(n) AS mentions, count(*) AS documents, avg(sentiment_score) AS avg_sentiment, avg(source_reliability) AS source
  FROM d LEFT JOIN docs USING (document_id) LEFT JOIN src_rel USING (document_id) GROUP BY client_id),
r AS (SELECT client_id, avg(risk_score) AS avg_risk FROM {gated_sql(f"(SELECT * FROM events WHERE {_window('coalesce(published_at, created_at)', DAYS_LONG)} AND entity_type IS DISTINCT FROM 'competitor')")} GROUP BY client_id),
h AS (SELECT DISTINCT client_id, TRUE AS recent FROM events WHERE {_window('created_at', 1)}),
c AS (SELECT client_id, coalesce(mentions, 0)::BIGINT AS mentions, coalesce(documents, 0) AS documents, (avg_sentiment + 1) / 2 * 100 AS sentiment, 100 - avg_risk AS risk, source,
  CASE WHEN mentions > 0 THEN mentions / (mentions + 5000.0::DOUBLE) * 100 END AS visibility, recent
  FROM clients LEFT JOIN p USING (client_id) LEFT JOIN r USING (client_id) LEFT JOIN h USING (client_id)),
z AS (SELECT *, CASE WHEN {_REP} IS NOT NULL THEN least(greatest({_REP}, 0), 100) END AS score, least(documents / 50.0::DOUBLE, 1.0) * 0.4 + {_REP_W} * 0.6 AS confidence FROM c)
SELECT client_id, mentions, documents, round(sentiment, 6) AS sentiment, round(risk, 6) AS risk, round(source, 6) AS source, round(visibility, 6) AS visibility,
  round(score, 6) AS score, {_grade("score")} AS grade, round(confidence, 6) AS confidence, CASE WHEN recent THEN 'COMPLETE' ELSE 'PARTIAL' END AS health FROM z
""")


def executives(s: Star) -> DataFrame:
    return rounded(scores.executive_score(s.entities, s.documents, s.mentions, _events(s), as_of=AS_OF))


_EXECUTIVE_SQL = star_sql(f"""
d AS (SELECT DISTINCT client_id, entity_id, document_id FROM {gated_sql(f"(SELECT * FROM facts WHERE entity_type = 'person' AND {_window('effective_at', 365)})")}),
p AS (SELECT client_id, entity_id, count(*) AS documents, avg(sentiment_score) AS avg_sentiment, avg(0.95::DOUBLE) AS page FROM d LEFT JOIN docs USING (document_id) GROUP BY ALL),
r AS (SELECT client_id, entity_id, avg(risk_score) AS avg_risk, max(created_at) AS last_risk
  FROM {gated_sql(f"(SELECT * FROM events WHERE entity_type = 'person' AND {_window('coalesce(published_at, created_at)', 365)})")} GROUP BY ALL),
c AS (SELECT e.client_id, e.entity_id, coalesce(documents, 0) AS documents, (avg_sentiment + 1) / 2 * 100 AS sentiment, 100 - avg_risk AS risk,
  CASE WHEN documents > 0 THEN least(documents / 500.0::DOUBLE * 100, 100) END AS visibility, coalesce(page, 1.0) AS page, coalesce({_window('last_risk', 1)}, FALSE) AS recent
  FROM (SELECT * FROM entities WHERE entity_type = 'person') e LEFT JOIN p ON p.client_id = e.client_id AND p.entity_id = e.entity_id LEFT JOIN r ON r.client_id = e.client_id AND r.entity_id = e.entity_id),
z AS (SELECT *, {_EXE_W} >= 0.2 - 1e-12 AS enough, CASE WHEN {_EXE_W} >= 0.2 - 1e-12 THEN least(greatest({_EXE} * page, 0), 100) ELSE 0 END AS score FROM c)
SELECT client_id, entity_id, documents, round(score, 6) AS score, CASE WHEN enough THEN {_grade("score")} ELSE 'NA' END AS grade,
  CASE WHEN NOT enough THEN 'INSUFFICIENT_EVIDENCE' WHEN recent THEN 'COMPLETE' ELSE 'PARTIAL' END AS health,
  round(CASE WHEN enough THEN least(documents / 10.0::DOUBLE, 1) * 0.6 + CASE WHEN recent THEN 0.4 ELSE 0.2 END ELSE 0 END, 6) AS confidence FROM z
""")


def _benchmark(kind: str, days: int, gated: bool):
    def run(s: Star) -> DataFrame:
        out = scores.entity_benchmark(s.entities, s.documents, s.mentions, _events(s), s.sources, kind=kind, as_of=AS_OF, days=days, gated=gated)
        return rounded(out)

    return run


def _benchmark_sql(kind: str, days: int, gated: bool) -> str:
    gate = gated_sql if gated else (lambda x: x)
    return f"""
g AS (SELECT * FROM {gate(f"(SELECT * FROM facts WHERE entity_type = '{kind}' AND {_window('effective_at', days)})")}),
p AS (SELECT client_id, entity_id, sum(mention_count) AS mentions, avg(sentiment_score) AS avg_sentiment, avg(source_reliability) AS source
  FROM g LEFT JOIN docs USING (document_id) LEFT JOIN src_rel USING (document_id) GROUP BY ALL),
r AS (SELECT client_id, entity_id, avg(risk_score) AS avg_risk FROM {gate(f"(SELECT * FROM events WHERE entity_type = '{kind}' AND {_window('coalesce(published_at, created_at)', days)})")} GROUP BY ALL),
c AS (SELECT e.client_id, e.entity_id, e.entity_name, coalesce(mentions, 0)::BIGINT AS mentions, (avg_sentiment + 1) / 2 * 100 AS sentiment, 100 - avg_risk AS risk, source,
  CASE WHEN mentions > 0 THEN mentions / (mentions + 5000.0::DOUBLE) * 100 END AS visibility
  FROM (SELECT * FROM entities WHERE entity_type = '{kind}') e LEFT JOIN p ON p.client_id = e.client_id AND p.entity_id = e.entity_id LEFT JOIN r ON r.client_id = e.client_id AND r.entity_id = e.entity_id),
z AS (SELECT *, {_REP_W} >= 0.2 - 1e-12 AS has_evidence, {_REP_W} AS weight, coalesce({_REP}, 0) AS score, sum(mentions) OVER (PARTITION BY client_id) AS total FROM c),
bench AS (SELECT client_id, entity_id, entity_name, mentions, round(score, 6) AS score, has_evidence, round(CASE WHEN total > 0 THEN mentions / total * 100 ELSE 0 END::DOUBLE, 6) AS share_of_voice,
  round(CASE WHEN has_evidence THEN least(mentions / 50.0::DOUBLE, 1) * 0.4 + weight * 0.6 ELSE 0 END, 6) AS confidence,
  CASE WHEN NOT has_evidence THEN 'INSUFFICIENT_EVIDENCE' WHEN weight >= 0.75 - 1e-9 THEN 'COMPLETE' ELSE 'PARTIAL' END AS health,
  CASE WHEN has_evidence THEN row_number() OVER (PARTITION BY client_id ORDER BY has_evidence DESC, score DESC, entity_id) ELSE 0 END AS rank FROM z)"""



def risk_rows(s: Star) -> DataFrame:
    return rounded(_events(s).select("client_id", "document_id", "entity_id", "topic", "sentiment", "risk_score", "risk_level", "confidence_score", "reliability", "modifier"))


def brand_gate(s: Star) -> DataFrame:
    facts = gates.client_mentions(s.mentions, s.entities, s.documents)
    rows = gates.brand_gate(gates.without_competitors(facts), gates.brand_documents(s.mentions, s.entities), s.entities)
    return rows.groupBy("client_id").agg(F.count("*").alias("rows"), F.countDistinct("document_id").alias("documents"), F.sum("mention_count").alias("mentions"))


QUERIES = {
    "g1_reputation_score": (reputation, _REPUTATION_SQL),
    "g2_executive_score": (executives, _EXECUTIVE_SQL),
    "g4_competitor_benchmark": (_benchmark("competitor", 365, True), star_sql(_benchmark_sql("competitor", 365, True) + "\nSELECT * FROM bench")),
    "g5_product_benchmark": (_benchmark("product", 365, False), star_sql(_benchmark_sql("product", 365, False) + "\nSELECT * FROM bench")),
    "g6_share_of_voice": (
        lambda s: rounded(scores.client_share_of_voice(_benchmark("competitor", 90, True)(s))),
        star_sql(_benchmark_sql("competitor", 90, True) + "\nSELECT client_id, round(greatest(100 - sum(share_of_voice), 0), 6) AS client_share FROM bench GROUP BY client_id"),
    ),
    "g34_biggest_drag": (
        lambda s: rounded(scores.biggest_drag(scores.reputation_score(s.clients, s.entities, s.documents, s.mentions, _events(s), s.sources, as_of=AS_OF, days=DAYS_LONG), R.REPUTATION_WEIGHTS)),
        _REPUTATION_SQL.rpartition("SELECT client_id, mentions")[0] + """
SELECT client_id, arg_max(component, lost) AS component, round(max(lost), 6) AS lost FROM (
  SELECT client_id, 'sentiment' AS component, (100 - sentiment) * 0.30 AS lost FROM z UNION ALL SELECT client_id, 'risk', (100 - risk) * 0.30 FROM z
  UNION ALL SELECT client_id, 'source', (100 - source) * 0.10 FROM z UNION ALL SELECT client_id, 'visibility', (100 - visibility) * 0.05 FROM z) GROUP BY client_id""",
    ),
    "r6_risk_score": (
        risk_rows,
        star_sql("""SELECT client_id, document_id, entity_id, topic, sentiment, round(risk_score, 6) AS risk_score, risk_level, round(confidence_score, 6) AS confidence_score,
  round(reliability, 6) AS reliability, round(modifier, 6) AS modifier FROM events"""),
    ),
    "r5_top_risk_topic": (lambda s: rounded(risk.top_risk_topic(s.topics)), star_sql("SELECT document_id, topic, round(topic_confidence, 6) AS topic_confidence, topic_weight FROM top_topic")),
    "r16_collapse_risk_events": (
        lambda s: risk.collapse_events(_events(s)).groupBy("client_id", "risk_level").agg(F.count("*").alias("events"), F.countDistinct("document_id").alias("documents")),
        star_sql("""SELECT client_id, risk_level, count(*) AS events, count(DISTINCT document_id) AS documents FROM (SELECT *, row_number() OVER (PARTITION BY client_id, entity_id,
  coalesce(topic, 'unknown'), content_hash ORDER BY risk_score DESC, document_id) AS k FROM events) WHERE k = 1 GROUP BY ALL"""),
    ),
    "j2_brand_gate_semi": (
        brand_gate,
        star_sql(f"SELECT client_id, count(*) AS rows, count(DISTINCT document_id) AS documents, sum(mention_count)::BIGINT AS mentions FROM {gated_sql('(SELECT * FROM facts WHERE entity_type IS DISTINCT FROM {0})'.format(chr(39) + 'competitor' + chr(39)))} GROUP BY client_id"),
    ),
    "j3_no_brand_clients": (lambda s: gates.clients_without_brand(s.clients, s.entities), star_sql("SELECT * FROM clients WHERE client_id NOT IN (SELECT client_id FROM own_clients)")),
    "j4_effective_date_join": (
        lambda s: gates.client_mentions(s.mentions, s.entities, s.documents).groupBy(F.date_trunc("month", "effective_at").alias("month")).agg(F.count("*").alias("rows"), F.sum("mention_count").alias("mentions")),
        star_sql("SELECT date_trunc('month', effective_at)::TIMESTAMP AS month, count(*) AS rows, sum(mention_count)::BIGINT AS mentions FROM facts GROUP BY 1"),
    ),
    "j6_source_reliability_join": (lambda s: rounded(gates.source_reliability(s.documents, s.sources)), star_sql("SELECT document_id, round(source_reliability, 6) AS source_reliability FROM src_rel")),
}
