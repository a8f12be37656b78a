"""Registered queries: terms, proposals, review, priorities and stream merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.operators import gates, planning, risk, terms
from murmura.plans.q_reports import _RANGE_SQL, slices
from murmura.plans.q_scores import _events, rounded, star_sql
from murmura.plans.q_text import answers
from murmura.plans.star import Star, with_star
from murmura.streaming import jobs

KINDS = {"brand": 0, "risk": 0, "executive": 1, "competitor": 2, "product": 3}


def _kinds(s: Star) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    return slices(s, months=12).withColumn("kind", F.element_at(names, (F.col("source_id") % len(KINDS) + 1).cast("int")))


def proposals(s: Star) -> DataFrame:
    k = F.col("s_suppkey")
    rows = s.table("supplier").select(
        (k % 6).alias("client_id"), F.concat(F.lit("Acme "), (k % 7).cast("string"), F.when(k % 2 == 0, " Ltd.").otherwise("")).alias("name"), (k % 4).alias("answer"), (k % 3).alias("slot"),
        F.array((k % 5).cast("string"), (k % 2).cast("string")).alias("urls"), F.when(k % 3 == 0, F.concat(F.lit("d"), (k % 9).cast("string"))).alias("detail"),
    )
    return terms.merged_proposals(rows).select("client_id", "key", "slot", "answers", F.array_join("urls", ",").alias("urls"))


def review(s: Star) -> DataFrame:
    words = answers(s).select(F.concat(F.lit("c"), F.col("conv_id") % 5).alias("client_id"), F.explode(F.split(F.lower("text"), r"\W+")).alias("name")).where(F.length("name") >= 9)
    rows = words.groupBy("client_id", "name").agg(F.count("*").alias("mentions")).where("mentions >= 2")
    size = F.length("name")
    flags = {"carries_client_name": size % 5 == 0, "title_near": size % 2 == 0, "client_near": size % 3 == 0, "brand_documents": size % 4}
    return terms.candidate_review(rows.withColumns(flags).withColumns({"tier": terms.review_tier(), "confidence": F.round(F.lit(0.5) + size / 100, 4)}))


def risk_stream(s: Star) -> DataFrame:
    """Risk rows arrive as a stream and merge by tier and recency, batch by batch."""
    rows = jobs.read_events(s.spark, s.sf_dir).select(
        (F.col("user_id") % 25).alias("client_id"), F.col("user_id").alias("document_id"), F.lit(None).cast("long").alias("entity_id"),
        F.when(F.col("event_id") % 7 == 0, "llm").otherwise("rule").alias("role_source"), F.struct("ts", "event_id").alias("computed_at"),
    )
    held = jobs.run_available(rows, mode="append", merge=risk.upsert_events, keys=["client_id", "document_id", "entity_id"])
    return held.select("client_id", "document_id", "role_source", F.col("computed_at.event_id").alias("winner"))


QUERIES = {
    "m2_boost_terms": (lambda s: terms.boost_terms(s.entities).select("client_id", *(F.array_join(c, ",").alias(c) for c in ("executive_terms", "product_terms", "brand_terms"))),
        with_star("""x AS (SELECT client_id, list_sort(list(lower(entity_name)) FILTER (entity_type = 'person')) AS e, list_sort(list(lower(entity_name)) FILTER (entity_type = 'product')) AS p, list_sort(list(lower(entity_name)) FILTER (entity_type = 'brand')) AS b FROM entities GROUP BY 1)
SELECT client_id, coalesce(array_to_string(e, ','), '') AS executive_terms, coalesce(array_to_string(p, ','), '') AS product_terms, coalesce(array_to_string(b, ','), '') AS brand_terms FROM x""")),
    "m4_write_gate": (lambda s: terms.write_gate(s.entities.select("client_id", "entity_id", F.concat(F.lit("about Supplier#0000000"), F.lpad((F.col("entity_id") % 100).cast("string"), 2, "0")).alias("text")), terms.boost_terms(s.entities)).select("entity_id"),
        with_star("t AS (SELECT client_id, entity_id, 'about supplier#0000000' || lpad(CAST(entity_id % 100 AS VARCHAR), 2, '0') AS text FROM entities), o AS (SELECT client_id, lower(entity_name) AS term FROM entities WHERE entity_type IN ('brand', 'product')) SELECT entity_id FROM t WHERE client_id NOT IN (SELECT client_id FROM o) OR EXISTS (SELECT 1 FROM o WHERE o.client_id = t.client_id AND contains(t.text, o.term))")),
    "m16_candidate_review": (review, None),
    "m18_revalidate_competitors": (lambda s: terms.revalidated(s.entities, s.entities.where("entity_type = 'brand'")).groupBy("new_type").agg(F.count("*").alias("entities")), with_star("x AS (SELECT 1) SELECT 'competitor' AS new_type, count(*) AS entities FROM entities WHERE entity_type = 'competitor'")),
    "m19_publisher_terms": (lambda s: terms.publisher_terms(s.sources.select(F.concat(F.col("category"), F.when(F.col("source_id") % 2 == 0, " News (history)").otherwise("")).alias("source_name")), s.entities),
        with_star("x AS (SELECT 1) SELECT DISTINCT category AS term FROM sources")),
    "m20_self_reference_terms": (lambda s: terms.self_reference_terms(s.entities), with_star("x AS (SELECT 1) SELECT DISTINCT client_id, lower(entity_name) AS key FROM entities WHERE entity_type IN ('brand', 'product')")),
    "g3_url_reliability": (lambda s: _pages(s), r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h FROM pages)
SELECT page_id, CASE WHEN regexp_matches(h, '\.gov|\.nic\.in|court|judiciary') THEN 1.2 WHEN regexp_matches(h, 'company|corporate|ir\.') THEN 1.1 WHEN regexp_matches(h, 'reuters\.com|bloomberg\.com|cnbc\.com|nytimes\.com|wsj\.com') THEN 1.0
WHEN regexp_matches(h, 'reddit\.com|twitter\.com|facebook\.com|t\.co') THEN 0.7 WHEN regexp_matches(h, 'blog|medium\.com|substack') THEN 0.85 ELSE 0.95 END::DOUBLE AS reliability FROM h"""),
    "g36_executive_evidence": (lambda s: gates.client_mentions(s.mentions, s.entities, s.documents).where("entity_type = 'person'").select("entity_id", "document_id").distinct().join(s.documents.select("document_id", "sentiment_score"), "document_id").groupBy("entity_id").agg(F.count_if(F.col("sentiment_score") > 0.25).alias("positive"), F.count_if(F.col("sentiment_score") < -0.25).alias("negative"), F.count("*").alias("documents")),
        star_sql("d AS (SELECT DISTINCT entity_id, document_id FROM facts WHERE entity_type = 'person') SELECT entity_id, count(*) FILTER (sentiment_score > 0.25) AS positive, count(*) FILTER (sentiment_score < -0.25) AS negative, count(*) AS documents FROM d JOIN docs USING (document_id) GROUP BY 1")),
    "g38_merge_proposals": (proposals, """WITH r AS (SELECT s_suppkey % 6 AS client_id, 'acme ' || (s_suppkey % 7) AS key, s_suppkey % 4 AS answer, s_suppkey % 3 AS slot, unnest([CAST(s_suppkey % 5 AS VARCHAR), CAST(s_suppkey % 2 AS VARCHAR)]) AS url FROM supplier)
SELECT client_id, key, min(slot) AS slot, count(DISTINCT answer) AS answers, array_to_string(list_sort(list(DISTINCT url)), ',') AS urls FROM r GROUP BY 1, 2"""),
    "k7_slice_priority": (lambda s: terms.slice_priority(_kinds(s), KINDS, "kind").where("place <= 50").select("kind", "slice_start", "place").groupBy("kind", "place").agg(F.max("slice_start").alias("slice_start")),
        with_star(f"""{_RANGE_SQL}, m AS (SELECT source_id, a, b, CAST(unnest(generate_series(date_trunc('year', a)::TIMESTAMP, (b - 1)::TIMESTAMP, INTERVAL 12 MONTH)) AS DATE) AS d FROM rg WHERE a < b),
n AS (SELECT ['brand', 'risk', 'executive', 'competitor', 'product'][CAST(source_id % 5 + 1 AS INT)] AS kind, greatest(d, a) AS slice_start FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY slice_start DESC) AS place FROM n) SELECT kind, place, slice_start FROM p WHERE place <= 50""")),
    "p5_expected_items": (lambda s: slices(s, months=6).groupBy("source_id").agg(F.sum(F.round(F.datediff("slice_end", "slice_start") * 0.5, 3)).alias("items")),
        with_star(f"{_RANGE_SQL} SELECT source_id, (b - a) * 0.5::DOUBLE AS items FROM rg WHERE a < b")),
    "r15_risk_confidence": (lambda s: rounded(_events(s).groupBy("client_id").agg(F.avg("confidence_score").alias("mean"), F.max("confidence_score").alias("top"))), star_sql("SELECT client_id, round(avg(confidence_score), 6) AS mean, round(max(confidence_score), 6) AS top FROM events GROUP BY 1")),
    "t8_risk_upsert_stream": (risk_stream, """WITH n AS (SELECT user_id % 25 AS client_id, user_id AS document_id, CASE WHEN event_id % 7 = 0 THEN 'llm' ELSE 'rule' END AS role_source, event_id AS winner,
row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7 = 0 DESC, ts DESC, event_id DESC) AS k FROM events) SELECT client_id, document_id, role_source, winner FROM n WHERE k = 1"""),
}


def _pages(s: Star) -> DataFrame:
    from murmura.functions.common import url_reliability

    return s.table("pages").select("page_id", url_reliability(F.col("url")).alias("reliability"))
