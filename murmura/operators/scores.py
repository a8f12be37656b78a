"""Reputation, executive and benchmark scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura import rules as R
from murmura.functions.common import clamp, grade, renormalised, url_reliability, within_days
from murmura.operators.gates import brand_documents, brand_gate, client_mentions, source_reliability, without_competitors


def reputation_score(clients, entities, documents, mentions, events, sources, *, as_of: str, days: int = R.REPUTATION_DAYS) -> DataFrame:
    """Per client: sentiment, risk, source and visibility components over the window, renormalised score, grade, health.

    Sentiment and source reliability average over distinct gated documents, risk over gated events without competitors."""
    brand = brand_documents(mentions, entities)
    facts = client_mentions(mentions, entities, documents).where(within_days(F.col("effective_at"), as_of, days))
    facts = brand_gate(without_competitors(facts), brand, entities)
    docs = facts.groupBy("client_id", "document_id").agg(F.sum("mention_count").alias("n"))
    rated = docs.join(documents.select("document_id", "sentiment_score"), "document_id", "left").join(source_reliability(documents, sources), "document_id", "left")
    per = rated.groupBy("client_id").agg(
        F.sum("n").alias("mentions"), F.count("*").alias("documents"), F.avg("sentiment_score").alias("avg_sentiment"),
        F.avg("source_reliability").alias("source"),
    )
    risky = events.withColumn("effective_at", F.coalesce("published_at", "created_at")).where(within_days(F.col("effective_at"), as_of, days))
    risky = brand_gate(without_competitors(risky), brand, entities)
    risk = risky.groupBy("client_id").agg(F.avg("risk_score").alias("avg_risk"))
    recent = events.where(within_days(F.col("created_at"), as_of, 1)).select("client_id").distinct().withColumn("recent", F.lit(True))
    all_ = clients.select("client_id").join(per, "client_id", "left").join(risk, "client_id", "left").join(recent, "client_id", "left")
    parts = all_.select(
        "client_id", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("documents", F.lit(0)).alias("documents"),
        ((F.col("avg_sentiment") + 1) / 2 * 100).alias("sentiment"), (100 - F.col("avg_risk")).alias("risk"), "source",
        F.when(F.col("mentions") > 0, F.col("mentions") / (F.col("mentions") + R.VISIBILITY_HALF) * 100).alias("visibility"), "recent",
    )
    score, weight = renormalised([(F.col(k), w) for k, w in R.REPUTATION_WEIGHTS.items()])
    score = clamp(score, 0, 100)
    score = F.when(weight >= R.MIN_WEIGHT - 1e-12, score)
    confidence = F.least(F.col("documents") / 50.0, F.lit(1.0)) * 0.4 + weight * 0.6
    return parts.select(
        "client_id", "mentions", "documents", "sentiment", "risk", "source", "visibility", score.alias("score"), grade(score).alias("grade"),
        confidence.alias("confidence"), F.when(F.col("recent"), "COMPLETE").otherwise("PARTIAL").alias("health"),
    )


def executive_score(entities, documents, mentions, events, *, as_of: str, days: int = R.EXECUTIVE_DAYS) -> DataFrame:
    """Per person: gated documents and events of the window; score times the mean reliability of the pages."""
    brand = brand_documents(mentions, entities)
    people = entities.where("entity_type = 'person'").select("client_id", "entity_id")
    facts = client_mentions(mentions, entities, documents).where("entity_type = 'person'").where(within_days(F.col("effective_at"), as_of, days))
    docs = brand_gate(facts, brand, entities).select("client_id", "entity_id", "document_id").distinct()
    rated = docs.join(documents.select("document_id", "sentiment_score", url_reliability(F.col("url")).alias("page")), "document_id", "left")
    per = rated.groupBy("client_id", "entity_id").agg(F.count("*").alias("documents"), F.avg("sentiment_score").alias("avg_sentiment"), F.avg("page").alias("page"))
    risky = events.where("entity_type = 'person'").withColumn("effective_at", F.coalesce("published_at", "created_at")).where(within_days(F.col("effective_at"), as_of, days))
    risk = brand_gate(risky, brand, entities).groupBy("client_id", "entity_id").agg(F.avg("risk_score").alias("avg_risk"), F.max("created_at").alias("last_risk"))
    parts = people.join(per, ["client_id", "entity_id"], "left").join(risk, ["client_id", "entity_id"], "left").select(
        "client_id", "entity_id", F.coalesce("documents", F.lit(0)).alias("documents"), ((F.col("avg_sentiment") + 1) / 2 * 100).alias("sentiment"),
        (100 - F.col("avg_risk")).alias("risk"), F.when(F.col("documents") > 0, F.least(F.col("documents") / R.EXECUTIVE_FULL_DOCS * 100, F.lit(100.0))).alias("visibility"),
        F.coalesce("page", F.lit(1.0)).alias("page"), F.coalesce(within_days(F.col("last_risk"), as_of, 1), F.lit(False)).alias("recent"),
    )
    base, weight = renormalised([(F.col(k), w) for k, w in R.EXECUTIVE_WEIGHTS.items()])
    enough = weight >= R.MIN_WEIGHT - 1e-12
    score = F.when(enough, clamp(base * F.col("page"), 0, 100)).otherwise(0.0)
    confidence = F.least(F.col("documents") / 10.0, F.lit(1.0)) * 0.6 + F.when(F.col("recent"), 0.4).otherwise(0.2)
    return parts.select(
        "client_id", "entity_id", "documents", score.alias("score"), F.when(enough, grade(score)).otherwise("NA").alias("grade"),
        F.when(~enough, "INSUFFICIENT_EVIDENCE").when(F.col("recent"), "COMPLETE").otherwise("PARTIAL").alias("health"),
        F.when(enough, confidence).otherwise(0.0).alias("confidence"),
    )


def entity_benchmark(entities, documents, mentions, events, sources, *, kind: str, as_of: str, days: int, gated: bool) -> DataFrame:
    """Per entity of one kind: averages over mention rows, comparable score, share of voice in the client, rank, health."""
    weights = R.REPUTATION_WEIGHTS
    facts = client_mentions(mentions, entities, documents).where(F.col("entity_type") == kind).where(within_days(F.col("effective_at"), as_of, days))
    risky = events.where(F.col("entity_type") == kind).withColumn("effective_at", F.coalesce("published_at", "created_at")).where(within_days(F.col("effective_at"), as_of, days))
    if gated:
        brand = brand_documents(mentions, entities)
        facts, risky = brand_gate(facts, brand, entities), brand_gate(risky, brand, entities)
    rated = facts.join(documents.select("document_id", "sentiment_score"), "document_id", "left").join(source_reliability(documents, sources), "document_id", "left")
    per = rated.groupBy("client_id", "entity_id").agg(
        F.sum("mention_count").alias("mentions"), F.avg("sentiment_score").alias("avg_sentiment"), F.avg("source_reliability").alias("source")
    )
    risk = risky.groupBy("client_id", "entity_id").agg(F.avg("risk_score").alias("avg_risk"))
    own = entities.where(F.col("entity_type") == kind).select("client_id", "entity_id", "entity_name")
    parts = own.join(per, ["client_id", "entity_id"], "left").join(risk, ["client_id", "entity_id"], "left").select(
        "client_id", "entity_id", "entity_name", F.coalesce("mentions", F.lit(0)).alias("mentions"), ((F.col("avg_sentiment") + 1) / 2 * 100).alias("sentiment"),
        (100 - F.col("avg_risk")).alias("risk"), "source", F.when(F.col("mentions") > 0, F.col("mentions") / (F.col("mentions") + R.VISIBILITY_HALF) * 100).alias("visibility"),
    )
    score, weight = renormalised([(F.col(k), w) for k, w in weights.items()])
    enough = weight >= R.MIN_WEIGHT - 1e-12
    total = F.sum("mentions").over(Window.partitionBy("client_id"))
    confidence = F.least(F.col("mentions") / 50.0, F.lit(1.0)) * 0.4 + weight * 0.6
    scored = parts.select(
        "client_id", "entity_id", "entity_name", "mentions", F.when(enough, score).otherwise(0.0).alias("score"), enough.alias("has_evidence"),
        F.when(total > 0, F.col("mentions") / total * 100).otherwise(0.0).alias("share_of_voice"), F.when(enough, confidence).otherwise(0.0).alias("confidence"),
        F.when(~enough, "INSUFFICIENT_EVIDENCE").when(weight >= sum(weights.values()) - 1e-9, "COMPLETE").otherwise("PARTIAL").alias("health"),
    )
    return benchmark_rank(scored)


def benchmark_rank(scored: DataFrame) -> DataFrame:
    """rank by score, then entity; 0 without evidence."""
    order = Window.partitionBy("client_id").orderBy(F.desc("has_evidence"), F.desc("score"), "entity_id")
    return scored.withColumn("rank", F.when(F.col("has_evidence"), F.row_number().over(order)).otherwise(0))


def client_share_of_voice(benchmark: DataFrame) -> DataFrame:
    """What the competitors' shares leave to the client, not below zero."""
    return benchmark.groupBy("client_id").agg(F.greatest(100 - F.sum("share_of_voice"), F.lit(0.0)).alias("client_share"))


def biggest_drag(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The component that loses the most weighted points."""
    lost = F.array(*(F.struct(((100 - F.col(k)) * w).alias("lost"), F.lit(k).alias("component")) for k, w in weights.items()))
    worst = F.array_max(F.filter(lost, lambda x: x["lost"].isNotNull()))
    return scores.select("client_id", worst["component"].alias("component"), worst["lost"].alias("lost"))
