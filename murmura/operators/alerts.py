"""Alerts: thresholds, evidence, merging into living incidents, lifecycle checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura import rules as R
from murmura.functions.jsons import merged_json
from murmura.operators.ranks import top_per_key

RESCALE = 1.25
SEVERITIES = ["WARNING", "HIGH", "CRITICAL"]


def evidence_threshold(events: DataFrame) -> DataFrame:
    """client_id, threshold: busier clients need more evidence."""
    n = F.count("*")
    level = F.when(n > R.ALERT_LEVELS[0][0], R.ALERT_LEVELS[0][1]).when(n > R.ALERT_LEVELS[1][0], R.ALERT_LEVELS[1][1])
    return events.groupBy("client_id").agg(level.otherwise(R.ALERT_DEFAULT).alias("threshold"))


def alert_candidates(events: DataFrame, n: int = 15) -> DataFrame:
    """Latest n events above the cap of each client."""
    return top_per_key(events.where(F.col("risk_score") > 50), ["client_id"], [F.desc("created_at"), F.desc("risk_score"), "document_id", "entity_id"], n)


def alert_evidence(candidates: DataFrame, executive_events: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Alerts that fire: per (client, entity) evidence from the candidates and from executive risks."""
    risks = candidates.groupBy("client_id", "entity_id").agg(
        F.max("risk_score").alias("max_risk"), F.count("*").alias("events"), F.sort_array(F.collect_set("document_id")).alias("documents")
    )
    people = executive_events.select("client_id", "entity_id").distinct().withColumn("executive", F.lit(True))
    both = risks.join(people, ["client_id", "entity_id"], "full").join(thresholds, "client_id")
    docs, top = F.coalesce(F.size("documents"), F.lit(0)), F.coalesce("max_risk", F.lit(0.0))
    docs = F.when(F.col("documents").isNull(), F.lit(0)).otherwise(docs)
    executive = F.coalesce("executive", F.lit(False))
    evidence = F.least((top * 0.45 + F.least(docs * 4.0, F.lit(20.0)) + F.when(executive, 15.0).otherwise(0.0)) * RESCALE, F.lit(100.0))
    confidence = F.least(F.greatest(40.0 + F.least(docs * 6.0, F.lit(30.0)) + top * 0.15, F.lit(10.0)), F.lit(100.0))
    rows = both.select("client_id", "entity_id", "threshold", executive.alias("executive"), docs.alias("n_documents"), "documents", evidence.alias("evidence_score"), confidence.alias("confidence_score"))
    fires = rows.where("evidence_score >= threshold AND confidence_score >= 40")
    severity = F.when((F.col("evidence_score") > 70) | F.col("executive"), "CRITICAL").when(F.col("evidence_score") > 45, "HIGH").otherwise("WARNING")
    return fires.withColumns({"severity": severity, "alert_type": F.when(F.col("executive"), "Executive Risk").otherwise("Multi-Signal Incident")})


def merge_alerts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Living alerts after new ones: a first one is NEW, severity only rises, documents unite, scores keep their maximum,
    resolved and closed alerts reopen, histories grow by each change of status. Where both tables have a column explainability
    (JSON objects), it is merged key by key: entries of the new alert win, those it lacks stay."""
    key = ["client_id", "alert_type", "entity_id"]
    s, n = stored.alias("s"), new.alias("n")
    both = s.join(n, [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full")
    rank = lambda c: F.array_position(F.array(*map(F.lit, SEVERITIES)), c)
    severity = F.when(F.coalesce(rank(F.col("n.severity")), F.lit(0)) > F.coalesce(rank(F.col("s.severity")), F.lit(0)), F.col("n.severity")).otherwise(F.col("s.severity"))
    nothing = F.array().cast("array<bigint>")
    status = F.when(F.col("s.lifecycle_status").isNull(), "NEW")
    status = status.when(F.col("n.severity").isNotNull() & F.col("s.lifecycle_status").isin("RESOLVED", "CLOSED"), "ACTIVE").otherwise(F.col("s.lifecycle_status"))
    rows = both.select(
        *(F.coalesce(f"s.{k}", f"n.{k}").alias(k) for k in key), severity.alias("severity"),
        F.sort_array(F.array_union(F.coalesce("s.documents", nothing), F.coalesce("n.documents", nothing))).alias("documents"),
        F.greatest("s.evidence_score", "n.evidence_score").alias("evidence_score"), F.greatest("s.confidence_score", "n.confidence_score").alias("confidence_score"),
        F.col("s.lifecycle_status").alias("was"), status.alias("lifecycle_status"), F.coalesce("s.history", F.array().cast("array<string>")).alias("history"),
        *([merged_json(F.col("s.explainability"), F.col("n.explainability")).alias("explainability")] if "explainability" in stored.columns and "explainability" in new.columns else []),
    )
    moved = ~F.col("was").eqNullSafe(F.col("lifecycle_status"))
    step = F.array(F.concat_ws(">", "was", "lifecycle_status"))
    return rows.withColumn("history", F.when(moved, F.concat("history", step)).otherwise(F.col("history"))).drop("was")


def alert_batch(rows: DataFrame) -> DataFrame:
    """One alert for each (client_id, alert_type, entity_id) of a batch of signals: highest severity and scores, all documents."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return rows.groupBy("client_id", "alert_type", "entity_id").agg(
        F.max_by("severity", rank).alias("severity"), F.sort_array(F.collect_set("document_id")).alias("documents"),
        F.max("evidence_score").alias("evidence_score"), F.max("confidence_score").alias("confidence_score"),
    )


def invalid_transitions(changes: DataFrame) -> DataFrame:
    """Changes (old_status, new_status) outside the transition table."""
    pairs = [(a, b) for a, bs in R.ALERT_TRANSITIONS.items() for b in bs]
    allowed = changes.sparkSession.createDataFrame(pairs, "old_status string, new_status string")
    return changes.join(allowed, ["old_status", "new_status"], "left_anti")


def summary_signature(rows: DataFrame, fields: list[str]) -> DataFrame:
    """signature: SHA-256 of the fields, unit-separated, null as empty."""
    joined = F.concat_ws("\u001f", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
    return rows.withColumn("signature", F.sha2(joined, 256))
