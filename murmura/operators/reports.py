"""Grouped reports for dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.common import risk_level
from murmura.functions.jsons import stripped_json


def topic_of_document(topics: DataFrame) -> DataFrame:
    """Topic of highest confidence; earliest line, then topic, on ties."""
    best = F.min(F.struct((-F.col("topic_confidence")).alias("less"), "line", "topic"))["topic"].alias("topic")
    return topics.groupBy("document_id").agg(best)


def topic_distribution(facts: DataFrame, topic: DataFrame) -> DataFrame:
    """Distinct documents of each (entity, topic), "General" without a topic, with the entity's total."""
    docs = facts.select("client_id", "entity_id", "document_id").distinct().join(topic, "document_id", "left")
    counts = docs.groupBy("client_id", "entity_id", F.coalesce("topic", F.lit("General")).alias("topic")).agg(F.count("*").alias("documents"))
    return counts.withColumn("entity_documents", F.sum("documents").over(Window.partitionBy("client_id", "entity_id")))


def document_counts(visible: DataFrame, sentiment: Column) -> DataFrame:
    """Per client: total, positive (> 0.3), negative (< -0.3), neutral and unscored documents."""
    return visible.groupBy("client_id").agg(
        F.count("*").alias("total"), F.count_if(sentiment > 0.3).alias("positive"), F.count_if(sentiment < -0.3).alias("negative"),
        F.count_if(sentiment.between(-0.3, 0.3)).alias("neutral"), F.count_if(sentiment.isNull()).alias("unscored"),
    )


def document_risk_summary(events: DataFrame, visible: DataFrame, recent: Column) -> DataFrame:
    """Per client over documents: counts by band of each document's highest score, mean of rounded scores, unscored."""
    per = events.groupBy("client_id", "document_id").agg(F.max("risk_score").alias("score"), F.max("created_at").alias("created_at"))
    rows = visible.select("client_id", "document_id").distinct().join(per, ["client_id", "document_id"], "left").withColumn("level", risk_level(F.col("score")))
    return rows.groupBy("client_id").agg(
        *(F.count_if(F.col("level") == b).alias(b.lower()) for b in ("LOW", "MEDIUM", "HIGH", "CRITICAL")),
        F.count_if(F.col("level").isin("HIGH", "CRITICAL") & recent).alias("recent_severe"), F.avg(F.bround("score")).alias("average"),
        F.max("score").alias("highest"), F.count_if(F.col("score").isNull()).alias("unscored"),
    )


def sentiment_summary(labels: DataFrame) -> DataFrame:
    """Label counts per client and the dominant one, "mixed" on a tie."""
    n = {k: F.count_if(F.col("label") == k) for k in ("Positive", "Neutral", "Negative")}
    per = labels.groupBy("client_id").agg(*(c.alias(k.lower()) for k, c in n.items()))
    top = F.greatest("positive", "neutral", "negative")
    ties = sum((F.col(k) == top).cast("int") for k in ("positive", "neutral", "negative"))
    name = F.when(ties > 1, "mixed").when(F.col("positive") == top, "positive").when(F.col("neutral") == top, "neutral").otherwise("negative")
    return per.withColumn("dominant", name)


def risk_heatmap(events: DataFrame, least: int = 5) -> DataFrame:
    """topic x level with row, column and grand totals; topics of few documents are hidden."""
    shown = events.where("topic IS NOT NULL").groupBy("topic").agg(F.countDistinct("document_id").alias("n")).where(F.col("n") >= least).select("topic")
    cells = events.join(shown, "topic").cube("topic", "risk_level")
    return cells.agg(F.count("*").alias("events"), F.avg("risk_score").alias("avg_risk"), F.grouping_id().alias("totals"))


def risk_matrix(events: DataFrame) -> DataFrame:
    """level x confidence tier (67 and 33 of 100)."""
    tier = F.when(F.col("confidence_score") * 100 >= 67, "high").when(F.col("confidence_score") * 100 >= 33, "medium").otherwise("low")
    return events.withColumn("tier", tier).groupBy("risk_level").pivot("tier", ["high", "medium", "low"]).count().na.fill(0)


def overview(labels: DataFrame, least: int = 5) -> DataFrame:
    """Net sentiment if there are enough readings, and the positive share."""
    per = labels.groupBy("client_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "Positive").alias("pos"), F.count_if(F.col("label") == "Negative").alias("neg"))
    return per.select("client_id", F.when(F.col("n") >= least, (F.col("pos") - F.col("neg")) / F.col("n")).alias("net"), (F.col("pos") / F.col("n")).alias("positive_share"))


def daily(rows: DataFrame, at: str, value: str) -> DataFrame:
    return rows.groupBy(F.date_trunc("day", F.col(at)).alias("day")).agg(F.count("*").alias("n"), F.round(F.avg(value), 2).alias("mean"))


def peak_day(days: DataFrame) -> DataFrame:
    """The day of most rows (earliest on ties) and rows a day."""
    return days.agg(F.min_by("day", F.struct(-F.col("n"), F.col("day"))).alias("peak"), F.max("n").alias("peak_rows"), F.avg("n").alias("per_day"))


def llm_cost(calls: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Calls, failures, tokens and cost by run and call type with totals; unknown types are counted at no cost."""
    table = F.create_map(*[x for k, v in prices.items() for x in (F.lit(k), F.lit(v))])
    price = F.element_at(table, F.col("call_type"))
    rows = calls.withColumn("usd", F.coalesce(price, F.lit(0.0)) * F.col("tokens") / 1e6).withColumn("known", price.isNotNull())
    return rows.rollup("run", "call_type").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failed"), F.sum("tokens").alias("tokens"), F.sum("usd").alias("usd"),
        F.bool_and("known").alias("price_known"),
    )


def alert_severity(alerts: DataFrame) -> DataFrame:
    """Alerts by severity; unknown and missing severities count as MEDIUM."""
    known = F.upper(F.coalesce("severity", F.lit("MEDIUM")))
    level = F.when(known.isin("CRITICAL", "HIGH", "LOW"), known).otherwise("MEDIUM")
    return alerts.groupBy(level.alias("severity")).agg(F.count("*").alias("alerts"))


def document_enrichment(visible: DataFrame, documents: DataFrame, sources: DataFrame, events: DataFrame, topics: DataFrame, named: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each visible (client_id, document_id): source, best risk with its entity, label (the entity's, else the
    document's), topic of highest confidence, and the mentioned entities' names.

    ``events`` are the client's own, competitors left out; ``named`` (document_id, entity_name); ``labels`` (document_id,
    entity_id, label). Each side is reduced to one row a key before it is joined."""
    best = F.min_by(F.struct("risk_score", "entity_id"), F.struct(-F.col("risk_score"), "entity_id")).alias("r")
    risk = events.groupBy("client_id", "document_id").agg(best).select("client_id", "document_id", "r.*")
    names = named.groupBy("document_id").agg(F.array_sort(F.collect_set("entity_name")).alias("mentions"))
    rows = visible.join(documents.select("document_id", "source_id", "sentiment_label"), "document_id").join(sources.select("source_id", "source_name"), "source_id", "left")
    rows = rows.join(risk, ["client_id", "document_id"], "left").join(labels, ["document_id", "entity_id"], "left").join(topic_of_document(topics), "document_id", "left").join(names, "document_id", "left")
    return rows.select("client_id", "document_id", "source_name", "risk_score", "entity_id", F.coalesce("label", "sentiment_label").alias("label"), F.coalesce("topic", F.lit("General")).alias("topic"), "mentions")


def document_feed(visible: DataFrame, documents: DataFrame, sources: DataFrame, events: DataFrame, topics: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row for each (client_id, document_id) of ``visible`` as readers are shown it.

    ``events`` (client_id, document_id, entity_id, risk_score, sentiment, explainability) holds no competitors; of a document's the highest
    counts, the smallest entity on ties. ``mentions`` (document_id, entity_id, entity_name, entity_type). A document without a score shows
    risk 0 and scored false. risk rounds half to even, bands and risk_exact are of the score as it is.
    What readers are shown of a document is one row of it, which meets its clients last: rows of (client, document) go through
    the other joins as ids and what their event says, and no text is repeated in them."""
    best = events.groupBy("client_id", "document_id").agg(F.min_by(F.struct("risk_score", F.col("sentiment").alias("label"), "explainability"), F.struct(-F.col("risk_score"), F.col("entity_id"))).alias("r"))
    entity = F.struct(F.coalesce("entity_name", F.lit("Unknown")).alias("name"), F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"))
    said = mentions.select("document_id", F.struct("entity_id", entity.alias("e")).alias("m")).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_set("m")), lambda x: x["e"]).alias("extracted_entities"))
    seen = visible.select("client_id", "document_id").join(best, ["client_id", "document_id"], "left").select("client_id", "document_id", "r.*")
    shown = documents.join(sources.select("source_id", "source_name"), "source_id", "left").join(topic_of_document(topics), "document_id", "left").join(said, "document_id", "left")
    rows = seen.join(shown, "document_id")
    source, score, sentiment = F.coalesce("source_name", F.lit("RSS Feed")), F.col("risk_score"), F.coalesce("sentiment_score", F.lit(0.0))
    scored = score.isNotNull()
    return rows.select(
        "client_id", "document_id", F.coalesce(F.nullif("title", F.lit("")), source).alias("title"), source.alias("source"), "document_type", F.coalesce("published_at", "collected_at").alias("timestamp"),
        F.coalesce("processing_status", F.lit("COMPLETED")).alias("status"), sentiment.alias("sentiment"), F.bround(F.coalesce(score, F.lit(0.0))).alias("risk"), scored.alias("scored"),
        risk_level(score).alias("risk_level"), score.alias("risk_exact"), F.when(scored, F.coalesce("label", "sentiment_label")).alias("risk_sentiment"),
        F.when(F.col("published_at").isNotNull(), "published").when(F.col("collected_at").isNotNull(), "collected").alias("date_basis"), stripped_json(F.col("explainability"), "trend").alias("risk_explainability"),
        F.col("normalized_content").alias("original_content"), F.coalesce("extracted_entities", F.array().cast("array<struct<name:string,entity_type:string>>")).alias("extracted_entities"),
        F.coalesce("topic", F.lit("General")).alias("topic"), F.concat(F.when(sentiment >= 0, "+").otherwise(""), F.format_string("%.1f", sentiment * 10)).alias("reputation_impact"),
    )


def matching_metrics(rows: DataFrame, at: str, matched: Column, took: str, width: str = "5 minutes") -> DataFrame:
    """Documents, matches and mean time of each flush interval."""
    per = rows.groupBy(F.window(F.col(at).cast("timestamp"), width).alias("w")).agg(F.count("*").alias("documents"), F.count_if(matched).alias("matches"), F.avg(took).alias("mean_time"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "documents", "matches", "mean_time")


def collection_status(clients: DataFrame, gated: DataFrame, documents: DataFrame, jobs: DataFrame, recent: Column) -> DataFrame:
    """Per client: documents and matches behind the brand gate, documents of the last day, jobs and their health.

    ``gated``: match rows (client_id, document_id) that pass the gate; ``jobs`` (client_id, status)."""
    counts = gated.join(documents.select("document_id", recent.alias("recent")), "document_id").groupBy("client_id").agg(
        F.countDistinct("document_id").alias("documents"), F.count("*").alias("matches"), F.countDistinct(F.when(F.col("recent"), F.col("document_id"))).alias("today")
    )
    runs = jobs.groupBy("client_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "SUCCESS").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    rows = clients.select("client_id").join(counts, "client_id", "left").join(runs, "client_id", "left").na.fill(0)
    health = F.when((F.col("jobs") == 0) | (F.col("failed") == 0), 100).otherwise(F.bround(F.col("completed") / F.col("jobs") * 100).cast("int"))
    return rows.withColumns({"queue_health": health, "platform": F.when(F.col("failed") == 0, "Healthy").otherwise("Degraded")})


def job_status(counts: DataFrame) -> DataFrame:
    """Final status of a job from its counters."""
    done = F.col("processed") >= F.col("total")
    return counts.withColumn("status", F.when(done & (F.col("failed") > 0), "PARTIAL").when(done, "COMPLETED").otherwise("RUNNING"))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """TP, FP, FN, TN of boolean ``truth`` against ``guess``."""
    t, g = F.col("truth"), F.col("guess")
    n = pairs.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    return n.select("*", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))


def range_violations(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, violations: one row for each rule."""
    wide = table.agg(*(F.count_if(~ok).alias(name) for name, ok in checks.items()))
    return wide.unpivot([], list(checks), "check_name", "violations")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    b, a = before.select(F.col(key).alias("bk"), F.col(value).alias("before")), after.select(F.col(key).alias("ak"), F.col(value).alias("after"))
    both = b.join(a, F.col("bk").eqNullSafe(F.col("ak")), "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(F.coalesce("bk", "ak").alias(key), "before", "after")
