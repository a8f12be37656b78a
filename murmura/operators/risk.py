"""Risk scores: mechanical score, relevance gate, caps and floors, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura import rules as R
from murmura.functions.common import (
    clamp,
    lookup,
    reach_modifier,
    reach_trust_eligible,
    reliability_modifier,
    risk_level,
    trust_modifier,
)
from murmura.functions.jsons import folded_json
from murmura.operators.components import heavy_rows, joined_by_key


def top_risk_topic(topics: DataFrame) -> DataFrame:
    """document_id, topic, topic_confidence, topic_weight: the heaviest topic of enough confidence, first line on ties."""
    weighted = topics.withColumn("topic_weight", lookup(F.col("topic"), R.TOPIC_WEIGHTS, 0))
    fit = weighted.where((F.col("topic_confidence") >= R.TOPIC_MIN_CONFIDENCE) & (F.col("topic_weight") > 0))
    best = F.min_by(F.struct("topic", "topic_confidence", "topic_weight"), F.struct(-F.col("topic_weight"), F.col("line"), F.col("topic"), F.col("topic_confidence"))).alias("b")
    return fit.groupBy("document_id").agg(best).select("document_id", "b.*")


def entity_sentiment(mentions: DataFrame) -> DataFrame:
    """First label and confidence of each (document, entity)."""
    first = F.min(F.struct("line", "label", "confidence")).alias("s")
    return mentions.groupBy("document_id", "entity_id").agg(first).select("document_id", "entity_id", "s.label", "s.confidence")


def risk_events(mentions: DataFrame, entities: DataFrame, documents: DataFrame, topics: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each (client, document, entity): score, level, confidence and the parts they come from."""
    kind, title, views, comments = (F.col(c) for c in ("document_type", "title", "view_count", "comment_count"))
    modifier = F.when(kind.isin("youtube", "instagram", "reddit"), reach_modifier(views, comments)).when(kind == "rss", trust_modifier(title)).otherwise(1.0)
    src = sources.select("source_id", reliability_modifier(F.concat_ws(" ", "category", "source_name")).alias("reliability"))
    docs = documents.join(src, "source_id", "left").select(
        "document_id", "published_at", "collected_at", F.coalesce("reliability", F.lit(1.0)).alias("reliability"), modifier.alias("modifier"),
        reach_trust_eligible(kind, title, views, comments).alias("eligible"), "title", "content_hash", "document_type",
    )
    rows = entity_sentiment(mentions).join(entities, "entity_id").join(docs, "document_id").join(top_risk_topic(topics), "document_id", "left")
    weight = F.coalesce("topic_weight", F.lit(0))
    raw = (weight + lookup(F.col("label"), R.SENTIMENT_WEIGHTS, 10)) / R.RISK_DIVISOR * 100.0 * F.col("reliability") * F.col("modifier")
    relevant = ((F.col("label") == "Negative") | (weight > 0)) & F.col("eligible")
    score = F.when(relevant, clamp(raw, 0, 100)).otherwise(0.0)
    return rows.select(
        "client_id", "document_id", "entity_id", "entity_name", "entity_type", "title", "document_type", "content_hash", "topic",
        F.col("label").alias("sentiment"), score.alias("risk_score"), risk_level(score).alias("risk_level"),
        ((F.coalesce("topic_confidence", F.lit(0.0)) + F.col("confidence")) / 2).alias("confidence_score"),
        "reliability", "modifier", "published_at", F.col("collected_at").alias("created_at"),
    )


def insensitive(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}")


def noise_reason(title: Column, kind: Column) -> Column:
    """market_move, financial_results, promotional, or null if the title may be a reputation event."""
    serious = insensitive(title, R.KEEP_SCORING) | insensitive(title, R.SERIOUS) | title.rlike(R.SERIOUS_ABBR)
    reason = F.when(F.coalesce(title, F.lit("")) == "", None).when(serious, None).when(insensitive(title, R.RESULTS), "financial_results")
    reason = reason.when(insensitive(title, R.MARKET), "market_move")
    return reason.when(kind.isin(R.PROMO_TYPES) & insensitive(title, R.PROMO), "promotional")


def names_entity(title: Column, name: Column) -> Column:
    t, n = F.lower(title), F.lower(F.trim(name))
    first = F.split(n, r"\s+")[0]
    return (n != "") & (t.contains(n) | ((F.length(first) >= 4) & t.contains(first)))


def serious_floor(title: Column, kind: Column, sentiment: Column, role: Column, name: Column, source: Column) -> Column:
    """True if a serious press title about the entity lifts its score to the floor."""
    low = F.lower(F.concat_ws(" ", title, source))
    excluded = F.lit(False)
    for o in R.FLOOR_EXCLUDED_OUTLETS:
        excluded = excluded | low.contains(o)
    quiet = insensitive(title, R.MARKET) | insensitive(title, R.RESULTS) | insensitive(title, R.CHARGES_DROPPED) | insensitive(title, R.FLOOR_EXCLUDE)
    ok = kind.isin(R.FLOOR_TYPES) & ~F.coalesce(sentiment == "Positive", F.lit(False)) & ~F.coalesce(role.isin("BYSTANDER", "EXONERATED"), F.lit(False))
    return F.coalesce(ok & ~excluded & names_entity(title, name) & ~quiet & (insensitive(title, R.SERIOUS) | title.rlike(R.SERIOUS_ABBR)), F.lit(False))


def penalty_fields(text: Column) -> dict[str, Column]:
    """amount_lakh (largest), authority, criminal and restricts of a headline."""

    def amounts(pattern: str) -> Column:
        number = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
        unit = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(2)), lambda x: F.lower(x))
        units = F.create_map(*[v for k, w in R.UNIT_LAKH.items() for v in (F.lit(k), F.lit(w))])
        return F.zip_with(number, unit, lambda v, u: F.when(u == "", v / 100000.0).otherwise(v * F.coalesce(F.element_at(units, u), F.lit(1.0))))

    senior = insensitive(text, R.SENIOR) | text.rlike(R.SENIOR_ABBR)
    return {
        "amount_lakh": F.array_max(F.concat(amounts(R.AMOUNT), amounts(R.AMOUNT_BARE))),
        "authority": F.when(senior, "senior").when(insensitive(text, R.SMALL), "small").otherwise("unknown"),
        "criminal": insensitive(text, R.CRIMINAL),
        "restricts": insensitive(text, R.RESTRICT),
    }


def penalty_cap(age_days: Column) -> tuple[Column, Column]:
    """(cap, reason) from the penalty fields in the row."""
    amount, small = F.col("amount_lakh"), F.col("authority") == "small"
    kept = F.when(F.col("criminal"), "criminal").when(F.col("authority") == "senior", "senior authority").when(F.col("restricts"), "restricting order")
    kept = kept.when(amount >= R.SMALL_LAKH, "amount")
    capped = F.when(age_days > R.OLD_DAYS, "old").when(amount.isNotNull(), "small amount").when(small, "small authority")
    cap = F.coalesce(kept, F.lit("")) == ""
    cap = cap & capped.isNotNull()
    return cap, F.coalesce(kept, capped, F.lit("nothing found"))


def is_news_outlet(name: Column) -> Column:
    words = "|".join(w.replace("-", r"\-") for w in sorted(R.NEWS_OUTLETS, key=len, reverse=True))
    return F.coalesce(name.rlike(rf"(?i)(?<![a-z0-9])(?:{words})(?![a-z0-9])"), F.lit(False))


def ugc_cap(kind: Column, views: Column, author: Column, status: Column) -> Column:
    """True if an allegation in a user-generated source of little reach is held at the cap."""
    return (
        F.coalesce(status == "allegation", F.lit(False))
        & F.coalesce(F.lower(kind).isin(R.UGC_TYPES), F.lit(False))
        & ~is_news_outlet(author)
        & (views.isNull() | (views < R.UGC_VIEWS))
    )


def final_score(rows: DataFrame, *, floor: bool, case_status: bool, as_of: str) -> DataFrame:
    """Adds final_score: noise cap, serious floor, role zeroing, status cap, penalty cap, user-generated cap.

    Takes risk_events with role, case_status, author and view_count; the flags switch the optional rules."""
    title, brand = F.col("title"), F.coalesce(F.col("entity_type") == "brand", F.lit(False))
    score = F.col("risk_score")
    if floor:
        score = F.when(brand & (score > R.LOW_CAP) & noise_reason(title, F.col("document_type")).isNotNull(), R.LOW_CAP).otherwise(score)
        lifts = serious_floor(title, F.col("document_type"), F.col("sentiment"), F.col("role"), F.col("entity_name"), F.lit(""))
        score = F.when(brand & lifts & (score < R.HIGH_FLOOR), R.HIGH_FLOOR).otherwise(score)
    rows = rows.withColumn("s1", score)
    zeroed = (F.col("s1") > R.ROLE_MIN) & F.coalesce(F.col("role").isin("BYSTANDER", "EXONERATED"), F.lit(False))
    rows = rows.withColumn("s2", F.when(zeroed, 0.0).otherwise(F.col("s1")))
    out = F.col("s2")
    if case_status:
        rows = rows.withColumns(penalty_fields(title))
        age = (F.lit(as_of).cast("timestamp").cast("double") - F.col("published_at").cast("timestamp").cast("double")) / 86400.0
        cap, _ = penalty_cap(age)
        status, over = F.col("case_status"), F.col("s2") > R.STATUS_CAP
        held = status.isin(R.CAPPED_STATUSES) | ((status == "penalty_or_order") & cap)
        held = held | ugc_cap(F.col("document_type"), F.col("view_count"), F.col("author"), status)
        out = F.when((F.col("s2") > R.ROLE_MIN) & over & F.coalesce(held, F.lit(False)), R.STATUS_CAP).otherwise(F.col("s2"))
    return rows.withColumn("final_score", out).drop("s1", "s2")


def collapse_events(events: DataFrame) -> DataFrame:
    """The highest score of each (client, entity, topic, content), smallest document on ties."""
    what = F.coalesce(F.nullif("content_hash", F.lit("")), F.lower(F.trim("title")))
    w = Window.partitionBy("client_id", "entity_id", F.coalesce("topic", F.lit("unknown")), what).orderBy(F.desc("risk_score"), "document_id")
    return events.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert_events(stored: DataFrame, new: DataFrame, json: str | None = None) -> DataFrame:
    """New rows win over stored ones of their key unless the stored one's label is of a better tier or it is newer.

    ``json`` names a column of JSON objects that is merged key by key: every row that stood when it came (in order of
    computed_at, on a tie the lesser tier first) leaves its entries, later ones win, entries that only earlier rows have stay."""
    tier = F.when(F.col("role_source") == "llm", 1).otherwise(0)
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    key = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("client_id", "document_id", "entity_id")))
    both = both.withColumns({"_key": key, "_tier": tier})
    order = [F.desc("_tier"), F.desc("computed_at"), F.desc("_new")]
    best = both.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_k = 1")
    if json is None:
        return best.select(*stored.columns)
    # With the stored row given, a row stood unless that one, or a better new one before it, ranks above it.
    rank = F.struct("_tier", "computed_at")
    marks = both.groupBy("_key").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("_new") == 0, rank)).alias("_held"), F.min(F.when((F.col("_new") == 1) & (F.col("_tier") == 1), F.col("computed_at"))).alias("_first")
    )
    rows = joined_by_key(both, marks, "_key", heavy_rows(both.count()))
    stood = (F.col("_held").isNull() | (rank >= F.col("_held"))) & ((F.col("_tier") == 1) | F.coalesce(F.col("computed_at") <= F.col("_first"), F.lit(True)))
    merged = folded_json(rows.where((F.col("_new") == 0) | stood), ["_key"], json, order)
    return best.drop(json).join(merged, "_key", "left").select(*stored.columns)


def parse_status(text: Column) -> tuple[Column, Column]:
    """(status, event) of a model's answer; status only from the fixed list."""
    status = F.lower(F.regexp_extract(text, r'(?i)"?status"?\s*[:=]\s*"?\s*([a-z_]+)\s*"?\s*(?:[,}\n]|$)', 1))
    event = F.lower(F.trim(F.regexp_replace(F.regexp_extract(text, r'(?i)"?event"?\s*[:=]\s*"([^"\n]{0,120})"', 1), r"\s+", " ")))
    return F.when(status.isin(R.CASE_STATUSES), status), F.nullif(event, F.lit(""))
