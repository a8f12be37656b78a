"""Sentiment and topic labels over model scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lexicon of the sentiment rules.
NEGATIVE_WORDS = [
    "recall", "recalls", "lawsuit", "lawsuits", "scandal", "investigate", "investigation", "investigations", "probe", "breach", "hack",
    "layoffs", "layoff", "fine", "fines", "bankruptcy", "sued", "court", "fraud", "complaint", "defect", "safety data", "misleading",
    "fatal", "crash", "accident",
]
POSITIVE_WORDS = [
    "profit", "profits", "beat", "launch", "launches", "innovation", "breakthrough", "partnership", "expansion", "award", "success",
    "record", "growth",
]
LITIGATION = ["ban", "case", "legal", "lawsuit", "sued", "ruling", "judge", "trial", "verdict", "injunction", "damages", "charges", "settlement"]
BENIGN_CRASH = ["crash course", "crash test"]
SAFETY_CONCERN = ["concern", "issue", "problem", "incident", "recall", "warning", "risk", "defect", "failure"]
BEAT_NEGATIVE = ["low", "loss", "miss", "decline", "worst", "plunge", "slump"]
RECORD_NEGATIVE = ["debt", "loss", "layoffs", "low", "worst", "deficit", "fine", "decline"]
CONFIDENT, NEGATIVE_BOOST, POSITIVE_BOOST = 0.65, 0.15, 0.10


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def trigger_words(text: Column) -> tuple[Column, Column]:
    """(negative, positive) words of the lexicon that count in this lower-case text."""
    word_ok = {"court": _any(text, LITIGATION), "fine": _any(text, LITIGATION), "crash": ~_any(text, BENIGN_CRASH), "safety data": _any(text, SAFETY_CONCERN)}
    good_ok = {"beat": text.rlike(r"\bbeat\b") & ~_any(text, BEAT_NEGATIVE), "record": ~_any(text, RECORD_NEGATIVE)}
    found = lambda words, rules: F.array_compact(F.array(*(F.when(F.contains(text, F.lit(w)) & rules.get(w, F.lit(True)), F.lit(w)) for w in words)))
    return found(NEGATIVE_WORDS, word_ok), found(POSITIVE_WORDS, good_ok)


def calibrated_sentiment(rows: DataFrame) -> DataFrame:
    """label, score, rule and trigger_words from text, raw_label and raw_score."""
    rows = rows.withColumn("_t", F.lower("text"))
    bad, good = trigger_words(F.col("_t"))
    rows = rows.withColumns({"_bad": bad, "_good": good})
    label, score = F.col("raw_label"), F.col("raw_score")
    is_bad, is_good = F.size("_bad") > 0, (F.size("_bad") == 0) & (F.size("_good") > 0)
    rule = F.when(is_bad & (label == "neutral"), "Negative-Risk Upgrade").when(is_bad & (label == "negative"), "Negative-Risk Boost")
    rule = rule.when(is_good & (label == "neutral"), "Positive-Milestone Upgrade").when(is_good & (label == "positive"), "Positive-Milestone Boost")
    rows = rows.withColumn("_rule", rule)
    up = F.when(F.col("_rule").startswith("Negative"), NEGATIVE_BOOST).when(F.col("_rule").startswith("Positive"), POSITIVE_BOOST).otherwise(0.0)
    rows = rows.withColumn("_score", F.least(score + up, F.greatest(score, F.lit(1.0))))
    unsure = F.col("_rule").isNull() & (F.col("_score") < CONFIDENT)
    new = F.when(unsure, "neutral").when(F.col("_rule") == "Negative-Risk Upgrade", "negative").when(F.col("_rule") == "Positive-Milestone Upgrade", "positive").otherwise(label)
    return rows.withColumns(
        {
            "label": new, "score": F.col("_score"), "rule": F.when(unsure, "Low-Confidence Neutral Calibration").otherwise(F.col("_rule")),
            "trigger_words": F.slice(F.when(is_bad, F.col("_bad")).otherwise(F.col("_good")), 1, 3),
        }
    ).drop("_t", "_bad", "_good", "_rule", "_score")


def dual_scores(rows: DataFrame, logits: str) -> DataFrame:
    """independent (sigmoid) and softmax scores of an array of logits."""
    x = F.transform(logits, lambda v: v.cast("double"))
    rows = rows.withColumn("_x", x).withColumn("_top", F.array_max("_x"))
    rows = rows.withColumn("_e", F.transform("_x", lambda v: F.exp(v - F.col("_top"))))
    rows = rows.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda s, v: s + v))
    return rows.withColumns({"independent": F.transform("_x", lambda v: 1 / (1 + F.exp(-v))), "softmax": F.transform("_e", lambda v: v / F.col("_sum"))}).drop("_x", "_top", "_e", "_sum")


def topic_threshold(scores: DataFrame, thresholds: DataFrame, doc: str, default: float = 0.5) -> DataFrame:
    """Labels at or above their threshold, ranked by score, then label."""
    passed = scores.join(thresholds, "label", "left").where(F.col("score") >= F.coalesce("threshold", F.lit(default)))
    return passed.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), "label")))


def degenerate_guard(passed: DataFrame, doc: str, labels: int) -> DataFrame:
    """Drops all topics of a document where half of the taxonomy or more fired."""
    n = F.count("*").over(Window.partitionBy(doc))
    return passed.withColumn("_n", n).where(F.col("_n") < 0.5 * labels).drop("_n")


def infer_once(rows: DataFrame, text: str, score) -> DataFrame:
    """Scores each distinct input once (by hash) and joins results back; ``score`` maps a frame of input_hash, text."""
    keyed = rows.withColumn("input_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    inputs = keyed.groupBy("input_hash").agg(F.min(text).alias("text"))
    return keyed.join(score(inputs).drop("text"), "input_hash")


def score_batches(rows: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[float]]]) -> DataFrame:
    """``rows`` with score, the model's value of each text (null: empty text).

    ``load`` makes the model; each Python worker calls it once and keeps the model for all its batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model(b.fillna("").tolist()), dtype="float64")

    return rows.withColumn("score", score(text))


# Topic -> words that suppress it, words that keep it.
SUPPRESSION = {
    "Electric Vehicles": (["nikola tesla", "tesla coil"], ["musk", "ev", "stock", "tsla", "car", "vehicle", "model 3", "model y", "model s", "model x", "gigafactory", "quarterly", "battery"]),
    "Social Media": (["meta-analysis", "meta-analyses", "meta analysis"], ["zuckerberg", "instagram", "whatsapp", "facebook", "quest", "threads", "social network", "ad revenue"]),
    "Consumer Electronics": (["apple pie", "baked apple"], []),
}


def suppressed_topics(text: Column, topics: Column) -> Column:
    low = F.lower(text)
    gone = [F.when(_any(low, bad) & ~(_any(low, keep) if keep else F.lit(False)), F.lit(t)) for t, (bad, keep) in SUPPRESSION.items()]
    return F.array_except(topics, F.array_compact(F.array(*gone)))
