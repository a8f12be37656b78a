"""Column expressions that many operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmura import rules as R


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def lookup(c: Column, table: dict, default) -> Column:
    """Value of a small fixed table, by equality."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def renormalised(parts: list[tuple[Column, float]], least: float = R.MIN_WEIGHT) -> tuple[Column, Column]:
    """(weighted mean over the non-null parts, their weight); no mean under ``least`` weight."""
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    total = sum((F.coalesce(c * F.lit(w), F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(weight >= least - 1e-12, total / weight), weight


def risk_level(score: Column) -> Column:
    """Bands on the unrounded score."""
    level = F.when(score.isNull(), F.lit(None))
    for top, name in R.RISK_BANDS:
        level = level.when(score <= top, name)
    return level.otherwise("CRITICAL")


def grade(score: Column) -> Column:
    g = F.when(score.isNull(), F.lit(None))
    for low, name in R.GRADES:
        g = g.when(score >= low, name)
    return g.otherwise("F")


def phrase_form(c: Column) -> Column:
    """Lower case, runs of non-words as one space, padded: contains(" x ") then matches whole phrases."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"(?U)[\W_]+", " ")), F.lit(" "))


def effective_date(published: Column, created: Column) -> Column:
    return F.coalesce(published, created)


def within_days(c: Column, as_of: str, days: int) -> Column:
    return c >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS")


def outlet_of(title: Column) -> Column:
    """Lower-case text after the last " - " of a title; null if there is none."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(title, r"^(?s)(.*) - (.*)$", 2))), F.lit(""))


def reach_modifier(views: Column, comments: Column) -> Column:
    reach = F.greatest(views, F.lit(0)) + F.greatest(F.coalesce(comments, F.lit(0)), F.lit(0)) * R.COMMENT_WEIGHT
    x = F.log10(reach.cast("double") + 1)
    m = F.when(views.isNull(), F.lit(1.0)).when(x <= R.REACH_ANCHORS[0][0], F.lit(R.REACH_ANCHORS[0][1]))
    for (x0, y0), (x1, y1) in zip(R.REACH_ANCHORS, R.REACH_ANCHORS[1:]):
        m = m.when(x <= x1, F.lit(y0) + (x - x0) / (x1 - x0) * (y1 - y0))
    return m.otherwise(F.lit(R.REACH_ANCHORS[-1][1]))


def trust_tier(title: Column) -> Column:
    return lookup(F.coalesce(outlet_of(title), F.lit("")), R.OUTLET_TIERS, "unknown")


def trust_modifier(title: Column) -> Column:
    return lookup(trust_tier(title), R.TRUST_TIERS, 0.65)


def reach_trust_eligible(kind: Column, title: Column, views: Column, comments: Column) -> Column:
    ok = F.when(kind == "rss", trust_tier(title).isin("medium", "high"))
    for name, (least_views, least_comments) in R.REACH_FLOORS.items():
        ok = ok.when(kind == name, (F.coalesce(views, F.lit(0)) >= least_views) | (F.coalesce(comments, F.lit(0)) >= least_comments))
    return ok.otherwise(True)


def reliability_modifier(text: Column) -> Column:
    """First word of the fixed list that the source's text contains."""
    m = None
    for word, value in R.RELIABILITY_BY_WORD:
        hit = F.lower(text).contains(word)
        m = F.when(hit, F.lit(value)) if m is None else m.when(hit, F.lit(value))
    return m.otherwise(F.lit(1.0))


# Host words, in order, and the reliability of their pages.
HOST_RELIABILITY = [
    ([".gov", ".nic.in", "court", "judiciary"], 1.20),
    (["company", "corporate", "ir."], 1.10),
    (["reuters.com", "bloomberg.com", "cnbc.com", "nytimes.com", "wsj.com"], 1.00),
    (["reddit.com", "twitter.com", "facebook.com", "t.co"], 0.70),
    (["blog", "medium.com", "substack"], 0.85),
]


def url_reliability(url: Column) -> Column:
    """Reliability of a page by words of its host; 1.0 without a url."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    m = F.when(F.coalesce(url, F.lit("")) == "", 1.0)
    for words, value in HOST_RELIABILITY:
        hit = F.lit(False)
        for w in words:
            hit = hit | host.contains(w)
        m = m.when(hit, value)
    return m.otherwise(0.95)
