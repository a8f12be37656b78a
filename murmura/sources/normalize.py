"""Raw items of each collector as one record shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.common import phrase_form
from murmura.functions.text import clean_document

NORMALIZED = ["source_type", "title", "content", "url", "author", "published_at", "view_count", "comment_count"]

# Field names of the collectors' payloads.
SCHEMAS = {
    "rss": "title string, link string, author string, published_parsed array<int>, summary string, content array<struct<value:string>>",
    "gdelt": "title string, url string, seendate string",
    "hn": "title string, url string, objectID string, story_text string, author string, created_at string",
    "youtube": "id string, snippet struct<title:string,description:string,channelTitle:string,publishedAt:string>, statistics struct<viewCount:string,commentCount:string>",
    "instagram": "url string, caption string, ownerUsername string, timestamp string, commentsCount int, playCount int, videoPlayCount int, videoViewCount int",
    "reddit": "title string, body string, url string, username string, upVotes int, numberOfComments int, createdAt string",
}


def _row(kind: str, title: Column, content: Column, url: Column, author: Column | None, published: Column, views: Column | None = None, comments: Column | None = None) -> list[Column]:
    none = F.lit(None)
    values = [F.lit(kind), title, content, url, none.cast("string") if author is None else author, published]
    values += [(none if c is None else c).cast("int") for c in (views, comments)]
    return [v.alias(n) for v, n in zip(values, NORMALIZED)]


def _parsed(raw: DataFrame, kind: str) -> DataFrame:
    keep = [c for c in raw.columns if c != "payload"]
    return raw.select(*keep, F.from_json("payload", SCHEMAS[kind]).alias("p")).select(*keep, "p.*")


def _iso(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, r"(\.\d+)?Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def normalize_rss(raw: DataFrame, keep: list[str]) -> DataFrame:
    p = _parsed(raw, "rss")
    t = [F.get("published_parsed", F.lit(i)) for i in range(6)]
    at = F.try_make_timestamp(*t[:5], t[5].cast("double"))
    body = F.coalesce(F.get("content", F.lit(0))["value"], F.col("summary"), F.lit(""))
    return p.select(*keep, *_row("rss", F.col("title"), clean_document(body), F.col("link"), F.col("author"), at))


def normalize_gdelt(raw: DataFrame, keep: list[str]) -> DataFrame:
    at = F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return _parsed(raw, "gdelt").select(*keep, *_row("gdelt", F.col("title"), F.col("title"), F.col("url"), None, at))


def normalize_hn(raw: DataFrame, keep: list[str]) -> DataFrame:
    url = F.coalesce("url", F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID"))
    return _parsed(raw, "hn").select(*keep, *_row("hn_algolia", F.col("title"), F.coalesce("story_text", "title"), url, F.col("author"), _iso(F.col("created_at"))))


def normalize_youtube(raw: DataFrame, keep: list[str]) -> DataFrame:
    views, comments = (F.col(f"statistics.{c}").try_cast("int") for c in ("viewCount", "commentCount"))
    said = F.concat(F.col("snippet.title"), F.lit("\nViews: "), F.format_number(F.coalesce(views, F.lit(0)), 0), F.lit("\n"), F.coalesce(F.col("snippet.description"), F.lit("")))
    row = _row("youtube", F.col("snippet.title"), said, F.concat(F.lit("https://youtu.be/"), "id"), F.col("snippet.channelTitle"), _iso(F.col("snippet.publishedAt")), views, comments)
    return _parsed(raw, "youtube").select(*keep, *row)


def normalize_instagram(raw: DataFrame, keep: list[str]) -> DataFrame:
    text = F.coalesce("caption", F.lit(""))
    title = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text)
    views = F.coalesce("playCount", "videoPlayCount", "videoViewCount")
    row = _row("instagram", title, text, F.col("url"), F.col("ownerUsername"), _iso(F.col("timestamp")), views, F.col("commentsCount"))
    return _parsed(raw, "instagram").select(*keep, *row)


def normalize_reddit(raw: DataFrame, keep: list[str], phrase: str | None = None) -> DataFrame:
    p = _parsed(raw, "reddit")
    if phrase:
        p = p.where(F.contains(phrase_form(F.concat_ws(" ", "title", "body", "url")), F.lit(f" {phrase.lower()} ")))
    row = _row("reddit", F.col("title"), F.coalesce("body", F.lit("")), F.col("url"), F.col("username"), _iso(F.col("createdAt")), F.col("upVotes"), F.col("numberOfComments"))
    return p.select(*keep, *row)


NORMALIZERS = {
    "rss": normalize_rss, "gdelt": normalize_gdelt, "hn": normalize_hn, "youtube": normalize_youtube, "instagram": normalize_instagram,
    "reddit": normalize_reddit,
}


def dispatch(raw: DataFrame, keep: list[str]) -> DataFrame:
    """Mixed raw rows (source_format, payload, ...) normalised by their format; unknown formats are read as rss."""
    kind = F.coalesce("source_format", F.lit("rss"))
    kind = F.when(kind.isin(*NORMALIZERS), kind).otherwise("rss")
    parts = [f(raw.where(kind == k), keep) for k, f in NORMALIZERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
