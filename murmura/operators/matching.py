"""Keyword matching, match confidence and accepted mentions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import without_legal_words
from murmura.operators.automaton import Keywords, of_worker

# Match confidence.
BUSINESS_WORDS = ["company", "corp", "inc", "ltd", "stock", "shares", "nasdaq", "nyse", "quarter", "revenue", "earnings"]
OWN_CONTEXT_RULE = ["tesla", "meta", "tata"]
SHORT_ALIASES = ["fsd", "tsla"]
ACCEPT, AMBIGUOUS_GAP, HALF_WINDOW = 0.60, 0.15, 75
#: Tracked keywords that travel to the tasks (some 100 bytes each).
MOST_KEYWORDS = 1_000_000


def lower_with_places(text: str) -> tuple[str, list[int] | None]:
    """Lower-case text and, where lower-casing changes lengths, the place in ``text`` of each of its characters."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    places = [i for i, c in enumerate(text) for _ in c.lower()]
    return "".join(c.lower() for c in text), [*places, len(text)]


def keyword_spans(docs: DataFrame, keywords: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keyword, start_idx, end_idx, context (lower-case text around the match): leftmost-longest, non-overlapping,
    case-insensitive whole-word matches.

    Words are runs of a-z, digits and underscores; any other character bounds them, and a keyword that begins with one (an
    accented letter, another script) is sought wherever that character stands. Offsets count in the text as it is. The
    roster, at most MOST_KEYWORDS, is broadcast once and compiled once a worker; a text is read once whatever the roster's
    size, and stays where it is."""
    if len(keywords) > MOST_KEYWORDS:
        raise ValueError(f"{len(keywords)} keywords: match them in parts of {MOST_KEYWORDS}")
    roster = docs.sparkSession.sparkContext.broadcast(sorted({k.lower() for k in keywords if k}))
    kind, name = docs.schema[key].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = of_worker(Keywords, name, roster.value)
        for b in batches:
            ids, words, starts, ends, around = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low, places = lower_with_places(t or "")
                for at, end, k in known.spans(low):
                    ids.append(i), words.append(k)
                    starts.append(places[at] if places else at), ends.append(places[end] if places else end)
                    around.append(low[max(0, at - HALF_WINDOW) : end + HALF_WINDOW])
            cols = [pa.array(ids, b.column(0).type), pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(around, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "keyword", "start_idx", "end_idx", "context"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, keyword string, start_idx int, end_idx int, context string")


def with_owners(spans: DataFrame, roster: DataFrame) -> DataFrame:
    """Every owner of each matched keyword (roster: keyword, entity_id, client_id, category, priority)."""
    return spans.join(roster, "keyword")


def entity_context(pairs: DataFrame) -> DataFrame:
    """Flags of each (document, entity) in ``pairs``, a row of which has the text and the entity's domain, industry,
    executive_terms and product_terms (lower case, may be null): what the document says about the entity anywhere."""
    rows = pairs.withColumn("_low", F.lower("text"))
    has = lambda c: F.coalesce(F.contains("_low", F.lower(c)), F.lit(False))
    any_of = lambda c: F.coalesce(F.exists(c, lambda t: F.contains(F.col("_low"), t)), F.lit(False))
    name = F.lower(F.coalesce("entity_name", F.lit("")))
    negative = (name.contains("meta") & F.col("_low").rlike(r"\bmeta-(analysis|description|programming|review)\b|\bmeta tag\b")) | (name.contains("tesla") & F.contains("_low", F.lit("tesla coil")))
    return rows.withColumns(
        {
            "has_domain": has(F.col("domain")), "has_industry": has(F.col("industry")), "has_executive": any_of(F.col("executive_terms")),
            "has_product": any_of(F.col("product_terms")), "negative_context": negative,
        }
    ).drop("_low", "text", "domain", "industry", "executive_terms", "product_terms")


def match_confidence(matches: DataFrame) -> DataFrame:
    """Adds confidence, accepted, bonuses and penalties to matches with entity_name, category and entity_context flags."""
    word, name = F.lower("keyword"), F.lower(F.coalesce("entity_name", F.lit("")))
    generic = ~word.isin(OWN_CONTEXT_RULE) & ((F.length("keyword") <= 4) | word.isin(SHORT_ALIASES))
    base = F.when(F.col("category") == "PRIMARY", 0.85).when(word == name, 0.75).when(~generic, 0.70).otherwise(0.40)
    near = F.col("context").rlike("|".join(BUSINESS_WORDS))
    domain, executive, product = F.col("has_domain"), F.col("has_executive"), F.col("has_product")
    step = lambda hit, kind, value: F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(value).alias("value")))
    bonuses = F.array_compact(F.array(step(domain, "domain", 0.25), step(executive, "executive", 0.20), step(product, "product", 0.20), step(F.col("has_industry"), "industry", 0.10), step(near, "nearby", 0.15)))
    penalties = F.array_compact(F.array(step(F.col("negative_context"), "negative_context", -0.50), step(generic & ~(executive | product | domain), "risky_alias", -0.30)))
    total = F.aggregate(F.concat("bonuses", "penalties"), F.col("base"), lambda s, x: s + x["value"])
    rows = matches.withColumns({"base": base.cast("double"), "bonuses": bonuses, "penalties": penalties})
    rows = rows.withColumn("confidence", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 2))
    return rows.withColumn("accepted", F.col("confidence") >= ACCEPT).drop("base")


def resolve_ambiguity(matches: DataFrame, doc: str = "doc_id") -> DataFrame:
    """status: ambiguous for every candidate of a span whose best two confidences lie close together."""
    w = Window.partitionBy(doc, "start_idx", "end_idx")
    second = F.nth_value("confidence", 2).over(w.orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    close = F.max("confidence").over(w) - second <= AMBIGUOUS_GAP + 1e-9
    status = F.when(F.coalesce(close, F.lit(False)), "ambiguous").when(F.col("accepted"), "accepted").otherwise("rejected")
    return matches.withColumn("status", status)


def best_match_per_entity(matches: DataFrame, doc: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(doc, "entity_id").orderBy(F.desc("confidence"), "start_idx", "keyword")
    return matches.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def document_state(matches: DataFrame, doc: str = "doc_id") -> DataFrame:
    return matches.groupBy(doc).agg(
        F.when(F.bool_or(F.col("status") == "accepted"), "MATCHED").when(F.bool_or(F.col("status") == "ambiguous"), "AMBIGUOUS").otherwise("SKIPPED").alias("state")
    )


def accepted_mentions(matches: DataFrame, doc: str = "doc_id") -> DataFrame:
    """First accepted match of each entity in a document, with the number of its matches."""
    ok = matches.where("status = 'accepted'")
    return ok.groupBy(doc, "entity_id").agg(F.min("start_idx").alias("first_at"), F.count("*").alias("mention_count"))


# Priorities and risk words of generated keywords, trailing legal words.
KEYWORD_PRIORITY = {"PRIMARY": 10, "LOWER": 5, "JOINED": 5, "STRIPPED": 8, "EXECUTIVE": 7, "RISK": 9}
KEYWORD_RISKS = ["lawsuit", "scandal", "fraud", "bankruptcy"]


def generated_keywords(entities: DataFrame) -> DataFrame:
    """entity_id, keyword, category, priority of the keywords that each entity's name makes.

    The name; as aliases its lower-case form, its form without spaces, and without trailing legal words (that one also without
    spaces), each where no earlier form equals it; the head of the firm; the name with each risk word."""
    name, none = F.col("entity_name"), F.lit(None).cast("string")
    low, joined, bare = F.lower(name), F.replace(name, F.lit(" "), F.lit("")), without_legal_words(name)
    aliases = [
        ("LOWER", F.when(low != name, low)), ("JOINED", F.when(name.contains(" ") & (joined != low), joined)), ("STRIPPED", bare),
        ("STRIPPED", F.when(bare.contains(" "), F.replace(bare, F.lit(" "), F.lit("")))),
    ]
    row = lambda text, kind, step: F.struct(text.alias("keyword"), F.lit(kind).alias("category"), F.lit(KEYWORD_PRIORITY[step]).alias("priority"))
    own = F.array(row(name, "PRIMARY", "PRIMARY"), *(row(F.coalesce(c, none), "ALIAS", step) for step, c in aliases))
    own = F.filter(own, lambda k: k["keyword"].isNotNull())
    first = F.filter(own, lambda k, i: ~F.exists(F.slice(own, F.lit(1), i), lambda e: e["keyword"] == k["keyword"]))
    more = F.array(row(F.concat(F.lit("CEO of "), name), "EXECUTIVE", "EXECUTIVE"), *(row(F.concat(name, F.lit(f" {w}")), "RISK", "RISK") for w in KEYWORD_RISKS))
    named = entities.where(name.isNotNull())
    return named.select("entity_id", F.explode(F.concat(first, more)).alias("k")).select("entity_id", "k.*")


def phrase_hits(text_form: Column, terms: Column) -> Column:
    """Terms (padded phrase forms) that the padded text contains."""
    return F.filter(terms, lambda t: F.contains(text_form, t))
