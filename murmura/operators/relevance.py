"""Relevance of collected items by rules over one set of phrase hits, and risk words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.common import phrase_form
from murmura.functions.text import without_legal_words
from murmura.operators.automaton import Phrases, of_worker
from murmura.operators.matching import MOST_KEYWORDS

# Words that mark a risk; words of context that a bare alias needs where a client names none.
RISK_WORDS = ["complaint", "RERA", "court", "refund", "fraud", "probe", "lawsuit", "protest"]
ALIAS_CONTEXT = [
    "limited", "ltd", "pvt", "private limited", "nse", "bse", "rera", "sebi", "india", "indian", "crore", "lakh",
    "stock", "shares", "share price", "dividend", "q1", "q2", "q3", "q4", "fy",
    "bengaluru", "bangalore", "mumbai", "delhi", "ncr", "gurugram", "gurgaon", "noida", "pune", "chennai", "hyderabad",
    "kolkata", "kochi", "kerala", "thrissur", "coimbatore", "karnataka", "maharashtra", "tamil nadu", "gujarat",
]
_NOT_WORD = re.compile(r"[\W_]+")


def normal_form(text: str | None) -> str:
    """Lower case, runs of other characters than letters and digits as one space, a space at both ends."""
    return f" {_NOT_WORD.sub(' ', (text or '').lower()).strip()} "


def term_hits(docs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, term, in_title of every distinct term of ``terms`` (term, a phrase) that a document's title or content holds
    as whole words.

    All terms of all clients are found in one pass over each text; they are at most MOST_KEYWORDS, compiled once a worker."""
    known = terms.select("term").where("term IS NOT NULL").distinct().limit(MOST_KEYWORDS + 1).toArrow()["term"].to_pylist()
    if len(known) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} terms: find them in parts")
    by_form: dict[str, list[str]] = {}
    for t in known:
        if form := normal_form(t).strip():
            by_form.setdefault(form, []).append(t)
    roster = docs.sparkSession.sparkContext.broadcast(by_form)
    kind, name = docs.schema[key].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = of_worker(Phrases, name, list(roster.value))
        for b in batches:
            ids, found, titles = [], [], []
            for i, title, content in zip(*(c.to_pylist() for c in b.columns)):
                head = phrases.held(normal_form(title))
                for form in head | phrases.held(normal_form(content)):
                    for t in roster.value[form]:
                        ids.append(i), found.append(t), titles.append(form in head)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(found, pa.string()), pa.array(titles, pa.bool_())], names=[key, "term", "in_title"])

    return docs.select(key, "title", "content").mapInArrow(run, f"{key} {kind}, term string, in_title boolean")


def relevant(docs: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, client_id) of the documents (key, title, content, source) that are relevant to a client.

    ``rules`` (client_id, term, kind) is the rule table. A term of kind full makes a document relevant. A bare one needs a
    context term besides: from YouTube, in the title and with no exclude term anywhere; elsewhere anywhere."""
    # Tasks reduce hits to one row for each document and client before the shuffle.
    hits = term_hits(docs, rules, key).join(rules.where("term IS NOT NULL").distinct(), "term")
    any_of = lambda kind, more=F.lit(True): F.bool_or((F.col("kind") == kind) & more)
    per = hits.groupBy(key, "client_id").agg(
        any_of("full").alias("full"), any_of("bare").alias("bare"), any_of("context").alias("context"), any_of("context", F.col("in_title")).alias("title_context"), any_of("exclude").alias("excluded")
    )
    youtube = F.lower(F.coalesce("source", F.lit(""))) == "youtube"
    by_alias = F.when(youtube, F.col("title_context") & ~F.col("excluded")).otherwise(F.col("context"))
    met = per.where("full OR bare").join(docs.select(key, "source"), key).where(F.col("full") | by_alias)
    return met.select(key, "client_id").distinct()


def relevance_rules(entities: DataFrame, terms: DataFrame, settings: DataFrame, *, kinds: tuple[str, ...] = ("brand", "person")) -> DataFrame:
    """client_id, term (in normal form), kind of every client's rules.

    ``terms`` (entity_id, term) are the names, aliases and PRIMARY and ALIAS keywords of entities (client_id, entity_id,
    entity_name, entity_type); those of ``kinds`` with three letters or more count. A term that is a name of the client
    without its legal words is bare, others are full. ``settings`` (client_id, context, exclude: array<string>) replaces a
    client's context words (null: ALIAS_CONTEXT) and adds exclude terms."""
    form = lambda c: F.trim(phrase_form(c))
    counted = entities.where(F.lower("entity_type").isin(*kinds)).select("client_id", "entity_id")
    own = terms.where(F.length(F.trim("term")) >= 3).join(counted, "entity_id").select("client_id", form(F.col("term")).alias("term")).where("term <> ''").distinct()
    clean = without_legal_words(F.col("entity_name"))
    bare = entities.select("client_id", F.explode(F.array(form(clean), form(F.replace(clean, F.lit(" "), F.lit(""))))).alias("term")).where("term IS NOT NULL").distinct()
    named = own.join(bare.withColumn("kind", F.lit("bare")), ["client_id", "term"], "left").withColumn("kind", F.coalesce("kind", F.lit("full")))
    clients = entities.select("client_id").distinct().join(settings, "client_id", "left")
    of = lambda words, kind: clients.select("client_id", F.explode(words).alias("term")).select("client_id", form(F.col("term")).alias("term"), F.lit(kind).alias("kind")).where("term <> ''")
    context = of(F.coalesce("context", F.array(*map(F.lit, ALIAS_CONTEXT))), "context")
    return named.unionByName(context).unionByName(of(F.col("exclude"), "exclude")).distinct()


def has_risk_word(title: Column, content: Column) -> Column:
    """Whether a risk word stands in title or content as a whole word; nulls are empty."""
    form = F.concat(phrase_form(F.coalesce(title, F.lit(""))), phrase_form(F.coalesce(content, F.lit(""))))
    return form.rlike(f" (?:{'|'.join(w.lower() for w in RISK_WORDS)}) ")


def mentions_phrase(phrase: str, fields: list[Column]) -> Column:
    """Whether a field holds the phrase as whole words; each field by itself. An empty phrase holds everywhere."""
    form = normal_form(phrase)
    if not form.strip():
        return F.lit(True)
    held = F.lit(False)
    for f in fields:
        held = held | F.coalesce(F.contains(phrase_form(f), F.lit(form)), F.lit(False))
    return held
