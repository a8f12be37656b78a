"""Text cleaning, keys and context windows as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Boilerplate, executive titles, legal suffixes, risk words.
BOILERPLATE = [
    r"(?i)this website uses cookies to ensure you get the best experience.*?\.",
    r"(?i)by continuing to browse the site you are agreeing to our use of cookies.*?\.",
    r"(?i)read our privacy policy.*?\.",
    r"(?i)all rights reserved\b.*?\bcopyright\b.*?\.",
    r"(?i)copyright © \d{4}.*?\.",
    r"(?i)share this article on (facebook|twitter|linkedin|reddit)",
    r"(?i)subscribe to our newsletter for more updates.*?\.",
    r"(?i)advertisement\b",
    r"(?i)click here to read more.*?\.",
]
TITLE_FORMS = [
    (r"\b(?:managing\s+director\s+&\s+)?chief\s+executive\s+officer\b", "CEO"), (r"\bmanaging\s+director\s+and\s+ceo\b", "CEO"),
    (r"\bmanaging\s+director\b", "MD"), (r"\bchief\s+technology\s+officer\b", "CTO"), (r"\bchief\s+operating\s+officer\b", "COO"),
    (r"\bco[- ]founder\b", "FOUNDER"), (r"\bchief\s+financial\s+officer\b", "CFO"), (r"\bchief\s+risk\s+officer\b", "CRO"),
    (r"\bchief\s+revenue\s+officer\b", "CRO"), (r"\bchief\s+marketing\s+officer\b", "CMO"), (r"\bchief\s+product\s+officer\b", "CPO"),
    (r"\bchief\s+people\s+officer\b", "CPO"), (r"\bexecutive\s+vice\s+president\b", "EVP"), (r"\bsenior\s+vice\s+president\b", "SVP"),
    (r"\bvice\s+president\b", "VP"),
]
LEGAL_SUFFIX = r"(?i)(?:[\s,]+(?:inc|incorporated|corp|corporation|co|company|ltd|limited|llc|plc|pvt|private|group|holdings|ag|sa|gmbh)\.?)+$"
# Pure legal forms, dropped from the end of a name where press copy leaves them out.
LEGAL_WORDS = "limited ltd pvt private inc incorporated llc llp corporation corp co plc enterprises company".split()
PLACEHOLDERS = re.compile(r"content content content|bench content text|\s*$|\s*<a href", re.IGNORECASE)
LEAST_CHARS = 20


def canonical_url(url: Column) -> Column:
    """Without query and fragment; null is empty."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)[?#].*$", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the content; empty stays empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.sha2(text, 256))


_TAG = re.compile(r"<!--.*?-->|<[^>]*>", re.S)
_GREY_FONT = re.compile(r"<font\b[^>]*\bcolor\s*=\s*[\"']?\s*#6f6f6f[^>]*>.*?</font>", re.S | re.I)
_CHROME_LINK = re.compile(r"<a\b[^>]*>\s*(?:<[^>]*>\s*)*(?:read full article|comments)\s*(?:<[^>]*>\s*)*</a>", re.S | re.I)


def clean_one(text: str | None) -> str:
    """Markup, outlet tags and chrome links removed, spaces collapsed; placeholders and short texts become empty."""
    if not text:
        return ""
    bare = _CHROME_LINK.sub(" ", _GREY_FONT.sub(" ", text))
    out = " ".join(html.unescape(_TAG.sub(" ", bare)).split())
    return "" if PLACEHOLDERS.match(out) or len(out) < LEAST_CHARS else out


@F.pandas_udf(StringType())
def clean_document(texts: pd.Series) -> pd.Series:
    return texts.map(clean_one)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def without_boilerplate(text: Column) -> Column:
    for p in BOILERPLATE:
        text = F.regexp_replace(text, p, " ")
    return text


def tidy_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n+", "\n"))


def executive_titles(text: Column) -> Column:
    for p, short in TITLE_FORMS:
        text = F.regexp_replace(text, f"(?i){p}", short)
    return text


def high_value_segments(title: Column, text: Column, words: list[str]) -> Column:
    """Title, two lead paragraphs, up to four that hold a word, and three more if little was found; cut at a sentence."""
    paragraphs = F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda p: p != "")
    later = F.slice(paragraphs, 3, 10_000_000)
    hit = lambda p: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(p), w))
    head = F.when(F.trim(title) != "", F.array(F.concat(F.lit("Title: "), F.trim(title)))).otherwise(F.array().cast("array<string>"))
    parts = F.array_distinct(F.concat(head, F.slice(paragraphs, 1, 2), F.slice(F.filter(later, hit), 1, 4)))
    parts = F.when(F.size(parts) <= 3, F.array_distinct(F.concat(parts, F.slice(later, 1, 3)))).otherwise(parts)
    whole = F.array_join(parts, "\n\n")
    cut = F.substring(whole, 1, 2000)
    sentence = F.regexp_extract(cut, r"(?s)^(.*[.?!])", 1)
    return F.when(F.length(whole) <= 2048, whole).when(F.length(sentence) > 1001, sentence).otherwise(F.concat(cut, F.lit("...")))


def strip_legal_suffix(name: Column) -> Column:
    """Name without trailing legal words; null if unchanged or under four characters."""
    short = F.trim(F.regexp_replace(name, LEGAL_SUFFIX, ""))
    return F.when((short != name) & (F.length(short) >= 4), short)


def without_legal_words(name: Column) -> Column:
    """Name without its trailing LEGAL_WORDS, whatever punctuation they carry; null if unchanged or under four characters."""
    word = r"\W*(?:" + "|".join(r"\W*".join(w) for w in LEGAL_WORDS) + r")\W*"
    kept = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), rf"(?iU)(?:(?:^|(?<=\s)){word}(?:\s|$))+$", "")
    short = F.regexp_replace(kept, r"^[ ,.&-]+|[ ,.&-]+$", "")
    return F.when((short != F.trim(name)) & (F.length(short) >= 4), short)


def entity_key(name: Column) -> Column:
    """Comparison key of a name: lower case, no possessive, no trailing punctuation or legal words."""
    n = F.regexp_replace(F.lower(F.trim(name)), r"['’]s\b", "")
    n = F.regexp_replace(n, r"[\s.,;:!?]+$", "")
    return F.trim(F.regexp_replace(n, LEGAL_SUFFIX, ""))


def context_window(text: Column, word: Column, size: int) -> Column:
    """Text around the first occurrence of a word, else the head."""
    at = F.instr(F.lower(text), F.lower(word))
    start = F.greatest(at - size, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at - start + F.length(word) + size)).otherwise(F.substring(text, 1, 2 * size))


def supporting_sentence(text: Column, words: Column) -> Column:
    """First sentence with one of the words, else the first sentence."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    hit = F.filter(sentences, lambda s: F.exists(words, lambda w: F.contains(F.lower(s), w)))
    return F.coalesce(F.get(hit, F.lit(0)), F.get(sentences, F.lit(0)))


def short_answer(text: Column, most: int = 320) -> Column:
    """Plain digest of a markdown answer, cut at a sentence end."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_#`>|]+", "")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    cut = F.substring(plain, 1, most)
    sentence = F.regexp_extract(cut, r"^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(plain) <= most, plain).when(sentence != "", sentence).otherwise(F.concat(F.trim(cut), F.lit("…")))
