"""Validity of discovered person and company names, evidence by proximity, and text grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.jsons import stripped_json
from murmura.functions.text import entity_key

# Words of the name rules.
PARTICLES = ["de", "del", "du", "la", "von", "van", "der", "di", "da"]
NAME_SUFFIXES = ["jr", "jr.", "sr", "sr.", "iii", "iv", "v", "ii", "esq", "phd", "md"]
PUBLISHER_WORDS = [
    "reuters", "bloomberg", "cnbc", "yahoo", "finance", "electrek", "marketwatch", "barron", "barrons", "fool", "motley", "forbes", "inc",
    "corp", "co", "news", "wall", "street", "journal", "times", "post", "globe", "mail", "tv", "press", "media", "alpha", "seeking",
    "zacks", "benzinga", "thestreet", "market", "wire", "pr", "newswire",
]
PRODUCT_WORDS = [
    "tesla", "cybertruck", "roadster", "fsd", "autopilot", "optimus", "supercharger", "megapack", "iphone", "ipad", "macbook", "pepsi",
    "coke", "coca-cola", "product", "software", "hardware", "battery", "batteries", "charger", "chargers", "vehicle", "vehicles",
    "automaker", "automakers", "car", "cars", "model", "semi",
]
GENERIC_TERMS = [
    "linkedin", "reuters", "bloomberg", "msn", "businessline", "techcrunch", "moneycontrol.com", "ndtv", "the times of india",
    "hindustan times", "economic times", "et auto", "autocar", "autocar professional", "autocar india", "cardekho", "carlelo",
    "autopunditz", "motley fool", "seeking alpha", "barron", "barrons", "cnbc", "bbc", "cnn", "espn", "yahoo finance", "yahoo", "forbes",
    "wsj", "wall street journal", "business insider", "business standard", "value research", "infoworld", "thestreet", "marketwatch",
    "zacks", "benzinga", "the new stack", "mit technology review", "daily sabah", "sec", "ipo", "ai", "cpu", "gpu", "llm", "super", "rgb",
    "yoy", "bee", "cev", "ev", "cto", "cfo", "coo", "eps", "ebitda", "roi", "qoq", "pr newswire", "globe newswire", "businesswire", "pr",
    "marketbeat", "cleantechnica", "electrek", "the verge", "wired", "techradar", "venturebeat", "engadget", "gizmodo", "mashable",
    "ars technica", "arstechnica", "9to5mac", "9to5google", "statistics indexbox", "indexbox", "statista", "gurufocus",
    "britannica money", "britannica", "newsroom",
]
KNOWN_COMPANIES = ["microsoft", "google", "amazon", "uco bank", "softbank", "infosys", "tcs", "wipro"]
LEGAL_WORDS = [
    "inc", "inc.", "corp", "corp.", "corporation", "ltd", "ltd.", "limited", "llc", "llc.", "plc", "gmbh", "ag", "sa", "nv", "bv", "co",
    "co.", "company", "holdings", "group",
]
CORPORATE_NOUNS = [
    "beverages", "industries", "motors", "systems", "technologies", "enterprises", "partners", "solutions", "labs", "foods", "chemicals",
    "energy", "international", "financial", "capital", "ventures", "consulting", "pharmaceuticals",
]
PLACEHOLDER_WORDS = ["example", "sample", "placeholder", "dummy", "lorem", "ipsum", "acme", "foo", "bar", "baz", "n/a", "tbd"]
MEDIA_WORDS = [
    "times", "news", "post", "press", "media", "journal", "daily", "weekly", "magazine", "wire", "digest", "briefing", "insider", "watch",
    "report", "beat", "fool", "alpha", "seeking", "cramer", "street",
]
MARKET_WORDS = [
    "shares", "share", "stock", "stocks", "ticker", "index", "indices", "etf", "etfs", "adr", "futures", "options", "dividend",
    "dividends", "earnings", "premarket", "aftermarket", "holdings",
]
EXCHANGES = [
    "nasdaq", "nyse", "amex", "dow jones", "dow", "s&p", "sp500", "ftse", "nikkei", "hang seng", "nifty", "sensex", "bse", "nse", "sebi",
    "ntsb", "nhtsa", "sec", "fdic", "fed", "niti", "faa", "epa", "doe", "doj", "ftc",
]
PRICE = r"(?i)^[A-Za-z]{0,3}[$€£¥₹]\s?\d[\d,]*(\.\d+)?$|^(USD|EUR|GBP|INR|HKD|JPY|CNY|AUD|CAD)\s?\d[\d,]*(\.\d+)?$"
MARKUP = r"^https?://|%[0-9A-F]{2}|<[^>]+>"
DOMAIN = r"\.(com|co|net|org|io|in|uk)$"
CONNECTIVES = ["of", "and", "for", "the", "de", "du", "van", "von", "da"]
GUARD_ROLE_WORDS = [
    "ceo", "cfo", "coo", "md", "managing director", "chief executive", "chief financial", "chairman", "chairperson", "chairwoman", "chair",
    "promoter", "founder", "co founder", "cofounder", "director", "president", "executive",
]
ROLE_SYNONYMS = {
    "chairperson": ["chairperson", "chairman", "chairwoman", "chair of the board"],
    "md_ceo": ["managing director", "chief executive officer", "ceo", "md ceo", "md and ceo"],
    "cfo": ["chief financial officer", "cfo", "finance director", "director finance"],
    "founder": ["founder", "co founder", "cofounder", "promoter"],
}
OWNER_PHRASES = ["wholly owned subsidiary of", "wholly owned by", "wholly owned", "subsidiary of", "owned by", "acquired by"]
PROMOTION_ROLES = (
    r"(?i)\b(ceo|cfo|coo|cto|cmo|cio|(?-i:MD)|dgm|agm|svp|evp|vp|president|chairman|chairperson|"
    r"chairwoman|director|founder|co-founder|promoter|chief|executive|managing|head of)\b"
)


def _any_of(words: Column, known: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, known)))


def _in(c: Column, known: list[str]) -> Column:
    return c.isin(*known)


def word_form(c: Column) -> Column:
    """The runs of [a-z0-9] of a lower-cased text, each between spaces."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " "), F.lit(" "))


def _own(low: Column, terms: Column) -> Column:
    """True if a lower-cased name equals a term, begins with one as a word, or is the leading or holds it as trailing words."""
    return F.coalesce(
        F.exists(
            terms,
            lambda t: (low == t)
            | low.startswith(F.concat(t, F.lit(" ")))
            | ((F.length(low) >= 4) & t.startswith(F.concat(low, F.lit(" "))))
            | ((F.length(t) >= 4) & low.endswith(F.concat(F.lit(" "), t))),
        ),
        F.lit(False),
    )


def person_name(name: Column, own: Column | None = None) -> tuple[Column, Column]:
    """(valid, first layer that failed) of a person name; ``own``: the client's own terms in lower case.

    Parts are split at white space and commas, and at hyphens within; particles stand between other parts, suffixes last."""
    clean = F.trim(F.coalesce(name, F.lit("")))
    parts = F.filter(F.split(clean, r"[\s,]+"), lambda p: p != "")
    low = F.transform(parts, lambda p: F.regexp_replace(F.lower(p), r"[.,]+$", ""))

    def fault(sub: Column, i: Column, n: Column) -> Column:
        known = (_in(F.lower(sub), PARTICLES) & (i > 0) & (i < n - 1)) | (_in(F.lower(sub), NAME_SUFFIXES) & (i == n - 1)) | sub.rlike(r"^\p{Lu}$")
        bad = F.when(sub == "", "hyphen").when(known, None).when(sub.rlike(r"^\p{L}") & ~sub.rlike(r"^\p{Lu}"), "case")
        return bad.when(~F.regexp_replace(sub, r"['.\-]", "").rlike(r"^\p{L}+$"), "characters")

    of_part = lambda p, i: F.when(F.regexp_replace(p, r"[.,]+$", "") != "", F.transform(F.split(F.regexp_replace(p, r"[.,]+$", ""), "-"), lambda sub: fault(sub, i, F.size(parts))))
    faults = F.array_compact(F.flatten(F.transform(parts, lambda p, i: F.coalesce(of_part(p, i), F.array().cast("array<string>")))))
    layer = F.when((F.length(clean) < 2) | (F.length(clean) > 100), "length").when(clean.rlike(MARKUP), "markup").when(clean.rlike(r"^[\-,;:/]|[\-,;:/]$"), "punctuation")
    layer = layer.when((F.size(parts) < 2) | (F.size(parts) > 5), "parts").when(F.size(faults) > 0, F.get(faults, F.lit(0)))
    layer = layer.when(_any_of(low, PUBLISHER_WORDS), "publisher").when(_any_of(low, PRODUCT_WORDS), "product").when(_any_of(low, GENERIC_TERMS + KNOWN_COMPANIES), "generic")
    layer = layer.when(_any_of(low, LEGAL_WORDS + CORPORATE_NOUNS), "corporate")
    if own is not None:
        whole = F.lower(clean)
        layer = layer.when(F.coalesce(F.exists(own, lambda t: (whole == t) | whole.startswith(F.concat(t, F.lit(" ")))), F.lit(False)), "self reference")
    return layer.isNull(), layer


def company_name(name: Column, own: Column) -> tuple[Column, Column]:
    """(valid, first layer that failed) of a company name; ``own``: the client's own terms in lower case."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    low = entity_key(raw)
    tokens = F.filter(F.split(raw, r"\s+"), lambda t: t != "")
    words = F.filter(F.split(low, r"[\s,.\-]+"), lambda w: w != "")
    marks = F.transform(F.split(F.lower(raw), r"[\s,.\-]+"), lambda w: F.regexp_replace(w, r"[.,]+$", ""))
    letters = F.regexp_replace(raw, "[^A-Za-z]", "")
    short = (F.length(low) <= 3) & ~((F.length(letters) >= 2) & ((letters == F.upper(letters)) | (letters == F.initcap(F.lower(letters)))))
    layer = F.when((low == "") | raw.rlike(MARKUP) | (F.length(raw) > 120), "shape").when(raw.rlike(r"('s|’s|s')$"), "possessive").when(low.rlike(DOMAIN), "domain")
    layer = layer.when(F.size(tokens) > 4, "words").when(_in(low, LEGAL_WORDS), "legal form")
    layer = layer.when(F.exists(tokens, lambda t: F.regexp_replace(F.lower(t), r"^[.,]+|[.,]+$", "").rlike(r"^\d+(st|nd|rd|th)$")), "ordinal")
    layer = layer.when(short | ~low.rlike("[A-Za-z]"), "shape").when(_any_of(marks, PLACEHOLDER_WORDS), "placeholder").when(raw.rlike(PRICE), "price")
    layer = layer.when(_own(low, own), "self reference").when(_any_of(words, MEDIA_WORDS), "media").when(_in(low, EXCHANGES), "exchange")
    layer = layer.when(_any_of(words, MARKET_WORDS), "market")
    layer = layer.when(_in(low, GENERIC_TERMS) | _any_of(F.filter(words, lambda w: F.length(w) >= 4), GENERIC_TERMS), "generic")
    return layer.isNull(), layer


def company_confidence(name: Column) -> Column:
    """Confidence of a company candidate from the shape of its name."""
    clean = F.trim(F.coalesce(name, F.lit("")))
    tokens = F.filter(F.split(clean, r"\s+"), lambda t: t != "")
    ends = _in(F.regexp_replace(F.lower(F.element_at(tokens, -1)), r",+$", ""), LEGAL_WORDS) & (F.size(tokens) >= 2)
    shaped = F.forall(F.filter(tokens, lambda t: t.rlike(r"^\p{L}")), lambda t: t.rlike(r"^\p{Lu}") | _in(F.lower(t), CONNECTIVES))
    c = F.lit(0.70) + F.when(ends, 0.10).otherwise(0.0) + F.when(shaped, 0.05).otherwise(-0.15)
    c = c - F.when(F.size(tokens) >= 4, 0.15).when(F.size(tokens) == 3, 0.05).otherwise(0.0)
    c = c - F.when(clean.rlike(r"\d"), 0.10).otherwise(0.0) - F.when(clean.rlike("['’]"), 0.10).otherwise(0.0)
    return F.when(clean == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(c, 4))))


def near_role(text: Column, name: Column, roles: list[str] = GUARD_ROLE_WORDS, most: int = 300) -> Column:
    """True if a role phrase stands with the full name on the page, within ``most`` characters of any occurrence."""
    needle = word_form(name)
    pieces = F.split(word_form(text), F.concat(F.lit(r"\Q "), F.trim(needle), F.lit(r"\E(?= )")))
    has = lambda t: F.exists(F.array(*(F.lit(f" {r} ") for r in roles)), lambda r: F.contains(t, r))
    before = F.exists(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: has(F.concat(F.right(p, F.lit(most)), F.lit(" "))))
    after = F.exists(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: has(F.left(p, F.lit(most + 1))))
    return F.when((F.size(pieces) > 1) & (F.trim(needle) != ""), before | after | has(needle)).otherwise(False)


def title_near_name(text: Column, name: Column, most: int = 100) -> Column:
    """True if a job title stands within ``most`` characters of any occurrence of the name, the name's own words aside."""
    pieces = F.split(text, F.concat(F.lit(r"(?i)\Q"), name, F.lit(r"\E")))
    n = F.size(pieces)
    before = F.transform(F.slice(pieces, 1, n - 1), lambda p, i: F.right(F.when(i > 0, F.concat(name, p)).otherwise(p), F.lit(most)))
    after = F.transform(F.slice(pieces, 2, F.greatest(n - 1, F.lit(0))), lambda p, i: F.left(F.when(i < n - 2, F.concat(p, name)).otherwise(p), F.lit(most)))
    found = F.exists(F.zip_with(before, after, lambda b, a: F.concat_ws(" | ", b, a)), lambda c: c.rlike(PROMOTION_ROLES))
    return F.coalesce(F.when((F.coalesce(name, F.lit("")) != "") & (n > 1), found), F.lit(False))


def ownership(text: Column, child: Column, parent: Column, most: int = 160) -> Column:
    """True if the text says that ``child`` is owned by ``parent``: an owner phrase with the one within ``most`` characters
    before it and the other within as many after it."""
    n, c, p = word_form(text), F.trim(word_form(child)), F.trim(word_form(parent))
    room = lambda taken, x: F.greatest(F.lit(most - taken) - F.length(x), F.lit(0)).cast("string")
    found = F.lit(False)
    for phrase in OWNER_PHRASES:
        left = F.concat(F.lit(" "), c, F.lit("(?= ).{0,"), room(1, c), F.lit(f"}} {phrase}(?= )"))
        found = found | F.regexp_like(n, F.concat(left, F.lit(".{0,"), room(3, p), F.lit("} "), p, F.lit(" ")))
    return F.coalesce(found & (c != "") & (p != ""), F.lit(False))


def grounded(answers: DataFrame, cited: DataFrame, least: int = 4) -> DataFrame:
    """answer_id, grounded: an answer shares a word of ``least`` letters with the records it cites; an empty one passes,
    one without records does not."""
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"(?U)\W+")), lambda w: F.length(w) >= least)
    said = answers.select("answer_id", "text", F.explode_outer(words("text")).alias("word"))
    held = cited.select("answer_id", F.explode(words("record")).alias("word")).distinct().withColumn("hit", F.lit(True))
    both = said.join(held, ["answer_id", "word"], "left")
    per = both.groupBy("answer_id").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("any"), F.bool_or(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))
    return per.select("answer_id", (F.col("any") | F.col("empty")).alias("grounded"))


def without_trend_keys(payload: Column) -> Column:
    """A JSON text without the entries whose key contains "trend", at any depth."""
    return stripped_json(payload, "trend")
