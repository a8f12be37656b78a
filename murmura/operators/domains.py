"""Reliability tiers of web hosts from one rule table, met by the suffixes of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura import rules as R

# Labels, second-level labels, official bodies, sites of users, and ratings not yet confirmed.
TIER_LABELS = {"high": "High", "medium": "Medium", "low": "Low", "official": "Official", "own": "Company", "user_generated": "User-generated", "unrated": "Unrated"}
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "nic", "ac", "edu"]
OFFICIAL_ENDS = ["gov.in", "nic.in", "gov"]
OFFICIAL_HOSTS = ["nseindia.com", "bseindia.com", "sebi.gov.in", "rbi.org.in", "mca.gov.in"]
USER_SITES = [
    "quora", "reddit", "youtube", "youtu", "facebook", "instagram", "twitter", "x", "linkedin", "medium", "pinterest",
    "tumblr", "blogspot", "wordpress", "substack", "consumercomplaints", "mouthshut", "trustpilot", "glassdoor",
    "ambitionbox", "complaintsboard", "pissedconsumer",
]
PROPOSED = {
    "timesofindia.indiatimes.com": "medium", "thehindubusinessline.com": "medium", "financialexpress.com": "medium", "cnbctv18.com": "medium",
    "theprint.in": "medium", "inc42.com": "medium", "livelaw.in": "medium", "livelawbiz.com": "medium", "barandbench.com": "medium",
    "businesstoday.in": "medium", "indiatoday.in": "medium",
}


def host_of(url: Column) -> Column:
    """Lower-case host of a url, or of a text that is a bare host, without port and leading www.; null if there is none."""
    whole = F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("//"), url))
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    return F.nullif(host, F.lit(""))


def registrable_label(host: Column) -> Column:
    """The name that a host is registered under: the label before its public suffix, of two labels in country domains."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    at = lambda k: F.try_element_at(parts, F.lit(-k))
    country = (n >= 3) & at(2).isin(*SECOND_LEVEL) & (F.length(at(1)) == 2)
    return F.when(country, at(3)).when(n >= 2, at(2)).otherwise(parts[0])


def _flat(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def tier_rules() -> list[tuple[str, str, bool, int]]:
    """(key, tier, proposed, place) of the fixed rules; the smallest place that a host meets decides. Keys: ``under:`` a host or
    what stands below it, ``below:`` only that, ``name:`` the registrable label, ``flat:`` the host's letters and digits."""
    flat = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    rules = [(f"below:{e}", "official", False, 1) for e in OFFICIAL_ENDS] + [(f"under:{h}", "official", False, 1) for h in OFFICIAL_HOSTS]
    rules += [(f"name:{n}", "user_generated", False, 4) for n in USER_SITES]
    for i, (outlet, tier) in enumerate(R.OUTLET_TIERS.items()):
        rules += [(key, tier, False, 10 + i) for key in [f"name:{flat(outlet)}", f"flat:{flat(outlet)}", *([f"below:{outlet}"] if "." in outlet else [])]]
    return rules + [(f"under:{h}", tier, True, 2000 + i) for i, (h, tier) in enumerate(PROPOSED.items())]


def domain_tiers(hosts: DataFrame) -> DataFrame:
    """host, client_name, tier, label, low_reliability, proposed of every distinct (host, client_name); null hosts are unrated.

    In order: official bodies, the client's own site (its name against the registrable label; only its first word: proposed), sites of
    users, rated outlets, outlets left out elsewhere (low), proposed ratings, else unrated. A host meets the rule table over
    its suffixes, a join of a few keys a host, not a scan of the rules."""
    spark = hosts.sparkSession
    rules = spark.createDataFrame(tier_rules(), "key string, tier string, proposed boolean, place int")
    rows = hosts.select(F.lower("host").alias("host"), "client_name").distinct()
    label = registrable_label(F.col("host"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = rows.where("host <> ''").select("host", label.alias("name"), suffixes.alias("ends")).distinct()
    keys = F.flatten(
        F.array(
            F.array(F.concat(F.lit("name:"), "name"), F.concat(F.lit("flat:"), _flat(F.col("host")))), F.transform("ends", lambda e: F.concat(F.lit("under:"), e)),
            F.transform(F.slice("ends", F.lit(2), F.size("ends")), lambda e: F.concat(F.lit("below:"), e)),
        )
    )
    met = keyed.select("host", F.explode(keys).alias("key")).join(rules, "key").groupBy("host").agg(F.min(F.struct("place", "tier", "proposed")).alias("rule"))
    name, own = F.coalesce(_flat(F.col("client_name")), F.lit("")), F.coalesce(label, F.lit(""))
    same = (name != "") & (F.length(own) >= 6) & (F.startswith(name, own) | F.startswith(own, name))
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("client_name", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 5)
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    left_out = F.lit(False)
    for o in R.FLOOR_EXCLUDED_OUTLETS:
        left_out = left_out | F.coalesce(F.contains(_flat(F.col("host")), F.lit(o.replace(" ", ""))), F.lit(False))
    decided = lambda tier, proposed, place: F.struct(F.lit(place).alias("place"), F.lit(tier).alias("tier"), F.lit(proposed).alias("proposed"))
    found = F.array_min(
        F.array_compact(
            F.array(
                F.col("rule"), F.when(same, decided("own", False, 2)), F.when((first != "") & F.startswith(own, first), decided("own", True, 3)),
                F.when(left_out, decided("low", False, 1000)), decided("unrated", False, 9999),
            )
        )
    )
    out = rows.join(met, "host", "left").withColumn("d", found).select("host", "client_name", "d.tier", "d.proposed")
    named = F.element_at(F.create_map(*[F.lit(x) for kv in TIER_LABELS.items() for x in kv]), F.col("tier"))
    return out.select("host", "client_name", "tier", F.concat(named, F.when(F.col("proposed"), " (proposed)").otherwise("")).alias("label"), F.col("tier").isin("low", "user_generated", "unrated").alias("low_reliability"), "proposed")
