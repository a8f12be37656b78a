"""Terms of clients and publishers, merged proposals, and review of discovered names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import entity_key
from murmura.operators import names
from murmura.operators.incidents import difflib_ratio, likely_pairs
from murmura.scratch import by_shuffle, materialize


def boost_terms(entities: DataFrame) -> DataFrame:
    """Per client: executive, product and brand terms, lower case, sorted."""
    rows = entities.select("client_id", "entity_type", F.lower("entity_name").alias("term"))
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("entity_type") == kind, F.col("term"))))
    return rows.groupBy("client_id").agg(of("person").alias("executive_terms"), of("product").alias("product_terms"), of("brand").alias("brand_terms"))


def write_gate(matches: DataFrame, terms: DataFrame) -> DataFrame:
    """Matches (client_id, text) whose text holds a brand or product term of the client; clients without terms keep all."""
    rows = matches.join(terms, "client_id", "left")
    own = F.concat(F.coalesce("brand_terms", F.array().cast("array<string>")), F.coalesce("product_terms", F.array().cast("array<string>")))
    return rows.where((F.size(own) == 0) | F.exists(own, lambda t: F.contains(F.lower("text"), t))).select(*matches.columns)


def publisher_terms(sources: DataFrame, own_names: DataFrame) -> DataFrame:
    """Source names without feed words, less those that a client's own name equals."""
    plain = F.trim(F.regexp_replace(F.lower("source_name"), r"\b(rss|feed|news|google|history)\b|\(.*?\)", " "))
    rows = sources.select(F.regexp_replace(plain, r"\s+", " ").alias("term")).where("term <> ''").distinct()
    return rows.join(own_names.select(F.lower("entity_name").alias("term")), "term", "left_anti")


def self_reference_terms(entities: DataFrame) -> DataFrame:
    """Per client: keys of its own names, and their leading word of four letters or more."""
    own = entities.where("entity_type IN ('brand', 'product')").select("client_id", entity_key(F.col("entity_name")).alias("key"))
    lead = own.select("client_id", F.split("key", " ")[0].alias("key")).where(F.length("key") >= 4)
    return own.unionByName(lead).where("key <> ''").distinct()


def revalidated(entities: DataFrame, brands: DataFrame) -> DataFrame:
    """Competitors with the layer that rejects them, and their new type."""
    brand = brands.groupBy("client_id").agg(F.min("entity_name").alias("brand"))
    rows = entities.where("entity_type = 'competitor'").join(brand, "client_id", "left")
    own = F.when(F.col("brand").isNotNull(), F.array(entity_key(F.col("brand"))))
    layer = names.company_name(F.col("entity_name"), own)[1]
    return rows.select("client_id", "entity_id", layer.alias("layer"), F.when(layer.isNull(), "competitor").otherwise("rejected_competitor").alias("new_type"))


def merged_proposals(answers: DataFrame) -> DataFrame:
    """One row for each (client_id, name key) over several answers: best slot, answers naming it, pooled urls, first detail."""
    rows = answers.withColumn("key", entity_key(F.col("name")))
    return rows.groupBy("client_id", "key").agg(
        F.min_by("name", F.struct("slot", "answer", "name")).alias("name"), F.min("slot").alias("slot"), F.countDistinct("answer").alias("answers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"), F.min_by("detail", F.when(F.col("detail").isNotNull(), F.col("answer"))).alias("detail"),
    )


# Words that a person's name doesn't begin with, or doesn't hold.
NO_FIRST_WORDS = [
    "today", "top", "news", "latest", "breaking", "live", "watch", "new", "this", "the", "cm", "pm", "mr", "mrs", "ms", "dr", "shri",
    "sri", "hon", "chief", "minister", "president", "files", "holds", "settle", "son", "telegram",
]
NO_NAME_WORDS = [
    "properties", "estate", "estates", "road", "roads", "residential", "sector", "ncr", "cements", "cement", "wafers", "renewables", "sons",
    "hobli", "nadu", "jayanti", "agrahara", "realty", "enterprises", "industries", "limited", "ltd", "projects", "infra",
    "infrastructure", "capital", "finance", "bank", "holdings", "energy", "motors", "steel", "airports", "ports", "worth", "sells",
    "forecast", "stocks", "shares", "market", "delhi", "mumbai", "bengal", "kolkata", "gujarat", "maharashtra", "pradesh", "india",
    "bangalore", "bengaluru", "pune", "gurgaon", "noida", "apni", "apno", "aapke", "ke", "ka", "ki", "saath", "baat", "safar", "humsafar",
    "hai", "hain", "acquire", "acquires", "acquisition", "mech", "enviro", "benzoplast", "labs", "pharma", "tech", "technologies",
    "systems", "solutions", "ventures", "logistics", "retail", "foods",
]


def name_shape_fault(name: Column) -> Column:
    """Why a typed name cannot be a person's, or null."""
    n = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    fault = F.when(n == "", "empty").when(F.length(n) > 80, "long").when(n.rlike(r"\p{N}"), "digits").when(~n.rlike(r"^\p{L}"), "start")
    return fault.when(n.rlike(r"[^\p{L}\p{M} '’.\-]"), "characters").when(n.rlike("[A-Z][a-z]{3,}[A-Z][a-z]+"), "glued")


def review_tier() -> Column:
    """0 to 4 of a candidate: carries the client's name, has a title and the client near, a title, the client's documents, none."""
    own = F.col("brand_documents") >= 1
    tier = F.when(F.col("carries_client_name") & own, 0).when(F.col("title_near") & F.col("client_near"), 1).when(F.col("title_near") & own, 2)
    return tier.when(own, 3).otherwise(4)


def hidden_candidate(name: Column) -> Column:
    """True if a review doesn't show the name: a fragment, an organisation, a place, or no valid person name."""
    words = F.split(F.lower(F.trim(name)), r"\s+")
    junk = words[0].isin(*NO_FIRST_WORDS) | F.arrays_overlap(words, F.array(*map(F.lit, NO_NAME_WORDS)))
    return name_shape_fault(name).isNotNull() | junk | ~names.person_name(name)[0]


def candidate_review(candidates: DataFrame, twin: float = 0.88) -> DataFrame:
    """client_id, name and the leader it stands under of every candidate (client_id, name, tier, confidence, mentions).

    In review order (tier, then confidence, mentions, name) a name joins the first leader that it resembles by ``twin``, else
    it leads. Names meet over their rarest letters only, likeness is computed once for each pair, and leaders settle in
    rounds: a name without an undecided earlier twin is decided."""
    order = Window.partitionBy("client_id").orderBy("tier", F.desc_nulls_last("confidence"), F.desc_nulls_last("mentions"), F.lower("name"), "name")
    rows = materialize(candidates.select("client_id", "name", F.lower("name").alias("low"), F.row_number().over(order).alias("place")), "review-names")
    low = rows.select("client_id", F.col("low").alias("name"))
    pairs = likely_pairs(low, low.withColumnRenamed("name", "other"), ["client_id"], F.lit(twin))
    # Likeness depends on which name comes first, so both ways are computed: the leader is the first argument.
    alike = pairs.where(difflib_ratio("name", "other") >= twin)
    a = rows.select("client_id", F.col("low").alias("name"), F.col("place").alias("a"))
    b = rows.select("client_id", F.col("low").alias("other"), F.col("place").alias("b"))
    twins = materialize(alike.join(by_shuffle(a), ["client_id", "name"]).join(by_shuffle(b), ["client_id", "other"]).where("a < b").select("client_id", "a", "b"), "review-twins")
    left, leaders = twins, None
    while not left.isEmpty():
        later = left.select("client_id", F.col("b").alias("a")).distinct()
        first = left.select("client_id", "a").distinct().join(by_shuffle(later), ["client_id", "a"], "left_anti")
        leaders = first if leaders is None else leaders.unionByName(first)
        # Names under a new leader are decided, and so are leaders: their links go, from both ends.
        under = left.join(by_shuffle(first), ["client_id", "a"], "left_semi").select("client_id", F.col("b").alias("x")).distinct()
        gone = by_shuffle(under.unionByName(first.select("client_id", F.col("a").alias("x"))))
        rest = left.join(gone.withColumnRenamed("x", "a"), ["client_id", "a"], "left_anti").join(gone.withColumnRenamed("x", "b"), ["client_id", "b"], "left_anti")
        freed = left.select("client_id", F.col("b").alias("a")).join(gone.withColumnRenamed("x", "a"), ["client_id", "a"], "left_anti").distinct()
        alone = freed.join(by_shuffle(rest.select("client_id", F.col("b").alias("a"))), ["client_id", "a"], "left_anti").join(by_shuffle(rest.select("client_id", "a")), ["client_id", "a"], "left_anti")
        leaders = materialize(leaders.unionByName(alone), "review-leaders")
        left = materialize(rest, "review-twins")
    if leaders is None:
        return rows.select("client_id", "name", F.col("name").alias("leader"))
    led = twins.join(by_shuffle(leaders), ["client_id", "a"], "left_semi").join(by_shuffle(leaders.withColumnRenamed("a", "b")), ["client_id", "b"], "left_anti")
    best = led.groupBy("client_id", F.col("b").alias("place")).agg(F.min("a").alias("under"))
    named = rows.select("client_id", F.col("place").alias("under"), F.col("name").alias("leader"))
    return rows.join(by_shuffle(best), ["client_id", "place"], "left").join(by_shuffle(named), ["client_id", "under"], "left").select("client_id", "name", F.coalesce("leader", "name").alias("leader"))


def slice_priority(slices: DataFrame, kinds: dict[str, int], key: str) -> DataFrame:
    """Order of slices: kind, then newest."""
    tier = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind")), F.lit(9))
    return slices.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(tier, F.desc("slice_start"), "kind")))


def expected_items(start: Column, end: Column, per_month: float) -> Column:
    return F.round(F.months_between(end, start) * per_month, 6)
