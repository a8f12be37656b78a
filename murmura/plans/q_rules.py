"""Registered queries: JSON merges, relevance and keyword rules, slice planning, domain tiers, peers, source reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.operators import domains, gates, ingest, lookups, matching, names, planning, relevance, reports, risk
from murmura.plans.q_reports import VISIBLE_SQL, visible
from murmura.plans.q_scores import _events, rounded, star_sql
from murmura.plans.q_text import docs
from murmura.plans.star import AS_OF, Star, _case, with_star

# -- JSON merges --------------------------------------------------------------------------------------------------------


def _facts(**fields) -> F.Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def merged_sources(s: Star) -> DataFrame:
    """Stored and new facts of each source; each entry of the JSON objects comes from the best row that has it."""
    k, v = F.col("document_id"), F.coalesce("view_count", F.lit(0))
    cols = ["source_id", v.alias("views"), "document_id"]
    stored = s.documents.where("document_id % 3 <> 0").select(*cols, _facts(views=v, stored=F.struct(k.alias("id"), F.array(F.lit(1), k % 5).alias("list"))).alias("facts"))
    new = s.documents.where("document_id % 3 = 0").select(*cols, _facts(views=v, new=F.struct(k.alias("id"))).alias("facts"))
    return ingest.merge_upsert(stored, new, ["source_id"], [F.desc("views"), F.desc("document_id")], "facts")


_SOURCES_SQL = with_star("""t AS (SELECT source_id, coalesce(view_count, 0) AS views, document_id, document_id % 3 = 0 AS fresh FROM docs),
g AS (SELECT source_id, arg_max(document_id, (views, document_id)) AS document_id, arg_max(views, (views, document_id)) AS views,
  arg_max(document_id, (views, document_id)) FILTER (fresh) AS n, arg_max(document_id, (views, document_id)) FILTER (NOT fresh) AS o FROM t GROUP BY 1)
SELECT source_id, views, document_id, '{' || CASE WHEN n IS NOT NULL THEN '"new":{"id":' || n || '},' ELSE '' END
  || CASE WHEN o IS NOT NULL THEN '"stored":{"id":' || o || ',"list":[1,' || (o % 5) || ']},' ELSE '' END || '"views":' || views || '}' AS facts FROM g""")


def risk_rows(s: Star, where: str, fresh: str) -> DataFrame:
    k = F.col("document_id")
    role = F.when(k % 7 == 0, "llm").otherwise("rule")
    text = _facts(role_source=role, winner=k, **{fresh: F.struct(k.alias("id"))})
    mod = F.to_json(F.create_map(F.concat(F.lit("m"), (k % 3).cast("string")), k))
    joined = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(","), F.substring(mod, F.lit(2), F.length(mod)))
    return s.documents.where(where).select(
        (k % 25).alias("client_id"), (F.col("source_id") % 400).alias("document_id"), F.lit(None).cast("long").alias("entity_id"), role.alias("role_source"),
        F.struct("collected_at", k.alias("document_id")).alias("computed_at"), joined.alias("explainability"),
    )


def upserted_risks(s: Star) -> DataFrame:
    """A stored row of each key and new ones in order of time; rows of a worse tier leave no trace once a better one stands."""
    stored = risk_rows(s, "document_id % 3 <> 0", "stored")
    first = stored.groupBy("client_id", "document_id").agg(F.min_by(F.struct(*stored.columns), "computed_at").alias("r")).select("r.*")
    return risk.upsert_events(first, risk_rows(s, "document_id % 3 = 0", "fresh"), "explainability").select(
        "client_id", "document_id", "role_source", F.col("computed_at.document_id").alias("winner"), "explainability"
    )


_RISKS_SQL = with_star("""r AS (SELECT document_id % 25 AS client_id, source_id % 400 AS k, document_id % 7 = 0 AS llm, collected_at AS came, document_id AS id, document_id % 3 = 0 AS fresh FROM docs),
f AS (SELECT client_id, k, llm, came, id, fresh FROM (SELECT *, row_number() OVER (PARTITION BY client_id, k, fresh ORDER BY came, id) AS place FROM r) WHERE fresh OR place = 1),
z AS (SELECT *, (CASE WHEN llm THEN '1' ELSE '0' END) || strftime(came, '%Y%m%d%H%M%S') || lpad(CAST(id AS VARCHAR), 12, '0') AS score FROM f),
b AS (SELECT *, max(score) OVER (PARTITION BY client_id, k ORDER BY fresh, came, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM z),
a AS (SELECT * FROM b WHERE best IS NULL OR score >= best),
g AS (SELECT client_id, k, arg_max(llm, score) AS llm, arg_max(id, score) AS id, arg_max(id, score) FILTER (fresh) AS n, arg_max(id, score) FILTER (NOT fresh) AS o,
  arg_max(id, score) FILTER (id % 3 = 0) AS m0, arg_max(id, score) FILTER (id % 3 = 1) AS m1, arg_max(id, score) FILTER (id % 3 = 2) AS m2 FROM a GROUP BY 1, 2)
SELECT client_id, k AS document_id, CASE WHEN llm THEN 'llm' ELSE 'rule' END AS role_source, id AS winner, '{' || coalesce('"fresh":{"id":' || n || '},', '')
  || coalesce('"m0":' || m0 || ',', '') || coalesce('"m1":' || m1 || ',', '') || coalesce('"m2":' || m2 || ',', '')
  || '"role_source":"' || CASE WHEN llm THEN 'llm' ELSE 'rule' END || '",' || coalesce('"stored":{"id":' || o || '},', '') || '"winner":' || id || '}' AS explainability FROM g""")


def stripped(s: Star) -> DataFrame:
    """Keys of scores no longer used, at several depths and in lists."""
    deep = F.struct(F.lit(1).alias("trend_weight"), F.struct(F.col("comment_count").alias("kept"), F.array(F.struct(F.lit(2).alias("myTREND"), F.col("source_id").alias("id"))).alias("list")).alias("weights"))
    payload = F.struct("title", F.col("view_count").alias("trend_views"), F.struct(deep.alias("inner"), F.lit("a trend").alias("text")).alias("outer"), F.lit(0).alias("untrended"))
    return s.documents.select("document_id", names.without_trend_keys(F.to_json(payload)).alias("payload"))


_STRIPPED_SQL = with_star("""x AS (SELECT 1) SELECT document_id, '{"title":"' || title || '","outer":{"inner":{"weights":{"kept":' || comment_count || ',"list":[{"id":' || source_id || '}]}},"text":"a trend"}}' AS payload FROM docs""")

# -- relevance and keywords ---------------------------------------------------------------------------------------------

#: client, kind, term of the rules that the query applies.
RULES = [
    (1, "full", "of the"), (1, "bare", "ertion"), (1, "context", "onre"), (1, "context", "Eaux"), (1, "exclude", "ouon"), (2, "bare", "und"), (2, "context", "die"), (2, "exclude", "der"),
    (3, "full", "de la"), (3, "bare", "para"), (3, "context", "the"), (4, "bare", "the"), (4, "context", "in"), (4, "exclude", "and"),
]
_NORM = r"' ' || trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


def relevant(s: Star) -> DataFrame:
    """Every document against the rules of every client; a quarter of them come from YouTube."""
    source = F.when(F.col("doc_id") % 4 == 0, "YouTube").when(F.col("doc_id") % 4 == 1, "google_news")
    rows = docs(s).select("doc_id", "title", F.col("text").alias("content"), source.alias("source"))
    return relevance.relevant(rows, s.spark.createDataFrame(RULES, "client_id int, kind string, term string"))


def _any(kind: str, of: str) -> str:
    return f"len(list_filter({kind}s, lambda x: contains({of}, ' ' || x || ' '))) > 0"


_RELEVANT_SQL = f"""WITH n AS (SELECT doc_id, doc_id % 4 = 0 AS youtube, {_NORM.format("split_part(text, chr(10), 1)")} AS title, {_NORM.format("text")} AS body FROM documents),
r(client_id, kind, term) AS (VALUES {", ".join(f"({c}, '{k}', '{t.lower()}')" for c, k, t in RULES)}),
g AS (SELECT client_id, {", ".join(f"list(term) FILTER (kind = '{k}') AS {k}s" for k in ("full", "bare", "context", "exclude"))} FROM r GROUP BY 1),
h AS (SELECT doc_id, client_id, youtube, coalesce({_any("full", "title || body")}, FALSE) AS f, coalesce({_any("bare", "title || body")}, FALSE) AS b, coalesce({_any("context", "title || body")}, FALSE) AS c,
  coalesce({_any("context", "title")}, FALSE) AS t, coalesce({_any("exclude", "title || body")}, FALSE) AS x FROM n, g)
SELECT doc_id, CAST(client_id AS INTEGER) AS client_id FROM h WHERE f OR b AND CASE WHEN youtube THEN t AND NOT x ELSE c END"""

TAILS = ["", " a complaint", " fraudulent", " RERA-order", " courts", " the court", " refund", " Fraud!", " probe", " lawsuits", " a lawsuit", " protest", " protests"]


def risk_flags(s: Star) -> DataFrame:
    """Whole texts, each with a tail that holds a risk word, a longer word, or none."""
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.col("doc_id") % len(TAILS) + 1).cast("int"))
    return docs(s).select("doc_id", relevance.has_risk_word(F.col("title"), F.concat("text", tail)).alias("flag"))


def tiers(s: Star) -> DataFrame:
    """The hosts of pages, and of every kind the rules know, for two clients."""
    listed = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    client = F.when(F.col("page_id") % 2 == 0, "Godrej Properties").otherwise("Orris Homes Ltd")
    rows = s.table("pages").select("page_id", client.alias("client_name"), F.explode(F.array(domains.host_of(F.col("url")), domains.host_of(listed))).alias("host"))
    found = domains.domain_tiers(rows)
    return found.select("host", "client_name", "tier", "label", "low_reliability", "proposed")


#: Hosts and urls, with the host they have and its tier; own sites depend on the client.
_HOSTS = [
    ("rbi.org.in", "rbi.org.in", "official"), ("https://www.data.gov.in/x?y", "data.gov.in", "official"), ("nic.in", "nic.in", "unrated"), ("sub.sebi.gov.in:8080", "sub.sebi.gov.in", "official"),
    ("godrejproperties.com", "godrejproperties.com", "own:Godrej Properties"), ("http://godrejltd.com/", "godrejltd.com", "first:Godrej Properties"), ("orrishomes.co.in", "orrishomes.co.in", "own:Orris Homes Ltd"),
    ("m.youtube.com", "m.youtube.com", "user_generated"), ("x.com", "x.com", "user_generated"), ("old.reddit.co.uk", "old.reddit.co.uk", "user_generated"), ("x.com.au", "x.com.au", "user_generated"), ("xx.com", "xx.com", "unrated"),
    ("realty.economictimes.indiatimes.com", "realty.economictimes.indiatimes.com", "high"), ("www.thehindu.com", "thehindu.com", "medium"), ("bwbusinessworld.in", "bwbusinessworld.in", "low"), ("news.moneycontrol.com", "news.moneycontrol.com", "high"),
    ("livemint.co.in", "livemint.co.in", "high"), ("inventiva.co.in", "inventiva.co.in", "low"), ("sproutsnews.com", "sproutsnews.com", "low"), ("www.inc42.com", "inc42.com", "proposed"), ("timesofindia.indiatimes.com", "timesofindia.indiatimes.com", "proposed"),
    ("indiatimes.com", "indiatimes.com", "unrated"), ("nowhere", "nowhere", "unrated"),
]
HOSTS = [h for h, _, _ in _HOSTS]
_TIERS_SQL = rf"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Godrej Properties' ELSE 'Orris Homes Ltd' END AS client_name,
  regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS own, {_case(f"page_id % {len(_HOSTS)}", [h for _, h, _ in _HOSTS])} AS host FROM pages),
t(host, rule) AS (VALUES {", ".join(f"('{h}', '{t}')" for _, h, t in _HOSTS)}),
u AS (SELECT DISTINCT own AS host, client_name, 'unrated' AS rule FROM p UNION SELECT DISTINCT p.host, client_name, rule FROM p JOIN t USING (host)),
v AS (SELECT host, client_name, CASE WHEN rule = 'own:' || client_name OR rule = 'first:' || client_name THEN 'own' WHEN rule LIKE '%:%' THEN 'unrated' WHEN rule = 'proposed' THEN 'medium' ELSE rule END AS tier,
  rule = 'proposed' OR rule = 'first:' || client_name AS proposed FROM u)
SELECT host, client_name, tier, CASE tier WHEN 'own' THEN 'Company' WHEN 'user_generated' THEN 'User-generated' ELSE upper(tier[1]) || tier[2:] END || CASE WHEN proposed THEN ' (proposed)' ELSE '' END AS label,
  tier IN ('low', 'user_generated', 'unrated') AS low_reliability, proposed FROM v"""


def peers(s: Star) -> DataFrame:
    """Companies that each client's answers propose, ranked."""
    k = F.col("entity_id")
    rows = s.entities.select(
        "client_id", F.col("entity_name").alias("name"), (k % 11 == 0).alias("tracked"), (k % 4).alias("seen_in"),
        F.when(k % 5 != 0, F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda i: ((k * i) % 9 + 1).cast("int"))).alias("positions"), F.when(k % 6 != 0, k % 50).alias("news_count"),
    )
    return lookups.ranked_peers(rows).select("client_id", "name", "place")


def reliabilities(s: Star) -> DataFrame:
    """L3: sources of several types, some without a category, a score or a record."""
    k = F.col("source_id")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (k % len(_TYPES) + 1).cast("int"))
    url = F.when(k % 7 == 0, "https://feeds.Reuters.com/x").otherwise("https://feed.example.com")
    base = F.when(k % 8 != 0, F.struct(F.col("base_reliability").alias("score")))
    return rounded(s.sources.select("source_id", lookups.source_reliability(k % 13 != 0, base, kind, url).alias("reliability")))


_TYPES = ["RSS", "reddit_apify", "Social", "gdelt", "forum/rss"]


def specs(s: Star) -> DataFrame:
    """Queries of each entity for each source; some have none for some."""
    k = F.col("entity_id")
    kind = F.element_at(F.array(*map(F.lit, _SPECS)), (k % len(_SPECS) + 1).cast("int"))
    query = lambda c: F.concat(F.lit(c), F.lit(" "), "entity_name")
    hn = F.when(~kind.isin("risk", "seed_risk"), query("h")).otherwise("")
    return s.entities.select("client_id", kind.alias("kind"), "entity_id", (kind.isin("seed_risk") | (k % 4 == 0)).alias("seeded"), query("g").alias("google_news"), F.when(k % 3 != 0, query("y")).alias("youtube"), query("d").alias("gdelt"), hn.alias("hn"))


_SPECS = ["brand", "risk", "executive", "competitor", "product", "seed_risk"]


def planned(s: Star) -> DataFrame:
    """Ten years of slices of every query, less those planned before."""
    rows = specs(s)
    before = planning.plan_slices(rows.where("entity_id % 2 = 0"), start="1995-03-10", end="1998-01-01", youtube_year=1996)
    out = planning.plan_slices(rows, start="1995-03-10", end=AS_OF[:10], youtube_year=1996, planned=before)
    return out.select("client_id", "source", "kind", "entity_id", "query", "slice_start", "slice_end")


def _plan_sql(where: str, end: str) -> str:
    return f"""SELECT client_id, source, kind, entity_id, query, slice_start, slice_end FROM (
  SELECT q.*, CAST(d AS DATE) AS day, greatest(CAST(d AS DATE), since) AS slice_start, least(CAST(d + to_months(CAST(m AS INTEGER)) AS DATE), DATE '{end}') AS slice_end
  FROM (SELECT q.*, m, greatest(DATE '1995-03-10', CASE WHEN seeded THEN DATE '{end}' - 730 END, CASE WHEN source = 'youtube' THEN DATE '1996-01-01' END) AS since FROM q JOIN wd USING (source, kind) WHERE {where}) q,
    unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2010-01-01', to_months(CAST(m AS INTEGER)))) AS g(d)
  WHERE d < DATE '{end}' AND d + to_months(CAST(m AS INTEGER)) > since)
UNION ALL SELECT client_id, source, kind, entity_id, query, CAST(d AS DATE), least(CAST(d AS DATE) + 15, DATE '{end}')
FROM q, unnest(generate_series(greatest(DATE '1995-03-10', DATE '{end}' - 89)::TIMESTAMP, (DATE '{end}' - 1)::TIMESTAMP, INTERVAL 15 DAY)) AS g(d) WHERE source = 'gdelt' AND {where}"""


_PLAN_SQL = with_star(f"""sp AS (SELECT *, {_case(f"entity_id % {len(_SPECS)}", _SPECS)} AS kind FROM entities),
q AS (SELECT client_id, kind, entity_id, kind = 'seed_risk' OR entity_id % 4 = 0 AS seeded, 'google_news' AS source, 'g ' || entity_name AS query FROM sp
  UNION ALL SELECT client_id, kind, entity_id, kind = 'seed_risk' OR entity_id % 4 = 0, 'youtube', 'y ' || entity_name FROM sp WHERE entity_id % 3 <> 0
  UNION ALL SELECT client_id, kind, entity_id, kind = 'seed_risk' OR entity_id % 4 = 0, 'gdelt', 'd ' || entity_name FROM sp
  UNION ALL SELECT client_id, kind, entity_id, kind = 'seed_risk' OR entity_id % 4 = 0, 'hn', 'h ' || entity_name FROM sp WHERE kind NOT IN ('risk', 'seed_risk')),
wd(source, kind, m) AS (VALUES {", ".join(f"('{s}', '{k}', {m})" for s, ks in planning.WIDTH_MONTHS.items() for k, m in ks.items())}),
al AS ({_plan_sql("TRUE", AS_OF[:10])}), bf AS ({_plan_sql("entity_id % 2 = 0", "1998-01-01")})
SELECT * FROM al ANTI JOIN (SELECT DISTINCT client_id, source, query, slice_start, slice_end FROM bf) USING (client_id, source, query, slice_start, slice_end)""")


def attached(s: Star) -> DataFrame:
    """One-word names of clients whose brands and products bear some of them."""
    k = F.col("entity_id")
    word = F.concat(F.lit("p"), (k % 9).cast("string"))
    named = F.when(k % 4 == 3, F.concat(F.lit("P"), (k % 9).cast("string"), F.lit(" Works"))).otherwise("Acme-Homes")
    own = s.entities.where("entity_type IN ('brand', 'product')").select("client_id", "entity_type", named.alias("entity_name"))
    people = s.entities.where("entity_type = 'person'").select("client_id", "entity_id", F.concat(F.when(k % 7 != 0, "Ann ").otherwise(""), F.upper(word)).alias("entity_name"))
    return lookups.surname_attach(s.entities.select("client_id", word.alias("word")).distinct(), people, lookups.own_words(own))


_KEYWORDS_SQL = """n AS (SELECT entity_id, entity_name || CASE entity_id % 4 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ', Inc' WHEN 2 THEN ' of the North' ELSE '' END AS e, entity_id % 4 AS r, entity_name AS b FROM entities)"""


def keywords(s: Star) -> DataFrame:
    """M9: all keywords that each entity's name makes."""
    tail = F.element_at(F.array(*map(F.lit, [" Pvt. Ltd.", ", Inc", " of the North", ""])), (F.col("entity_id") % 4 + 1).cast("int"))
    return matching.generated_keywords(s.entities.select("entity_id", F.concat("entity_name", tail).alias("entity_name")))


def document_feed(s: Star) -> DataFrame:
    """Every document that a client sees, with all that readers are shown."""
    k = F.col("document_id")
    own = gates.without_competitors(_events(s)).withColumn("explainability", F.to_json(F.struct(F.struct(F.lit(1).alias("trend"), F.col("entity_id").alias("by")).alias("weights"))))
    rows = s.documents.withColumns({"normalized_content": F.concat("title", F.lit(" text")), "processing_status": F.when(k % 4 != 0, "PROCESSED"), "title": F.when(k % 19 != 0, F.col("title")).otherwise("")})
    named = s.mentions.select("document_id", "entity_id").join(s.entities.select("entity_id", "entity_name", "entity_type"), "entity_id")
    feed = reports.document_feed(visible(s), rows, s.sources, own, s.topics, named)
    said = F.array_join(F.transform("extracted_entities", lambda e: F.concat_ws("/", e["name"], e["entity_type"])), ",")
    return rounded(feed.withColumns({"extracted_entities": said, "timestamp": F.col("timestamp").cast("timestamp_ntz")}))


_FEED_SQL = star_sql(f"""{VISIBLE_SQL},
tt AS (SELECT document_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY topic_confidence DESC, line, topic) AS k FROM topics) WHERE k = 1),
rr AS (SELECT client_id, document_id, risk_score, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY client_id, document_id ORDER BY risk_score DESC, entity_id) AS k FROM events WHERE entity_type IS DISTINCT FROM 'competitor') WHERE k = 1),
nn AS (SELECT document_id, string_agg(entity_name || '/' || coalesce(entity_type, 'unknown'), ',' ORDER BY entity_id) AS said FROM (SELECT DISTINCT document_id, entity_id FROM mentions) JOIN entities USING (entity_id) GROUP BY 1)
SELECT v.client_id, v.document_id, CASE WHEN v.document_id % 19 <> 0 THEN title ELSE coalesce(source_name, 'RSS Feed') END AS title, coalesce(source_name, 'RSS Feed') AS source, document_type, coalesce(published_at, collected_at) AS "timestamp",
  CASE WHEN v.document_id % 4 <> 0 THEN 'PROCESSED' ELSE 'COMPLETED' END AS status, sentiment_score AS sentiment, round_even(coalesce(risk_score, 0), 0)::DOUBLE AS risk, risk_score IS NOT NULL AS scored,
  CASE WHEN risk_score <= 25 THEN 'LOW' WHEN risk_score <= 50 THEN 'MEDIUM' WHEN risk_score <= 75 THEN 'HIGH' WHEN risk_score IS NOT NULL THEN 'CRITICAL' END AS risk_level, round(risk_score, 6) AS risk_exact,
  CASE WHEN risk_score IS NOT NULL THEN coalesce(fl.label, sentiment_label) END AS risk_sentiment, CASE WHEN published_at IS NULL THEN 'collected' ELSE 'published' END AS date_basis,
  CASE WHEN risk_score IS NOT NULL THEN '{{"weights":{{"by":' || rr.entity_id || '}}}}' END AS risk_explainability, title || ' text' AS original_content, coalesce(said, '') AS extracted_entities, coalesce(topic, 'General') AS topic,
  CASE WHEN sentiment_score >= 0 THEN '+' ELSE '' END || printf('%.1f', sentiment_score * 10) AS reputation_impact
FROM visible v JOIN docs d ON d.document_id = v.document_id LEFT JOIN sources so ON so.source_id = d.source_id LEFT JOIN rr ON rr.client_id = v.client_id AND rr.document_id = v.document_id
LEFT JOIN first_label fl ON fl.document_id = v.document_id AND fl.entity_id = rr.entity_id LEFT JOIN tt ON tt.document_id = v.document_id LEFT JOIN nn ON nn.document_id = v.document_id""")


_COMPANIES = [" Ltd", " Group", "", " Realty", " Online Ltd", " Estates Projects", " Retail"]


def companies(s: Star) -> DataFrame:
    """Spellings of a few companies of each client."""
    tail = F.element_at(F.array(*map(F.lit, _COMPANIES)), (F.col("entity_id") % len(_COMPANIES) + 1).cast("int"))
    return lookups.same_company(s.entities.select("client_id", F.concat(F.lit("Acme & "), (F.col("entity_id") % 3).cast("string"), tail).alias("name")))


QUERIES = {
    "j20_same_company_pairs": (
        companies,
        with_star(f"""n AS (SELECT DISTINCT client_id, 'Acme & ' || (entity_id % 3) || {_case(f"entity_id % {len(_COMPANIES)}", _COMPANIES)} AS name, 'acme and ' || (entity_id % 3) AS stem, {_case(f"entity_id % {len(_COMPANIES)}", ["", "", "", "realty", "online", "estates", "retail"])} AS extra FROM entities),
c AS (SELECT client_id, stem, extra, min(name) AS a FROM n GROUP BY ALL)
SELECT client_id, a, name AS b, 'core' AS basis FROM n JOIN c USING (client_id, stem, extra) WHERE name <> a
UNION ALL SELECT x.client_id, least(x.a, y.a), greatest(x.a, y.a), 'extra' FROM c x JOIN c y USING (client_id, stem) WHERE x.extra = '' AND y.extra IN ('realty', 'online', 'estates')"""),
    ),
    "x13_doc_feed": (document_feed, _FEED_SQL),
    "s9_merge_upsert": (merged_sources, _SOURCES_SQL),
    "r17_risk_upsert": (upserted_risks, _RISKS_SQL),
    "x12_explainability_strip": (stripped, _STRIPPED_SQL),
    "x9_relevance_filter": (relevant, _RELEVANT_SQL),
    "x10_risk_term_flag": (
        risk_flags,
        f"""WITH t AS (SELECT doc_id, {_NORM.format("split_part(text, chr(10), 1)")} || {_NORM.format("text || " + _case(f"doc_id % {len(TAILS)}", TAILS))} AS t FROM documents)
SELECT doc_id, {" OR ".join(f"contains(t, ' {w.lower()} ')" for w in relevance.RISK_WORDS)} AS flag FROM t""",
    ),
    "x11_keyword_mention_filter": (
        lambda s: docs(s).where(relevance.mentions_phrase("Src_7", [F.col("title"), F.col("text"), F.col("source")]) | relevance.mentions_phrase("of-the", [F.col("title"), F.col("text")])).select("doc_id"),
        f"""SELECT doc_id FROM documents WHERE contains({_NORM.format("text")}, ' src 7 ') OR contains({_NORM.format("coalesce(source, '')")}, ' src 7 ') OR contains({_NORM.format("text")}, ' of the ')""",
    ),
    "m9_keyword_generation": (
        keywords,
        with_star(f"""{_KEYWORDS_SQL} SELECT entity_id, e AS keyword, 'PRIMARY' AS category, 10 AS priority FROM n UNION ALL SELECT entity_id, lower(e), 'ALIAS', 5 FROM n UNION ALL
SELECT entity_id, replace(e, ' ', ''), 'ALIAS', 5 FROM n WHERE contains(e, ' ') UNION ALL SELECT entity_id, b, 'ALIAS', 8 FROM n WHERE r < 2 UNION ALL
SELECT entity_id, 'CEO of ' || e, 'EXECUTIVE', 7 FROM n UNION ALL SELECT entity_id, e || ' ' || w, 'RISK', 9 FROM n, (SELECT unnest(['lawsuit', 'scandal', 'fraud', 'bankruptcy']) AS w)"""),
    ),
    "m10_surname_attach": (
        attached,
        with_star("""w AS (SELECT DISTINCT client_id, 'p' || (entity_id % 9) AS word FROM entities),
o AS (SELECT DISTINCT client_id, 'p' || (entity_id % 9) AS word FROM entities WHERE entity_type IN ('brand', 'product') AND entity_id % 4 = 3),
p AS (SELECT client_id, 'p' || (entity_id % 9) AS word, count(*) AS n, min(entity_id) AS entity_id, bool_or(entity_id % 7 <> 0) AS two FROM entities WHERE entity_type = 'person' GROUP BY 1, 2)
SELECT client_id, word, entity_id FROM w JOIN p USING (client_id, word) ANTI JOIN o USING (client_id, word) WHERE n = 1 AND two"""),
    ),
    "g29_domain_tier": (tiers, _TIERS_SQL),
    "k13_competitor_ranking": (
        peers,
        with_star("""k AS (SELECT *, entity_id % 11 = 0 AS tracked, entity_id % 4 AS seen, CASE WHEN entity_id % 5 <> 0 THEN list_avg(list_transform(range(1, entity_id % 3 + 2), lambda i: (entity_id * i) % 9 + 1)) ELSE 99.0 END AS mean,
  CASE WHEN entity_id % 6 <> 0 THEN entity_id % 50 ELSE 0 END AS news FROM entities)
SELECT client_id, entity_name AS name, CAST(row_number() OVER (PARTITION BY client_id ORDER BY tracked DESC, seen DESC, mean, news DESC, lower(entity_name)) AS INTEGER) AS place FROM k"""),
    ),
    "l3_dynamic_source_reliability": (
        reliabilities,
        with_star("""b AS (SELECT source_id, CASE WHEN source_id % 8 = 0 THEN 0.65 ELSE coalesce(base_reliability::DOUBLE, 1.0) END AS v FROM sources)
SELECT source_id, round(CASE WHEN source_id % 13 = 0 THEN 0.65 WHEN source_id % 5 IN (1, 2, 4) THEN least(v, 0.60) WHEN source_id % 5 = 0 THEN CASE WHEN source_id % 7 = 0 THEN 1.0 ELSE least(v, 0.80) END ELSE v END::DOUBLE, 6) AS reliability FROM b"""),
    ),
    "p3_plan_slices": (planned, _PLAN_SQL),
}
