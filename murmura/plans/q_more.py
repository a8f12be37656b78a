"""Registered queries: lookups, discovery, names, telemetry and acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.common import reliability_modifier
from murmura.operators import alerts, gates, incidents, lookups, names, ranks, risk, scores
from murmura.operators.matching import best_match_per_entity, match_confidence
from murmura.plans.q_reports import RUNS_SQL, VISIBLE_SQL, calls, calls_sql, daily_runs, stored_alerts, visible
from murmura.plans.q_scores import _EXECUTIVE_SQL, TS, _benchmark, _benchmark_sql, _events, gated_sql, rounded, star_sql
from murmura.plans.q_text import CITED_SQL, MATCHED_SQL, answers, cited, docs, incident_items, matches
from murmura.plans.star import AS_OF, Star, _case, with_star

HITS_SQL = "hits AS (SELECT c_custkey AS hit_id, 'https://site' || (c_custkey % 9) || '.example.com/a/' || (c_custkey % 5000) AS url_key, sha256(CAST(c_custkey % 4500 AS VARCHAR)) AS hash_key FROM customer)"


def hits(s: Star) -> DataFrame:
    k = F.col("c_custkey")
    return s.table("customer").select(k.alias("hit_id"), F.concat(F.lit("https://site"), (k % 9).cast("string"), F.lit(".example.com/a/"), (k % 5000).cast("string")).alias("url_key"), F.sha2((k % 4500).cast("string"), 256).alias("hash_key"))


def pair_hits(s: Star) -> DataFrame:
    """Search hits as (document, entity) pairs: each document with two entities, some of them mentioned."""
    n = 20
    return s.documents.select("document_id", "title", F.explode(F.array((F.col("document_id") % n + 1), (F.col("document_id") % 7 + 1))).alias("entity_id")).distinct()


PAIRS_SQL = "ph AS (SELECT DISTINCT document_id, title, unnest([document_id % 20 + 1, document_id % 7 + 1]) AS entity_id FROM docs)"


def keyed(s: Star) -> DataFrame:
    return s.documents.select("document_id", F.col("url").alias("url_key"), F.col("content_hash").alias("hash_key"))


NAME = r"\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*"


def name_facts(s: Star) -> DataFrame:
    """Extracted names, the runs of capitalised words of each whole text, with the language as client."""
    rows = docs(s).select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("name"))
    return rows.select(F.col("lang").alias("client_id"), F.col("doc_id").alias("document_id"), F.lower("name").alias("name_key"), F.col("doc_id").alias("seen_at"))


NAMES_SQL = rf"nf AS (SELECT lang AS client_id, doc_id AS document_id, lower(unnest(regexp_extract_all(text, '{NAME}'))) AS name_key, doc_id AS seen_at FROM documents)"


def telemetry(s: Star) -> DataFrame:
    """Per client and stage: documents, failures and success rate."""
    v = visible(s).join(s.documents, "document_id", "left").join(_events(s).groupBy("client_id", "document_id").agg(F.max("risk_score").alias("score")), ["client_id", "document_id"], "left")
    return rounded(v.groupBy("client_id").agg(F.count("*").alias("documents"), F.count_if(F.col("sentiment_score").isNotNull()).alias("with_sentiment"), F.count_if(F.col("score").isNotNull()).alias("with_risk"), (F.count_if(F.col("score") > 0) / F.count("*") * 100).alias("scored_rate"), F.max("collected_at").alias("last_seen")))


def snapshot(s: Star) -> DataFrame:
    """Entities by type, documents by kind and source category, as one long table."""
    a = s.entities.groupBy(F.coalesce("entity_type", F.lit("none")).alias("name")).agg(F.count("*").alias("rows")).withColumn("kind", F.lit("entity type"))
    b = s.documents.groupBy(F.col("document_type").alias("name")).agg(F.count("*").alias("rows")).withColumn("kind", F.lit("document type"))
    c = s.documents.join(s.sources, "source_id").groupBy(F.col("category").alias("name")).agg(F.count("*").alias("rows")).withColumn("kind", F.lit("source category"))
    return a.unionByName(b).unionByName(c)


def feeds(s: Star) -> DataFrame:
    last = s.documents.groupBy("source_id").agg(F.max("collected_at").alias("last_polled"))
    return s.sources.select("source_id", (F.col("source_id") % 25).alias("client_id"), (F.col("source_id") % 6 != 0).alias("active")).join(last, "source_id", "left")


FEEDS_SQL = "fd AS (SELECT source_id, source_id % 25 AS client_id, source_id % 6 <> 0 AS active, last_polled FROM sources LEFT JOIN (SELECT source_id, max(collected_at) AS last_polled FROM docs GROUP BY 1) USING (source_id))"
CHECKS = {"documents": (10, 400), "entities": (1, 4), "mentions": (100, 2000)}


def client_counts(s: Star) -> DataFrame:
    m = s.mentions.join(s.entities, "entity_id").groupBy("client_id").agg(F.countDistinct("document_id").alias("documents"), F.countDistinct("entity_id").alias("entities"), F.count("*").alias("mentions"))
    return s.clients.select("client_id").join(m, "client_id", "left").na.fill(0)


COUNTS_SQL = "cc AS (SELECT c.client_id, count(DISTINCT m.document_id) AS documents, count(DISTINCT m.entity_id) AS entities, count(m.document_id) AS mentions FROM clients c LEFT JOIN (SELECT m.*, e.client_id FROM mentions m JOIN entities e USING (entity_id)) m USING (client_id) GROUP BY 1)"


def verdicts(s: Star) -> DataFrame:
    e = gates.without_competitors(_events(s)).groupBy("client_id").agg(F.count_if(F.col("risk_score") > 99.9).alias("critical"), F.count_if(F.col("risk_score") > 25).alias("flagged"))
    rows = client_counts(s).join(e, "client_id", "left").na.fill(0).withColumn("alerts", F.when(F.col("client_id") % 9 == 0, 1).otherwise(0))
    return lookups.verdict(rows).select("client_id", "verdict")


NAME_TAILS = [" Rao", " rao", " Group", " 7", " van Rao", " Post", ""]
ORG_NAMES = ["1st Bank", "HK$205,000", "Evening Post", "", "Orris Home's", "The Best Homes in Town", "Nasdaq", "Orris Shares", "orris.com"]


def role_pages(s: Star) -> DataFrame:
    """Pages with a person's name and a role so many letters after it."""
    return s.documents.select("document_id", F.concat(F.lit("News of Ann Rao "), F.repeat(F.lit("x"), (F.col("document_id") % 400).cast("int")), F.lit(" CEO of a firm")).alias("text"))


def owner_pages(s: Star) -> DataFrame:
    """Pages with an owner phrase so many letters after the child's name; in every seventh the parent is another."""
    parent = F.when(F.col("document_id") % 7 == 0, "Other Group").otherwise("Acme Group")
    return s.documents.select("document_id", F.concat(F.lit("Orris Homes "), F.repeat(F.lit("x"), (F.col("document_id") % 200).cast("int")), F.lit(" is owned by the "), parent, F.lit(" now")).alias("text"))


ASKED = ["supplier#000000001", "SUPPLIER#000000007", "0000002", "00000001", "nobody", "00099"]

QUERIES = {
    "j10_uncounted_hits": (lambda s: lookups.uncounted_hits(pair_hits(s), s.mentions).select("document_id", "entity_id"),
        with_star(f"{PAIRS_SQL} SELECT document_id, entity_id FROM ph ANTI JOIN mentions USING (document_id, entity_id)")),
    "j11_hit_lookup": (lambda s: lookups.hit_lookup(hits(s), keyed(s)), with_star(f"""{HITS_SQL}, u AS (SELECT url AS url_key, min(document_id) AS by_url FROM docs GROUP BY 1), h AS (SELECT content_hash AS hash_key, min(document_id) AS by_hash FROM docs GROUP BY 1)
SELECT hit_id, coalesce(by_url, by_hash) AS document_id, CASE WHEN by_url IS NOT NULL THEN 'url' WHEN by_hash IS NOT NULL THEN 'hash' ELSE 'none' END AS basis FROM hits LEFT JOIN u USING (url_key) LEFT JOIN h USING (hash_key)""")),
    "j12_hit_attribution": (lambda s: lookups.hit_attribution(pair_hits(s), s.mentions, F.contains("title", F.lit("item 1"))).select("document_id", "entity_id", "outcome"),
        with_star(f"""{PAIRS_SQL}, k AS (SELECT DISTINCT document_id, entity_id, TRUE AS known FROM mentions), o AS (SELECT document_id, entity_id, CASE WHEN known THEN 'already' WHEN contains(title, 'item 1') THEN 'attached' ELSE 'refused' END AS outcome FROM ph LEFT JOIN k USING (document_id, entity_id)) SELECT * FROM o""")),
    "j14_seeded_exec_gate": (lambda s: docs(s).where(F.contains(F.lower(F.concat_ws(" ", "title", F.substring("text", 1, 600))), F.lit("ertion")) & F.contains(F.lower(F.concat_ws(" ", "title", F.substring("text", 1, 600))), F.lit("onre"))).select("doc_id"),
        "WITH d AS (SELECT doc_id, lower(split_part(text, chr(10), 1) || ' ' || substr(text, 1, 600)) AS t FROM documents) SELECT doc_id FROM d WHERE contains(t, 'ertion') AND contains(t, 'onre')"),
    "j17_rematch_recent": (lambda s: visible(s).join(s.documents.where(F.col("collected_at") >= F.expr(f"{TS} - INTERVAL 30 DAYS")), "document_id", "left_semi").join(s.mentions.where("entity_id = 5").select("document_id"), "document_id", "left_anti"),
        with_star(f"{VISIBLE_SQL} SELECT client_id, document_id FROM visible WHERE document_id IN (SELECT document_id FROM docs WHERE collected_at >= {TS} - INTERVAL 30 DAY) AND document_id NOT IN (SELECT document_id FROM mentions WHERE entity_id = 5)")),
    "j18_parent_self_join": (lambda s: s.entities.where("entity_type = 'product'").alias("p").join(s.entities.where("entity_type IN ('brand', 'competitor')").alias("q"), "client_id").groupBy("client_id", F.col("p.entity_id").alias("product")).agg(F.min("q.entity_id").alias("parent")),
        with_star("x AS (SELECT 1) SELECT p.client_id, p.entity_id AS product, min(q.entity_id) AS parent FROM entities p JOIN entities q USING (client_id) WHERE p.entity_type = 'product' AND q.entity_type IN ('brand', 'competitor') GROUP BY ALL")),
    "j21_hidden_duplicates": (lambda s: (e := s.entities.withColumn("name_key", F.col("entity_id") % 40)).where("entity_id % 3 <> 0").join(e.where("entity_id % 3 = 0").select("client_id", "name_key"), ["client_id", "name_key"], "left_semi").select("entity_id"),
        with_star("e AS (SELECT *, entity_id % 40 AS k FROM entities) SELECT entity_id FROM e WHERE entity_id % 3 <> 0 AND (client_id, k) IN (SELECT (client_id, k) FROM e WHERE entity_id % 3 = 0)")),
    "j24_brand_docs_by_text": (lambda s: gates.brand_documents(s.mentions, s.entities).union(s.documents.where(F.contains("title", F.lit("item 7"))).select((F.col("document_id") % 25).alias("client_id"), "document_id")).distinct().groupBy("client_id").agg(F.count("*").alias("documents")),
        star_sql("u AS (SELECT client_id, document_id FROM brand_docs UNION SELECT document_id % 25, document_id FROM docs WHERE contains(title, 'item 7')) SELECT client_id, count(*) AS documents FROM u GROUP BY 1")),
    "j25_match_gap": (lambda s: lookups.match_gap(s.documents, s.mentions, s.entities, visible(s).where("document_id % 3 <> 0")).groupBy("client_id").agg(F.count("*").alias("gap")),
        star_sql("SELECT client_id, count(*) AS gap FROM brand_docs WHERE document_id % 3 = 0 AND document_id IN (SELECT document_id FROM docs) GROUP BY 1")),
    "j26_name_lookup": (lambda s: lookups.name_lookup(ASKED, s.spark, s.entities.select(F.col("entity_name").alias("name"))),
        with_star("q AS (SELECT unnest([" + ", ".join(f"'{a}'" for a in ASKED) + """]) AS query), e AS (SELECT query, min(entity_name) AS exact FROM q JOIN entities ON lower(entity_name) = lower(query) GROUP BY 1),
p AS (SELECT query, count(*) AS n, min(entity_name) AS partial FROM q JOIN entities ON contains(lower(entity_name), lower(query)) WHERE query NOT IN (SELECT query FROM e) GROUP BY 1)
SELECT query, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'partial' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how, coalesce(exact, CASE WHEN n = 1 THEN partial END) AS name FROM q LEFT JOIN e USING (query) LEFT JOIN p USING (query)""")),
    "j28_due_feeds": (lambda s: lookups.due_feeds(feeds(s), daily_runs(s).select((F.col("user_id")).alias("source_id"), "status"), AS_OF).select("source_id", "client_id", "batch"),
        with_star(f"""{FEEDS_SQL}, {RUNS_SQL}, f AS (SELECT * FROM fd WHERE active AND (last_polled IS NULL OR last_polled < {TS} - INTERVAL 1 DAY) AND source_id NOT IN (SELECT user_id FROM runs WHERE status = 'RUNNING'))
SELECT source_id, client_id, CAST(floor((row_number() OVER (PARTITION BY client_id ORDER BY last_polled NULLS FIRST, source_id) - 1) / 5) AS INT) AS batch FROM f""")),
    "j29_revival_feeds": (lambda s: lookups.revival_feeds(feeds(s), AS_OF, 60).select("source_id"), with_star(f"{FEEDS_SQL} SELECT source_id FROM fd WHERE NOT active AND (last_polled IS NULL OR last_polled < {TS} - INTERVAL 60 DAY)")),
    "j22_claim_to_incident": (lambda s: lookups.claim_status(s.documents.select("document_id"), incidents.incidents(incident_items(s)).select("item_id.document_id", "incident_id")).select("document_id", "status", "incidents"),
        star_sql("i AS (SELECT DISTINCT document_id, entity_id FROM events WHERE risk_score > 50) SELECT d.document_id, CASE WHEN count(i.entity_id) > 0 THEN 'matched' ELSE 'open' END AS status, count(i.entity_id) AS incidents FROM docs d LEFT JOIN i USING (document_id) GROUP BY 1")),
    "m6_best_match_per_entity": (lambda s: best_match_per_entity(match_confidence(matches(s))).select("doc_id", "entity_id", "start_idx", "keyword", "confidence"),
        f"WITH {MATCHED_SQL} SELECT doc_id, entity_id, start_idx, keyword, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_id ORDER BY confidence DESC, start_idx, keyword) AS k FROM s) WHERE k = 1"),
    "m11_discover_candidates": (lambda s: lookups.discovered(name_facts(s), s.spark.createDataFrame([("en", "the"), ("de", "die"), ("fr", "de")], "client_id string, name_key string")),
        f"WITH {NAMES_SQL} SELECT client_id, name_key, count(DISTINCT document_id) AS documents, count(*) AS mentions, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM nf WHERE (client_id, name_key) NOT IN (('en', 'the'), ('de', 'die'), ('fr', 'de')) GROUP BY 1, 2"),
    "m12_person_confidence": (lambda s: rounded(lookups.person_confidence(s.mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("documents")).withColumns({"parts": F.lit(2), "title_nearby": F.col("entity_id") % 2 == 0, "tracked_surname": F.col("entity_id") % 3 == 0})).select("entity_id", "confidence")),
        with_star("m AS (SELECT entity_id, count(*) AS n, count(DISTINCT document_id) AS d FROM mentions GROUP BY 1) SELECT entity_id, round(least(0.5 + 0.1 + least((n - 1) * 0.05, 0.15) + least((d - 1) * 0.05, 0.20) + CASE WHEN entity_id % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN entity_id % 6 = 0 THEN 0.20 ELSE 0 END, 1.0)::DOUBLE, 6) AS confidence FROM m")),
    "m15_promotion_gate": (lambda s: lookups.promotion_gate(s.mentions.groupBy("part_id").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("documents"), F.max("confidence").alias("confidence"), F.countDistinct(F.when(F.col("entity_id") % 5 == 0, F.col("document_id"))).alias("related_documents")).withColumn("title_nearby", F.col("part_id") % 4 != 0)).groupBy("held_reason").agg(F.count("*").alias("candidates")),
        with_star("""m AS (SELECT part_id, count(*) AS n, count(DISTINCT document_id) AS d, max(confidence) AS c, count(DISTINCT CASE WHEN entity_id % 5 = 0 THEN document_id END) AS r FROM mentions GROUP BY 1),
g AS (SELECT CASE WHEN n < 2 THEN 'mentions' WHEN d < 2 THEN 'documents' WHEN c < 0.65 THEN 'confidence' WHEN r < 2 THEN 'related documents' WHEN part_id % 4 = 0 THEN 'title evidence' END AS held_reason FROM m) SELECT held_reason, count(*) AS candidates FROM g GROUP BY 1""")),
    "m17_bare_alias_measure": (lambda s: rounded(lookups.alias_measure(docs(s).select(F.col("source").alias("alias"), (F.col("doc_id") % 11 == 0).alias("false_match")))),
        "WITH a AS (SELECT source AS alias, count(*) AS documents, count(*) FILTER (doc_id % 11 = 0) AS false_matches FROM documents GROUP BY 1) SELECT *, round(false_matches / documents::DOUBLE, 6) AS rate, documents >= 20 AND false_matches / documents::DOUBLE <= 0.10 AS enabled FROM a"),
    "x14_person_name_validity": (
        lambda s: s.mentions.groupBy("label", "line").agg(F.count("*").alias("rows")).withColumn("tail", F.element_at(F.array(*map(F.lit, NAME_TAILS)), F.col("line"))).select(F.concat("label", "tail").alias("name"), "rows").select("name", "rows", names.person_name(F.col("name"), F.array(F.lit("neutral")))[1].alias("layer")),
        with_star(f"""n AS (SELECT label, line, count(*) AS rows FROM mentions GROUP BY 1, 2) SELECT label || {_case("line - 1", NAME_TAILS)} AS name, rows,
CASE line WHEN 1 THEN CASE WHEN label = 'Neutral' THEN 'self reference' END WHEN 2 THEN 'case' WHEN 3 THEN 'corporate' WHEN 4 THEN 'characters' WHEN 5 THEN CASE WHEN label = 'Neutral' THEN 'self reference' END WHEN 6 THEN 'publisher' ELSE 'parts' END AS layer FROM n""")),
    "x15_org_name_validity": (
        lambda s: s.entities.withColumn("n", F.element_at(F.array(*map(F.lit, ORG_NAMES)), (F.col("entity_id") % len(ORG_NAMES) + 1).cast("int"))).select("entity_id", names.company_name(F.coalesce(F.nullif("n", F.lit("")), "entity_name"), F.array(F.lit("supplier#000000003")))[1].alias("layer")),
        with_star("x AS (SELECT 1) SELECT entity_id, CASE entity_id % 9 WHEN 0 THEN 'ordinal' WHEN 1 THEN 'price' WHEN 2 THEN 'media' WHEN 3 THEN CASE WHEN entity_id = 3 THEN 'self reference' END WHEN 4 THEN 'possessive' WHEN 5 THEN 'words' WHEN 6 THEN 'exchange' WHEN 7 THEN 'market' ELSE 'domain' END AS layer FROM entities")),
    "x19_name_role_proximity": (
        lambda s: role_pages(s).select("document_id", names.near_role(F.col("text"), F.lit("Ann Rao"), names.ROLE_SYNONYMS["md_ceo"]).alias("near")),
        with_star("x AS (SELECT 1) SELECT document_id, document_id % 400 <= 295 AS near FROM docs")),
    "x20_ownership_evidence": (
        lambda s: owner_pages(s).select("document_id", names.ownership(F.col("text"), F.lit("Orris Homes"), F.lit("Acme Group")).alias("owned")),
        with_star("x AS (SELECT 1) SELECT document_id, document_id % 200 <= 144 AND document_id % 7 <> 0 AS owned FROM docs")),
    "x21_text_grounding": (lambda s: names.grounded(answers(s).select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), "text"), s.table("conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("answer_id"), F.col("text").alias("record"))), r"""WITH a AS (SELECT conv_id || '-' || turn AS answer_id, text, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}_]+')), lambda w: length(w) >= 4) AS w FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id || '-' || (turn + 1) AS answer_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}_]+')) AS w FROM conversations WHERE role = 'user'), c AS (SELECT answer_id, list(DISTINCT w) AS cited FROM u WHERE length(w) >= 4 GROUP BY 1)
SELECT answer_id, coalesce(bool_or(len(list_intersect(w, cited)) > 0), FALSE) OR bool_or(trim(coalesce(text, '')) = '') AS grounded FROM a LEFT JOIN c USING (answer_id) GROUP BY 1"""),
    "l10_topic_explain": (lambda s: s.topics.groupBy("document_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set(F.when((F.col("topic_confidence") < 0.5) & (F.col("topic_confidence") >= 0.15), F.col("topic")))), 1, 3), ",").alias("competing")),
        with_star("t AS (SELECT document_id, list_sort(list(DISTINCT CASE WHEN topic_confidence < 0.5 AND topic_confidence >= 0.15 THEN topic END) FILTER (topic_confidence < 0.5 AND topic_confidence >= 0.15))[1:3] AS l FROM topics GROUP BY 1) SELECT document_id, coalesce(array_to_string(l, ','), '') AS competing FROM t")),
    "g14_telemetry": (telemetry, star_sql(f"""{VISIBLE_SQL}, p AS (SELECT client_id, document_id, max(risk_score) AS score FROM events GROUP BY ALL)
SELECT v.client_id, count(*) AS documents, count(sentiment_score) AS with_sentiment, count(score) AS with_risk, round(count(*) FILTER (score > 0) / count(*)::DOUBLE * 100, 6) AS scored_rate, max(collected_at) AS last_seen
FROM visible v LEFT JOIN docs d ON d.document_id = v.document_id LEFT JOIN p ON p.client_id = v.client_id AND p.document_id = v.document_id GROUP BY 1""")),
    "g15_client_processing_summary": (lambda s: client_counts(s).join(_events(s).groupBy("client_id").agg(F.count("*").alias("risks")), "client_id", "left").na.fill(0),
        star_sql(f"{COUNTS_SQL}, r AS (SELECT client_id, count(*) AS risks FROM events GROUP BY 1) SELECT cc.*, coalesce(risks, 0) AS risks FROM cc LEFT JOIN r USING (client_id)")),
    "g23_candidate_confidence_avg": (lambda s: rounded(s.mentions.where("line = 1").select("confidence").unionByName(s.mentions.where("line = 2").select("confidence")).agg(F.avg("confidence").alias("mean"))),
        with_star("x AS (SELECT 1) SELECT round(avg(confidence), 6) AS mean FROM mentions WHERE line IN (1, 2)")),
    "g24_exec_stats": (lambda s: (e := scores.executive_score(s.entities, s.documents, s.mentions, _events(s), as_of=AS_OF).withColumn("score", F.round("score", 6))).agg(F.min_by("entity_id", F.struct(-F.col("documents"), F.col("entity_id"))).alias("most_mentioned"), F.min_by("entity_id", F.struct(-F.col("score"), F.col("entity_id"))).alias("highest"), F.min_by("entity_id", F.struct("score", "entity_id")).alias("lowest")),
        _EXECUTIVE_SQL.rpartition("SELECT client_id, entity_id, documents")[0] + "SELECT arg_min(entity_id, (-documents, entity_id)) AS most_mentioned, arg_min(entity_id, (-round(score, 6), entity_id)) AS highest, arg_min(entity_id, (round(score, 6), entity_id)) AS lowest FROM z"),
    "g30_baseline_snapshot": (snapshot, with_star("x AS (SELECT 1) SELECT 'entity type' AS kind, coalesce(entity_type, 'none') AS name, count(*) AS rows FROM entities GROUP BY 2 UNION ALL SELECT 'document type', document_type, count(*) FROM docs GROUP BY 2 UNION ALL SELECT 'source category', category, count(*) FROM docs JOIN sources USING (source_id) GROUP BY 2")),
    "g37_gn_count": (lambda s: s.documents.groupBy("source_id", F.expr("make_date(year(collected_at), CASE WHEN month(collected_at) <= 6 THEN 1 ELSE 7 END, 1)").alias("slice")).agg(F.count("*").alias("n")).groupBy("source_id").agg(F.sum("n").alias("items"), F.bool_or(F.col("n") >= 4).alias("capped")),
        with_star("h AS (SELECT source_id, make_date(CAST(year(collected_at) AS INT), CASE WHEN month(collected_at) <= 6 THEN 1 ELSE 7 END, 1) AS slice, count(*) AS n FROM docs GROUP BY ALL) SELECT source_id, sum(n)::BIGINT AS items, bool_or(n >= 4) AS capped FROM h GROUP BY 1")),
    "g41_search_totals": (lambda s: calls(s).agg(F.countDistinct("client_id").alias("clients"), F.count("*").alias("jobs"), F.sum("tokens").alias("found")), calls_sql("SELECT count(DISTINCT client_id) AS clients, count(*) AS jobs, sum(tokens)::BIGINT AS found FROM calls")),
    "g45_llm_usage": (lambda s: rounded(calls(s).groupBy("call_type").agg(F.count("*").alias("calls"), F.avg("tokens").alias("mean_tokens"), (F.count_if("success") / F.count("*")).alias("success_rate"))),
        calls_sql("SELECT call_type, count(*) AS calls, round(avg(tokens), 6) AS mean_tokens, round(count(*) FILTER (success) / count(*)::DOUBLE, 6) AS success_rate FROM calls GROUP BY 1")),
    "g46_acceptance_report": (lambda s: lookups.acceptance(client_counts(s), CHECKS), with_star(f"""{COUNTS_SQL}, r AS (SELECT client_id, 'documents' AS check_name, CASE WHEN documents >= 400 THEN 'PASS' WHEN documents >= 10 THEN 'WARN' ELSE 'FAIL' END AS result FROM cc UNION ALL
SELECT client_id, 'entities', CASE WHEN entities >= 4 THEN 'PASS' WHEN entities >= 1 THEN 'WARN' ELSE 'FAIL' END FROM cc UNION ALL SELECT client_id, 'mentions', CASE WHEN mentions >= 2000 THEN 'PASS' WHEN mentions >= 100 THEN 'WARN' ELSE 'FAIL' END FROM cc)
SELECT *, CASE WHEN bool_or(result = 'FAIL') OVER w THEN 'FAIL' WHEN bool_or(result = 'WARN') OVER w THEN 'WARN' ELSE 'PASS' END AS overall FROM r WINDOW w AS (PARTITION BY client_id)""")),
    "g47_summary_verdict": (verdicts, star_sql(f"""{COUNTS_SQL}, e AS (SELECT client_id, count(*) FILTER (risk_score > 99.9) AS critical, count(*) FILTER (risk_score > 25) AS flagged FROM events WHERE entity_type IS DISTINCT FROM 'competitor' GROUP BY 1)
SELECT client_id, CASE WHEN client_id % 9 = 0 THEN 'alert' WHEN critical > 0 THEN 'danger' WHEN flagged > 0 THEN 'flagged' WHEN documents = 0 THEN 'no data' ELSE 'clear' END AS verdict FROM cc LEFT JOIN e USING (client_id)""")),
    "w3_benchmark_rank": (lambda s: _benchmark("competitor", 365, True)(s).select("client_id", "entity_id", "rank"), star_sql(_benchmark_sql("competitor", 365, True) + "\nSELECT client_id, entity_id, rank FROM bench")),
    "w4_client_rank": (lambda s: lookups.client_rank(s.clients.select("client_id", (F.col("client_id") * 2.0).alias("score"), F.col("client_id").alias("entity_id")), s.entities.where("entity_type = 'competitor'").select("client_id", "entity_id", (F.col("entity_id") % 50).cast("double").alias("score"))),
        with_star("x AS (SELECT 1) SELECT c.client_id, count(e.entity_id) FILTER (e.entity_id % 50 > c.client_id * 2 OR (e.entity_id % 50 = c.client_id * 2 AND e.entity_id < c.client_id)) + 1 AS rank FROM clients c LEFT JOIN (SELECT * FROM entities WHERE entity_type = 'competitor') e USING (client_id) GROUP BY 1")),
    "w7_latest_run_only": (lambda s: (r := daily_runs(s)).join(r.groupBy("user_id").agg(F.max("day").alias("day")), ["user_id", "day"], "left_semi").select("user_id", "day", "status"), f"WITH {RUNS_SQL} SELECT user_id, day, status FROM runs WHERE (user_id, day) IN (SELECT (user_id, max(day)) FROM runs GROUP BY user_id)"),
    "w10_fresh_enough": (lambda s: lookups.fresh_enough(_events(s).select("client_id", F.col("created_at").alias("at")), gates.client_mentions(s.mentions, s.entities, s.documents).select("client_id", F.col("effective_at").alias("at")), AS_OF, 48),
        star_sql(f"a AS (SELECT client_id, max(created_at) AS last_score FROM events GROUP BY 1), b AS (SELECT client_id, max(effective_at) AS last_mention FROM facts GROUP BY 1) SELECT client_id, last_score, last_mention, last_score >= {TS} - INTERVAL 48 HOUR AND NOT coalesce(last_mention > last_score, FALSE) AS skip FROM a LEFT JOIN b USING (client_id)")),
    "k4_top_risks": (lambda s: ranks.top_per_key(gates.without_competitors(_events(s)).select("client_id", "document_id", F.bround("risk_score").alias("shown")).groupBy("client_id", "document_id").agg(F.max("shown").alias("shown")), ["client_id"], [F.desc("shown"), "document_id"], 20).select("client_id", "document_id", "rn"),
        star_sql("e AS (SELECT client_id, document_id, max(round_even(risk_score, 0)) AS shown FROM events WHERE entity_type IS DISTINCT FROM 'competitor' GROUP BY ALL), t AS (SELECT client_id, document_id, row_number() OVER (PARTITION BY client_id ORDER BY shown DESC, document_id) AS rn FROM e) SELECT * FROM t WHERE rn <= 20")),
    "k6_nlp_priority_queue": (lambda s: lookups.priority_queue(visible(s).join(s.documents, "document_id"), "client_id", F.col("sentiment_label") == "Negative", "published_at", 40).select("client_id", "document_id", "place"),
        with_star(f"{VISIBLE_SQL}, t AS (SELECT client_id, document_id, row_number() OVER (PARTITION BY client_id ORDER BY sentiment_label = 'Negative' DESC, published_at DESC NULLS LAST, document_id) AS place FROM visible JOIN docs USING (document_id)) SELECT * FROM t WHERE place <= 40")),
    "k11_benchmark_listing": (lambda s: _benchmark("competitor", 365, True)(s).withColumn("place", F.row_number().over(Window.partitionBy("client_id").orderBy(F.col("rank") == 0, "rank", "entity_name"))).where("place <= 10").select("client_id", "entity_id", "place"),
        star_sql(_benchmark_sql("competitor", 365, True) + ", t AS (SELECT client_id, entity_id, row_number() OVER (PARTITION BY client_id ORDER BY rank = 0, rank, entity_name) AS place FROM bench)\nSELECT * FROM t WHERE place <= 10")),
    "k14_stale_pending": (lambda s: s.documents.where(f"published_at IS NULL AND collected_at < {TS} - INTERVAL 1 HOUR").orderBy("collected_at", "document_id").limit(200).select("document_id"),
        with_star(f"x AS (SELECT 1) SELECT document_id FROM docs WHERE published_at IS NULL AND collected_at < {TS} - INTERVAL 1 HOUR ORDER BY collected_at, document_id LIMIT 200")),
    "o1_term_union": (lambda s: s.entities.where("entity_type = 'brand'").select(F.lower("entity_name").alias("term")).union(s.entities.where("entity_type = 'product'").select(F.lower("entity_name"))).distinct(), with_star("x AS (SELECT 1) SELECT lower(entity_name) AS term FROM entities WHERE entity_type = 'brand' UNION SELECT lower(entity_name) FROM entities WHERE entity_type = 'product'")),
    "o5_merged_documents": (lambda s: (a := stored_alerts(s))[0].select("entity_id", F.col("documents").alias("x")).join(a[1].select("entity_id", F.col("documents").alias("y")), "entity_id").select("entity_id", F.size(F.array_union("x", "y")).alias("documents")),
        with_star("d AS (SELECT entity_id, min(document_id) AS lo, max(document_id) AS hi FROM mentions GROUP BY 1) SELECT entity_id, CASE WHEN lo = hi THEN 1 ELSE 2 END AS documents FROM d JOIN entities USING (entity_id) WHERE entity_id % 3 <> 0 AND entity_id % 5 <> 0")),
    "c6_duplicate_name_groups": (lambda s: s.entities.groupBy("client_id", (F.col("entity_id") % 30).alias("name_key")).agg(F.count("*").alias("names"), F.min("entity_id").alias("least")).where("names >= 2"),
        with_star("x AS (SELECT 1) SELECT client_id, entity_id % 30 AS name_key, count(*) AS names, min(entity_id) AS least FROM entities GROUP BY ALL HAVING count(*) >= 2")),
    "al4_active_alerts": (lambda s: gates.brand_gate(alerts.alert_candidates(gates.without_competitors(_events(s)).withColumn("risk_score", F.round("risk_score", 6))), gates.brand_documents(s.mentions, s.entities), s.entities).groupBy("client_id").agg(F.count("*").alias("alerts")),
        star_sql(f"t AS (SELECT client_id, document_id, entity_id, row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, round(risk_score, 6) DESC, document_id, entity_id) AS rn FROM events WHERE entity_type IS DISTINCT FROM 'competitor' AND round(risk_score, 6) > 50) SELECT client_id, count(*) AS alerts FROM {gated_sql('(SELECT * FROM t WHERE rn <= 15)')} GROUP BY 1")),
    "al7_plan_advisory": (lambda s: lookups.advised(s.clients, _events(s).withColumn("risk_score", F.round("risk_score", 6))),
        star_sql("p AS (SELECT client_id, arg_min(document_id, (-round(risk_score, 6), document_id)) AS d FROM events WHERE entity_type = 'person' GROUP BY 1), w AS (SELECT client_id, arg_min(document_id, (-round(risk_score, 6), document_id)) AS d FROM events GROUP BY 1) SELECT client_id, coalesce(p.d, w.d) AS document_id FROM clients LEFT JOIN p USING (client_id) LEFT JOIN w USING (client_id)")),
}
