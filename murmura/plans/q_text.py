"""Registered queries: collectors, cleaning, deduplication, matching, labels, title rules, incidents, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions import common, text
from murmura.operators import incidents, ingest, labels, matching, risk
from murmura.plans.q_scores import _REACH, _TIER, _events, rounded, star_sql
from murmura.plans.star import Star, with_star
from murmura.sources import normalize

ROSTER = ["the", "of the", "in the", "and", "ertion", "der", "und die", "les", "de la", "para", "erten", "onti the"]
FIRST_LINE = "split_part(text, chr(10), 1)"


def docs(s: Star) -> DataFrame:
    return s.table("documents").withColumn("title", F.split("text", "\n")[0])


def raw_items(s: Star, kind: str) -> DataFrame:
    """Payloads of one collector made of the documents."""
    d = docs(s).withColumn("at", F.expr("timestampadd(MINUTE, doc_id, TIMESTAMP '2024-01-01 00:00:00')"))
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body, url = F.col("text"), F.concat(F.lit("https://x.example/"), F.col("doc_id"))
    shapes = {
        "gdelt": F.struct(F.col("title"), url.alias("url"), F.when(F.col("doc_id") % 7 == 0, "bad").otherwise(F.date_format("at", "yyyyMMdd'T'HHmmss'Z'")).alias("seendate")),
        "hn": F.struct("title", F.when(F.col("doc_id") % 3 != 0, url).alias("url"), F.col("doc_id").cast("string").alias("objectID"), F.when(F.col("doc_id") % 2 == 0, body).alias("story_text"), F.col("source").alias("author"), iso.alias("created_at")),
        "youtube": F.struct(F.col("doc_id").cast("string").alias("id"), F.struct("title", F.col("text").alias("description"), F.col("source").alias("channelTitle"), iso.alias("publishedAt")).alias("snippet"),
            F.struct((F.col("doc_id") * 37).cast("string").alias("viewCount"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).otherwise("n/a").alias("commentCount")).alias("statistics")),
        "instagram": F.struct(url.alias("url"), F.col("text").alias("caption"), F.col("source").alias("ownerUsername"), iso.alias("timestamp"), (F.col("doc_id") % 50).cast("int").alias("commentsCount"), F.when(F.col("doc_id") % 4 == 0, F.col("doc_id").cast("int")).alias("videoViewCount")),
        "reddit": F.struct("title", F.col("text").alias("body"), url.alias("url"), F.col("source").alias("username"), (F.col("doc_id") % 90).cast("int").alias("upVotes"), (F.col("doc_id") % 30).cast("int").alias("numberOfComments"), iso.alias("createdAt")),
        "rss": F.struct("title", url.alias("link"), F.col("source").alias("author"), F.array(*(F.date_part(F.lit(p), F.col("at")).cast("int") for p in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE")), F.lit(0)).alias("published_parsed"), F.concat(F.lit("<p>"), body, F.lit("</p>")).alias("summary")),
    }
    return d.select("doc_id", F.to_json(shapes[kind]).alias("payload"), F.lit(kind).alias("source_format"))


def _norm(kind: str, **kw):
    return lambda s: normalize.NORMALIZERS[kind](raw_items(s, kind), ["doc_id"], **kw).select("doc_id", "title", F.length("content").alias("n"), "url", "author", "published_at", "view_count", "comment_count")


def _norm_sql(kind: str, url: str, n: str, at: str, views: str = "NULL::INT", comments: str = "NULL::INT", author: str = "source", title: str = FIRST_LINE, where: str = "TRUE") -> str:
    return f"""WITH d AS (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS at0 FROM documents)
SELECT doc_id, {title} AS title, {n} AS n, {url} AS url, {author} AS author, {at} AS published_at, {views} AS view_count, {comments} AS comment_count FROM d WHERE {where}"""


_URL = "'https://x.example/' || doc_id"


def dispatched(s: Star) -> DataFrame:
    both = raw_items(s, "gdelt")
    for k in ("hn", "youtube", "instagram", "reddit", "rss"):
        both = both.unionByName(raw_items(s, k))
    return normalize.dispatch(both, ["doc_id"]).select("doc_id", "source_type", "title", "url", "published_at")


_DISPATCH_SQL = "WITH d AS (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS at0 FROM documents)\n" + " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS source_type, {title} AS title, {url} AS url, {at} AS published_at FROM d"
    for kind, title, url, at in (
        ("rss", FIRST_LINE, _URL, "at0"), ("gdelt", FIRST_LINE, _URL, "CASE WHEN doc_id % 7 <> 0 THEN at0 END"),
        ("hn_algolia", FIRST_LINE, f"CASE WHEN doc_id % 3 <> 0 THEN {_URL} ELSE 'https://news.ycombinator.com/item?id=' || doc_id END", "at0"),
        ("youtube", FIRST_LINE, "'https://youtu.be/' || doc_id", "at0"),
        ("instagram", "CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END", _URL, "at0"), ("reddit", FIRST_LINE, _URL, "at0"),
    )
)


def dedupe_input(s: Star) -> DataFrame:
    return s.documents.select(F.col("document_id").alias("id"), F.col("url").alias("url_key"), F.col("content_hash").alias("hash_key"), F.col("collected_at"))


def matches(s: Star) -> DataFrame:
    """Spans of the roster with owners and what each document says about them."""
    owners = [(k, i, i % 3, "PRIMARY" if i % 2 == 0 else "ALIAS") for i, k in enumerate(ROSTER)] + [("ertion", 100, 1, "ALIAS")]
    roster = s.spark.createDataFrame(owners, "keyword string, entity_id int, client_id int, category string")
    rows = matching.with_owners(matching.keyword_spans(docs(s), ROSTER), roster).withColumn("entity_name", F.initcap("keyword"))
    pairs = rows.select("doc_id", "entity_id", "entity_name").distinct().join(docs(s).select("doc_id", "text"), "doc_id")
    pairs = pairs.withColumns({"domain": F.lit(None).cast("string"), "industry": F.lit("edble"), "executive_terms": F.array(F.lit("thand"), F.lit("onre")), "product_terms": F.array(F.lit("ingwh"))})
    return rows.join(matching.entity_context(pairs).drop("entity_name"), ["doc_id", "entity_id"])


_SPAN = r"\b(?:" + "|".join(sorted(ROSTER, key=len, reverse=True)) + r")\b"


def sentiment_input(s: Star) -> DataFrame:
    words = ["", " fine", " court case", " lawsuit", " profit up", " record debt", " crash course", " beat", " safety data issue"]
    k = F.col("doc_id")
    add = F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    lab = F.element_at(F.array(F.lit("neutral"), F.lit("negative"), F.lit("positive")), (k % 3 + 1).cast("int"))
    return docs(s).select("doc_id", F.concat("text", add).alias("text"), lab.alias("raw_label"), ((k % 50) / 100.0 + 0.5).cast("double").alias("raw_score"))


TITLES = ["RERA fines {n} Rs 12 lakh", "Stocks of {n} fall 4%", "{n} Q2 net profit up", "ED probe into {n} fraud of Rs 40 crore", "{n} settles case", "High Court orders refund by {n}", "Book now 3 BHK at {n}", "{n} opens plant"]


def titled(s: Star) -> DataFrame:
    """Risk events with titles that the title rules read."""
    k = F.col("document_id") + F.col("entity_id")
    title = F.replace(F.element_at(F.array(*map(F.lit, TITLES)), (k % len(TITLES) + 1).cast("int")), F.lit("{n}"), F.col("entity_name"))
    return _events(s).select(
        "document_id", "entity_id", "entity_name", "entity_type", "document_type", "sentiment", "published_at", F.col("risk_score"), title.alias("title"), (k % len(TITLES)).alias("k"),
        F.when(k % 19 == 0, "BYSTANDER").alias("role"), F.element_at(F.array(*map(F.lit, ["allegation", "penalty_or_order", "settled", "probe"])), (k % 4 + 1).cast("int")).alias("case_status"),
        F.when(k % 3 == 0, "NDTV India").otherwise("someone").alias("author"), (k * 101 % 200000).alias("view_count"),
    )


STORY_WORDS = ["bridge", "harbour", "turbine", "ledger", "warehouse", "signal", "pipeline", "voucher", "orchard", "tunnel", "reactor", "satellite"]
ACTS = ["raid", "office", "search", "refund", "order", "betting", "license", "dispute"]


def incident_items(s: Star) -> DataFrame:
    """Flagged documents of each entity as items; titles out of a few stories, some with an event, dated by publication."""
    k = F.col("document_id")
    pick = lambda i: F.element_at(F.array(*map(F.lit, STORY_WORDS)), (F.pmod(i, F.lit(len(STORY_WORDS))) + 1).cast("int"))
    title = F.concat_ws(" ", pick(k % 5), pick(k % 5 + 3), pick(k % 7 + 5), pick(k % 3 + 1), F.lit("closes"))
    act = lambda i: F.element_at(F.array(*map(F.lit, ACTS)), (F.pmod(i, F.lit(len(ACTS))) + 1).cast("int"))
    event = F.when(k % 6 == 0, F.concat_ws(" ", act(k % 11), act(k % 11 + 2), act(k % 13 + 1))).when(k % 17 == 0, act(k % 11))
    rows = _events(s).where("risk_score > 50")
    item = F.struct("document_id", "entity_id").alias("item_id")
    return rows.select(item, "entity_id", "entity_name", F.concat(title, F.lit(" - Reuters")).alias("title"), event.alias("event"), "published_at", F.col("risk_score").alias("score"))


def _ids(df: DataFrame, *columns: str) -> DataFrame:
    """Items as two plain columns each."""
    parts = [F.col(f"{c}.{k}").alias(f"{c.removesuffix('_id')}_{k}") for c in columns for k in ("document_id", "entity_id")]
    return df.select(*parts, *(c for c in df.columns if c not in columns))


def answers(s: Star) -> DataFrame:
    return s.table("conversations").where("role = 'assistant'").select("conv_id", "turn", "text")


def cited(s: Star) -> DataFrame:
    """Pages that each answer cites: every page belongs to one question, two of three of its answers cite it."""
    n = s.table("conversations").agg(F.max("conv_id")).first()[0] + 1
    p = s.table("pages").select("page_id", "url", F.pmod("page_id", F.lit(n)).alias("conv_id"))
    a = answers(s).select("conv_id", "turn").distinct().join(p, "conv_id").where((F.col("page_id") + F.col("turn")) % 3 != 0)
    return a.withColumn("host", F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", ""))


CITED_SQL = """a AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant'),
c AS (SELECT a.*, page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM a JOIN pages ON a.conv_id = page_id % (SELECT max(conv_id) + 1 FROM conversations)
  WHERE (page_id + turn) % 3 <> 0)"""


def stability(s: Star) -> DataFrame:
    """Share of a question's pages that all of its repeats cite."""
    per = cited(s).groupBy("conv_id", "page_id").agg(F.countDistinct("turn").alias("k"))
    n = answers(s).groupBy("conv_id").agg(F.countDistinct("turn").alias("repeats"))
    return rounded(per.join(n, "conv_id").groupBy("conv_id").agg((F.count_if(F.col("k") == F.col("repeats")) / F.count("*")).alias("shared")))


def sentences(s: Star) -> DataFrame:
    """Sentences of five words or more that several answers hold, with the questions that hold them."""
    rows = answers(s).select("conv_id", "turn", F.explode(F.split("text", r"[.!?\n]+")).alias("sentence"))
    keyed = rows.withColumn("key", F.trim(F.regexp_replace(F.lower("sentence"), r"[ \t,;:]+", " "))).where(F.size(F.split("key", " ")) >= 5)
    return keyed.groupBy("key").agg(F.countDistinct("conv_id").alias("questions"), F.count("*").alias("occurrences")).where("occurrences > 1")


_KEEP = "regexp_extract_all(lower(text), '" + _SPAN + "')"

#: Every match with its place, owners, confidence and status: what stands between matches tells their places.
_OWNERS = [(k, i, i % 3, "PRIMARY" if i % 2 == 0 else "ALIAS") for i, k in enumerate(ROSTER)] + [("ertion", 100, 1, "ALIAS")]
MATCHED_SQL = rf"""x AS (SELECT doc_id, lower(text) AS low, {_KEEP} AS k, string_split_regex(lower(text), '{_SPAN}') AS p FROM documents),
y AS (SELECT doc_id, low, k, p, unnest(range(1, len(k) + 1)) AS i FROM x),
z AS (SELECT doc_id, low, k[i] AS keyword, CAST(coalesce(list_sum(list_transform(p[1:i], lambda t: length(t))), 0) + coalesce(list_sum(list_transform(k[1:i - 1], lambda t: length(t))), 0) AS INTEGER) AS start_idx FROM y),
o(keyword, entity_id, category) AS (VALUES {", ".join(f"('{k}', {e}, '{c}')" for k, e, _, c in _OWNERS)}),
f AS (SELECT doc_id, start_idx, z.keyword, entity_id, CASE WHEN category = 'PRIMARY' THEN 0.85 ELSE 0.75 END::DOUBLE AS base, contains(low, 'thand') OR contains(low, 'onre') AS e, contains(low, 'ingwh') AS p, contains(low, 'edble') AS i,
  regexp_matches(substr(low, greatest(start_idx - 75, 0) + 1, start_idx + length(z.keyword) + 75 - greatest(start_idx - 75, 0)), '{"|".join(matching.BUSINESS_WORDS)}') AS n, length(z.keyword) <= 4 AS g FROM z JOIN o USING (keyword)),
c AS (SELECT doc_id, start_idx, keyword, CAST(entity_id AS INTEGER) AS entity_id, round(least(greatest(base + CASE WHEN e THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN p THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN i THEN 0.10::DOUBLE ELSE 0 END
  + CASE WHEN n THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN g AND NOT (e OR p) THEN -0.30::DOUBLE ELSE 0 END, 0.0), 1.0), 2)::DOUBLE AS confidence FROM f),
s AS (SELECT *, confidence >= 0.60 AS accepted, CASE WHEN max(confidence) OVER w - nth_value(confidence, 2) OVER (w ORDER BY confidence DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) <= 0.15 + 1e-9 THEN 'ambiguous'
  WHEN confidence >= 0.60 THEN 'accepted' ELSE 'rejected' END AS status FROM c WINDOW w AS (PARTITION BY doc_id, start_idx, keyword))"""

def _holds(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


#: Which words of the lexicon count, and where.
_WHERE = {
    "court": _holds(labels.LITIGATION), "fine": _holds(labels.LITIGATION), "crash": f"NOT {_holds(labels.BENIGN_CRASH)}", "safety data": _holds(labels.SAFETY_CONCERN),
    "beat": rf"regexp_matches(t, '\bbeat\b') AND NOT {_holds(labels.BEAT_NEGATIVE)}", "record": f"NOT {_holds(labels.RECORD_NEGATIVE)}",
}


def _counted(words: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains(t, '{w}') AND {_WHERE.get(w, 'TRUE')} THEN '{w}' END" for w in words) + "], lambda w: w IS NOT NULL)"


_SENTIMENT_SQL = f"""WITH r AS (SELECT doc_id, lower(text || (['', ' fine', ' court case', ' lawsuit', ' profit up', ' record debt', ' crash course', ' beat', ' safety data issue'])[CAST(doc_id % 9 + 1 AS INT)]) AS t,
  (['neutral', 'negative', 'positive'])[CAST(doc_id % 3 + 1 AS INT)] AS label, ((doc_id % 50) / 100.0::DOUBLE + 0.5)::DOUBLE AS score FROM documents),
w AS (SELECT *, {_counted(labels.NEGATIVE_WORDS)} AS bad, {_counted(labels.POSITIVE_WORDS)} AS good FROM r),
u AS (SELECT *, CASE WHEN len(bad) > 0 THEN CASE label WHEN 'neutral' THEN 'Negative-Risk Upgrade' WHEN 'negative' THEN 'Negative-Risk Boost' END
  WHEN len(good) > 0 THEN CASE label WHEN 'neutral' THEN 'Positive-Milestone Upgrade' WHEN 'positive' THEN 'Positive-Milestone Boost' END END AS rule FROM w),
v AS (SELECT *, least(score + CASE WHEN rule LIKE 'Negative%' THEN 0.15 WHEN rule LIKE 'Positive%' THEN 0.10 ELSE 0 END::DOUBLE, greatest(score, 1.0)) AS final FROM u)
SELECT doc_id, CASE WHEN rule IS NULL AND final < 0.65 THEN 'neutral' WHEN rule = 'Negative-Risk Upgrade' THEN 'negative' WHEN rule = 'Positive-Milestone Upgrade' THEN 'positive' ELSE label END AS label, round(final, 6) AS score,
  CASE WHEN rule IS NULL AND final < 0.65 THEN 'Low-Confidence Neutral Calibration' ELSE rule END AS rule, array_to_string((CASE WHEN len(bad) > 0 THEN bad ELSE good END)[1:3], ',') AS words FROM v"""

_SEGMENTS_SQL = r"""WITH p AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
a AS (SELECT doc_id, ps[3:] AS later, (CASE WHEN title <> '' THEN ['Title: ' || title] ELSE [] END) || ps[1:2] || (list_filter(ps[3:], lambda x: contains(lower(x), 'ertion') OR contains(lower(x), 'onre') OR contains(lower(x), 'eaux')))[1:4] AS l FROM p),
b AS (SELECT doc_id, later, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM a),
c AS (SELECT doc_id, CASE WHEN len(l) <= 3 THEN l || later[1:3] ELSE l END AS l FROM b), d AS (SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10) || chr(10)) AS w FROM c),
e AS (SELECT *, substr(w, 1, 2000) AS cut, regexp_extract(substr(w, 1, 2000), '(?s)^(.*[.?!])', 1) AS s FROM d)
SELECT doc_id, CASE WHEN length(w) <= 2048 THEN w WHEN length(s) > 1001 THEN s ELSE cut || '...' END AS segments FROM e"""

#: Rounds over what is left: rows that come first by both keys are stored (1), then those that share a key with one of them go (2).
ROUNDS_SQL = """w AS (SELECT id, u, h, came, 0 AS status FROM arrivals
  UNION ALL SELECT id, u, h, came, status FROM (
    SELECT id, u, h, came, CASE WHEN won THEN 1 WHEN bool_or(won) OVER (PARTITION BY u) OR bool_or(won) OVER (PARTITION BY h) THEN 2 ELSE 0 END AS status FROM (
      SELECT *, row_number() OVER (PARTITION BY u ORDER BY came, id) = 1 AND row_number() OVER (PARTITION BY h ORDER BY came, id) = 1 AS won FROM w WHERE status = 0)) WHERE status < 2)"""

def _words_of(text_sql: str) -> str:
    """SQL: distinct story words of a headline of `incident_items`; of these, none is a stop word or like an entity's name."""
    one = "CASE WHEN w = 'search' THEN 'raid' WHEN length(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END"
    return f"list_sort(list_distinct(list_transform(string_split({text_sql}, ' '), lambda w: {one})))"


def _picked(words: list[str], at: str) -> str:
    return f"([{', '.join(repr(w) for w in words)}])[CAST(({at}) % {len(words)} + 1 AS INT)]"


#: Items, all pairs of one entity that tell one story, and components by the smallest number reachable.
INCIDENTS_SQL = f"""fl AS (SELECT document_id AS k, entity_id, published_at, risk_score AS score FROM events WHERE risk_score > 50),
ti AS (SELECT *, {" || ' ' || ".join(_picked(STORY_WORDS, a) for a in ("k % 5", "k % 5 + 3", "k % 7 + 5", "k % 3 + 1"))} || ' closes' AS head,
  CASE WHEN k % 6 = 0 THEN {" || ' ' || ".join(_picked(ACTS, a) for a in ("k % 11", "k % 11 + 2", "k % 13 + 1"))} WHEN k % 17 = 0 THEN {_picked(ACTS, "k % 11")} END AS event FROM fl),
it AS (SELECT *, row_number() OVER (ORDER BY k, entity_id) AS id, {_words_of("head")} AS t, CASE WHEN event IS NULL THEN [] ELSE {_words_of("event")} END AS e FROM ti),
st AS (SELECT row_number() OVER () AS sid, entity_id, t, e FROM (SELECT DISTINCT entity_id, t, e FROM it)),
sp AS (SELECT a.sid AS x, b.sid AS y FROM st a JOIN st b ON a.entity_id = b.entity_id AND a.sid <= b.sid
  WHERE len(list_intersect(a.t, b.t)) >= 4 AND len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.5 OR len(list_intersect(a.e, b.e)) > 0 AND (len(list_intersect(a.e, b.e)) / len(list_distinct(a.e || b.e)) >= 0.5
    OR len(list_intersect(a.e, b.e)) >= 3 AND len(list_intersect(a.e, b.e)) / least(len(a.e), len(b.e)) >= 0.6)),
si AS (SELECT id, sid, published_at FROM it JOIN st USING (entity_id, t, e)),
eg AS (SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM sp JOIN si a ON a.sid = sp.x JOIN si b ON b.sid = sp.y
  WHERE a.id <> b.id AND coalesce(abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 45 * 86400000000, TRUE)),
bo AS (SELECT a, b FROM eg UNION ALL SELECT b, a FROM eg),
cc(id, root) USING KEY (id) AS (SELECT id, id AS root FROM it UNION (SELECT p.id, min(c.root) FROM recurring.cc p JOIN bo ON bo.a = p.id JOIN cc c ON c.id = bo.b WHERE c.root < p.root GROUP BY p.id)),
gi AS (SELECT it.*, cc.root FROM it JOIN cc USING (id)),
ro AS (SELECT id AS root, k AS incident_document_id, entity_id AS incident_entity_id FROM it)"""


def incidents_sql(select: str) -> str:
    return star_sql(f"{INCIDENTS_SQL} {select}").replace("WITH ", "WITH RECURSIVE ", 1)


SUMMARY_SQL = """SELECT incident_document_id, incident_entity_id, count(*) AS items, CAST(1 AS BIGINT) AS outlets, arg_min(head || ' - Reuters', (-score, k, entity_id)) AS lead_title, round(max(score), 6) AS score FROM gi JOIN ro USING (root) GROUP BY 1, 2"""

_BARE = "text"
for _pattern in text.BOILERPLATE:
    _BARE = f"regexp_replace({_BARE}, '{_pattern}', ' ', 'g')"
#: The documents hold no characters that NFKC changes and NFC does not.
_PLAIN_SQL = rf"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize({_BARE}), '[ \t]+', ' ', 'g'), '\n+', chr(10), 'g')) AS content FROM documents"

QUERIES = {
    "s2_normalize_gdelt": (_norm("gdelt"), _norm_sql("gdelt", _URL, f"length({FIRST_LINE})", "CASE WHEN doc_id % 7 <> 0 THEN at0 END", author="NULL::VARCHAR")),
    "s3_normalize_hn": (_norm("hn"), _norm_sql("hn", f"CASE WHEN doc_id % 3 <> 0 THEN {_URL} ELSE 'https://news.ycombinator.com/item?id=' || doc_id END", f"CASE WHEN doc_id % 2 = 0 THEN length(text) ELSE length({FIRST_LINE}) END", "at0")),
    "s4_normalize_youtube": (_norm("youtube"), _norm_sql("youtube", "'https://youtu.be/' || doc_id", f"length({FIRST_LINE}) + 9 + length(format('{{:,}}', doc_id * 37)) + length(text)", "at0", "CAST(doc_id * 37 AS INT)", "CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS INT) END")),
    "s5_normalize_instagram": (_norm("instagram"), _norm_sql("instagram", _URL, "length(text)", "at0", "CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS INT) END", "CAST(doc_id % 50 AS INT)", title="CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END")),
    "s6_normalize_reddit": (_norm("reddit", phrase="of the"), _norm_sql("reddit", _URL, "length(text)", "at0", "CAST(doc_id % 90 AS INT)", "CAST(doc_id % 30 AS INT)", where=rf"position(' of the ' IN ' ' || regexp_replace(lower({FIRST_LINE} || ' ' || text || ' ' || {_URL}), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g') || ' ') > 0")),
    "s1_normalize_rss": (lambda s: _norm("rss")(s).select("doc_id", "title", "url", "author", "published_at"), f"SELECT doc_id, {FIRST_LINE} AS title, {_URL} AS url, source AS author, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at FROM documents"),
    "s7_dispatch_by_format": (dispatched, _DISPATCH_SQL),
    "x1_canonical_url": (lambda s: s.table("pages").select("page_id", text.canonical_url(F.col("url")).alias("url")), "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages"),
    "x2_content_hash": (lambda s: docs(s).select("doc_id", text.content_hash(F.col("text")).alias("hash")), "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE sha256(text) END AS hash FROM documents"),
    "x3_clean_document": (lambda s: s.table("pages").select("page_id", text.clean_document("html").alias("content")), None),
    "x4_strip_boilerplate": (lambda s: docs(s).select("doc_id", text.tidy_spaces(text.nfkc(text.without_boilerplate(F.col("text")))).alias("content")), _PLAIN_SQL),
    "x5_high_value_segments": (lambda s: docs(s).select("doc_id", text.high_value_segments(F.col("title"), F.col("text"), ["ertion", "onre", "eaux"]).alias("segments")), _SEGMENTS_SQL),
    "x6_outlet_of": (lambda s: s.documents.groupBy(common.outlet_of(F.col("title")).alias("outlet")).agg(F.count("*").alias("documents")), with_star("x AS (SELECT nullif(lower(regexp_extract(title, '^(.*) - (.*)$', 2)), '') AS outlet FROM docs) SELECT outlet, count(*) AS documents FROM x GROUP BY 1")),
    "x7_ingest_dedupe": (lambda s: ingest.ingest_dedupe(dedupe_input(s)).select("id"), with_star(f"arrivals AS (SELECT document_id AS id, url AS u, content_hash AS h, collected_at AS came FROM docs), {ROUNDS_SQL} SELECT id FROM w WHERE status = 1").replace("WITH ", "WITH RECURSIVE ", 1)),
    "x8_ingest_quality_filter": (
        lambda s: s.documents.select(F.coalesce(ingest.reject_reason(F.col("published_at"), F.when(F.col("document_id") % 23 != 0, F.col("url")), F.contains("title", F.lit("Story 1")), "1999-01-01 00:00:00"), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows")),
        with_star("""x AS (SELECT CASE WHEN published_at IS NULL THEN 'undated' WHEN published_at > TIMESTAMP '1999-01-01' + INTERVAL 2 DAY THEN 'future' WHEN document_id % 23 = 0 THEN 'no_url' WHEN NOT contains(title, 'Story 1') THEN 'irrelevant' ELSE 'kept' END AS reason FROM docs)
SELECT reason, count(*) AS rows FROM x GROUP BY 1"""),
    ),
    "x16_normalize_entity_name": (lambda s: s.entities.select("entity_id", text.entity_key(F.concat("entity_name", F.lit("'s Works Pvt. Ltd."))).alias("key")), with_star("x AS (SELECT 1) SELECT entity_id, lower(entity_name) || ' works' AS key FROM entities")),
    "x18_short_answer": (lambda s: answers(s).select("conv_id", "turn", text.short_answer(F.col("text")).alias("answer")), r"""WITH p AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_#`>|]+', '', 'g'), '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'assistant'),
q AS (SELECT *, substr(t, 1, 320) AS cut, regexp_extract(substr(t, 1, 320), '^(.*[.!?])(?:\s|$)', 1) AS s FROM p)
SELECT conv_id, turn, CASE WHEN length(t) <= 320 THEN t WHEN s <> '' THEN s ELSE trim(cut) || '…' END AS answer FROM q"""),
    "j1_keyword_match": (lambda s: matching.keyword_spans(docs(s), ROSTER).groupBy("doc_id", "keyword").agg(F.count("*").alias("n")), f"WITH m AS (SELECT doc_id, unnest({_KEEP}) AS keyword FROM documents) SELECT doc_id, keyword, count(*) AS n FROM m GROUP BY ALL"),
    "j16_seeded_rematch": (
        lambda s: docs(s).select("doc_id", F.explode(F.array(*(F.struct(F.lit(w).alias("phrase"), (F.size(F.split(common.phrase_form(F.col("text")), f" {w} ")) - 1).alias("n")) for w in ("ertion", "onre", "ouon")))).alias("h")).select("doc_id", "h.phrase", F.least("h.n", F.lit(10)).alias("mention_count")).where("mention_count > 0"),
        r"""WITH n AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g') || ' ' AS t FROM documents), p AS (SELECT unnest(['ertion', 'onre', 'ouon']) AS phrase)
SELECT doc_id, phrase, CAST(least((length(t) - length(replace(t, ' ' || phrase || ' ', ''))) / (length(phrase) + 2), 10) AS INT) AS mention_count FROM n, p WHERE contains(t, ' ' || phrase || ' ')""",
    ),
    "j19_near_duplicate_names": (lambda s: incidents.near_duplicate_names(s.entities.select("client_id", F.col("entity_name").alias("name"), F.coalesce("entity_type", F.lit("other")).alias("kind")), s.entities.select("client_id", F.col("entity_name").alias("name"), F.coalesce("entity_type", F.lit("other")).alias("kind"))), None),
    "m1_normalize_titles": (lambda s: s.documents.select("document_id", text.executive_titles(F.concat("title", F.lit(" by Chief Executive Officer and Senior Vice President"))).alias("title")), with_star("x AS (SELECT 1) SELECT document_id, title || ' by CEO and SVP' AS title FROM docs")),
    "m3_match_confidence": (lambda s: matching.match_confidence(matches(s)).select("doc_id", "start_idx", "keyword", "entity_id", "confidence", "accepted"), f"WITH {MATCHED_SQL} SELECT doc_id, start_idx, keyword, entity_id, confidence, accepted FROM s"),
    "m5_resolve_ambiguity": (lambda s: matching.resolve_ambiguity(matching.match_confidence(matches(s))).select("doc_id", "start_idx", "keyword", "entity_id", "status"), f"WITH {MATCHED_SQL} SELECT doc_id, start_idx, keyword, entity_id, status FROM s"),
    "m7_document_match_state": (lambda s: matching.document_state(matching.resolve_ambiguity(matching.match_confidence(matches(s)))),
        f"WITH {MATCHED_SQL} SELECT doc_id, CASE WHEN bool_or(status = 'accepted') THEN 'MATCHED' WHEN bool_or(status = 'ambiguous') THEN 'AMBIGUOUS' ELSE 'SKIPPED' END AS state FROM s GROUP BY 1"),
    "m8_accept_mentions": (lambda s: matching.accepted_mentions(matching.resolve_ambiguity(matching.match_confidence(matches(s)))),
        f"WITH {MATCHED_SQL} SELECT doc_id, entity_id, min(start_idx) AS first_at, count(*) AS mention_count FROM s WHERE status = 'accepted' GROUP BY 1, 2"),
    "l1_orm_sentiment_rules": (lambda s: rounded(labels.calibrated_sentiment(sentiment_input(s)).select("doc_id", "label", "score", "rule", F.array_join("trigger_words", ",").alias("words"))), _SENTIMENT_SQL),
    "l2_label_to_score": (lambda s: rounded(s.documents.select("document_id", (common.lookup(F.col("sentiment_label"), {"Positive": 1.0, "Neutral": 0.0, "Negative": -1.0}, 0.0) * 0.65).alias("weighted"))), with_star("x AS (SELECT 1) SELECT document_id, round(sentiment_score * 0.65, 6) AS weighted FROM docs")),
    "l4_entity_context_window": (lambda s: docs(s).select("doc_id", F.length(text.context_window(F.col("text"), F.lit("ertion"), 200)).alias("n")), """WITH p AS (SELECT doc_id, text, instr(lower(text), 'ertion') AS a FROM documents)
SELECT doc_id, CAST(length(CASE WHEN a > 0 THEN substr(text, greatest(a - 200, 1), a - greatest(a - 200, 1) + 206) ELSE substr(text, 1, 400) END) AS INT) AS n FROM p"""),
    "l5_supporting_sentence": (lambda s: docs(s).select("doc_id", text.supporting_sentence(F.col("text"), F.array(F.lit("onre"), F.lit("eaux"))).alias("sentence")), r"""WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents)
SELECT doc_id, coalesce(list_filter(s, lambda x: contains(lower(x), 'onre') OR contains(lower(x), 'eaux'))[1], s[1]) AS sentence FROM p"""),
    "l6_dual_topic_scores": (
        lambda s: rounded(labels.dual_scores(s.table("embeddings"), "embedding").select("vec_id", F.get("independent", F.lit(0)).alias("first_independent"), F.array_max("softmax").alias("top_softmax"))),
        """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), t AS (SELECT vec_id, max(x) AS m, sum(exp(x)) AS z, max(x) FILTER (i = 0) AS f FROM e GROUP BY 1)
SELECT vec_id, round(1 / (1 + exp(-f)), 6) AS first_independent, round(exp(m) / z, 6) AS top_softmax FROM t""",
    ),
    "l7_topic_threshold": (
        lambda s: labels.topic_threshold(s.topics.select("document_id", F.col("topic").alias("label"), F.round("topic_confidence", 6).alias("score")).groupBy("document_id", "label").agg(F.max("score").alias("score")), s.spark.createDataFrame([("Legal Risk", 0.7), ("Cybersecurity", 0.3)], "label string, threshold double"), "document_id").select("document_id", "label", "score", "rank"),
        with_star("""m AS (SELECT document_id, topic AS label, max(round(topic_confidence, 6)) AS score FROM topics GROUP BY ALL), p AS (SELECT * FROM m WHERE score >= CASE label WHEN 'Legal Risk' THEN 0.7 WHEN 'Cybersecurity' THEN 0.3 ELSE 0.5 END)
SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, label) AS rank FROM p"""),
    ),
    "l8_degenerate_topic_guard": (
        lambda s: labels.degenerate_guard(s.topics.select("document_id", "topic").distinct(), "document_id", 6),
        with_star("m AS (SELECT DISTINCT document_id, topic FROM topics), c AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM m) SELECT document_id, topic FROM c WHERE n < 3"),
    ),
    "l9_negative_suppression": (lambda s: docs(s).select("doc_id", F.array_join(labels.suppressed_topics(F.concat("title", F.when(F.col("doc_id") % 2 == 0, " apple pie").otherwise(" car")), F.array(F.lit("Consumer Electronics"), F.lit("Social Media"))), ",").alias("topics")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Social Media' ELSE 'Consumer Electronics,Social Media' END AS topics FROM documents"),
    "l12_inference_dedupe": (lambda s: labels.infer_once(docs(s).select("doc_id", "text"), "text", lambda x: x.withColumn("score", F.length("text") % 7)).select("doc_id", "score"), "SELECT doc_id, length(text) % 7 AS score FROM documents"),
    "r1_reach_modifier": (lambda s: rounded(s.documents.select("document_id", common.reach_modifier(F.col("view_count"), F.col("comment_count")).alias("modifier"))), with_star(f"x AS (SELECT 1) SELECT document_id, round({_REACH}, 6) AS modifier FROM docs")),
    "r2_trust_tier": (lambda s: s.documents.select("document_id", common.trust_tier(F.col("title")).alias("tier")), with_star(f"x AS (SELECT 1) SELECT document_id, {_TIER} AS tier FROM docs")),
    "r18_parse_label_text": (
        lambda s: s.documents.select("document_id", F.concat(F.lit('```json\n{"status": "'), F.when(F.col("document_id") % 2 == 0, "probe").otherwise("odd"), F.lit('", "event": "  A  raid '), F.col("document_id") % 5, F.lit('"}```')).alias("t")).select("document_id", risk.parse_status(F.col("t"))[0].alias("status"), risk.parse_status(F.col("t"))[1].alias("event")),
        with_star("x AS (SELECT 1) SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 'probe' END AS status, 'a raid ' || (document_id % 5) AS event FROM docs"),
    ),
    "c2_c3_incidents": (lambda s: _ids(incidents.incidents(incident_items(s)), "item_id", "incident_id"),
        incidents_sql("SELECT k AS item_document_id, entity_id AS item_entity_id, incident_document_id, incident_entity_id FROM gi JOIN ro USING (root)")),
    "c4_incident_summary": (lambda s: rounded(_ids(incidents.incident_summary(i := incident_items(s), incidents.incidents(i)), "incident_id")), incidents_sql(SUMMARY_SQL)),
    "g25_answer_source_stats": (lambda s: cited(s).groupBy("conv_id", "host").agg(F.countDistinct("turn").alias("answers"), F.countDistinct("page_id").alias("pages")), f"WITH {CITED_SQL} SELECT conv_id, host, count(DISTINCT turn) AS answers, count(DISTINCT page_id) AS pages FROM c GROUP BY ALL"),
    "g26_source_stability": (stability, f"""WITH {CITED_SQL}, p AS (SELECT conv_id, page_id, count(DISTINCT turn) AS k FROM c GROUP BY ALL), n AS (SELECT conv_id, count(DISTINCT turn) AS r FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, round(count(*) FILTER (k = r) / count(*)::DOUBLE, 6) AS shared FROM p JOIN n USING (conv_id) GROUP BY 1"""),
    "g27_low_reliability_pages": (lambda s: cited(s).where(F.col("host").contains("example.net")).groupBy("url").agg(F.countDistinct("conv_id").alias("questions"), F.countDistinct("conv_id", "turn").alias("answers")), f"WITH {CITED_SQL} SELECT url, count(DISTINCT conv_id) AS questions, count(DISTINCT (conv_id, turn)) AS answers FROM c WHERE contains(host, 'example.net') GROUP BY 1"),
    "g28_accusation_sentences": (sentences, r"""WITH r AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS s FROM conversations WHERE role = 'assistant'), k AS (SELECT *, trim(regexp_replace(lower(s), '[ \t,;:]+', ' ', 'g')) AS key FROM r)
SELECT key, count(DISTINCT conv_id) AS questions, count(*) AS occurrences FROM k WHERE len(string_split(key, ' ')) >= 5 GROUP BY 1 HAVING count(*) > 1"""),
}
