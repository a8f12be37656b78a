"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from murmura.llm import bpe_count, chat, hard_negatives, html_main, imatch, kd_sharding, license_scan, mixing, pieces, quality, repair, simhash, token_output

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_output.write_token_blocks(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return token_output.read_token_digests(blocks)


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_documents(_table(spark, sf_dir, "documents"))
    first, second = (F.get("positions", F.lit(k)).alias(f"{name}_position") for k, name in enumerate(("first", "second")))
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", first, second)
    return rows.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.quality_verdicts(_table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_sharding.with_slots(kd_sharding.kd_shards(_table(spark, sf_dir, "documents"), shards=16))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )  # fmt: skip


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"),
    )  # fmt: skip
    out = chat.formatted_chats(turns.unionByName(extra))
    read = out.withColumns({"turns": chat.read_chat(F.col("formatted")), "loss": chat.loss_text(F.col("segments"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )  # fmt: skip


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    return pieces.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), columns)


def op9_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_pages(_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", label.cast("int").alias("label"), hard_negatives.floored("embedding").alias("q"))
    return hard_negatives.mined_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair.repaired_conversations(repair.damaged(turns), turns)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.licence_scans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output, op2_curriculum_mix, op3_imatch, op4_adaptive_quality, op5_kd_shards, op6_token_counts, op7_chat_format,
        op8_sentencepiece, op9_html_main, op10_simhash, op11_hard_negatives, op12_repair,
        op13_license_scan,
    )
} | {"pipeline": corpus_pipeline.run}  # fmt: skip

#: Word sizes, the water-filled targets and each document's share of the mix.
_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', '7', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope,
             source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, (SELECT arg_min(level, (cap / weight, level)) FROM l WHERE level * weight <= cap) AS water FROM l),
t0 AS (SELECT source, source_size, slope, least(cap, coalesce(water * weight, cap)) AS target FROM g),
t AS (SELECT *, coalesce(round(sum(target * slope) OVER () / sum(target) OVER (), 9), 0) AS pace FROM t0),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, t.pace,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(least(CAST(floor(target) AS BIGINT) - start, size), 0) AS once,
             greatest(least(CAST(floor(target) AS BIGINT) - source_size - start, size), 0) AS again FROM p),
u AS (SELECT *, CASE WHEN once > 0 THEN start / target END AS x, CASE WHEN again > 0 THEN (source_size + start) / target END AS y FROM k),
v AS (SELECT *, CASE WHEN slope = 0 THEN x ELSE (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * x, 0.0)) - (1 - slope)) / (2 * slope) END AS t1,
             CASE WHEN slope = 0 THEN y ELSE (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * y, 0.0)) - (1 - slope)) / (2 * slope) END AS t2 FROM u)
SELECT doc_id, size, source_size, target, CAST(once + again AS BIGINT) AS taken,
       CASE WHEN once > 0 THEN t1 + pace * (t1 * t1 - t1) END AS first_position, CASE WHEN again > 0 THEN t2 + pace * (t2 * t2 - t2) END AS second_position
FROM v
"""

#: The turns of every conversation as its formatted text reads back.
_CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS esc,
         replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS esc_role,
         row_number() OVER w AS k, lag(role) OVER w AS before
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(esc) + 8 + CASE WHEN before IS NOT DISTINCT FROM role THEN 0 ELSE length(esc_role) + 6 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Scores of every anchor against all rows.
_NEGATIVES_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

#: Ways through the turns so far: five digits of cost, edits, chr(1), repaired text; the least such string is the best way.
_ADDED = "lpad(CAST(CAST(left({way}, 5) AS INTEGER) + {cost} AS VARCHAR), 5, '0') || replace(substr({way}, 6), chr(1), '{edit}' || chr(1)) || {said}"


def _added(way: str, cost: str, edit: str, said: str = "") -> str:
    """SQL: ``way`` and one more edit; ``said``: the repaired turn."""
    line = f"CASE WHEN {way} LIKE '%' || chr(1) THEN '' ELSE chr(10) END || {said}" if said else "''"
    return _ADDED.format(way=way, cost=cost, edit=edit, said=line)


def _moves(state: int, initial: str, sources: tuple[int, ...], role: str) -> str:
    """SQL: the best way to ``state`` over one turn, kept or reroled from ``sources``, or deleted."""
    kept = [f"CASE WHEN i = '{initial}' THEN {_added(f'w.q{q}', 't', 'K', chr(34) + 'role' + chr(34) + " || ':' || text")} END" for q in sources]
    reroled = [_added(f"w.q{q}", "2 + t", "R", f"'{role}:' || text") for q in sources if role]
    return f"least({_added(f'w.q{state}', '3', 'D')}, CASE WHEN fault NOT IN (1, 2) THEN least({', '.join(kept + reroled)}) END) AS q{state}"


_BYTE = "CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(k, CAST(i // 8 + 1 AS INTEGER), 1)) AS BIGINT) ELSE 0 END"
_REPAIR_SQL = rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (
  SELECT k, 4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * strlen(k)), lambda i: CAST(i AS BIGINT))),
    lambda r, i: CASE WHEN xor(r, {_BYTE}) & 1 = 1 THEN xor(xor(r, {_BYTE}) >> 1, 3988292384) ELSE xor(r, {_BYTE}) >> 1 END) AS crc
  FROM (SELECT DISTINCT k FROM o)),
d AS (
  SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
         CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM o JOIN crc USING (k), range(CASE WHEN crc % 20 = 3 THEN 2 ELSE 1 END) WHERE crc % 20 <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
         CASE WHEN NOT regexp_matches(text, '[^ 	

]') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][ 	

]*\z') THEN 3 ELSE 0 END AS fault FROM p),
s AS (SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS t FROM f),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM f GROUP BY conv_id),
-- q0 to q3: the best way to each state.
w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '00000' || chr(1) AS q0, NULL::VARCHAR AS q1, '00002I' || chr(1) || 'user:' AS q2,
         '00004II' || chr(1) || 'user:' || chr(10) || 'assistant:' AS q3
  FROM g
  UNION ALL
  SELECT conv_id, pos, q0, q1, q2, least(q3, {_added('q2', '2', 'I', "'assistant:'")}) AS q3
  FROM (
    SELECT conv_id, pos, q0, q1, q3, least(q2, {', '.join(_added(f'q{q}', '2', 'I', "'user:'") for q in (0, 1, 3))}) AS q2
    FROM (
      SELECT w.conv_id, s.pos, {_added('w.q0', '3', 'D')} AS q0, {_moves(1, 's', (0,), '')}, {_moves(2, 'u', (0, 1, 3), 'user')}, {_moves(3, 'a', (2,), 'assistant')}
      FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1))),
b AS (SELECT g.*, least(q0, q3) AS best FROM g JOIN w ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = g.n)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(CAST(left(best, 5) AS INTEGER), 0) AS BIGINT) AS cost,
       coalesce(substr(best, 6, strpos(best, chr(1)) - 6), '') AS audit, sha256(coalesce(substr(best, strpos(best, chr(1)) + 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
"""

SQL = {"op12_repair": _REPAIR_SQL, "op11_hard_negatives": _NEGATIVES_SQL, "op2_curriculum_mix": _MIX_SQL, "op7_chat_format": _CHAT_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
