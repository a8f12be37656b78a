"""The media-monitoring model as views over the driver's tables, in Spark and, for comparison, in SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.scratch import scratch_path

AS_OF = "2001-08-02 00:00:00"
OUTLETS = ["Reuters", "The Hindu", "Devdiscourse", "Nowhere Post", "Livemint"]
KINDS = ["rss", "youtube", "instagram", "reddit", "gdelt"]
TOPICS = ["Regulatory Risk", "Legal Risk", "Cybersecurity", "Labor Relations", "Product Launch", "Market Share"]


@dataclass
class Star:
    """Lazy views; each reads only the columns a query uses."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def write(self, df: DataFrame, name: str, by: list[str]) -> DataFrame:
        """``df`` as a table in the shared folder, partitioned by the columns ``by``, read back."""
        path = scratch_path(self.spark, name)
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def clients(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("client_id"), F.col("n_name").alias("client_name"))

    @cached_property
    def entities(self) -> DataFrame:
        k = F.col("s_suppkey")
        kind = F.when(k % 5 == 0, "brand").when(k % 5 == 1, "competitor").when(k % 5 == 2, "person").when(k % 5 == 3, "product")
        return self.table("supplier").select(k.alias("entity_id"), F.col("s_nationkey").cast("long").alias("client_id"), F.col("s_name").alias("entity_name"), kind.alias("entity_type"))

    @cached_property
    def documents(self) -> DataFrame:
        k = F.col("o_orderkey")
        pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
        title = F.concat(F.lit("Story "), (k % 97).cast("string"), F.lit(" about item "), (k % 13).cast("string"))
        outlet = F.when(k % 11 != 0, F.concat(F.lit(" - "), pick(OUTLETS, F.col("o_custkey")))).otherwise("")
        label = F.when(F.col("o_orderstatus") == "F", "Negative").when(F.col("o_orderstatus") == "O", "Neutral").otherwise("Positive")
        return self.table("orders").select(
            k.alias("document_id"), F.when(k % 10 != 0, F.col("o_orderdate")).alias("published_at"),
            (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("collected_at"),
            pick(KINDS, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("document_type"),
            F.concat(title, outlet).alias("title"), F.concat(F.lit("https://site"), (k % 7).cast("string"), F.lit(".example.com/a/"), (k % 5000).cast("string")).alias("url"),
            F.sha2((k % 4000).cast("string"), 256).alias("content_hash"),
            F.when(k % 17 != 0, F.floor(F.col("o_totalprice") / 10)).cast("long").alias("view_count"), (k % 60).alias("comment_count"),
            F.col("o_custkey").alias("source_id"), label.alias("sentiment_label"),
            F.when(F.col("o_orderstatus") == "F", -1.0).when(F.col("o_orderstatus") == "O", 0.0).otherwise(1.0).alias("sentiment_score"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("entity_id"), F.col("l_linenumber").alias("line"),
            F.col("l_quantity").cast("long").alias("mention_count"), F.col("l_shipdate").alias("created_at"),
            F.when(F.col("l_returnflag") == "R", "Negative").when(F.col("l_returnflag") == "A", "Neutral").otherwise("Positive").alias("label"),
            (F.col("l_discount") * 10).alias("confidence"), F.col("l_partkey").alias("part_id"),
        )

    @cached_property
    def topics(self) -> DataFrame:
        """document_id, topic, topic_confidence, line."""
        parts = self.table("part").select(F.col("p_partkey").alias("part_id"), (F.col("p_size") % len(TOPICS)).alias("t"))
        topic = F.element_at(F.array(*map(F.lit, TOPICS)), (F.col("t") + 1).cast("int"))
        return self.mentions.join(parts, "part_id").select("document_id", "line", topic.alias("topic"), F.col("confidence").alias("topic_confidence"))

    @cached_property
    def sources(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(
            c.alias("source_id"), F.lower("c_mktsegment").alias("category"), F.col("c_name").alias("source_name"),
            F.when(c % 9 != 0, (c % 50 + 50) / 100.0).cast("decimal(3,2)").alias("base_reliability"),
            F.when(c % 4 == 0, (c % 5) / 10.0).cast("decimal(3,2)").alias("penalty"),
        )


def _case(expr: str, names: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


#: The same views for the comparison queries.
STAR_SQL = f"""
clients AS (SELECT CAST(n_nationkey AS BIGINT) AS client_id, n_name AS client_name FROM nation),
entities AS (SELECT s_suppkey AS entity_id, CAST(s_nationkey AS BIGINT) AS client_id, s_name AS entity_name,
  CASE s_suppkey % 5 WHEN 0 THEN 'brand' WHEN 1 THEN 'competitor' WHEN 2 THEN 'person' WHEN 3 THEN 'product' END AS entity_type FROM supplier),
docs AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS published_at,
  o_orderdate + INTERVAL 2 DAY AS collected_at, {_case("CAST(substr(o_orderpriority, 1, 1) AS INT) - 1", KINDS)} AS document_type,
  'Story ' || (o_orderkey % 97) || ' about item ' || (o_orderkey % 13) || CASE WHEN o_orderkey % 11 <> 0 THEN ' - ' || {_case("o_custkey % 5", OUTLETS)} ELSE '' END AS title,
  'https://site' || (o_orderkey % 7) || '.example.com/a/' || (o_orderkey % 5000) AS url, sha256(CAST(o_orderkey % 4000 AS VARCHAR)) AS content_hash,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice / 10) AS BIGINT) END AS view_count, o_orderkey % 60 AS comment_count, o_custkey AS source_id,
  CASE o_orderstatus WHEN 'F' THEN 'Negative' WHEN 'O' THEN 'Neutral' ELSE 'Positive' END AS sentiment_label,
  CASE o_orderstatus WHEN 'F' THEN -1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS sentiment_score FROM orders),
mentions AS (SELECT l_orderkey AS document_id, l_suppkey AS entity_id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS mention_count, l_shipdate AS created_at,
  CASE l_returnflag WHEN 'R' THEN 'Negative' WHEN 'A' THEN 'Neutral' ELSE 'Positive' END AS label, l_discount * 10 AS confidence, l_partkey AS part_id FROM lineitem),
topics AS (SELECT document_id, line, {_case(f"p_size % {len(TOPICS)}", TOPICS)} AS topic, confidence AS topic_confidence FROM mentions JOIN part ON part_id = p_partkey),
sources AS (SELECT c_custkey AS source_id, lower(c_mktsegment) AS category, c_name AS source_name,
  CASE WHEN c_custkey % 9 <> 0 THEN CAST((c_custkey % 50 + 50) / 100.0 AS DECIMAL(3,2)) END AS base_reliability,
  CASE WHEN c_custkey % 4 = 0 THEN CAST((c_custkey % 5) / 10.0 AS DECIMAL(3,2)) END AS penalty FROM customer)
"""


def with_star(sql: str) -> str:
    return f"WITH {STAR_SQL.strip()},\n{sql.strip()}"
