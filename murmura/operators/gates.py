"""Joins and gates that the score operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions.common import effective_date

OWN_TYPES = ["brand", "product"]


def client_mentions(mentions: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Mentions with client, entity type and effective date (publication, else creation)."""
    dated = documents.select("document_id", "published_at")
    return (
        mentions.join(entities, "entity_id")
        .join(dated, "document_id", "left")
        .withColumn("effective_at", effective_date(F.col("published_at"), F.col("created_at")))
        .drop("published_at")
    )


def brand_documents(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (client_id, document_id) that mention one of the client's own entities."""
    own = entities.where(F.col("entity_type").isin(OWN_TYPES)).select("entity_id", "client_id")
    return mentions.join(own, "entity_id").select("client_id", "document_id").distinct()


def clients_without_brand(clients: DataFrame, entities: DataFrame) -> DataFrame:
    own = entities.where(F.col("entity_type").isin(OWN_TYPES)).select("client_id")
    return clients.join(own, "client_id", "left_anti")


def brand_gate(facts: DataFrame, brand_docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts whose document mentions the client's own entities; clients without any such entity stay ungated."""
    own = entities.where(F.col("entity_type").isin(OWN_TYPES)).select("client_id").distinct()
    gated = facts.join(brand_docs, ["client_id", "document_id"], "left_semi")
    return gated.unionByName(facts.join(own, "client_id", "left_anti"))


def without_competitors(facts: DataFrame) -> DataFrame:
    """Competitor rows go, rows without entity or type stay."""
    return facts.where(~F.coalesce(F.col("entity_type") == "competitor", F.lit(False)))


def source_reliability(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """document_id, source_reliability (0 to 100); sources without a base score are left out."""
    rel = F.greatest(F.least((F.col("base_reliability").cast("double") - F.coalesce(F.col("penalty").cast("double"), F.lit(0.0))) * 100, F.lit(100.0)), F.lit(0.0))
    dim = sources.where("base_reliability IS NOT NULL").select("source_id", rel.alias("source_reliability"))
    return documents.select("document_id", "source_id").join(dim, "source_id").select("document_id", "source_reliability")


def orphans(facts: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Fact rows whose key no parent has."""
    return facts.join(parents.select(key), key, "left_anti")


def latest_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key under a total order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
