"""Entities and their aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_alias


def norm(c: Column) -> Column:
    return normalize_alias(c)


def list_entities(entities: DataFrame, tenant: str, kind: str | None, part: str | None, limit: int) -> DataFrame:
    rows = entities.where(F.col("tenant") == tenant)
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.where(F.contains("canonical_name", F.lit(part))) if part else rows
    return rows.orderBy(F.desc("created_at"), "entity_id").limit(max(1, min(1024, limit)))


def lookup(aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (tenant, alias) with the owner's entity_id, or null."""
    return asked.withColumn("alias_text", norm(F.col("alias"))).join(aliases.select("tenant", "alias_text", "entity_id"), ["tenant", "alias_text"], "left")


def resolve_or_create(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """tenant, alias, entity_id, minted: the owner of each alias, or an id made from the alias itself, so a rerun mints the same one."""
    distinct = asked.select("tenant", norm(F.col("alias")).alias("alias_text")).distinct()
    found = distinct.join(aliases.select("tenant", "alias_text", "entity_id"), ["tenant", "alias_text"], "left")
    fresh = F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat_ws("\x1f", "tenant", "alias_text"), 256), 1, 16))
    return found.select("tenant", F.col("alias_text").alias("alias"), F.coalesce("entity_id", fresh).alias("entity_id"), F.col("entity_id").isNull().alias("minted"))


def alias_outcomes(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked (tenant, entity_id, alias): inserted, already on the same entity, or in conflict with another."""
    owner = aliases.select("tenant", "alias_text", F.col("entity_id").alias("owner"))
    out = asked.withColumn("alias_text", norm(F.col("alias"))).join(owner, ["tenant", "alias_text"], "left")
    return out.withColumn("outcome", F.when(F.col("owner") == F.col("entity_id"), "already_on_same_entity").when(F.col("owner").isNotNull(), "conflict").otherwise("inserted"))


def with_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with their aliases, oldest first."""
    listed = aliases.groupBy("tenant", "entity_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "alias_text"))).alias("aliases"))
    return entities.join(listed, ["tenant", "entity_id"], "left").withColumn("aliases", F.transform("aliases", lambda a: a["alias_text"]))


def resolve_drafts(drafts: DataFrame, aliases: DataFrame, tenant: str) -> DataFrame:
    """Edge drafts whose object is a named thing (kind:name) get the entity's node where an alias owns the name."""
    name = F.regexp_extract("to_node", r"^(topic|tag|project|repo|module):(.*)$", 2)
    owner = aliases.where(F.col("tenant") == tenant).select(F.col("alias_text").alias("name_"), F.col("entity_id").alias("owner_"))
    joined = drafts.withColumn("name_", norm(name)).join(owner, "name_", "left")
    return joined.withColumn("to_node", F.when(F.col("owner_").isNotNull(), F.concat(F.lit("entity:"), "owner_")).otherwise(F.col("to_node"))).drop("name_", "owner_")
