"""Copies between stores: what the target lacks, counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = {"capsules": ["tenant", "capsule_id"], "transcripts": ["transcript_path", "line_number", "block_index"], "episodes": ["tenant", "episode_id"], "entities": ["tenant", "canonical_name"], "edges": ["from_node", "to_node", "relation"]}


def parse_spec(spec: str) -> tuple[str, str]:
    """`kind:locator`."""
    kind, colon, locator = spec.partition(":")
    if not colon or not locator:
        raise ValueError(f"not of the form kind:locator: {spec}")
    return kind, locator


def missing(domain: str, source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows to append: one a key, keys the target lacks. Edges: active ones only."""
    keys = KEYS[domain]
    rows = source.where("valid_to is null") if domain == "edges" else source
    have = target.where("valid_to is null") if domain == "edges" else target
    return rows.dropDuplicates(keys).join(have.select(*keys), keys, "left_anti")


def report(domain: str, source: DataFrame, target: DataFrame) -> DataFrame:
    """domain, copied, skipped: a dry run."""
    keys = KEYS[domain]
    rows = (source.where("valid_to is null") if domain == "edges" else source).select(*keys).distinct()
    have = target.select(*keys).distinct().withColumn("there", F.lit(1))
    counted = rows.join(have, keys, "left").agg(F.count_if(F.col("there").isNull()).alias("copied"), F.count("there").alias("skipped"))
    return counted.select(F.lit(domain).alias("domain"), "copied", "skipped")
