"""Measures of ranked results: runs (query, item, rank) against relevance (query, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def evaluate(runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query: dcg, ndcg, mrr, recall, recall_any, recall_all, precision at k. A query without relevant items scores 0; one without results has precision 0."""
    rel = qrels.select("query_id", "item_id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = runs.join(rel.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    per = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("hit") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    both = n.join(per, "query_id", "full_outer").fillna(0, ["relevant", "hits"]).fillna(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("relevant").cast("int"), F.lit(k)))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    none = F.col("relevant") == 0
    return both.select(
        "query_id", "dcg", F.when(none, 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg"), F.when(F.col("first").isNull(), 0.0).otherwise(1.0 / F.col("first")).alias("mrr"),
        F.when(none, 0.0).otherwise(F.col("hits") / F.col("relevant")).alias("recall"), (F.col("hits") > 0).cast("double").alias("recall_any"), F.when(none, 0.0).otherwise((F.col("hits") == F.col("relevant")).cast("double")).alias("recall_all"), (F.col("hits") / k).alias("precision"),
    )


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df as it is, and counters that its next action fills on the way, without a pass of their own: `.get` is the snapshot."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in counters.items())), seen
