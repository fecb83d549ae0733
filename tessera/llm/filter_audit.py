"""Filter interaction audit: a histogram of failure masks answers what every order of the filters would keep, remove and lose.

DataFrame functions only. One scan makes a row of some fifty bytes for each document: its part, the bits of the filters that read the text alone, and a hash of the text.
A text groupBy gives the least doc_id of each text; a row fails the duplicate filter if its doc_id is not that one. The row meets the least doc_id on (hash, doc_id),
not on the hash, so a text that a third of all rows share is dealt over all tasks. Labels meet rows on doc_id. What is left is 32 cells a part, aggregated before
their shuffle; the orders are enumerated from the cells, whatever the size of the corpus.

Defined results: a null text is an empty one; a null lang is the part ''. Rows without a doc_id never fail the duplicate filter, are no one's earlier copy and have no
labels. Rows that repeat a doc_id count each; with equal texts none of them is a copy of the other. A doc_id labelled twice takes its larger labels. An empty table
has no parts. Very long texts are read whole. Extra columns, whatever their names, do no harm.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_SPACE, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
DUPLICATE = 1 << FILTERS.index("E")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, which read one text alone."""
    inner = F.btrim(text, F.lit(ASCII_SPACE))
    words = F.split(inner, r"[\x20\x09-\x0D]+", -1)
    n = F.when(F.octet_length(inner) == 0, 0).otherwise(F.size(words))
    distinct = F.when(F.octet_length(inner) == 0, 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        n < MIN_WORDS,
        100 * distinct.cast("long") < MIN_DISTINCT_PERCENT * n.cast("long"),
        100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.char_length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask: a row for each row of docs (doc_id, text, lang)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    # 128 bits: two hashes under different seeds
    rows = rows.select("doc_id", "part", text_mask(F.col("text")).alias("own"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    rows = written(rows, "filter-masks")
    first = rows.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    met = rows.join(first, ["h1", "h2", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return met.select("doc_id", "part", (F.col("own") + F.when(copy, DUPLICATE).otherwise(0)).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many rows have which mask, and which of their labels are 1. 32 rows a part at most."""
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    is_one = lambda c: F.count(F.when(F.col(c) == 1, 1))
    return masks.join(told, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), is_one("quality").alias("good"), is_one("toxic").alias("toxic"))


def orders() -> Column:
    """All steps of all orders of the filters, as one array: filter_order, step, bit (the step's filter), before (those ahead of it)."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append((order, step, bit, before))
            before |= bit
    fields = zip(("filter_order", "step", "bit", "before"), zip(*steps, strict=True), strict=True)
    return F.arrays_zip(*(F.array(*map(F.lit, values)).alias(name) for name, values in fields))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and step."""
    cells = mask_cells(failure_masks(docs), labels)
    at = cells.select("*", F.explode(orders()).alias("o")).select("part", "mask", "n", "good", "toxic", "o.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda what, when: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    # of the orders of all filters, one in as many as the mask has bits puts this one ahead of the mask's others
    share = F.sum(F.when(fails, F.col("n") * (F.lit(len(list(permutations(FILTERS)))) / F.bit_count("mask")).cast("long")))
    return at.groupBy("part", "filter_order", "step").agg(
        total("n", ~fails & ~earlier).alias("kept"),
        total("n", fails & ~earlier).alias("removed"),
        total("n", fails & earlier).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~earlier).alias("good_lost"),
        total("toxic", fails & ~earlier).alias("toxic_lost"),
        F.coalesce(share, F.lit(0)).cast("long").alias("shapley"),
    )
