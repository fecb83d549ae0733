"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the threshold, reassemble by position.

DataFrame functions only. The exploded table carries hashes and positions, not texts; it is written once and read for the counts and for the
drops. Counts are pre-aggregated before their shuffle. Lines that make up more than 1 / HOT of all (HOT keys at most, however large the corpus) meet
their verdict by broadcast, the others by a shuffle on their hash, so no key fills a task. The one shuffle that carries texts brings each document its
dropped positions.

Defined results: a null or empty text is one empty line. Rows without a doc_id are not counted as documents and keep all lines. Rows that
repeat a doc_id count as one document; each keeps the lines its own text may keep, so equal rows stay equal. Short keys are never dropped.
Any extra columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_SPACE, ascii_lower, written

MIN_KEY_CHARS = 40
MIN_DOCUMENTS = 5
#: Keys with more than 1 / HOT of all lines are hot; there can be no more than HOT of them.
HOT = 1_000


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row per row of docs: `row` (all its columns as a struct), `kept_text`, `n_lines` and `n_dropped` (long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.transform(F.split(text, "\n", -1), line_key)).alias("pos", "key"))
    # 128 bits: two hashes under different seeds
    lines = keys.where(F.col("doc_id").isNotNull() & (F.char_length("key") >= min_chars)).select(
        "doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")
    )
    lines = written(lines, "line-hashes")
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    common = written(counted.where(F.col("n") >= min_documents), "common-lines")
    least = lines.count() / HOT
    hot = F.broadcast(common.where(F.col("n") > least).select("h1", "h2", F.col("keeper").alias("hot_keeper")))
    told = lines.join(hot, ["h1", "h2"], "left")
    cold = told.where("hot_keeper is null").drop("hot_keeper").join(common.where(F.col("n") <= least).drop("n"), ["h1", "h2"])
    judged = told.where("hot_keeper is not null").withColumnRenamed("hot_keeper", "keeper").unionByName(cold)
    drops = (
        judged.where(F.col("doc_id") < F.col("keeper"))
        .groupBy("doc_id", "th")
        .agg(F.collect_set("pos").alias("drop"))
        .select(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th"), "drop")
    )
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    split = F.split("text", "\n", -1)
    joined = rows.join(drops, (F.col("id") == F.col("d_id")) & (F.col("th") == F.col("d_th")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    return joined.withColumn("lines", split).select(
        "row",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_documents(docs: DataFrame, **settings: int) -> DataFrame:
    """docs with the dropped lines gone; n_chars, if there, follows the text. A null text with nothing to drop stays null."""
    out = dedup_lines(docs, **settings)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text} | ({"n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))
