"""Upkeep of tables: files rewritten to size, old generations dropped, and postings, the lexical index as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import B, K1, SCALE, query_terms, ranked, tokens

# Fixed values of the index policy.
LEAST_ROWS, REINDEX_ROWS, ROWS_A_CELL, MOST_CELLS = 5_000, 4_096, 1_024, 4_096


def index_action(rows: Column, unindexed: Column, force: Column) -> Column:
    """skip, build or rebuild. unindexed: rows that an index lacks; null where there is no index."""
    return F.when(rows < LEAST_ROWS, "skip").when(unindexed.isNull(), "build").when(force | (unindexed > REINDEX_ROWS), "rebuild").otherwise("skip")


def cells(rows: Column) -> Column:
    """Cells of a vector index."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_CELLS), F.floor(rows / ROWS_A_CELL))).cast("int")


def postings(corpus: DataFrame, text: Column, id_column: str) -> DataFrame:
    """term, id, tf, length: the lexical index, rebuilt from the rows. Counts are made row by row, so the one shuffle (by term) carries distinct terms of a row."""
    words = corpus.select(F.col(id_column).alias("id"), tokens(text).alias("w_")).withColumn("length", F.size("w_"))
    each = words.select("id", "length", F.explode("w_").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))
    return each.select("term", "id", "tf", "length")


def lengths(corpus: DataFrame, text: Column) -> DataFrame:
    """One row: documents and their mean length."""
    return corpus.agg(F.count("*").cast("double").alias("n"), F.avg(F.size(tokens(text))).alias("avg"))


def bm25_of(index: DataFrame, whole: DataFrame, query: str, k: int) -> DataFrame:
    """id, score (millionths), rank: of the postings only the query's terms are read (a table partitioned or sorted by term prunes the rest)."""
    hits = index.where(F.col("term").isin(*query_terms(query)))
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    one = whole.select(F.struct("*").alias("s")).scalar().getField
    idf = F.log(1 + (one("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(K1) * (1 - B + B * F.col("length") / one("avg"))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    scored = hits.join(F.broadcast(df), "term").groupBy("id").agg(F.round(F.sum(part) * SCALE).cast("bigint").alias("score"))  # one row a term of the query
    return ranked(scored.orderBy(F.desc("score"), "id").limit(k), F.desc("score"), F.col("id"))


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = 512 << 20, sort: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a Parquet table in files of about file_bytes, dealt by ranges of `sort` if given; the table written is returned."""
    df = spark.read.parquet(source)
    files = max(1, -(-_bytes(spark, source) // file_bytes))
    (df.repartitionByRange(files, *sort).sortWithinPartitions(*sort) if sort else df.repartition(files)).write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def expired_generations(generations: DataFrame, now: str, keep_days: int) -> DataFrame:
    """generations (table, generation, written_at) that may go: older than keep_days, and not the newest of their table."""
    newest = generations.groupBy("table").agg(F.max_by("generation", F.struct("written_at", "generation")).alias("newest"))
    old = F.col("written_at").cast("bigint") < int(now) - keep_days * 86_400_000
    return generations.join(newest, "table").where(old & (F.col("generation") != F.col("newest"))).select("table", "generation")
