"""Token counts through a digest cache.

A count is stored under the digest of the normalised content and the digest of the tokenizer (its file and library version). Documents join the
cache by digest; only contents that are not there are encoded, each once, and appended. Normalisation here is null -> empty: nothing else
leaves the counts of every tokenizer as they are (a caller may pass a stronger one that is known to).

One shuffle carries texts, and only one copy of each content per task enters it (first() is pre-aggregated). The join that gives documents their
counts carries digests alone; a hot digest may be split by the adaptive skew join. The cache is a Parquet table in the shared folder,
partitioned by tokenizer; a rerun finds its own counts there.

Defined results: null and empty texts have 0 bytes and 0 tokens. Repeated rows get equal counts. Null doc_ids pass. Extra columns do no harm. A
count appended twice by two concurrent runs is the same count and is read once.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache
from importlib.metadata import version
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, shared_dir

MODEL = "piece_bpe_32k.model"
MAX_TOKENS = 4096
CACHE_SCHEMA = "content_digest binary, n_tokens long, tokenizer string"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(Path(path).read_bytes() + f"{library} {version(library)}".encode()).hexdigest()


@lru_cache(maxsize=4)
def counter_for(name: str):
    """texts -> counts. Loaded once per worker process."""
    path = tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    from py4j.java_gateway import java_import

    jvm = spark.sparkContext._jvm
    java_import(jvm, "org.apache.hadoop.fs.Path")
    at = jvm.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content_digest binary, n_tokens long")
    return spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == tokenizer).select("content_digest", "n_tokens")


def count_tokens(docs: DataFrame, cache_path: str | None = None, model: str = MODEL) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs (doc_id, text). Without a cache_path the cache is new, and serves this call alone."""
    spark = docs.sparkSession
    cache_path = cache_path or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    tokenizer = tokenizer_digest(tokenizer_path(model))
    content = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content")).withColumn("content_digest", F.unhex(F.sha2("content", 256)))
    known = read_cache(spark, cache_path, tokenizer).select("content_digest").distinct()
    distinct = content.groupBy("content_digest").agg(F.first("content").alias("content"))
    misses = distinct.join(known, "content_digest", "left_anti")

    def count(digest: list, texts: list) -> dict[str, list]:
        return {"content_digest": digest, "n_tokens": counter_for(model)(texts) if texts else []}

    new = map_rows(misses, count, "content_digest binary, n_tokens long")
    new.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = read_cache(spark, cache_path, tokenizer).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    sizes = content.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), "content_digest")
    return sizes.join(counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens")
