"""Channels of retrieval and their fusion: BM25 ranks, vector ranks, reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scoring import rrf_raw
from tessera.operators.storage import ensure_importable

K1, B = 1.2, 0.75
#: Scores leave as whole millionths, so that engines agree on order.
SCALE = 1_000_000


#: Scripts written without spaces: their runs are cut into pairs of neighbouring characters (a lone one stands for itself).
UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORD = r"[\p{L}\p{N}\p{M}]+"


def tokens(text: Column) -> Column:
    """Words as they are written: runs of letters, digits and marks, unspaced scripts in pairs."""
    text = F.coalesce(text, F.lit(""))
    apart = F.regexp_replace(text, f"([{UNSPACED}]+)", " $1 ")
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(r) - 1)), lambda i: F.substring(r, i, F.lit(2)))
    mixed = F.flatten(F.transform(F.regexp_extract_all(apart, F.lit(WORD), 0), lambda r: F.when(r.rlike(f"^[{UNSPACED}]"), pairs(r)).otherwise(F.array(r))))
    # most texts are ASCII, and then nothing else is looked for in them
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), 0)).when(text.rlike(f"[{UNSPACED}]"), mixed).otherwise(F.regexp_extract_all(text, F.lit(WORD), 0))


def query_terms(query: str) -> list[str]:
    """Distinct, in order; cut as texts are."""
    import regex

    out = []
    for run in regex.findall(WORD, regex.sub(f"([{UNSPACED}]+)", r" \1 ", query)):
        out += [run[i : i + 2] for i in range(max(1, len(run) - 1))] if regex.match(f"[{UNSPACED}]", run) else [run]
    return list(dict.fromkeys(out))


def score_terms(query: str) -> list[str]:
    """What the lifecycle score looks for in fields: lower-case runs of ASCII letters and digits."""
    import re

    return re.findall("[a-z0-9]+", query.lower())


def bm25(corpus: DataFrame, text: Column, id_column: str, query: str, k: int, within: Column | None = None) -> DataFrame:
    """id, score (millionths), rank of the k best rows. Statistics are of the whole corpus, `within` only filters what may rank.

    Term counts are made in the scan, so nothing but k rows a task is shuffled; document frequencies and the mean length are one aggregate. Written as SQL text: a
    query's plan is made anew each time, and one expression a term by way of Python takes longer than a small corpus takes to search."""
    terms = query_terms(query)
    if not terms:
        return corpus.select(F.col(id_column), F.lit(0).cast("bigint").alias("score"), F.lit(0).alias("rank")).limit(0)
    listed = ", ".join(f"'{q}'" for q in terms)  # letters, digits and marks alone: nothing to escape
    inside = F.lit(True) if within is None else within
    # one pass over the words leaves those of the query; the rest is counted on that short list
    t = corpus.select(F.col(id_column), tokens(text).alias("words_"), inside.alias("within_")).selectExpr(f"`{id_column}`", "within_", "size(words_) AS length_", f"filter(words_, x -> x IN ({listed})) AS found_")
    whole = t.selectExpr("count(*) AS n", "avg(length_) AS avg", "array(" + ", ".join(f"CAST(count_if(array_contains(found_, '{q}')) AS DOUBLE)" for q in terms) + ") AS df")
    counted = t.where("within_").selectExpr(f"`{id_column}`", "length_", f"transform(array({listed}), q -> CAST(size(filter(found_, x -> x = q)) AS DOUBLE)) AS c_").withColumn("s_", whole.select(F.struct("*")).scalar())  # one subquery, run once
    norm = f"({K1} * (1 - {B} + {B} * length_ / s_.avg))"
    score = f"aggregate(zip_with(c_, s_.df, (c, d) -> ln(1 + (s_.n - d + 0.5D) / (d + 0.5D)) * c * CAST({K1 + 1} AS DOUBLE) / (c + CAST({norm} AS DOUBLE))), 0D, (a, x) -> a + x)".replace(f"{K1} *", f"{K1}D *").replace(f"- {B} + {B} *", f"- {B}D + {B}D *")
    scored = counted.selectExpr(f"`{id_column}`", f"CAST(round({score} * {SCALE}) AS BIGINT) AS score")
    # rows without a match come last, so they are dropped after the limit: a filter before it would be pushed down and count everything again
    return ranked(scored.orderBy(F.desc("score"), id_column).limit(k).where("score > 0"), F.desc("score"), F.col(id_column))


def ranked(top: DataFrame, *order: Column) -> DataFrame:
    """rank from 1; top is a bounded list already."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, or a side is empty or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def vectors_of(column) -> np.ndarray:
    """Rows of an Arrow list column whose lists are of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, query: list[float], k: int, id_column: str = "capsule_id") -> DataFrame:
    """The k ids with the nearest vector, by Euclidean distance, best chunk of each id: id, distance (millionths), rank. Vectors of another length never rank.

    One pass: a batch leaves its k best ids alone, so what is sorted is k rows a batch, whatever the table."""
    ensure_importable(vectors.sparkSession)
    q = np.array(query, float)
    kind = vectors.schema[id_column].dataType.simpleString()
    usable = vectors.where(F.col(id_column).isNotNull() & (F.size("embedding") == len(q)) & ~F.exists("embedding", lambda x: x.isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = vectors_of(batch.column(1)).astype(float)
            best: dict = {}
            away = np.rint(np.sqrt(((m - q) ** 2).sum(axis=1)) * SCALE).astype(np.int64)
            ids = batch.column(0).to_pylist()
            for i in np.lexsort((np.array(ids), away)).tolist():
                best.setdefault(ids[i], int(away[i]))
                if len(best) == k:
                    break
            yield pa.RecordBatch.from_arrays([pa.array(list(best), batch.schema.field(0).type), pa.array(list(best.values()), pa.int64())], names=[id_column, "distance"])

    found = usable.select(id_column, "embedding").mapInArrow(run, f"{id_column} {kind}, distance bigint")
    best = found.groupBy(id_column).agg(F.min("distance").alias("distance"))
    return ranked(best.orderBy("distance", id_column).limit(k), F.col("distance"), F.col(id_column))


def fuse(lexical: DataFrame, vector: DataFrame, id_column: str = "capsule_id") -> DataFrame:
    """id, ranks, rrf (double): the sum of 1 / (60 + rank) over both lists."""
    none = F.lit(None).cast("int")
    both = lexical.select(id_column, F.col("rank").alias("lexical_rank"), none.alias("vector_rank")).unionAll(vector.select(id_column, none, F.col("rank")))
    ranks = both.groupBy(id_column).agg(F.max("lexical_rank").alias("lexical_rank"), F.max("vector_rank").alias("vector_rank"))
    return ranks.withColumn("rrf", rrf_raw(F.col("lexical_rank")) + rrf_raw(F.col("vector_rank")))


def hybrid(capsules: DataFrame, vectors: DataFrame, tenant: str, query: str, vector: list[float], k: int) -> DataFrame:
    """The k best live rows of a tenant: twice k of each channel, fused, hydrated. Vector neighbours are taken over all tenants and filtered then.

    Both lists have 2 k rows at most, so they are what is broadcast, and the tables are scanned, not shuffled."""
    searchable = ~F.col("status").isin("archived", "rejected") & (F.col("capsule_type") != "diary")
    corpus = capsules.where(searchable)
    mine = F.col("tenant") == tenant
    lexical = bm25(corpus, F.concat_ws(" ", "summary", "content"), "capsule_id", query, 2 * k, mine)
    near = capsules.where(mine).select("capsule_id").join(F.broadcast(nearest(vectors, vector, 2 * k).drop("rank")), "capsule_id")  # 2 k rows
    near = ranked(near, F.col("distance"), F.col("capsule_id"))
    hydrated = corpus.where(mine).join(F.broadcast(fuse(lexical, near)), "capsule_id").withColumn("rrf_score", F.round(F.col("rrf") * SCALE).cast("bigint"))  # 4 k rows
    order = (F.desc("rrf_score"), F.desc("updated_at"), F.asc("capsule_id"))
    return ranked(hydrated.orderBy(*order).limit(k), *order)


def similarity_pairs(vectors: DataFrame, threshold: float, upper: float | None = None, keys: tuple[str, ...] = (), id_column: str = "capsule_id", block: int | None = None, cells: int | None = None) -> DataFrame:
    """a, b (a < b), sim (millionths) of all pairs at or over the threshold (and under `upper`), within equal keys. Exact.

    Rows are dealt to blocks by the hash of their id, `cells` at most, and a task meets two of them: a pair is found in one task alone, so what is shuffled is each row once for each block, and pairs leave unshuffled."""
    from tessera.operators import vector_blocks as B

    rows, names, kind = B.packed(vectors, keys, id_column)
    pairs = B.in_pairs(B.in_blocks(rows, names, block or B.BLOCK, cells or B.CELLS))
    low, high = round(threshold * SCALE), None if upper is None else round(upper * SCALE)
    ddl = "a string, b string, sim bigint"
    out = pa_schema(ddl)

    def run(table: pa.Table) -> pa.Table:
        at = B.Pair(table, kind)
        repeats = bool(len(at.group)) and at.group[-1] + 1 < len(at.group)
        found = []
        for x, y, s in at.in_band(low, high):
            found.append((np.minimum(x, y), np.maximum(x, y), s))
        if repeats and found:  # an id of several vectors: one row for each similarity
            x, y, s = (np.concatenate(c) for c in zip(*found, strict=True))
            one = np.unique(np.stack([at.group[x], at.group[y], s], axis=1), axis=0)
            first = np.searchsorted(at.group, one[:, :2])
            found = [(first[:, 0], first[:, 1], one[:, 2])]
        return B.table_of([{"a": at.ids.take(pa.array(x)), "b": at.ids.take(pa.array(y)), "sim": s} for x, y, s in found], out)

    return B.dealt(pairs, *names, "i", "j").groupBy(*names, "i", "j").applyInArrow(run, ddl)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def pa_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def components(edges: DataFrame, spark_dir: str | None = None) -> DataFrame:
    """node, root: least node of each connected component, by rounds of large-star and small-star contraction until nothing changes. Each round is
    written (checkpoint), so the plan does not grow and a lost executor costs no more than a round."""
    from tessera.operators.storage import cut

    state = cut(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct())
    before = None
    while True:
        both = state.unionAll(state.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).unionAll(least.select("x", F.col("m").alias("y")))
        state = cut(small.where("x <> y").distinct())
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first()
        if now == before:
            return state.select(F.col("x").alias("node"), F.col("y").alias("root"))
        before = now
