"""Neighbours and clusters of vectors without all pairs of rows: the nearest few of each vector within a band of similarity, and the components of a similarity graph by spanning forests.

Rows are dealt to blocks, `cells` at most, and a task multiplies two of them (operators.vector_blocks): what is shuffled is each row once for each block, and what leaves a task is bounded too: a few neighbours for each row, or a forest.
The products are of all pairs in the worst case, so their time grows with the square; a forest leaves out the tiles whose rows are joined already. All results are exact. Vectors of another length than most meet among themselves;
null, empty and zero vectors, and rows without an id, are like nothing. Extra columns do no harm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import vector_blocks as B
from tessera.operators.retrieval import SCALE, pa_schema
from tessera.operators.storage import cut
from tessera.operators.vector_blocks import BLOCK, CELLS


def usable(vectors: DataFrame, keys: tuple[str, ...], id_column: str) -> tuple[DataFrame, list[str], str]:
    """The rows that can be like any other, packed; a null key is an empty one."""
    rows = vectors.where(F.exists("embedding", lambda x: x != 0)).withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys}) if keys else vectors.where(F.exists("embedding", lambda x: x != 0))
    return B.packed(rows, keys, id_column)


def nearest_in_band(
    vectors: DataFrame, k: int, low: float = -1.0, high: float | None = None, keys: tuple[str, ...] = (), queries: DataFrame | None = None, id_column: str = "capsule_id", block: int = BLOCK, cells: int = CELLS
) -> DataFrame:
    """from_id, to_id, sim (millionths), pos: for each vector (or each whose id is in `queries`) the k most alike of equal keys, of those with low <= similarity < high.

    A task looks both ways between two blocks and returns k rows for each vector in them, at most; of these the k best stay."""
    rows, names, kind = usable(vectors, keys, id_column)
    asks = F.lit(True)
    if queries is not None:
        ids = queries.select(F.col(id_column).cast("string").alias("id")).where("id is not null").distinct().withColumn("asks", F.lit(True))
        rows, asks = rows.join(ids, "id", "left"), F.coalesce("asks", F.lit(False))
    pairs = B.in_pairs(B.in_blocks(rows.select(*names, "id", "v", asks.alias("asks")), names, block, cells))
    lowest, highest = round(low * SCALE), 2 * SCALE if high is None else round(high * SCALE)
    ddl = "from_id string, to_id string, sim bigint"
    out = pa_schema(ddl)

    def look(table: pa.Table) -> pa.Table:
        at = B.Pair(table, kind)
        found = at.nearest(at.table.column("asks").to_numpy().astype(bool), lowest, highest, k)
        return B.table_of([{"from_id": at.ids.take(pa.array(x)), "to_id": at.ids.take(pa.array(y)), "sim": s} for x, y, s in found], out)

    found = B.dealt(pairs, *names, "i", "j").groupBy(*names, "i", "j").applyInArrow(look, ddl)
    order = Window.partitionBy("from_id").orderBy(F.desc("sim"), "to_id")
    # dealt by from_id once: both the best of each pair and the order need no other
    best = B.dealt(found, "from_id").groupBy("from_id", "to_id").agg(F.max("sim").alias("sim"))
    return best.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("from_id", "to_id", "sim", "pos")


def similarity_forest(vectors: DataFrame, threshold: float, keys: tuple[str, ...] = (), id_column: str = "capsule_id", block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """a, b: links that have the same components as all pairs at or over the threshold (within equal keys), without all pairs.

    Equal vectors become one representative and its copies. Each block finds its own components and labels its rows by them; between blocks only labels are linked, and a task keeps a spanning forest of what it finds. n vectors
    that are all alike give n rows if equal, else n rows and one for each pair of blocks."""
    rows, names, kind = usable(vectors, keys, id_column)
    # 128 bits: two hashes under different seeds
    hashed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    same = hashed.groupBy(*names, "h1", "h2").agg(F.min("id").alias("rep"))
    single = cut(hashed.join(same, [*names, "h1", "h2"]))
    copies = single.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    reps = single.where("id = rep").dropDuplicates([*names, "id", "h1", "h2"]).select(*names, "id", "v")
    placed = B.in_blocks(reps, names, block, cells)
    least = round(threshold * SCALE)

    def within(table: pa.Table) -> pa.Table:
        at = B.Pair(table, kind)
        label, _ = at.joined(at.group, least)
        first = np.searchsorted(at.group, label[at.group])  # the least id of the component
        return at.table.append_column("label", at.ids.take(pa.array(first)))

    known = cut(B.dealt(placed, *names, "own").groupBy(*names, "own").applyInArrow(within, f"{B.ddl(placed)}, label string"))
    own = known.where("id <> label").select(F.col("label").alias("a"), F.col("id").alias("b"))
    ddl = "a string, b string"
    out = pa_schema(ddl)

    def between(table: pa.Table) -> pa.Table:
        at = B.Pair(table, kind)
        labels, code = np.unique(at.column("label").astype(str), return_inverse=True)
        links = [(str(labels[a]), str(labels[b])) for a, b in at.joined(code, least)[1]]
        return pa.Table.from_arrays([pa.array([x[n] for x in links], pa.string()) for n in (0, 1)], schema=out)

    across = B.dealt(B.in_pairs(known, between_only=True), *names, "i", "j").groupBy(*names, "i", "j").applyInArrow(between, ddl)
    return copies.unionByName(own).unionByName(across).distinct()
