"""Workers hold pieces of Arrow batches, whatever the batch."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import embedding, subwords
from tessera.functions.pieces import BYTES, ROWS, pieces


def test_pieces_are_the_column_within_rows_and_bytes():
    texts = [None, "", "é" * 10, "x" * 50, *(["ab"] * 30)]
    for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.array([[t, "c"] if t else None for t in texts]), pa.array([t and t.encode() for t in texts])):
        cut = list(pieces(column, 8, 40))
        assert pa.concat_arrays(cut).to_pylist() == column.to_pylist()
        assert max(map(len, cut)) <= 8 and [len(c) for c in cut if 50 in [len(v) for v in c.to_pylist() if v and len(v) == 50]] in ([1], [])
    assert [len(c) for c in pieces(pa.array([], pa.string()))] == [0]


def test_a_provider_sees_pieces_of_a_batch(spark):
    def provider(texts):
        assert len(texts) <= ROWS and sum(map(len, texts)) <= BYTES
        return embedding.deterministic(texts, 4)

    df = spark.range(3000, numPartitions=1).select(F.when(F.col("id") % 7 != 0, F.repeat(F.col("id").cast("string"), 400)).alias("t"))
    rows = df.select("t", embedding.embed(provider)(F.col("t")).alias("e")).collect()
    assert len(rows) == 3000 and [list(r["e"]) for r in rows] == embedding.deterministic([r["t"] or "" for r in rows], 4)


def test_windows_leave_a_batch_in_pieces(spark):
    own = subwords.loaded(subwords.default_vocabulary())
    texts = [None if i % 9 == 0 else f"text {i} " * (i % 40) for i in range(2000)]
    out = list(subwords.windows_of(iter([pa.array(texts)]), own, 16, 4))
    assert max(map(len, out)) <= ROWS
    assert [w and [tuple(x.values()) for x in w] for part in out for w in part.to_pylist()] == [None if t is None else own.windows(t, 16, 4) for t in texts]
