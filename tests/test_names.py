"""Names within a few edits against levenshtein over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import mining


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def spoilt(rng, word, edits):
    w = list(word)
    for _ in range(edits):
        at = rng.randint(0, len(w))
        kind = rng.choice("idr")
        if kind == "i" or not w:
            w.insert(at, rng.choice("abcé"))
        elif kind == "d":
            w.pop(min(at, len(w) - 1))
        else:
            w[min(at, len(w) - 1)] = rng.choice("abcé")
    return "".join(w)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_all_pairs_within_edits(spark, most):
    rng = random.Random(most)
    names = {"".join(rng.choice("abcé") for _ in range(rng.choice((1, 2, 3, 4, 5, 7, 9, 12)))) for _ in range(70)} | {"x" * 200 + str(i) for i in range(3)}
    words = {spoilt(rng, n, rng.randint(0, most + 1)) for n in sorted(names) for _ in range(2)} | {"", "zzzzzz"}
    wanted = {(w, n, d) for w in words for n in names if w and abs(len(w) - len(n)) <= most and 1 <= (d := distance(w, n)) <= most}
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in sorted(xs)] + [(None,)], f"{c} string")
    found = mining.within_edits(frame(words, "word"), frame(names, "norm"), most).collect()
    assert {(r["word"], r["norm"], r["distance"]) for r in found} == wanted and len(found) == len(wanted) > 50


def test_long_names_have_few_keys(spark):
    names = spark.range(200).select(F.concat(F.repeat(F.lit("n"), 500), F.col("id").cast("string")).alias("norm"))
    words = spark.range(200).select(F.concat(F.lit("m"), F.repeat(F.lit("n"), 499), F.col("id").cast("string")).alias("word"))
    assert mining.within_edits(words.where("length(word) = 503"), names, 1).count() == 100  # each its own number


def test_suggestions_are_limited_and_ordered(spark):
    entities = spark.createDataFrame([("t", "1", "Postgres"), ("t", "2", "postgre"), ("t", "3", "Postgress"), ("u", "4", "postgras"), ("t", "5", "redis")], "tenant string, entity_id string, canonical_name string")
    nodes = spark.createDataFrame([("t", "entity:postgras"), ("t", "postgres"), ("t", "entity:"), ("t", None)], "tenant string, node string")
    found = [tuple(r) for r in mining.neighbour_suggestions(nodes, entities, 2).orderBy("node", "pos").collect()]
    assert found == [("t", "entity:postgras", 1, "entity:1", "Postgres", 1), ("t", "entity:postgras", 2, "entity:3", "Postgress", 2), ("t", "postgres", 1, "entity:3", "Postgress", 1), ("t", "postgres", 2, "entity:2", "postgre", 1)]
