"""The filter audit against applying each order of the filters, document by document."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    words = [f"w{i}" for i in range(150)]
    long_ = " ".join(words)
    rows = [(i, long_ + f" {i}", ("en", "de", None, "")[i % 4]) for i in range(12)]
    rows += [
        (20, long_, "en"), (21, long_, "de"), (22, long_, "en"), (23, "a b", "en"), (24, "a b", "fr"), (25, None, None), (26, "", "fr"), (27, None, "en"), (28, " \t\n\x0b\x0c\r ", "en"),
        (29, "A" * 40 + " " + long_, "en"), (30, "tag #1 " + long_, "de"), (31, "w " * 200, "en"), (32, "W| " * 200, "en"), (33, "é" * 5 + "AB", "fr"), (34, "x" * 200_000, "en"), (35, "q\x1cq é " * 60, "en"),
        (None, long_, "en"), (None, "a b", None), (20, long_, "en"), (20, "other", "en"), (36, "A" * 10 + "b" * 90, "es"), (37, "A" * 11 + "b" * 89, "es"),
    ]
    return rows + [(40 + i, "hot text", "en") for i in range(60)]


LABELLED = [(20, 1, 0), (20, 0, 1), (21, 0, 1), (23, 1, 1), (24, None, 1), (29, 1, None), (31, 1, 0), (None, 1, 1), (45, 1, 0), (46, 0, 1), (999, 1, 1)]


def by_order(rows, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    facts = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d}
        facts.append((lang or "", fails, d in good and d is not None, d in toxic and d is not None))
    out = []
    for part in {f[0] for f in facts}:
        mine, shapley, steps = [f for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left, gone = mine, []
            for step, name in enumerate(order, 1):
                removed, redundant = [f for f in left if f[1][name]], sum(f[1][name] for f in gone)
                left = [f for f in left if not f[1][name]]
                shapley[name] += len(removed)
                steps.append((part, order, step, len(left), len(removed), redundant, sum(f[1][name] and sum(f[1].values()) == 1 for f in mine), sum(f[2] for f in removed), sum(f[3] for f in removed)))
                gone = gone + removed
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_all_orders(spark, parts):
    rows = corpus()
    clash = [F.lit("clash").alias(c) for c in ("part", "mask", "own", "h1", "first", "n", "quality", "toxic", "o", "bit", "before", "step")]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *clash).repartition(parts)
    labels = spark.createDataFrame(LABELLED, LABELS).withColumn("part", F.lit("clash"))
    found = filter_audit.audit_filters(docs, labels)
    assert dict(found.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")
    assert sorted(map(tuple, found.collect())) == by_order(rows, LABELLED)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit_filters(nothing, spark.createDataFrame([], LABELS)).count() == 0
    assert filter_audit.audit_filters(spark.createDataFrame([(1, None, None)], SCHEMA), spark.createDataFrame([], LABELS)).count() == 600


def test_native_and_dealt_by_document(spark):
    plan = filter_audit.failure_masks(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowRDD", "")
    assert re.search(r"hashpartitioning\(h1#\d+L, h2#\d+L, doc_id#\d+L", plan) or "BroadcastHashJoin" in plan
