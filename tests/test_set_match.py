"""Best matches of sets of members, against all pairs; what meets is counted."""

import random

from pyspark.sql import functions as F

from tessera.operators import evolution, mining
from tessera.operators import set_match as M


def half_up(x):
    return int(x * 1_000_000 + 0.5)


def test_best_match_equals_all_pairs(spark):
    g = random.Random(5)
    some = lambda n: [g.choice([None, "x", *map(str, range(12))]) for _ in range(n)]
    asks = [(i, g.choice(["a", "b", None]), some(g.randint(0, 7))) for i in range(150)] + [(900, "a", None)]
    offers = [(1000 + i, g.choice(["a", "b"]), some(g.randint(0, 7)), g.choice([None, "1", "2"])) for i in range(150)]
    p = spark.createDataFrame(asks, "proposal_id long, op_kind string, members array<string>")
    c = spark.createDataFrame(offers, "candidate_id long, op_kind string, member_ids array<string>, created_at string")
    for least in (0.5, 0.6, 1 / 3, 0.8):
        jaccard, overlap = {}, {}
        for i, k, m in asks:
            for o, l, t, made in offers:
                mine, theirs = set(m or []), set(t)
                shared = mine & theirs
                if not shared - {None}:
                    continue
                s = half_up(len(shared) / len(mine | theirs))
                if k == l and s >= int(least * 1e6):
                    jaccard[i] = min(jaccard.get(i, (0, 0)), (-s, o))
                s = half_up(len(shared) / min(len(mine), len(theirs)))
                if s >= int(least * 1e6):
                    overlap.setdefault(i, []).append((-s, -int(made or 0), o))
        found = {r["proposal_id"]: (-r["score"], r["candidate_id"]) for r in mining.match_candidates(p, c, least).collect()}
        assert found == jaccard, least
        existing = c.select(F.col("candidate_id").alias("capsule_id"), F.col("member_ids").alias("members"), "created_at")
        found = {r["proposal_id"]: (-r["score"], r["target"]) for r in evolution.supersede_target(p, existing, least).collect()}
        assert found == {i: (s, o) for i, (s, _, o) in ((i, min(x)) for i, x in overlap.items())}, least


def test_copies_meet_once_and_large_sets_are_not_repeated(spark, monkeypatch):
    """Before, 3000 rows of two sets met 1500 x 1500 times over, and a set of n members was written n times."""
    written = []
    monkeypatch.setattr(M, "cut", lambda df: written.append(df.count()) or df)
    row = F.when(F.col("id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"), F.lit("z"), F.lit("y")))
    p = spark.range(3000).select(F.col("id").alias("proposal_id"), F.lit("k").alias("op_kind"), row.alias("members"))
    c = p.select((F.col("proposal_id") + 5000).alias("candidate_id"), "op_kind", F.col("members").alias("member_ids"))
    found = mining.match_candidates(p, c).collect()
    assert written == [4] and len(found) == 3000 and {r["candidate_id"] for r in found} == {5000, 5001} and {r["score"] for r in found} == {1_000_000}
    wide = spark.range(2).select(F.col("id").alias("proposal_id"), F.lit("k").alias("op_kind"), F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda x: F.concat(F.lit("cap_"), x.cast("string"))).alias("members"))
    plan = mining.match_candidates(wide, wide.select(F.col("proposal_id").alias("candidate_id"), "op_kind", F.col("members").alias("member_ids")))
    assert [(r["candidate_id"], r["score"]) for r in plan.collect()] == [(0, 1_000_000)] * 2
