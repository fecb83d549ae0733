"""The sweep: detectors against plain Python, and several sweeps over a table against a sequential run."""

import hashlib
import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.evolution import procedural_siblings
from tessera.plans import evolution_sweep as E

CAPSULE = "capsule_id string, tenant string, source_agent string, project string, repo string, capsule_type string, status string, content string, code_refs array<string>, topics array<string>, tags array<string>, confidence double, decay_score double, last_recalled_at string, expires_at string, supersedes_id string"
at = lambda ms: str(ms).rjust(20, "0")
DAY = 86_400_000
NOW = at(100 * DAY)


def world(seed=3, n=130):
    g = random.Random(seed)
    v = np.random.default_rng(seed)
    bases = v.normal(size=(8, 6))
    caps, vectors = [], []
    for i in range(n):
        base = g.randrange(8)
        content = " ".join(g.choice([f"{base}abc{g.randrange(3)}de0", "word", f"mem_0a1b2c3d-{i}", "1234567", "deadbee1"]) for _ in range(4))
        caps.append((f"c{i:03}", g.choice("tu"), "agent" if g.random() < 0.9 else "other", "p", g.choice(["r", None]), g.choice(["experience", "experience", "episode", "preference", "implementation"]), g.choice(["active"] * 6 + ["archived"]), content, [f"f{base}_{g.randrange(9)}.py"] if g.random() < 0.5 else [],
                     [f"T{base}", "Common"], [" common ", "other"] if g.random() < 0.9 else [], g.choice([0.5, 0.7, 0.9]), g.choice([0.1, 0.5, 0.9]), g.choice([None, None, at(100 * DAY - 1000), at(90 * DAY), at(20 * DAY), at(99 * DAY + i % 3)]), g.choice([None, None, None, NOW]), f"c{i - 8:03}" if i >= 8 and g.random() < 0.2 else None))
        if g.random() < 0.95:
            vectors.append((f"c{i:03}", 0, (bases[base] + v.normal(size=6) * g.choice([0.02, 0.3, 4.0])).tolist()))
            if g.random() < 0.4:
                vectors += [(f"c{i:03}", k, (bases[g.randrange(8)] + v.normal(size=6) * 0.05).tolist()) for k in range(1, g.randint(2, 4))]
    for k in range(4):  # one procedure, four executions
        caps.append((f"k{k}", "t", "agent", "kin", "r", "episode", "active", f"run {k}abcdef{k}12", [], ["only"], [], 0.9, 0.1, None, None, None))
        vectors.append((f"k{k}", 0, [0.0, 0.0, 0.0, 0.0, -9.0 - k / 100, 9.0]))
    edges = [("capability_capsule:c001", "capability_capsule:c002", "suspected_supersede", None), ("capability_capsule:c001", "capability_capsule:c005", "suspected_supersede", NOW), ("capability_capsule:c003", "capability_capsule:c004", "co_recalled_with", None)] + [(f"capability_capsule:x{i}", f"capability_capsule:c{i:03}", "suspected_supersede", None) for i in range(10, 40, 3)]
    feedback = [(f"c{g.randrange(n):03}", g.choice(["outdated", "outdated", "useful"])) for _ in range(120)]
    return caps, vectors, edges, feedback


def groups_of(ids, vec, threshold):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in ids:
        for y in ids:
            a, b = vec[x], vec[y]
            if x < y and round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) * 1e6) >= threshold * 1e6:
                parent[find(y)] = find(x)
    out = {}
    for i in ids:
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def anchors(c):
    bare = re.sub("mem_[0-9a-f-]+", " ", c["content"])
    return {t for t in re.findall(r"\b[0-9a-f]{7,40}\b", bare) if re.search("[0-9]", t) and re.search("[a-f]", t)} | set(c["code_refs"])


def detected(caps, vectors, edges, feedback, s):
    names = [x.split()[0] for x in CAPSULE.split(", ")]
    live = {c[0]: dict(zip(names, c, strict=True)) for c in caps if c[6] == "active" and not (c[14] and c[14] <= NOW)}
    vec = {i: np.array(e) for i, k, e in vectors if k == 0 and i in live}
    guide = lambda i: live[i]["capsule_type"] in ("preference", "workflow")
    theme = lambda i: {t.strip().lower() for t in live[i]["topics"] + live[i]["tags"]}
    out = set()
    add = lambda i, op, members: out.add((live[i]["tenant"], op, tuple(sorted(members))))
    for t in "tu":
        mine = [i for i in vec if live[i]["tenant"] == t]
        for c in groups_of(mine, vec, s.cluster_at):
            usual = [i for i in c if not guide(i)]
            for key in {(live[i]["source_agent"], live[i]["project"], live[i]["repo"]) for i in usual}:
                same = [i for i in usual if (live[i]["source_agent"], live[i]["project"], live[i]["repo"]) == key]
                for sub in groups_of(same, vec, s.merge_at):
                    free = [i for i in sub if live[i]["supersedes_id"] not in sub]
                    if len(sub) < 2 or len(free) < 2:
                        continue
                    sets = [anchors(live[i]) for i in free]
                    kin = all(sets) and all(len(a & b) / min(len(a), len(b)) <= 0.2 for x, a in enumerate(sets) for b in sets[x + 1 :])
                    if not kin or len(free) >= s.generalize_from:
                        add(free[0], "workflow_generalize" if kin else "merge", free)
            epi = [i for i in c if live[i]["capsule_type"] in ("experience", "episode")]
            if len(epi) >= s.generalize_from and len(set.intersection(*map(theme, epi))) >= 2 and sum(live[i]["confidence"] for i in epi) / len(epi) >= 0.6 - 1e-9:
                add(epi[0], "generalize", epi)
            recent = [i for i in usual if (live[i]["last_recalled_at"] or "") >= at(100 * DAY - s.interval_s * 1000)]
            if len(usual) >= 2 and len(recent) / len(usual) > 0.5:
                add(usual[0], "reweight_up", usual)
            if len(c) == 1 and usual and live[c[0]]["last_recalled_at"] is None and live[c[0]]["decay_score"] <= 0.8:
                add(c[0], "reweight_decay", c)
        batches = {}
        for i, c in live.items():
            if c["tenant"] == t and c["last_recalled_at"]:
                batches.setdefault(c["last_recalled_at"], []).append(i)
        linked = {(a[19:], b[19:]) for a, b, r, to in edges if r == "co_recalled_with" and to is None}
        for b in batches.values():
            if 2 <= len(b) <= 12:
                for x in b:
                    for y in b:
                        if x < y and (x, y) not in linked:
                            add(x, "corecall", (x, y))
    chunks = {}
    for i, k, e in vectors:
        chunks.setdefault(i, {})[k] = np.array(e)
    suspects = {b[19:] for _, b, r, to in edges if r == "suspected_supersede" and to is None}
    for i, c in live.items():
        if guide(i) or c["decay_score"] > 0.8:
            continue
        if len(chunks.get(i, {})) >= 2:
            parts = groups_of(list(chunks[i]), chunks[i], s.cluster_at)
            cos = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) * 1e6)
            if len(parts) >= 2 and all(cos(chunks[i][a], chunks[i][b]) <= s.split_at * 1e6 for x, p in enumerate(parts) for q in parts[x + 1 :] for a in p for b in q):
                add(i, "split", [i])
        if (c["last_recalled_at"] or "") >= at(70 * DAY) and (i in suspects or sum(f == (i, "outdated") for f in feedback) >= 2):
            add(i, "refine", [i])
    return out


def test_detectors(spark):
    caps, vectors, edges, feedback = world()
    s = E.Sweep(NOW)
    frames = spark.createDataFrame(caps, CAPSULE).withColumn("root", F.lit("clash")).drop("root"), spark.createDataFrame(vectors, "capsule_id string, chunk int, embedding array<double>"), spark.createDataFrame(edges, "from_node string, to_node string, relation string, valid_to string"), spark.createDataFrame(feedback, "capsule_id string, kind string")
    found = E.proposals(*frames, s).collect()
    wanted = detected(caps, vectors, edges, feedback, s)
    assert {(r["tenant"], r["op_kind"], tuple(r["members"])) for r in found} == wanted and len(found) == len(wanted)
    assert {w[1] for w in wanted} >= {"merge", "workflow_generalize", "generalize", "reweight_up", "reweight_decay", "split", "refine", "corecall"}, {w[1] for w in wanted}
    empty = E.sweep(*(f.limit(0) for f in frames), spark.createDataFrame([], E.CANDIDATES), s)
    assert [x.count() for x in empty] == [0, 0, 0]


def one_sweep(found, candidates, s):
    """Proposal after proposal, then the silent ones."""
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))

    def best(p, pool):
        hits = [(-jac(p["members"], c["member_ids"]), c["candidate_id"]) for c in pool if (c["tenant"], c["op_kind"]) == (p["tenant"], p["op_kind"]) and jac(p["members"], c["member_ids"]) >= 0.8]
        return min(hits)[1] if hits else None

    pools = {k: [c for c in candidates if c["status"] in k.split("|")] for k in ("pending", "executed|accepted", "cancelled")}
    after = {c["candidate_id"]: dict(c) for c in candidates}
    heard = set()
    for p in found:
        if p["op_kind"] in E.ONE_SHOT and best(p, pools["executed|accepted"]):
            continue
        if p["op_kind"] == "corecall" and any(c["op_kind"] == "corecall" and c["tenant"] == p["tenant"] and c["params"] == p["params"] and c["member_ids"] == p["members"] for c in pools["cancelled"]):
            continue
        hit = best(p, pools["pending"])
        old = next((c for c in pools["pending"] if c["candidate_id"] == hit), None)
        if old:
            if p["op_kind"] == "corecall" and old["params"] == p["params"]:
                continue
            heard.add(hit)
            c = after[hit] | {"evidence": s.decay * old["evidence"] + 1, "cycles": old["cycles"] + 1, "last_signal_at": s.now}
            if p["op_kind"] == "corecall":
                c["params"] = p["params"]
        else:
            pid = hashlib.sha256("\x1f".join((p["tenant"], p["op_kind"], "\x1e".join(p["members"]), p["params"])).encode()).hexdigest()
            c = {"candidate_id": "evo_" + hashlib.sha256(f"{pid}\x1f{s.now}".encode()).hexdigest()[:24], "tenant": p["tenant"], "op_kind": p["op_kind"], "member_ids": p["members"], "params": p["params"], "evidence": 1.0, "cycles": 1, "status": "pending", "first_proposed_at": s.now, "last_signal_at": s.now, "executed_at": None}
        if c["cycles"] >= s.cycles:
            c = c | {"executed_at": s.now} | ({} if c["op_kind"] in E.RECURRING else {"status": "executed"})
        after[c["candidate_id"]] = c
    for c in pools["pending"]:
        if c["candidate_id"] not in heard:
            e = c["evidence"] * s.decay
            after[c["candidate_id"]] = after[c["candidate_id"]] | {"evidence": e, "cycles": 0} | ({"status": "cancelled"} if e < s.hysteresis else {})
    return list(after.values())


def test_texts_stay_out_of_what_is_written(spark, monkeypatch):
    """Before, clusters were joined to whole capsules, so every text was shuffled and written with them."""
    caps, vectors, edges, feedback = world()
    frames = (spark.createDataFrame(caps, CAPSULE), spark.createDataFrame(vectors, "capsule_id string, chunk int, embedding array<double>"), spark.createDataFrame(edges, "from_node string, to_node string, relation string, valid_to string"), spark.createDataFrame(feedback, "capsule_id string, kind string"))
    kept, write = [], E.cut
    monkeypatch.setattr(E, "cut", lambda df: kept.append(set(df.columns)) or write(df))
    assert E.proposals(*frames, E.Sweep(NOW)).count()
    assert len(kept) == 3 and not any("content" in columns for columns in kept)


def test_siblings_share_next_to_nothing(spark):
    """Sets of few anchors (one in common is too much) and of many (two of nine), against all pairs."""
    g = random.Random(5)
    sets = {f"p{p}": [{f"a{g.randrange(most)}" for _ in range(g.randrange(1, size))} for _ in range(g.randrange(1, 5))] for p, (most, size) in enumerate([(9, 4), (60, 5), (60, 12), (200, 12), (400, 14)] * 12)} | {"none": [{"a1"}, set()]}
    rows = [(p, f"c{i}", sorted(s)) for p, group in sets.items() for i, s in enumerate(group)]
    found = {r[0] for r in procedural_siblings(spark.createDataFrame(rows, "proposal_id string, capsule_id string, anchors array<string>")).collect()}
    close = lambda group: any(len(x & y) / min(len(x), len(y)) > 0.2 for i, x in enumerate(group) for y in group[:i])
    want = {p for p, group in sets.items() if len(group) > 1 and all(group) and not close(group)}
    assert found == want and 5 < len(want) < 50


def test_six_sweeps_equal_a_sequential_run(spark):
    g = random.Random(5)
    kinds = ["merge", "generalize", "workflow_generalize", "refine", "split", "reweight_up", "reweight_decay", "corecall"]
    steady = [{"tenant": g.choice("tu"), "op_kind": g.choice(kinds[:-1]), "members": sorted(g.sample([f"c{i}" for i in range(30)], g.randint(1, 10))), "params": "{}"} for _ in range(25)]
    pairs = [{"tenant": "t", "op_kind": "corecall", "members": sorted(g.sample([f"c{i}" for i in range(12)], 2)), "params": None} for _ in range(8)]
    plain, table = [], spark.createDataFrame([], E.CANDIDATES)
    seen = set()
    for n in range(6):
        s = E.Sweep(at(n), cycles=3)
        found = [dict(p) for p in steady if g.random() < 0.8] + [dict(p, params=json.dumps({"batch": g.choice([n, n // 3])})) for p in pairs if g.random() < 0.7]
        for p in found:
            if len(p["members"]) > 5 and g.random() < 0.3:  # nearly the same members
                p["members"] = sorted(set(p["members"]) - {g.choice(p["members"])})
        found = list({(p["tenant"], p["op_kind"], tuple(p["members"]), p["params"]): p for p in found}.values())
        if n == 4:
            plain = [c | {"status": "accepted"} if c["status"] == "executed" and c["op_kind"] == "merge" else c for c in plain]
            table = table.withColumn("status", F.when((F.col("status") == "executed") & (F.col("op_kind") == "merge"), "accepted").otherwise(F.col("status")))
        df = spark.createDataFrame([(p["tenant"], p["op_kind"], p["members"], p["params"]) for p in found], "tenant string, op_kind string, members array<string>, params string")
        decisions, table = E.reconcile(df, table, s)
        plain = one_sweep(found, plain, s)
        round_ = lambda c: {**c, "evidence": round(c["evidence"], 9)}
        key = lambda c: c["candidate_id"]
        got = sorted((round_(r.asDict()) for r in table.collect()), key=key)
        assert got == sorted((round_({k: list(v) if k == "member_ids" else v for k, v in c.items()}) for c in plain), key=key), n
        seen |= {r["decision"] for r in decisions.collect()} | {c["status"] for c in plain}
    assert seen >= {"execute", "hold", "cancel", "pending", "executed", "cancelled"}, seen
