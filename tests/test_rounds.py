"""Segments, ordered matching and completed rounds against a walk through each transcript, block by block."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import rounds as R
from tessera.operators import sequences as Q

COLUMNS = ("block_id", "tenant", "caller_agent", "session_id", "transcript_path", "line_number", "block_index", "message_uuid", "role", "block_type", "content", "tool_name", "tool_use_id", "meta_json", "created_at")
SCHEMA = ", ".join(f"{c} {'bigint' if c in ('line_number', 'block_index') else 'string'}" for c in COLUMNS)
FAMILY = {"bash": "shell", "exec": "shell", "read": "read_file", "grep": "search_files", "edit": "edit_file"}
META = {None: {}, '{"is_error":true}': {"e": True}, '{"is_error":false}': {"e": False}, '{"is_error":"x"}': {}, '{"phase":"final_answer"}': {"f": True}, '{"phase":"commentary"}': {"f": False}, '{"stop_reason":"end_turn"}': {"f": True}, '{"stop_reason":"tool_use"}': {"f": False}}


def transcripts(seed, n=120):
    rng = random.Random(seed)
    out = []
    for t in range(n):
        line = 0
        for i in range(rng.randint(1, 40)):
            line += rng.choice((0, 1, 1, 2)) if i else 1
            role, kind = rng.choice((("user", "text"), ("assistant", "text"), ("assistant", "text"), ("assistant", "text"), ("assistant", "tool_use"), ("assistant", "tool_use"), ("user", "tool_result"), ("user", "tool_result"), ("system", "text"), ("assistant", "thinking")))
            out.append((
                f"b{t}_{i:03}", "t1", "agent", None if t % 9 == 8 else f"s{t}", f"/p/{t % 50}", line, i, rng.choice((None, f"u{t}_{line // 2}", f"u{t}_{i}")), role, kind, rng.choice(("", " 　", f" do {i} things ", "x", "y", "z")),
                rng.choice(("Bash", "exec ", "read", "GREP", "edit", "other", None)) if kind == "tool_use" else None, rng.choice(("a", "a", "b", None)) if kind.startswith("tool") else None, rng.choice([*META, None, None, None, None, None, None]), str(1704067200000 + i).rjust(20, "0"),
            ))
    return out


def walked(rows):
    """(rounds, segment of each block): transcripts block by block, message by message."""
    streams, rounds, segment_of = {}, [], {}
    for r in rows:
        r = dict(zip(COLUMNS, r, strict=True))
        if r["session_id"] is not None:
            streams.setdefault((r["tenant"], r["caller_agent"], r["session_id"], r["transcript_path"]), []).append(r)
    human = lambda b: b["role"] == "user" and b["block_type"] == "text" and b["content"].strip() != ""
    for key, blocks in streams.items():
        blocks.sort(key=lambda b: (b["line_number"], b["block_index"], b["block_id"]))
        groups = []
        for b in blocks:
            last = groups[-1][-1] if groups else None
            same = last and (last["message_uuid"] == b["message_uuid"] if last["message_uuid"] and b["message_uuid"] else last["message_uuid"] is b["message_uuid"] and groups[-1][0]["line_number"] == b["line_number"])
            groups[-1].append(b) if same else groups.append([b])
        segments, active = [], False
        for g in groups:
            if any(map(human, g)):
                if not segments or active:
                    segments.append([])
                    active = False
                segments[-1].append(g)
            elif segments:
                active |= any(b["role"] == "assistant" for b in g)
                segments[-1].append(g)
            segment_of |= {b["block_id"]: len(segments) for b in g}
        for n, segment in enumerate(segments, 1):
            flat = [b for g in segment for b in g]
            tools = [b for b in flat if b["block_type"] in ("tool_use", "tool_result")]
            calls = [b for b in tools if b["block_type"] == "tool_use"]
            final = None
            for i, g in enumerate(segment):
                if not any(b["block_type"] == "tool_use" for b in g):
                    for b in g:
                        if b["role"] == "assistant" and b["block_type"] == "text" and b["content"].strip() and META[b["meta_json"]].get("f", True):
                            final = i, b
            if not calls or final is None or any(b in tools for g in segment[final[0] + 1 :] for b in g):
                continue
            held, s = {}, {"matched": 0, "orphan": 0, "errors": 0, "unknown": 0}
            for b in tools:
                if b["block_type"] == "tool_use":
                    held[b["tool_use_id"]] = held.get(b["tool_use_id"], 0) + 1
                elif b["tool_use_id"] is not None and held.get(b["tool_use_id"], 0) > 0:
                    held[b["tool_use_id"]] -= 1
                    s["matched"] += 1
                    e = META[b["meta_json"]].get("e")
                    s["errors"] += e is True
                    s["unknown"] += e is None
                else:
                    s["orphan"] += 1
            start = next(b for b in flat if human(b))
            family = lambda b: FAMILY.get((b["tool_name"] or "").strip().lower(), "other")
            rounds.append((
                *key, n, len(calls), s["matched"], len(calls) - s["matched"], s["orphan"], s["errors"], s["unknown"], len(calls) == s["matched"] and not s["orphan"], [b["tool_use_id"] for b in calls if b["tool_use_id"]],
                list(dict.fromkeys(family(b) for b in calls if b["tool_name"])), hashlib.sha256(b"\1\0\0\0\0" + "\0".join(map(family, calls)).encode()).hexdigest(), "\n".join(b["content"].strip() for b in flat if human(b)),
                "next_human" if n < len(segments) else "stream_end", start["block_id"], final[1]["block_id"], final[1]["created_at"],
            ))
    return rounds, segment_of


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_against_a_walk(spark, seed):
    rows = transcripts(seed)
    wanted, segment_of = walked(rows)
    blocks = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {r["block_id"]: r["segment_no"] for r in Q.segments(blocks).collect()} == segment_of
    out = Q.completed_rounds(blocks).select(
        *Q.STREAM, "segment_no", "tools", "matched", "missing", "orphan", "errors", "unknown", "clean", "call_ids", "families", "pattern_fingerprint", "task", "seal", "start_at.block_id", "final_at.block_id", "completed_at"
    )
    assert sorted(map(list, out.collect()), key=str) == sorted(map(list, wanted), key=str) and len(wanted) > 20
    assert any(w[6] for w in wanted) and any(w[7] for w in wanted) and any(w[8] for w in wanted) and any(w[9] for w in wanted) and any(w[10] for w in wanted)


def test_one_shuffle_for_segments_and_matches(spark):
    plan = Q.completed_rounds(spark.createDataFrame(transcripts(1), SCHEMA).repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_names_of_rounds(spark):
    block = lambda i, role, kind, uid=None, text="x", **more: tuple((dict(zip(COLUMNS, (f"b{i}", "t1", "agent", "s", "/p", i, 0, uid, role, kind, text, None, None, None, "1"), strict=True)) | more)[c] for c in COLUMNS)
    rows = [block(0, "user", "text", "u-é", "Fix the build 12"), block(1, "assistant", "tool_use", "m", tool_name="Bash"), block(2, "assistant", "text", "f", "done"), block(3, "user", "text", None, "x"), block(4, "assistant", "tool_use", "m2"), block(5, "assistant", "text", "f2", "done")]
    big = [block(6, "user", "text", "u6", "a" * 40_000), block(7, "user", "text", "u7", "b" * 40_000), block(8, "assistant", "tool_use", "m3"), block(9, "assistant", "text", "f3", "done")]
    found = {r["segment_no"]: r for r in Q.named_rounds(Q.completed_rounds(spark.createDataFrame(rows + big, SCHEMA))).collect()}
    framed = lambda s: len(s.encode()).to_bytes(8, "little") + s.encode()
    head = b"mem.completed_tool_round.id.v3" + framed("t1") + framed("agent") + framed("s") + framed("/p")
    # a name of bytes: uuid5 as its standard has it
    assert found[1]["round_id"] == f"round_{uuid.uuid5(uuid.NAMESPACE_OID, head + bytes([1]) + framed('u-é'))}"
    assert found[2]["round_id"] == f"round_{uuid.uuid5(uuid.NAMESPACE_OID, head + bytes([0]) + (3).to_bytes(8, 'little') + (0).to_bytes(8, 'little'))}"
    assert found[1]["task_fingerprint"] == hashlib.sha256(b"\1\0\0\0\0fix the build <num>").hexdigest()
    assert found[2]["task_fingerprint"] is None and found[3]["task"] is None and found[3]["task_fingerprint"] is None  # too short; more than 64 KiB


def test_a_block_stored_twice_changes_the_fingerprint(spark):
    rows = transcripts(3, 4)
    prints = lambda r: {x["session_id"]: x["fingerprint"] for x in R.source_fingerprints(spark.createDataFrame(r, SCHEMA)).collect()}
    once, shuffled, doubled, gone = prints(rows), prints(rows[::-1]), prints(rows + [rows[0], rows[0]]), prints(rows[1:])
    assert once == shuffled and once["s0"] not in (doubled["s0"], gone.get("s0")) and doubled["s0"] != gone.get("s0") and once["s1"] == doubled["s1"]


def test_rebuild_of_nothing(spark):
    none = spark.createDataFrame([], "tenant string, session_id string, version bigint, fingerprint string, round_count bigint, built_at string")
    report, rounds, builds = R.rebuild(spark.createDataFrame([], SCHEMA), none, "0")
    assert report.count() == rounds.count() == builds.count() == 0
    blocks = spark.createDataFrame(transcripts(4), SCHEMA).withColumn("transcript_path", F.concat("transcript_path", F.lit("/"), F.coalesce("session_id", F.lit("-"))))
    report, rounds, builds = R.rebuild(blocks, none, "1")
    total = report.groupBy().sum("rounds", "clean", "gapped").first()
    assert total[0] == rounds.count() == total[1] + total[2] > 0 and {r["status"] for r in report.collect()} == {"published"}
    assert {r["status"] for r in R.rebuild(blocks, builds, "2")[0].collect()} == {"unchanged"}
