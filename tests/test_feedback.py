"""Credits from transcripts against a reading line by line, in one pass and with a cursor."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.plans import feedback

COLUMNS = "transcript_path string, line_number bigint, block_index bigint, role string, block_type string, content string, tool_name string, tool_use_id string"
WORDS = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfing", "hotel"]


def tokens(text):
    import re

    return set(re.findall("[a-z0-9]{4,}", text.lower()))


def transcript(seed, name):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))
    rows, calls = [], 0
    ids = [f"mem_0000000{i}-x" for i in range(6)]
    for line in range(1, rng.randint(10, 40)):
        kind = rng.choice(["search", "result", "say", "say", "banner", "get", "think", "junk"])
        if kind == "search":
            calls += 1
            rows.append((name, line, 0, "assistant", "tool_use", "{}", rng.choice(["mcp__mem__capability_capsule_search", "x.capability_capsule_search"]), f"s{calls}"))
        elif kind == "result":
            found = {rng.choice(feedback.SECTIONS): [{"capability_capsule_id": rng.choice([*ids, ""]), "text": text()} for _ in range(2)]}
            rows.append((name, line, 0, "user", "tool_result", json.dumps(found) if rng.random() < 0.9 else "no json", None, f"s{rng.randint(1, calls + 1)}"))
        elif kind == "banner":
            rows.append((name, line, 0, rng.choice(["user", "assistant"]), "text", f"mem auto-recall\n- {text()} `[{rng.choice(ids)}]`\nother", None, None))
        elif kind == "get":
            rows.append((name, line, 0, "assistant", "tool_use", json.dumps({"capability_capsule_id": rng.choice(ids)}), "mcp__mem__capability_capsule_get", None)) if rng.random() < 0.3 else None
        elif kind in ("say", "think"):
            rows.append((name, line, 0, "assistant", "text" if kind == "say" else "thinking", text(), None, None))
        else:
            rows.append((name, line, 0, "user", "text", text(), None, None))
    return rows


def read(rows, every=False):
    calls, got, shown, said = set(), {}, [], []
    import re

    for _, line, _, role, kind, content, tool, use in rows:
        if kind == "tool_use" and tool.endswith("_search"):
            calls.add(use)
        elif kind == "tool_use":
            got.setdefault(json.loads(content)["capability_capsule_id"], line)
        elif kind == "tool_result" and use in calls:
            try:
                found = json.loads(content)
            except ValueError:
                continue
            shown += [(e["capability_capsule_id"], tokens(e["text"]), line) for s in feedback.SECTIONS for e in found.get(s, []) if e["capability_capsule_id"]]
        elif (kind == "tool_result" or role != "assistant") and feedback.BANNERS[0] in content:
            shown += [(i, tokens(ln), line) for ln in content.split("\n") for i in re.findall(r"\[(mem_[0-9a-f]{8}-[^\]]*)\]", ln)]
        elif role == "assistant":
            said.append((line, tokens(content)))
    out = {}
    for i, t, line in shown:
        if i in got:
            e = got[i]
        elif every or not t:
            e = line
        else:
            e = next((at for at, s in said if at > line and len(t & s) >= 3), None)
        if e is not None:
            out[i] = min(e, out.get(i, e))
    return out


@pytest.mark.parametrize("every", [False, True])
def test_credits_line_by_line(spark, every):
    rows = {f"/p/{i}": transcript(i, f"/p/{i}") for i in range(60)}
    blocks = spark.createDataFrame([r for x in rows.values() for r in x], COLUMNS).withColumns({c: F.lit("clash") for c in ("called", "place_", "tokens", "t", "line")})
    found = {(r["transcript_path"], r["capsule_id"]): r["line"] for r in feedback.credits(blocks.unionByName(blocks.limit(40)), every).collect()}
    assert found == {(p, i): line for p, x in rows.items() for i, line in read(x, every).items()} and len(found) > 40


def test_two_passes_with_a_cursor_credit_what_one_does(spark):
    rows = [r for i in range(60) for r in transcript(i, f"/p/{i}") if r[6] is None or not r[6].endswith("_get")]  # a fetch may give new evidence for what was credited before
    whole = spark.createDataFrame(rows, COLUMNS)
    lines = whole.select(F.col("transcript_path").alias("path"), "line_number")
    none = spark.createDataFrame([], "transcript_path string, last_line_number bigint")
    key = lambda df: {(r["transcript_path"], r["capsule_id"], r["line"]) for r in df.collect()}
    at_once, _ = feedback.credit_pass(whole, lines, none, "useful", "1")
    first, cursors = feedback.credit_pass(whole.where("line_number <= 14"), lines.where("line_number <= 14"), none, "useful", "1")
    second, after = feedback.credit_pass(whole, lines, cursors, "useful", "2")
    one, two = key(first), key(second)
    assert one | two == key(at_once) and not one & two and one and two
    assert feedback.credit_pass(whole, lines, after, "useful", "3")[0].count() == 0  # read to the end
    assert {r["transcript_path"][: -len(feedback.CURSOR_SUFFIX)]: r["last_line_number"] for r in after.collect()} == {r["path"]: r["m"] for r in lines.groupBy("path").agg(F.max("line_number").alias("m")).collect()}
    assert feedback.advanced(after, lines.limit(0)).count() == after.count()
    again = feedback.credit_pass(whole.where("line_number <= 14"), lines, none, "useful", "9")[0]
    assert {r["feedback_id"] for r in again.collect()} == {r["feedback_id"] for r in first.collect()}  # a lost pass that runs again sends the same


def test_a_fetch_counts_above_all(spark):
    rows = [("/p", 1, 0, "assistant", "tool_use", "{}", "x.capability_capsule_search", "s"), ("/p", 2, 0, "user", "tool_result", '{"directives":[{"capability_capsule_id":"a","text":"alpha bravo charlie"}]}', None, "s"), ("/p", 3, 0, "assistant", "text", "alpha bravo charlie", None, None), ("/p", 9, 0, "assistant", "tool_use", '{"capability_capsule_id":"a"}', "mcp__mem__capability_capsule_get", None), ("/p", 10, 0, "assistant", "tool_use", '{"capability_capsule_id":"never shown"}', "mcp__mem__capability_capsule_get", None)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert [tuple(r) for r in feedback.credits(df).collect()] == [("/p", "a", 9)]
    assert [tuple(r) for r in feedback.credits(df.where("line_number < 9")).collect()] == [("/p", "a", 3)]
    assert feedback.credits(df.limit(0)).count() == 0
