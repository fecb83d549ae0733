"""Subword windows and budgets against the library's own encode and decode, and packed texts."""

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.functions import subwords
from tessera.plans import packing

TEXTS = ["", " ", "short", "alpha beta gamma delta epsilon " * 60, "任务✅完成了🚀部署到生产🔥环境🎉成功" * 20, "naïve café—über " * 40, "x" * 5000, "\n\n a\tb\r\n" * 100, "🎉" * 200, "é <|endoftext|> it's" * 30, "end�" * 30]


@pytest.fixture(scope="module")
def encoding():
    own = subwords.loaded(subwords.default_vocabulary())
    return tiktoken.Encoding("again", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.encoding._mergeable_ranks, special_tokens={})


def library_windows(encoding, text, size, overlap):
    ids = encoding.encode_ordinary(text)
    if len(ids) <= size:
        return [text]
    out, at = [], 0
    while True:
        end = min(at + size, len(ids))
        out.append(encoding.decode_bytes(ids[at:end]).decode("utf-8", "replace"))
        if end == len(ids):
            return out
        at += size - overlap


@pytest.mark.parametrize("size,overlap", [(100, 20), (16, 4), (7, 0), (3, 9), (0, 0), (1, 0)])
def test_windows_equal_the_library(spark, encoding, size, overlap):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "i int, t string")
    found = {r["i"]: r["w"] for r in df.select("i", subwords.subword_windows(F.col("t"), size, overlap).alias("w")).collect()}
    assert found[99] is None
    clamped = max(1, size)
    for i, t in enumerate(TEXTS):
        data = t.encode()
        wanted = library_windows(encoding, t, clamped, min(overlap, clamped - 1))
        assert len(found[i]) == len(wanted)
        for w, text in zip(found[i], wanted, strict=True):
            assert w["text"].encode() == data[w["start"] : w["stop"]]  # offsets are exact
            if "�" not in t:
                assert w["text"] == text.strip("�"), (i, w)  # cuts inside a character trimmed
        assert (len(found[i]) == 1 and found[i][0]["text"] == t) or found[i][-1]["stop"] == len(data)


def test_windows_of_all_documents(spark, sf_dir, encoding):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", subwords.subword_windows(F.col("text"), 64, 8).alias("w"), subwords.count_subwords(F.col("text")).alias("n")).collect()
    for r in rows:
        assert [w["text"] for w in r["w"]] == [x.strip("�") for x in library_windows(encoding, r["text"], 64, 8)]
        assert r["n"] == len(encoding.encode_ordinary(r["text"]))


def test_budgets(spark, encoding):
    df = spark.createDataFrame([(i, t, n) for i, t in enumerate(TEXTS) for n in (0, 9, 50, 10_000)] + [(99, None, 5)], "i int, t string, n int")
    for r in df.select("*", subwords.fit_tokens(F.col("t"), F.col("n")).alias("cut")).collect():
        if r["t"] is None:
            assert r["cut"] is None
            continue
        ids, most = encoding.encode_ordinary(r["t"]), max(8, r["n"])
        whole = r["t"] if len(ids) <= most else encoding.decode_bytes(ids[:most]).decode("utf-8", "replace").rstrip("�")
        if len(ids) > most and "�" not in r["t"]:
            at = max((i for i, c in enumerate(whole) if c.isspace()), default=-1)
            whole = whole[:at].rstrip() if at >= 0 and len(whole[:at].encode()) > len(whole.encode()) // 2 else whole
        if "�" not in r["t"]:
            assert r["cut"] == whole
        assert r["t"].startswith(r["cut"]) and len(encoding.encode_ordinary(r["cut"])) <= max(most, 8) + 1
    secret = spark.createDataFrame([("key sk-" + "a" * 40 + " end",)], "t string").select(subwords.fit_tokens(F.col("t"), 100)).first()[0]
    assert secret == "key [redacted:sk] end"


def test_packed_by_subwords(spark, encoding):
    long = "word " * 500
    rows = [("p1", "preference", "active", " ", long, [], []), ("p2", "preference", "active", "b", "c", [], []), ("f1", "experience", "active", "s", "  ", ["a.py", "b.py"], []), ("f2", "experience", "active", long, long, [], []), ("f3", "experience", "active", "x", "y", [], []),
            ("t1", "experience", "active", "a pattern", "one line", [], []), ("w0", "workflow", "pending_confirmation", "no", "no", [], []), ("w1", "workflow", "active", "goal", "- one; two\n• three", ["c.py"], ["e1", "e2"])]
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "rank int, capsule_id string, capsule_type string, status string, summary string, content string, code_refs array<string>, evidence array<string>").withColumns({"tags": F.array(F.lit("x")), "project": F.lit("p"), "repo": F.lit(None).cast("string"), "module": F.lit("m")})
    out = {(r["section"], r["pos"]): r for r in packing.packed(df, 400).collect()}
    assert sorted(out) == [("directive", 1), ("fact", 1), ("fact", 2), ("pattern", 1), ("workflow", 1)]
    assert out["fact", 1]["text"] == "s" and out["fact", 1]["code_refs"] == ["a.py", "b.py"] and out["pattern", 1]["text"] == "a pattern" and out["pattern", 1]["applies"] == "project p, module m"
    assert 100 < len(encoding.encode_ordinary(out["directive", 1]["text"])) <= 120 and len(encoding.encode_ordinary(out["fact", 2]["source_summary"])) <= 78
    w = out["workflow", 1]
    assert (w["capsule_id"], w["text"], w["steps"], w["signals"]) == ("w1", "goal", ["one", "two"], ["e1, e2"])
    assert packing.packed(df, 0).count() == 0 and packing.packed(df.limit(0), 400).count() == 0
    h = spark.createDataFrame([("s1", 1, "b1", "user", long), ("s1", 2, "b2", "user", "hi"), ("s2", 1, "b3", "user", long)], "session_id string, pos int, block_id string, role string, content string")
    n = {r["block_id"]: len(encoding.encode_ordinary(r["text"])) for r in packing.packed_sessions(h, 200).collect()}
    assert n["b1"] <= 50 < n["b3"] <= 100 and n["b2"] == 1 and packing.packed_sessions(h, 0).count() == 0
