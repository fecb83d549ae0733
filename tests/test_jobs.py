"""The jobs: over growing input, in two runs and more, against plain Python; and rerun after failures."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import archive_transcripts as archive
from jobs import queries, sweep_lifecycle
from jobs.common import replace_partitions

ROOT = Path(__file__).resolve().parents[1]
TURNS = "conv_id bigint, turn bigint, role string, text string"
KEY = "sk-" + "a" * 24


def turns_of(first, last):
    return [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c} says number {c * t}" + (f" key {KEY}" if c % 5 == 0 else "")) for c in range(first, last) for t in range(3)]


def put(spark, rows, path):
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(path)


def wanted(rows):
    """The first of each (conv_id, turn)."""
    out = {}
    for c, t, role, text in rows:
        named = c is not None and t is not None
        out.setdefault((c, t) if named else (role, text), (c if named else None, t, role, (text or "").replace(KEY, "[redacted:sk]")))
    return sorted(out.values(), key=str)


def found(spark, output):
    rows = archive.read_back(spark, output).select(F.regexp_extract("block_id", r"^(\d+):", 1).alias("c"), "line_number", "role", "content").collect()
    return sorted(((int(r["c"]) if r["c"] else None, r["line_number"], r["role"], r["content"]) for r in rows), key=str)


def state(spark, output):
    return sorted(map(str, archive.read_back(spark, output).collect()))


@pytest.fixture
def places(tmp_path):
    return {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}


def test_archive_takes_only_what_is_new(spark, places):
    one, two = turns_of(0, 12), turns_of(12, 20) + turns_of(3, 5) + [(3, 9, "user", "a later turn"), (None, 1, "user", "no conversation"), (7, None, None, None)]
    put(spark, one, places["input"])
    n = archive.run(spark, **places, parts=4)
    assert (n["rows_read"], n["blocks_written"], n["sessions_written"]) == (36, 36, 12)
    assert found(spark, places["output"]) == wanted(one)
    put(spark, two, places["input"])
    n = archive.run(spark, **places, parts=4)
    assert (n["rows_read"], n["blocks_written"]) == (len(two), len(two) - 6)  # nothing of the first file is read again, what came twice is not written
    assert found(spark, places["output"]) == wanted(one + two)
    before = state(spark, places["output"])
    assert archive.run(spark, **places, parts=4) == {"batches": 0, "rows_read": 0, "blocks_written": 0, "sessions_written": 0}
    assert state(spark, places["output"]) == before
    sessions = {r["session_id"]: r for r in spark.read.parquet(f"{places['output']}/sessions").collect()}
    assert len(sessions) == 20 and sessions["conv_3"]["blocks"] == 4 and sessions["conv_3"]["last_line"] == 9 and sessions["conv_5"]["redacted"] == 3
    assert all(r["chars"] == sum(len(x[3]) for x in wanted(one + two) if x[0] is not None and x[1] is not None and f"conv_{x[0]}" == s) for s, r in sessions.items())


def test_archive_in_many_batches_equals_one(spark, places, tmp_path):
    for at in range(0, 20, 5):
        put(spark, turns_of(at, at + 5) + turns_of(0, 2), places["input"])
    archive.run(spark, **places, parts=4, files_per_batch=1)
    other = {"input": places["input"], "output": str(tmp_path / "whole"), "checkpoint": str(tmp_path / "mark2")}
    archive.run(spark, **other, parts=4)
    assert state(spark, places["output"]) == state(spark, other["output"])


def test_archive_runs_again_after_a_failed_batch(spark, places, monkeypatch):
    put(spark, turns_of(0, 6), places["input"])
    archive.run(spark, **places, parts=4)
    put(spark, turns_of(4, 9), places["input"])
    with monkeypatch.context() as m:
        m.setattr(archive, "rolled_up", lambda blocks: 1 / 0)  # after the blocks are written, before the batch is done
        with pytest.raises(Exception, match="division"):
            archive.run(spark, **places, parts=4)
    archive.run(spark, **places, parts=4)
    assert found(spark, places["output"]) == wanted(turns_of(0, 9))
    assert {r["session_id"]: r["blocks"] for r in spark.read.parquet(f"{places['output']}/sessions").collect()} == {f"conv_{c}": 3 for c in range(9)}


def test_archive_catches_up_after_a_run_that_lost_its_last_step(spark, places, monkeypatch):
    put(spark, turns_of(0, 6), places["input"])
    with monkeypatch.context() as m:
        m.setattr(archive, "replace_partitions", lambda rows, path, *by: (1 / 0) if path.endswith("/sessions") else replace_partitions(rows, path, *by))
        with pytest.raises(ZeroDivisionError):
            archive.run(spark, **places, parts=4)
    n = archive.run(spark, **places, parts=4)  # nothing new, and yet the sessions that lacked
    assert (n["rows_read"], n["sessions_written"]) == (0, 6)


def test_archive_of_nothing(spark, places):
    spark.createDataFrame([], TURNS).write.parquet(places["input"])
    archive.run(spark, **places)
    assert archive.read_back(spark, places["output"]).count() == 0
    put(spark, [(1, 0, "user", None), (1, 1, "user", "x" * 300_000), (1, 2, "user", " ok ")], places["input"])
    archive.run(spark, **places)
    assert {r["line_number"]: (r["n_chars"], r["recall"]) for r in archive.read_back(spark, places["output"]).collect()} == {0: (0, False), 1: (300_000, True), 2: (4, False)}


def test_sweep_replaces_the_tenants_it_sweeps(spark, sf_dir, tmp_path):
    out = str(tmp_path / "swept")
    read = lambda: sorted(map(str, sweep_lifecycle.read_back(spark, out, queries.NOW).collect()))
    first = sweep_lifecycle.run(spark, sf_dir, out, queries.NOW)
    whole = read()
    assert first["capsules_read"] == len(whole) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and first["changed"] > 0
    assert sweep_lifecycle.run(spark, sf_dir, out, queries.NOW) == first and read() == whole  # again, the same
    sweep_lifecycle.run(spark, sf_dir, out, queries.NOW, tenants=["de"], idle_after_days=0, promote_after_days=10_000)
    rows = spark.read.parquet(f"{out}/state")
    assert rows.where("tenant = 'de' and action = 'promoted'").count() == 0
    assert rows.where("tenant <> 'de'").count() == sum("tenant='de'" not in r for r in whole)
    sweep_lifecycle.run(spark, sf_dir, out, queries.NOW, tenants=["de"])
    assert read() == whole


def test_sweep_actions(spark):
    base = {"tenant": None, "capsule_type": "experience", "confidence": 0.5, "decay_score": 0.3, "created_at": "1".rjust(20, "0"), "updated_at": queries.NOW, "last_used_at": None, "last_recalled_at": None, "expires_at": None, "content": "short", "code_refs": []}
    old = "0".rjust(20, "0")
    rows = [
        base | {"capsule_id": "idle", "status": "active"}, base | {"capsule_id": "recalled", "status": "active", "last_recalled_at": old}, base | {"capsule_id": "told", "status": "active"},
        base | {"capsule_id": "expired", "status": "pending_confirmation", "expires_at": queries.NOW}, base | {"capsule_id": "ripe", "status": "pending_confirmation", "updated_at": str(int(queries.NOW) - 8 * 86_400_000).rjust(20, "0")},
        base | {"capsule_id": "fresh", "status": "pending_confirmation"}, base | {"capsule_id": "long", "status": "active", "content": None},
    ]
    schema = ", ".join(f"{c} {'double' if c in ('confidence', 'decay_score') else 'array<string>' if c == 'code_refs' else 'string'}" for c in rows[0])
    capsules = spark.createDataFrame([tuple(r[c] for c in rows[0]) for r in rows], schema)
    feedback = spark.createDataFrame([("f1", "told", "incorrect", old), ("f2", "told", "useful", old), ("f3", "nobody", "useful", old)], "feedback_id string, capsule_id string, kind string, created_at string")
    out = {r["capsule_id"]: r for r in sweep_lifecycle.swept(capsules, feedback, queries.NOW, 7, ["experience"], 0.45, 9, 0.5, 0.25, 400).collect()}
    assert {k: (r["action"], r["status"]) for k, r in out.items()} == {
        "idle": ("archived_idle", "archived"), "recalled": (None, "active"), "told": ("by_feedback", "archived"), "expired": ("expired", "archived"), "ripe": ("promoted", "active"), "fresh": (None, "pending_confirmation"), "long": (None, "active"),
    }
    assert out["told"]["tenant"] == "" and abs(out["told"]["confidence"] - 0.6) < 1e-9 and out["told"]["validated_at"] == old


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, sf_dir, name):
    from test_queries import plain
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    conf = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    df = queries.QUERIES[name](spark, sf_dir)
    assert conf == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    rows = [[plain(r[c]) for c in order] for r in df.collect()]
    assert rows and sorted(rows, key=str) == sorted(([plain(v) for _, v in sorted(zip(columns, r, strict=True))] for r in result.fetchall()), key=str)


def test_command_line(tmp_path, sf_dir):
    config = json.loads((ROOT / "jobs/sweep_lifecycle.json").read_text()) | {"tables": sf_dir, "output": str(tmp_path / "out"), "tenants": ["fr"]}
    (tmp_path / "own.json").write_text(json.dumps(config))
    ran = subprocess.run([sys.executable, "-m", "jobs.sweep_lifecycle", "--config", str(tmp_path / "own.json"), "--idle-after-days", "3"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0 and "sweep_lifecycle: read" in ran.stderr and (tmp_path / "out/state/tenant=fr").exists() and not (tmp_path / "out/state/tenant=en").exists()
