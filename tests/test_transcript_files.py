"""Transcripts through files: as many files as the bytes need, not one a transcript."""

from pathlib import Path

from tessera.queries import sequences


def test_files_do_not_grow_with_transcripts(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(sequences, "shared_dir", lambda _: str(tmp_path))
    found = sequences.transcript_files(spark, sf_dir).first()
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn <> 5")
    assert (found["blocks"], found["files"]) == (c.count(), c.select("conv_id").distinct().count())
    assert found["files"] > 8 >= len([f for f in Path(tmp_path).rglob("part-*")])
