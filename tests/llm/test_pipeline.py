"""The pipeline's stages on a small table: the columns stay, decisions take effect, the last stage reads back."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mixing", "token_ids"]
    from tracelode.llm.common import work_dir, written

    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{work_dir(spark)}/{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert before > counts[0] >= counts[1] >= counts[2] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == counts[3] and sum(r["n_tokens"] for r in last) == max(r["start"] + r["n_tokens"] for r in last)


def held_mb():
    return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon:")) / 1024


def test_driver_gives_back_free_memory(spark, tmp_path):
    """Blocks that were freed below one that is in use stay with the process until they are given back."""
    from tracelode.llm import common

    assert "Trim native heap" in common.driver_gives_back(spark)
    for step in (lambda: common.written(spark.range(3), str(tmp_path / "t")).count(), lambda: common.work_dir(spark)):
        blocks = [b"x" * (60_000 + k % 2) for k in range(2000)]
        last, full = blocks[-1], held_mb()
        del blocks
        step()
        assert held_mb() < full - 60 and last


def test_training_gives_back_free_memory(spark, docs, monkeypatch):
    from tracelode.llm import quality

    calls = []
    monkeypatch.setattr(quality, "driver_gives_back", calls.append)
    quality.train(docs, docs.selectExpr("doc_id", "doc_id % 2 label"))
    assert calls == [spark]


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
