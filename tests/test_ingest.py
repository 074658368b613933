"""Streamed ingest equals the batch: distinct keys, resumed without repeats."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.streaming.ingest import DistinctSink, ingest


def test_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put = lambda name, ids: (src / name).write_text("\n".join([*(json.dumps({"id": f"ü{i}", "text": "t"}) for i in ids), "", "{cut"]))
    args = (spark, str(src), str(tmp_path / "out"), "id string, text string", "id", str(tmp_path / "ck"), 1)
    put("a.jsonl", [1, 2, 2])
    put("b.jsonl", [2, 3])
    assert ingest(*args) == 3
    assert ingest(*args) == 0
    put("c.jsonl", [3, 4])
    assert ingest(*args) == 1
    assert sorted(r.id for r in DistinctSink(spark, str(tmp_path / "out"), "id").read("id string, text string").collect()) == ["ü1", "ü2", "ü3", "ü4"]


def test_sink_after_a_kill(spark, tmp_path):
    """Batches that run again, after whatever was written, change nothing; the filters' size doesn't grow."""
    sink = DistinctSink(spark, str(tmp_path / "s"), "id", buckets=4, bits=64)  # so few bits that most keys look known
    batch = lambda lo, hi: spark.range(lo, hi).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("text"))
    got = lambda: sorted(int(r.id) for r in sink.read("id string, text string").collect())
    assert [sink.write(batch(0, 100), 0), sink.write(batch(50, 150), 1), sink.write(batch(50, 150), 1)] == [100, 50, 50]
    assert got() == list(range(150))
    broken = batch(140, 200).withColumn("text", F.when(F.col("id") == "199", F.raise_error(F.lit("killed"))).otherwise("t"))
    with pytest.raises(Exception, match="killed"):
        sink.write(broken, 2)
    assert sink.write(batch(140, 200), 2) == 50 and got() == list(range(200))
    for n in range(3, 6):
        assert sink.write(batch(0, 200), n) == 0
    held = spark.read.parquet(f"{tmp_path}/s/_filters/v=5")
    assert held.count() == 4 and {len(r.bits) for r in held.collect()} == {8}
    assert sum(1 for p in (tmp_path / "s" / "_filters").iterdir()) <= 4
