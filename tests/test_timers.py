"""Typed state with timers: results of the table's operators, and no state once traces are over."""

import datetime as dt

import numpy as np
import pytest

from tessella.operators import checkpoints
from tessella.streaming import detector, timers

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.with_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream(spark, tmp_path, rows, schema, batches, run):
    """run(stream of the batches, then one row long after) written to memory; (rows, state rows after each batch)."""
    at = str(tmp_path / "in")
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(at)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(at)
    name = f"t{abs(hash(str(tmp_path)))}"
    q = run(s).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    return spark.table(name).collect(), [timers.state_rows(p) for p in q.recentProgress if p["stateOperators"]]


def test_detector_frees_its_state(spark, tmp_path):
    r = np.random.default_rng(3)
    schema = "seq_id long, pos long, entropy double, content boolean, ts timestamp"
    rows = [(s, p, float(r.integers(0, 40)) / 4, bool(r.random() < 0.7), START + dt.timedelta(seconds=p)) for s in range(5) for p in range(60)]
    late = [(99, 0, 1.0, False, START + dt.timedelta(days=1))]
    later = [(98, 0, 1.0, False, START + dt.timedelta(days=2))]
    table = spark.createDataFrame(rows, schema)
    want = {(x.seq_id, x.pos, x.trend) for x in detector.detect(table, lambda pos, trend: trend > 6).collect()}
    got, state = stream(spark, tmp_path, rows, schema, [[x for x in rows if x[1] // 15 == k] for k in range(4)] + [late, later], lambda s: timers.detect(s, lambda pos, trend: trend > 6))
    assert {(x.seq_id, x.pos, x.trend) for x in got} == want and len(want) > 2
    per_trace = max(state) // 5
    assert max(state) >= 10 and state[-1] <= 2 * max(1, per_trace)  # what is left is of the two last sequences


@pytest.mark.parametrize(("dense", "stratified", "most"), [(False, False, 3), (True, True, 5), (True, False, 4)])
def test_observer_equals_the_table(spark, tmp_path, dense, stratified, most):
    r = np.random.default_rng(7)
    rows = []
    for s in range(6):
        prefix = ""
        for t in range(1, 30):
            prefix += [" word", " end.", " more!", " so the answer is x" if r.random() < 0.06 else " y"][int(r.integers(4))]
            ids = [t // 2] if s % 2 else [t]
            rows.append((f"q{s}", 3 * t, prefix if t > 2 else "  ", ids, bool(r.random() < 0.1), START + dt.timedelta(seconds=t)))
    schema = "qid string, token_index long, prefix string, prefix_token_ids array<int>, triggered boolean, ts timestamp"
    options = {"dense": dense, "stride": 10, "most_grid": 6} if dense else {}
    table = spark.createDataFrame(rows, schema)
    want = checkpoints.finalise(checkpoints.collect(table, ["qid"], **options), ["qid"], most, stratified)
    want = {(x.qid, x.checkpoint_type, x.candidate_key, x.token_index, x.checkpoint_index) for x in want.collect()}
    ends = [[("zz", 1, "x", [1], False, START + dt.timedelta(days=d))] for d in (1, 2)]
    batches = [[x for x in rows if (x[1] // 3 - 1) // 10 == k] for k in range(3)] + ends
    got, state = stream(spark, tmp_path, rows, schema, batches, lambda s: timers.observe(s, most, stratified, **options))
    assert {tuple(x) for x in got if x.qid != "zz"} == want and len(want) >= 6
    assert state[-1] < max(state) / 3
