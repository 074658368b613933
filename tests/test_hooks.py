"""Hooks: prompts, retries, salvage, rewards and loops with fake models."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import extract as X
from tessella.operators import hooks


def test_generate_and_parse(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, q string").coalesce(1)
    got = hooks.generate(df, lambda f: "Q: " + f["q"], lambda ps: [f'said {{"v": "{p[-1]}"}}.' for p in ps])
    assert sorted((r.k, r.result.v) for r in hooks.parsed(got, "v string").collect()) == [(1, "a"), (2, "b")]

    def broken(prompts):
        raise RuntimeError("down")

    rows = hooks.generate(df, lambda f: f["q"], broken, retries=1, wait=0.0).collect()
    assert {(r.response, r.response_error) for r in rows} == {(None, "down")}


def test_rewards_and_filters(spark):
    df = spark.createDataFrame([("x</step><answer>Rome</answer>", "rome", 0.5), ("y", "z", -1.0)], "t string, g string, s double")
    got = [r.reward for r in hooks.rewards(df, {"fmt": lambda d: X.format_reward(d["t"]), "s2": lambda d: d["s"]}).orderBy("g").collect()]
    assert got == [pytest.approx(1.5), pytest.approx(-2.0)]
    assert hooks.keep_exact(df, "t", "g").count() == 1 and hooks.keep_scored(df, "s").count() == 1


def test_hops_and_search(spark, tmp_path):
    df = spark.createDataFrame([(i, 0, False) for i in range(6)], "qid long, n int, done boolean")

    def save(d, n):
        d.write.parquet(str(tmp_path / str(n)))
        return spark.read.parquet(str(tmp_path / str(n)))

    got = hooks.run_hops(df, lambda d: d.withColumn("n", F.col("n") + 1).withColumn("done", F.col("n") > F.col("qid")), 4, save)
    assert sorted((r.qid, r.n, r.done) for r in got.collect()) == [(0, 1, True), (1, 2, True), (2, 3, True), (3, 4, True), (4, 4, False), (5, 4, False)]
    docs = spark.createDataFrame([("d", "T", "body")], "doc_id string, title string, text string")
    fake = lambda q, k: q.filter("qid < 1").select("qid", F.lit("d").alias("doc_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    rows = {r.qid: r.context for r in hooks.retrieve(df, fake, docs, 1).collect()}
    assert rows[0] == "Doc 1(Title: T) body\n" and rows[5] == ""
