"""Evidence of retrieve actions: title hits, first gold rank, stage labels (an order is an action, its lines the ranked hits, returned parts the gold titles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dialect import pair

_HITS = """
WITH r AS (SELECT l_orderkey, l_partkey, l_returnflag = 'R' AS gold, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS rank FROM lineitem),
     h AS (SELECT l_orderkey, count(DISTINCT CASE WHEN gold THEN l_partkey END) AS n_gold, count(DISTINCT CASE WHEN gold AND rank <= 2 THEN l_partkey END) AS hits, min(CASE WHEN gold AND rank <= 2 THEN rank END) AS first_rank FROM r GROUP BY l_orderkey)"""

QUERIES = [
    ("evidence_labels", *pair(_HITS + """,
     l AS (SELECT o.o_custkey, CASE WHEN h.hits = h.n_gold THEN 'full_hit' WHEN h.hits > 0 THEN 'partial_hit' ELSE 'miss' END AS stage, CASE WHEN o.o_totalprice >= 150000 THEN 'correct' WHEN o.o_totalprice > 50000 THEN 'partial' ELSE 'wrong' END AS outcome FROM h JOIN orders o ON o.o_orderkey = h.l_orderkey WHERE h.n_gold > 0),
     c AS (SELECT stage, outcome, count(*) AS n, count(DISTINCT o_custkey) AS samples FROM l GROUP BY stage, outcome)
        SELECT concat(s.stage, '__', b.outcome) AS label, coalesce(c.n, 0) AS n_actions, coalesce(c.samples, 0) AS n_samples FROM (VALUES ('full_hit'), ('partial_hit'), ('miss')) AS s(stage) CROSS JOIN (VALUES ('correct'), ('partial'), ('wrong')) AS b(outcome) LEFT JOIN c ON c.stage = s.stage AND c.outcome = b.outcome""")),
]


def hit_diagnostics(lines: DataFrame) -> DataFrame:
    """Per order what _HITS and the query's SQL say.

    Distinct parts are an order's own small sets, on the window's shuffle and sort: no
    task holds a table of all its orders and parts.
    """
    gold = F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    r = lines.select("l_orderkey", gold.alias("gold"), (F.col("l_returnflag") == "R").alias("is_gold"), rank.alias("rank"))
    near = F.col("rank") <= 2
    h = r.groupBy("l_orderkey").agg(F.size(F.collect_set("gold")).cast("long").alias("n_gold"), F.size(F.collect_set(F.when(near, F.col("gold")))).cast("long").alias("hits"), F.min(F.when(F.col("is_gold") & near, F.col("rank"))).alias("first_rank"))
    recall = F.when(F.col("n_gold") > 0, F.round(F.col("hits").cast("double") / F.col("n_gold"), 9)).otherwise(0.0)
    return h.select("l_orderkey", "n_gold", "hits", (F.col("hits") > 0).alias("any_hit"), ((F.col("n_gold") > 0) & (F.col("hits") == F.col("n_gold"))).alias("full_hit"), recall.alias("recall"), F.coalesce(F.col("first_rank"), F.lit(-1)).cast("long").alias("first_rank"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_diagnostics(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


CALLS = [
    ("hit_diagnostics", _hits, pair(_HITS + """
        SELECT l_orderkey, n_gold, hits, hits > 0 AS any_hit, n_gold > 0 AND hits = n_gold AS full_hit, coalesce(round(cast(hits AS double) / nullif(n_gold, 0), 9), cast(0 AS double)) AS recall, cast(coalesce(first_rank, -1) AS bigint) AS first_rank FROM h""")[1]),
]
