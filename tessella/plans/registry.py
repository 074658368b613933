"""Name -> query and name -> SQL over the driver's tables.

A query is declared once, as SQL over table names, and where the two dialects differ
as a pair of texts. Spark runs it over the Parquet files, so pruning and pushdown
reach the scans; the other text is the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import answers, bundles, checkpoints, corpus, evidence, hooks, multimatch, ranks, retrieval, rollouts, samples, scoring, sequence, splits, stats, traces, trees

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps")
_NAME = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")


def spark_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_NAME.sub(lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", text))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (corpus, retrieval, scoring, sequence, bundles, evidence, stats, splits):
    for _name, _spark, _duck in _module.QUERIES:
        QUERIES[_name] = spark_query(_spark)
        ORACLES[_name] = _duck or _spark
for _module in (answers, evidence, rollouts, ranks, trees, retrieval, samples, checkpoints, hooks, traces, multimatch):  # operators called on DataFrames
    for _name, _call, _duck in _module.CALLS:
        QUERIES[_name] = _call
        if _duck:
            ORACLES[_name] = _duck
