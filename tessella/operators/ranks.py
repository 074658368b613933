"""Ranks and balanced chunks of a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64


def global_rank(df: DataFrame, order: list[str], name: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """df with the row's place from 0 in the order of the columns, the first of which is a number.

    Bounds of the first column cut the table into buckets of about one size; places are
    counts of the buckets before and a window within each. Nulls come first.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(order[0], shares, 10_000).alias("c")).first()["c"] or []
    cuts = sorted({float(c) for c in cuts})
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col(order[0]))) if cuts else F.lit(0)
    cut = df.withColumn("bucket_", F.when(F.col(order[0]).isNull(), -1).otherwise(place))
    sizes = cut.groupBy("bucket_").agg(F.count("*").alias("n_"))
    before = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most buckets + 1 rows
    within = F.row_number().over(Window.partitionBy("bucket_").orderBy(*order)) - 1
    placed = cut.withColumn("in_", within).join(F.broadcast(before.select("bucket_", "before_")), "bucket_")
    return placed.withColumn(name, F.col("in_") + F.col("before_")).drop("bucket_", "in_", "before_")


def balanced_chunk(rank: Column, rows: int, chunks: int) -> Column:
    """The chunk from 1 of a rank when the first rows mod chunks chunks get one row more: the rule of ntile."""
    size, extra = divmod(rows, chunks)
    big = F.lit(extra * (size + 1))
    small = F.lit(extra) + F.floor((rank - big) / F.lit(max(size, 1)))
    return (F.when(rank < big, F.floor(rank / F.lit(size + 1))).otherwise(small) + 1).cast("long")


def _ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return global_rank(c, ["c_custkey"]).select("c_custkey", balanced_chunk(F.col("rank"), c.count(), 10).alias("chunk"))


CALLS = [("ntile_chunks", _ntile, "SELECT c_custkey, cast(ntile(10) OVER (ORDER BY c_custkey) AS bigint) AS chunk FROM customer")]
