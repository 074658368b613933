"""Shared-folder tables, words and connected components used by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where none is set and Spark runs in this process alone (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_made: list[str] = []


def tables_made() -> int:
    """A mark for discard_since()."""
    return len(_made)


def discard_since(spark: SparkSession, mark: int) -> None:
    """Delete the tables written by materialize() after the mark; nothing may read them any more."""
    for path in _made[mark:]:
        delete(spark, path)
    del _made[mark:]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for discard_since() to delete."""
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def tasks(spark: SparkSession, rows: int, each: int = 200_000, least: int = 8) -> int:
    """How many tasks write a table of so many rows; never more than the shuffle has."""
    return min(shuffles(spark), max(least, -(-rows // each)))


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        delete(df.sparkSession, path)


HOT = 1000  # rows of one key that one task may meet at any size of table


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows join facts on keys, null-safe for none: facts has one row a key, and in n how many rows hold it.

    Keys of more than HOT rows, or a 2^16th of all, can't be more than 2^16; they go
    to every executor, so their rows stay where they are. The others are met by a
    shuffle in which no key is hot. total: the rows, or more.
    """
    hot = max(HOT, total >> 16)
    many = facts.filter(F.col(n) > hot)
    marked = rows.join(F.broadcast(many.withColumn("hot", F.lit(True))), keys, "left")
    here = marked.filter("hot").drop("hot")
    away = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(facts.filter(F.col(n) <= hot), keys, how)
    return here.unionByName(away)


def names_apart(df: DataFrame) -> DataFrame:
    """df with another node for contents that share the 64 bits of node and differ in those of check, expected from 10^10 contents on."""
    shared = df.filter("node is not null").groupBy("node").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).filter("c0 <> c1")
    if shared.isEmpty():
        return df
    own = F.when(F.col("check") != F.col("c0"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return df.join(shared, "node", "left").withColumn("node", own).drop("c0", "c1")


def free_name(df: DataFrame, base: str) -> str:
    """A column name like base that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return df[name].cast(kind) if name in df.columns else F.lit(None).cast(kind)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node reachable, for every node that has a link.

    Minimum-label propagation with pointer jumping, all in joins and partial
    aggregates; each superstep is one table in the shared folder. Hub nodes are
    safe: minima combine before the shuffle, and AQE splits a skewed join side.
    """
    n = tasks(links.sparkSession, 2 * links.count())
    both = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(b, a)).distinct().coalesce(n), "cc-edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).withColumnRenamed("u", "node").coalesce(n), "cc-labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("root"))
        new = materialize(step.join(jump, "mid").select("node", "old", F.least("mid", "root").alias("comp")).coalesce(n), "cc-labels")
        moved = not new.filter("comp <> old").isEmpty()
        discard(labels)
        labels = new
        if not moved:
            discard(both)
            return labels.select("node", "comp")
