"""Sinks with guards: exclusive and appending JSON lines, layers, deltas, resumption, shards, run directories."""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scans import _path, exists


def claim(spark: SparkSession, path: str, content: str = "") -> bool:
    """Create the file path with the content; False where it exists. Of several that try at once one succeeds."""
    p, fs = _path(spark, path)
    jvm = spark._jvm
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
        at = jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark._sc._gateway.new_array(jvm.String, 0))
        try:
            jvm.java.nio.file.Files.createFile(at, spark._sc._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        out = fs.create(p, True)
    else:
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
    out.write(bytearray(content.encode()))
    out.hsync()
    out.close()
    return True


def _commits(spark: SparkSession, path: str) -> list[int]:
    p, fs = _path(spark, f"{path}/_commits")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []


def append_jsonl(df: DataFrame, path: str) -> int:
    """Append rows as JSON lines with sorted keys; the commit's number.

    Tasks write a folder of their own, which becomes part of the table when its name is
    in the commit of the next free number. Writers at once get numbers of their own; a
    job that fails or dies leaves a folder that no commit names, so no row.
    """
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", False).json(f"{path}/{folder}")
    n = max(_commits(spark, path), default=-1) + 1
    while not claim(spark, f"{path}/_commits/{n}", folder):
        n += 1
    return n


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows of append_jsonl() and create_jsonl()."""
    folders = [spark.read.text(f"{path}/_commits/{n}", wholetext=True).first() for n in _commits(spark, path)]
    named = [f"{path}/{r[0]}" for r in folders if r and r[0]]  # a commit that is being written names nothing yet
    return spark.read.schema(schema).json(named) if named else spark.createDataFrame([], schema)


def create_jsonl(df: DataFrame, path: str) -> None:
    """Write JSON lines to a path that must not exist; of writers at once exactly one succeeds, before it computes anything."""
    if exists(df.sparkSession, path) or not claim(df.sparkSession, f"{path}/_claim"):
        raise FileExistsError(f"{path} already exists")
    append_jsonl(df, path)


def write_result(report: DataFrame, path: str) -> None:
    """(metric, value) rows, comma-separated without a header."""
    report.select("metric", "value").coalesce(1).write.mode("overwrite").option("header", False).csv(path)


def write_layers(layers: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each layer as JSON lines; one that is there must have as many rows, else it is refused. A layer is computed once."""
    rows = {}
    for name, df in layers.items():
        at, spark = f"{path}/{name}", df.sparkSession
        if exists(spark, at):
            rows[name], held = df.count(), read_jsonl(spark, at, df.schema).count()
            if held != rows[name]:
                raise ValueError(f"{at} has {held} rows, not {rows[name]}")
        else:
            create_jsonl(df, at)
            rows[name] = read_jsonl(spark, at, df.schema).count()
    return rows


def extend_corpus(base: DataFrame, new: DataFrame, path: str, key: str = "hash", order: str = "id") -> DataFrame:
    """Write base with the new rows and, beside it, the new rows alone; of equal new keys the first by order stays. Returns the delta."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    delta = first.join(base.select(key), key, "left_anti").select(*new.columns)
    delta.write.mode("errorifexists").parquet(f"{path}/new")
    kept = base.sparkSession.read.schema(delta.schema).parquet(f"{path}/new")
    base.unionByName(kept).write.mode("errorifexists").parquet(f"{path}/all")
    return kept


def pending(items: DataFrame, sink: str, key: str | list[str]) -> DataFrame:
    """The items whose key the Parquet sink doesn't hold; all of them while there is no sink."""
    if not exists(items.sparkSession, sink):
        return items
    keys = [key] if isinstance(key, str) else key
    return items.join(items.sparkSession.read.parquet(sink).select(*keys).distinct(), keys, "left_anti")


def guard_config(old: dict, new: dict, ignore: tuple = ()) -> None:
    """Raise where the configuration of a run differs from the one it began with."""
    drift = sorted(k for k in {*old, *new} - set(ignore) if old.get(k, "absent") != new.get(k, "absent"))
    if drift:
        raise ValueError(f"the configuration has changed: {drift}")


def free_run_dir(spark: SparkSession, base: str, most: int = 10_000) -> str:
    """The first of base/0, base/1, ... that doesn't exist, made; of drivers that look at once each gets its own."""
    for i in range(most):
        at = f"{base}/{i}"
        if not exists(spark, at) and claim(spark, f"{at}/_claim"):
            return at
    raise FileExistsError(base)


def merge_shards(shards: dict[int, DataFrame], index: str, expected: DataFrame | None = None) -> DataFrame:
    """The rows of strided shards in order. A missing or repeated index, one in the wrong shard, and missing or extra ones against the expected raise."""
    n = len(shards)
    merged = reduce(DataFrame.unionByName, [df.withColumn("shard", F.lit(k)) for k, df in shards.items()])
    bad = merged.filter(F.col(index).isNull() | (F.col(index) % n != F.col("shard"))).limit(1).collect()
    if bad:
        raise ValueError(f"an index is missing or in the wrong shard: {bad[0].asDict()}")
    twice = merged.groupBy(index).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"an index occurs twice: {twice[0][0]}")
    if expected is not None:
        gone = expected.select(index).join(merged, index, "left_anti").limit(1).collect()
        extra = merged.select(index).join(expected, index, "left_anti").limit(1).collect()
        if gone or extra:
            raise ValueError(f"the shards lack {gone} or hold too much {extra}")
    return merged.drop("shard").orderBy(index)
