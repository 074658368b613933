"""Incremental ingest of JSON lines with a resumable, idempotent sink of bounded state."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scans import _path, exists

BUCKETS = 64
BITS = 1 << 20  # of a bucket's Bloom filter
HASHES = 4


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES places of each 64-bit hash, by double hashing."""
    h = h.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def _unpacked(filters: pa.Table, bits: int) -> np.ndarray:
    if not filters.num_rows:
        return np.zeros(bits, bool)
    return np.unpackbits(np.frombuffer(filters["bits"][0].as_py(), np.uint8)).astype(bool)


def _probe(bits: int):
    def run(rows: pa.Table, filters: pa.Table) -> pa.Table:
        seen = _unpacked(filters, bits)
        h = rows["hash_"].to_numpy()
        return rows.append_column("known_", pa.array(seen[_places(h, bits)].all(1) if len(h) else np.zeros(0, bool)))

    return run


def _extend(bits: int):
    def run(rows: pa.Table, filters: pa.Table) -> pa.Table:
        seen = _unpacked(filters, bits)
        if rows.num_rows:
            seen[_places(rows["hash_"].to_numpy(), bits)] = True
        bucket = (rows if rows.num_rows else filters)["bucket_"][0].as_py()
        return pa.table({"bucket_": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    return run


class DistinctSink:
    """A Parquet table with one row a key, fed batch by batch: batch=<number>/bucket_=<bucket>/.

    Keys are dealt to buckets, and a bucket has a Bloom filter of fixed size beside the
    table. A batch's rows whose key a filter doesn't know are new; only the others meet
    the keys of their buckets. So the state is BUCKETS filters, whatever came before.
    A batch reads what batches of lower numbers left and writes over what a failed try of
    its own left, so a batch that is run again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS, bits: int = BITS):
        self.spark, self.path, self.key, self.buckets, self.bits = spark, path, key, buckets, bits

    def _filters(self, number: int) -> DataFrame:
        p, fs = _path(self.spark, f"{self.path}/_filters")
        held = [int(s.getPath().getName()[2:]) for s in (fs.listStatus(p) if fs.exists(p) else []) if s.getPath().getName().startswith("v=") and fs.exists(_path(self.spark, f"{self.path}/_filters/{s.getPath().getName()}/_SUCCESS")[0])]
        older = [v for v in held if v < number]
        for v in sorted(older)[:-2]:
            at, _ = _path(self.spark, f"{self.path}/_filters/v={v}")
            fs.delete(at, True)
        if not older:
            return self.spark.createDataFrame([], "bucket_ int, bits binary")
        return self.spark.read.schema("bucket_ int, bits binary").parquet(f"{self.path}/_filters/v={max(older)}")

    def _earlier(self, number: int, schema) -> DataFrame:
        p, fs = _path(self.spark, self.path)
        names = [s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else [])]
        before = [n for n in names if n.startswith("batch=") and int(n[6:]) < number]
        if not before:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", self.path).schema(schema).parquet(*(f"{self.path}/{n}" for n in before))

    def write(self, batch: DataFrame, number: int) -> int:
        """Add a batch; returns its new rows. Rows without a key are left out, of those that share one any stays."""
        spark, at = self.spark, f"{self.path}/batch={number}"
        h = F.xxhash64(self.key)
        rows = batch.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key]).withColumn("hash_", h).withColumn("bucket_", F.pmod(h, F.lit(self.buckets)).cast("int"))
        staged = f"{self.path}/_staged"
        rows.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(rows.schema).parquet(staged)
        filters = self._filters(number)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        probed = rows.groupBy("bucket_").cogroup(filters.groupBy("bucket_")).applyInArrow(_probe(self.bits), f"{ddl}, known_ boolean")
        touched = [r[0] for r in rows.select("bucket_").distinct().collect()]  # buckets at most
        held = self._earlier(number, rows.schema).filter(F.col("bucket_").isin(touched)).select("bucket_", self.key)
        again = probed.filter("known_").join(held, ["bucket_", self.key], "left_anti").select(*rows.columns)
        fresh = probed.filter("NOT known_").select(*rows.columns).unionByName(again)
        fresh.write.mode("overwrite").partitionBy("bucket_").parquet(at)
        new = spark.read.schema(rows.schema).parquet(at)
        wider = new.select("bucket_", "hash_").groupBy("bucket_").cogroup(filters.groupBy("bucket_")).applyInArrow(_extend(self.bits), "bucket_ int, bits binary")
        wider.write.mode("overwrite").parquet(f"{self.path}/_filters/v={number}")
        return new.count()

    def read(self, schema: str) -> DataFrame:
        """The table's rows; empty before the first batch."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*self._folders())

    def _folders(self) -> list[str]:
        p, fs = _path(self.spark, self.path)
        return [str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")]


def ingest(spark: SparkSession, source: str, sink: str, schema: str, key: str, checkpoint: str, files_per_batch: int = 64, buckets: int = BUCKETS, bits: int = BITS) -> int:
    """Append the rows of new files under source to the sink, one row per key; returns the rows added.

    Blank and unreadable lines have a null key and are skipped. A resumed run equals one
    without the failure: see DistinctSink.
    """
    held = DistinctSink(spark, sink, key, buckets, bits)
    added = 0

    def append(batch: DataFrame, number: int) -> None:
        nonlocal added
        added += held.write(batch, number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return added
