"""Exact inner-product search over vectors that lie in cells.

An index keeps each vector in the cell of its nearest centre, and of a cell its centre,
its radius and how many vectors it has. No vector of a cell can have an inner product
with a query above q . centre + |q| * radius, so a query opens the cells of the highest
bounds first, and then only those that can still reach its k-th best score. Queries stay
a table: they meet bounded blocks of vectors, and a block gives its best k for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, new_path

SAMPLE = 20_000  # vectors the centres are fitted on, about
MOST = 1024  # cells; their centres go to every executor
FIRST = 2  # cells a query opens first
BLOCK = 4096  # vectors of a cell, and queries, that meet in one task, about
SLICE = 1 << 21  # scores at once


@dataclass(frozen=True)
class Cells:
    """vectors (id, v, cell, block) and cells (cell, centre, radius, n, blocks)."""

    vectors: DataFrame
    cells: DataFrame


def fit_centres(points: np.ndarray, count: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's centres of a sample; fewer where it has fewer distinct points."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:count]]
    for _ in range(rounds):
        near = nearest(points, centres)[0]
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, distance) of each point's nearest centre; the distance is computed from the difference."""
    out = np.zeros(len(points), np.int64)
    norms = (centres**2).sum(1)
    step = max(1, SLICE // max(1, len(centres)))
    for at in range(0, len(points), step):
        out[at : at + step] = np.argmin(norms - 2 * points[at : at + step] @ centres.T, axis=1)
    return out, np.linalg.norm(points - centres[out], axis=1)


def _rows(b: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """The batch's vectors, of one length each and without nulls, as a matrix."""
    return b[column].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _usable(c: Column, size: int) -> Column:
    return c.isNotNull() & (F.size(c) == size) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _unit(v: Column, normalise: bool) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-300))) if normalise else v


def build_cells(vectors: DataFrame, path: str, vector_id: str = "vec_id", column: str = "embedding", cells: int | None = None, normalise: bool = False) -> Cells:
    """Write the index of vectors to a new path and open it.

    Vectors all have the length of the first one; null ones, others and ones with null or
    non-finite components aren't kept. Centres are fitted on a sample of about SAMPLE
    vectors; which centres they are changes how much is pruned and never a result. The
    count of cells follows from the vectors', up to MOST.
    """
    v = F.col(column).cast("array<double>")
    head = vectors.filter(v.isNotNull()).select(F.size(v)).first()
    size = head[0] if head else 0
    kept = vectors.filter(_usable(v, size)).select(F.col(vector_id).cast("long").alias("id"), _unit(v, normalise).alias("v"))
    n = kept.count()
    cells = min(MOST, cells or max(1, int(n**0.5) // 2))
    share = SAMPLE * 2**20 // max(n, 1)
    rows = kept.filter(F.pmod(F.xxhash64("id"), F.lit(2**20)) < share).limit(2 * SAMPLE).select("v").toPandas()["v"]  # bounded by the sample
    centres = fit_centres(np.array([np.asarray(r) for r in rows]), cells) if len(rows) else np.zeros((1, size))
    blocks = -(-n // BLOCK) + 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, far = nearest(_rows(b), centres)
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(near), pa.array(far)], names=["id", "v", "cell", "distance"])

    placed = materialize(kept.mapInArrow(assign, "id long, v array<double>, cell long, distance double"), "vector-cells")
    sizes = placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))  # MOST rows at most
    sizes = sizes.withColumn("blocks", F.least(F.ceil(F.col("n") / BLOCK), F.lit(blocks)))
    spark = vectors.sparkSession
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell long, centre array<double>")
    sizes.join(F.broadcast(known), "cell").write.mode("errorifexists").parquet(f"{path}/cells")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    dealt = placed.join(F.broadcast(sizes.select("cell", "blocks")), "cell").select("id", "v", "cell", block)
    dealt.repartition("cell", "block").write.mode("errorifexists").parquet(f"{path}/vectors")
    return open_cells(spark, path)


def open_cells(spark: SparkSession, path: str) -> Cells:
    return Cells(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"))


def _bounds(index: Cells):
    """(qid, q) in; (qid, cell, bound, place) out, cells in the order of their bounds."""
    held = index.cells.select("cell", "centre", "radius").toPandas()  # MOST rows at most
    cell, radius = held["cell"].to_numpy(np.int64), held["radius"].to_numpy(np.float64)
    centres = np.array([np.asarray(c) for c in held["centre"]], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, SLICE // max(1, len(cell)))):
                b = whole.slice(at, max(1, SLICE // max(1, len(cell))))
                if not len(cell):
                    continue
                q = _rows(b, "q")
                bound = q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radius
                order = np.argsort(-bound, axis=1, kind="stable")
                n, m = bound.shape
                yield pa.RecordBatch.from_arrays([b["qid"].take(pa.array(np.repeat(np.arange(n), m))), pa.array(cell[order].ravel()), pa.array(np.take_along_axis(bound, order, 1).ravel() + 2e-6), pa.array(np.tile(np.arange(m), n))], names=["qid", "cell", "bound", "place"])

    return run


def _best(k: int, apart: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            qid, ids = left["qid"].to_numpy(), right["id"].to_numpy()
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
            v = right["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[by_id]
            q = left["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(qid), -1)
            step = max(1, SLICE // len(ids))
            for at in range(0, len(qid), step):
                score = np.round(q[at : at + step] @ v.T, 6) + 0.0
                if apart:
                    score[qid[at : at + step, None] == ids[None]] = -np.inf
                if k < len(ids):  # all that reach the k-th best, so equal scores are settled by id
                    edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                    rows, columns = np.nonzero((score >= edge) & np.isfinite(score))
                else:
                    rows, columns = np.nonzero(np.isfinite(score))
                found = score[rows, columns]
                order = np.lexsort((columns, -found, rows))  # columns are in the order of ids
                rows, columns, found = rows[order], columns[order], found[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                keep = place < k
                for column, x in zip(out, (qid[at + rows[keep]], ids[columns[keep]], found[keep]), strict=True):
                    column.append(x)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({n: np.concatenate(x) if x else np.zeros(0, t) for n, x, t in zip(("qid", "vec_id", "score"), out, kinds, strict=True)})

    return run


def _open(index: Cells, queries: DataFrame, chosen: DataFrame, k: int, apart: bool) -> DataFrame:
    """The best k of each chosen (qid, cell)'s blocks. Queries of a cell are dealt to parts of about BLOCK."""
    keys = ["cell", "block", "part"]
    counts = chosen.groupBy("cell").agg(F.count("*").alias("asked")).join(F.broadcast(index.cells.select("cell", "blocks")), "cell")
    counts = materialize(counts.withColumn("parts", F.ceil(F.col("asked") / BLOCK)), "vector-asked")  # MOST rows at most
    asked = chosen.join(queries, "qid").join(F.broadcast(counts), "cell")
    asked = asked.select("qid", "q", "cell", F.pmod(F.xxhash64("qid"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    held = index.vectors.join(F.broadcast(counts.select("cell", "parts")), "cell")
    held = held.select("id", "v", "cell", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_best(k, apart), "qid long, vec_id long, score double")


def chosen_cells(index: Cells, queries: DataFrame, k: int, apart: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits of the cells opened first, (qid, cell) opened first, (qid, cell) still to open); queries: qid, q."""
    every = materialize(queries.mapInArrow(_bounds(index), "qid long, cell long, bound double, place long"), "vector-bounds")
    first = every.filter(F.col("place") < FIRST).select("qid", "cell")
    hits = materialize(_open(index, queries, first, k, apart), "vector-first")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    least = hits.withColumn("place", place).filter(F.col("place") == k).select("qid", F.col("score").alias("least"))
    rest = every.filter(F.col("place") >= FIRST).join(least, "qid", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    return hits, first, materialize(rest.select("qid", "cell"), "vector-rest")


def search_cells(index: Cells, queries: DataFrame, k: int, query_id: str = "vec_id", column: str = "embedding", normalise: bool = False, apart: bool = True) -> DataFrame:
    """qid, vec_id, score, rank: the k vectors of the greatest inner products, in double precision, to six decimals.

    apart: a vector isn't its own answer. Queries that aren't of the vectors' length or
    aren't finite have no answers; of rows that share a query id any one is asked.
    """
    head = index.cells.select(F.size("centre")).first()
    v = F.col(column).cast("array<double>")
    asked = queries.filter(_usable(v, head[0] if head else 0)).select(F.col(query_id).cast("long").alias("qid"), _unit(v, normalise).alias("q")).dropDuplicates(["qid"])
    asked = materialize(asked, "vector-queries")
    hits, _, rest = chosen_cells(index, asked, k, apart)
    every = hits.unionByName(_open(index, asked, rest, k, apart))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")).cast("long")
    return every.withColumn("rank", rank).filter(F.col("rank") <= k)


def dense(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "vec_id", vector_id: str = "vec_id", column: str = "embedding", normalise: bool = False, apart: bool = True) -> DataFrame:
    """search_cells() in an index built for this call; for several calls build_cells() once."""
    index = build_cells(vectors, new_path(vectors.sparkSession, "cells"), vector_id, column, normalise=normalise)
    return search_cells(index, queries, k, query_id, column, normalise, apart)
