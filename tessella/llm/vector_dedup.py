"""Near-duplicate embeddings by E8 lattice hashing (operator 8).

Each of several tables projects unit vectors to a few random 8-dimensional spaces and
decodes each to its nearest E8 lattice point; the points name a vector's own cell. The
more vectors a label has, the more spaces (blocks) a cell is named by, so that vectors
that aren't alike meet about once at most, and the more tables, so that alike ones are
missed by all of them with a chance of MISS. A
vector also probes the cells of neighbouring lattice points, those towards which its
residual leans most. Vectors that meet, one in its own cell and one probing it, are
verified by cosine in double precision. Meetings are counted once: a pair counts in
the first table and direction in which it meets.

Equal vectors of a label are one node. A cell with many vectors is split into blocks
whose pairs are compared by matrix products; a block gives a count for each vector
and its local components, never the pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import components, materialize, names_apart, shuffles
from ._text import lean, mix

THRESHOLD, MISS = 0.98, 1e-4
MEET = 0.02  # a block's part of the chance that unlike vectors meet in a table: measured 1e-4 with two blocks, under 1e-6 with three
SPREAD = 0.28  # mean distance at the threshold in a projected space, where lattice points are sqrt(2) apart
BLOCK = 1024  # vectors compared with as many in one step
PROBES = 6


@functools.lru_cache(1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    a = [v for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1) for v in [np.eye(8)[i] * s + np.eye(8)[j] * t]]
    signs = np.array(np.meshgrid(*[[0.5, -0.5]] * 8)).reshape(8, -1).T
    return np.concatenate([np.array(a), signs[(signs < 0).sum(1) % 2 == 0]])


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 + {0, 1/2}^8."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(1) % 2 != 0)
        worst = np.abs(off[odd]).argmax(1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


@functools.lru_cache(64)
def _projection(dim: int, table: int, blocks: int) -> np.ndarray:
    r = np.random.default_rng([dim, table, 88])
    q, _ = np.linalg.qr(r.normal(size=(max(dim, 8 * blocks), 8 * blocks)))
    return q[:dim] * (SPREAD / (np.sqrt(2 - 2 * THRESHOLD) * np.sqrt(8 / max(dim, 8 * blocks))))


def cells(unit: np.ndarray, salt: np.ndarray, tables: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(own, probes): hashes [n, tables] and [n, tables, PROBES] for unit vectors of one dimension; salt: a hash of what must be equal."""
    n, dim = unit.shape
    own, probes = np.empty((n, tables), np.int64), np.empty((n, tables, PROBES), np.int64)
    coef = mix(np.arange(7, 7 + 8 * blocks, dtype=np.uint64)) | np.uint64(1)
    r = roots()

    def name(points: list[np.ndarray], t: int) -> np.ndarray:
        whole = np.rint(2 * np.concatenate(points, 1)).astype(np.int64).astype(np.uint64)
        return mix(mix((whole * coef).sum(1, dtype=np.uint64) + np.uint64(t)) ^ salt).astype(np.int64)

    for t in range(tables):
        y = unit @ _projection(dim, t, blocks)
        near, first, second = [], [], []
        for b in range(blocks):
            x = y[:, 8 * b : 8 * b + 8]
            p = decode_e8(x)
            lean = (x - p) @ r.T
            top = np.argpartition(-lean, 1, axis=1)[:, :2]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(lean, top, 1), axis=1), 1)
            near.append(p)
            first.append(p + r[top[:, 0]])
            second.append(p + r[top[:, 1]])
        own[:, t] = name(near, t)
        combos = [near, [first[0], *near[1:]], [*near[:-1], first[-1]], first, [second[0], *near[1:]], [*near[:-1], second[-1]]]
        for k, c in enumerate(combos):
            probes[:, t, k] = name(c, t)
    return own, probes


def scheme(largest: int, dim: int, miss: float = MISS) -> tuple[int, int]:
    """(tables, blocks) for labels of at most so many distinct vectors of that dimension.

    Blocks are added until a vector meets one unlike vector a table at most; tables
    follow from the share of pairs at the threshold that meet in one, measured on
    generated pairs, so that the chance to be missed by all is `miss` at most.
    """
    blocks = 2
    while largest * MEET**blocks > 1 and 8 * (blocks + 1) <= dim:
        blocks += 1
    r = np.random.default_rng(8)
    a, b = r.normal(size=(2, 1000, max(dim, 8 * blocks)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    none = np.zeros(len(a), np.uint64)
    (oa, pa_), (ob, pb) = (cells(x, none, 2, blocks) for x in (a, THRESHOLD * a + np.sqrt(1 - THRESHOLD**2) * b))
    share = ((oa[:, :, None] == pb).any(2) | (ob[:, :, None] == pa_).any(2)).mean()
    return int(np.ceil(np.log(miss) / np.log(1 - min(share, 0.99)))), blocks


def _matrix(column: pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _hash(tables: int, blocks: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b["dim"].to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                for at in range(0, part.num_rows, 2048):
                    c = part.slice(at, 2048)
                    v = _matrix(c["v"]).astype(np.float64)
                    v /= np.abs(v).max(1, keepdims=True)
                    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                    salt = mix(c["label"].to_numpy().astype(np.int64).astype(np.uint64) * np.uint64(2654435761) + np.uint64(d))
                    own, probes = cells(unit, salt, tables, blocks)
                    listed = lambda m, kind: pa.array(list(m.reshape(len(m), -1)), pa.list_(kind))
                    yield pa.RecordBatch.from_arrays([c["node"], c["copies"], listed(unit, pa.float64()), listed(own, pa.int64()), listed(probes, pa.int64())], names=["node", "copies", "u", "own", "probes"])

    return run


def _met(own_a: np.ndarray, probes_b: np.ndarray) -> np.ndarray:
    return (own_a[:, None, None] == probes_b[None, :, :]).any(2)


def _compare(t: int, a: dict, b: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, links, local component) of vectors a in their own cell and b that probe it."""
    linked = (a["u"] @ b["u"].T >= threshold) & (a["node"][:, None] != b["node"][None, :])
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    nodes = np.unique(np.concatenate([a["node"][rows], b["node"][cols]]))
    if not len(nodes):
        return nodes, nodes, nodes
    a, b, linked = {k: v[rows] for k, v in a.items()}, {k: v[cols] for k, v in b.items()}, linked[np.ix_(rows, cols)]
    fresh = linked.copy()
    for s in range(t):
        fresh &= ~_met(a["own"][:, s], b["probes"][:, s]) & ~_met(b["own"][:, s], a["probes"][:, s]).T
    later = a["node"][:, None] > b["node"][None, :]
    fresh &= ~(later & _met(b["own"][:, t], a["probes"][:, t]).T)
    ia, ib = np.searchsorted(nodes, a["node"]), np.searchsorted(nodes, b["node"])
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, ia, fresh @ b["copies"])
    np.add.at(links, ib, a["copies"] @ fresh)
    label, i, j = np.arange(len(nodes)), *np.nonzero(linked)
    x, y = ia[i], ib[j]
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return nodes, links, nodes[label]
        label = new


def _verify(threshold: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                if not b.num_rows:
                    continue
                g = np.stack([b[c].to_numpy() for c in ("key", "i", "j")])
                cuts = [0, *(np.flatnonzero((g[:, 1:] != g[:, :-1]).any(0)) + 1), b.num_rows]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    now = b.slice(x, y - x)
                    if held and any(held[0][c][0] != now[c][0] for c in ("key", "i", "j")):
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(now)
            if held:
                yield pa.Table.from_batches(held)

        out: list[tuple] = []
        for t in groups():
            probing = t["probing"].to_numpy()
            if probing.all() or not probing.any():
                continue
            sides = []
            for side in (~probing, probing):
                s = t.filter(pa.array(side))
                n = s.num_rows
                sides.append({"node": s["node"].to_numpy(), "copies": s["copies"].to_numpy(), "u": _matrix(s["u"]), "own": _matrix(s["own"]), "probes": _matrix(s["probes"]).reshape(n, -1, PROBES)})
            out.append(_compare(t["t"][0].as_py(), *sides, threshold))
            if len(out) >= 500:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["node", "links", "near"])


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared within equal non-null labels and equal lengths only.
    Vectors that are null, empty, zero, or hold null or non-finite components, and
    those of null label, are linked with nothing. Repeated rows are vectors of their
    own and linked with each other. An empty table gives no rows; other columns
    are not read.
    """
    v = F.col("v")
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    plain = F.transform(v, lambda x: x + 0.0)  # -0.0 is 0.0
    d = d.withColumn("node", F.when(fine, F.xxhash64("label", plain))).withColumn("check", F.xxhash64(F.lit(1), plain, "label"))
    d = names_apart(d)
    one = d.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"), F.min(F.struct("label", "v")).alias("x"))
    one = materialize(one.select("node", "copies", "rep", "x.label", "x.v", F.size("x.v").alias("dim")), "vec-nodes")
    largest = one.groupBy("label", "dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).select("n", "dim").first() or (0, 64)
    tables, blocks = scheme(*largest)
    hashed = materialize(one.select("node", "copies", "label", "v", "dim").mapInArrow(_hash(tables, blocks), "node long, copies long, u array<double>, own array<long>, probes array<long>"), "vec-cells")
    own = hashed.select("node", F.posexplode("own").alias("t", "key"), F.lit(False).alias("probing"))
    probes = hashed.select("node", F.posexplode("probes").alias("p", "key"), F.lit(True).alias("probing")).select("node", F.expr(f"int(p div {PROBES})").alias("t"), "key", "probing")
    met = own.union(probes)
    # cells in which an own vector meets a probing one, with the blocks they are cut into
    live = met.groupBy("key").agg(F.sum(F.when(F.col("probing"), 0).otherwise(1)).alias("n_own"), F.sum(F.when(F.col("probing"), 1).otherwise(0)).alias("n_probe"), F.min("node").alias("n0"), F.max("node").alias("n1"))
    cuts = lambda c: F.ceil(F.col(c) / float(BLOCK)).cast("int")
    live = materialize(live.filter("n_own > 0 and n0 <> n1").select("key", cuts("n_own").alias("bi"), cuts("n_probe").alias("bj")), "vec-live")
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    m = met.join(live, "key")
    blocked = m.filter(~F.col("probing")).withColumn("i", spot("bi")).withColumn("j", every("bj")).unionByName(m.filter("probing").withColumn("j", spot("bj")).withColumn("i", every("bi")))
    rows = blocked.select("key", "t", "probing", "i", "j", "node").join(hashed, "node")
    rows = rows.repartition(shuffles(vectors.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialize(rows.mapInArrow(_verify(threshold), "node long, links long, near long"), "vec-found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.filter("node <> near").select(F.col("node").alias("a"), F.col("near").alias("b")).distinct())
    named = one.select("node", "copies", "rep").join(comp, "node", "left").select("node", "copies", "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    known = materialize(named.join(least, "comp").join(links, "node", "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vec-known")
    out = d.select("vec_id", "node").join(known, "node", "left")
    cid = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(False)).alias("kept"))
