"""Near-duplicate documents by HyperMinHash (operator 2).

A document's distinct 5-word shingles are hashed; of each of BUCKETS buckets the
least hash is kept as a register: the count of its leading zeros and MANTISSA bits
after the first one. Empty buckets borrow from a full one in a fixed random order.
BANDS bands of ROWS registers give candidate pairs, an estimate of the Jaccard
similarity from equal registers, corrected for registers equal by chance, sorts out
most false ones, and full shingle sets confirm the rest.

Documents with equal sets, told by 128 bits, are one node from the start, so copies
cost nothing.
Within a band's bucket, nodes are first paired with one centre, which joins groups of
near copies at the price of a pair per member. Buckets whose members are still apart
are finished exactly: cut into blocks of about BLOCK nodes, every block meets every
block of its bucket inside a task, where all pairs of different components are
estimated from registers, and then those that are likely are confirmed with their full
sets. Only links leave the task, at most one for each component in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import components, discard, free_name, materialize, names_apart, tasks
from ._text import blocks, lean, mix, slices, words

WORDS, BUCKETS, MANTISSA, ROWS = 5, 256, 10, 6
BANDS = BUCKETS // ROWS
SURE_BELOW = 0.6  # an estimate below this is over five standard errors from 0.75
BLOCK = 512  # nodes of a torn bucket that meet as many in one unit of a task's work
SALTS = 64

_COEF = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def _probes() -> np.ndarray:
    """For bucket j, the order in which an empty one looks at the others: row a is the a-th try of all buckets."""
    a, j = np.meshgrid(np.arange(1, 4 * BUCKETS, dtype=np.uint64), np.arange(BUCKETS, dtype=np.uint64), indexing="ij")
    return (mix(a * np.uint64(1000003) + j * np.uint64(7919) + np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64)


_PROBES = _probes()


def shingles(texts: list[bytes], width: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, part in blocks(texts):
        h, bounds, *_ = words(part)
        s = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            s += h[k : k + len(s)] * _COEF[k]
        s = mix(s)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= width:
                yield np.unique(s[a : b - width + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * _COEF[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield s[:0]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of non-empty sorted sets, 0 nowhere: empty buckets borrow."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for i, s in enumerate(sets):
        bucket = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = (s[first] << np.uint64(BUCKETS.bit_length() - 1)) >> np.uint64(11)
        _, length = np.frexp(rest.astype(np.float64))
        zeros = (53 - length).astype(np.uint64)
        mantissa = ((rest << (zeros + np.uint64(12))) >> np.uint64(64 - MANTISSA)) if len(rest) else rest
        out[i, bucket[first]] = (zeros << np.uint64(MANTISSA)) + mantissa + np.uint64(1)
    full = out > 0
    rows, cols = np.nonzero(~full)
    for probe in _PROBES:
        if not len(rows):
            break
        src = probe[cols]
        ok = full[rows, src]
        out[rows[ok], cols[ok]] = out[rows[ok], src[ok]]
        rows, cols = rows[~ok], cols[~ok]
    for r, c in zip(rows, cols, strict=True):
        out[r, c] = out[r, np.flatnonzero(full[r])[0]]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, corrected for chance collisions."""
    return _corrected((a == b).mean(1))


def estimate_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimate for each row of a with each row of b."""
    if len(a) * len(b) <= 1024:
        return _corrected((a[:, None] == b[None]).mean(2))
    same = np.zeros((len(a), len(b)), np.uint16)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        same += x[:, None] == y[None, :]
    return _corrected(same / BUCKETS)


def overlaps(values: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray, wide: int = 4096) -> np.ndarray:
    """Common elements of each set in one with each in two; set i is values[ends[i]:ends[i + 1]], without repeats."""
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    held = np.flatnonzero(n[at] > 1)  # an element of one set alone is common to none
    column = (np.cumsum(n > 1) - 1)[at[held]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[held[order]]
    out = np.zeros((len(one), len(two)), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, columns, wide):
        x, y = np.searchsorted(column, [c, c + wide])
        has = np.zeros((len(ends) - 1, min(wide, columns - c)), np.float32)
        has[owner[x:y], column[x:y] - c] = 1
        out += has[one] @ has[two].T
    return out.astype(np.int64)


def _corrected(same: np.ndarray) -> np.ndarray:
    # two different minima agree when their zero counts do, at 1/3, and their mantissas
    chance = 2.0**-MANTISSA / 3
    return (same - chance) / (1 - chance)


@lean
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = b["text"].cast(pa.binary()).to_pylist()
        n, node, check, regs, some = [], [], [], [], []

        def flush(some=some, regs=regs) -> None:
            regs += [r.tobytes() for r in registers(some)] if some else []
            some.clear()

        for s in shingles(texts):
            n.append(len(s))
            if not len(s):
                flush()
                node.append(None)
                check.append(None)
                regs.append(None)
                continue
            node.append(int(mix(s + np.uint64(len(s))).sum(dtype=np.uint64).astype(np.int64)))
            check.append(int(mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).astype(np.int64)))
            some.append(s)
            if len(some) == 512:
                flush()
        flush()
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "node", "check", "regs"])


@lean
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coef = mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            c = b.slice(at, 2048)
            r = np.frombuffer(b"".join(c["regs"].to_pylist()), np.uint16).reshape(-1, BUCKETS)[:, : BANDS * ROWS]
            keys = mix((r.reshape(-1, BANDS, ROWS).astype(np.uint64) * coef).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64).ravel()), pa.array(np.repeat(c["node"].to_numpy(), BANDS))], names=["key", "node"])


@lean
def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            keep = np.flatnonzero(estimate(x, y) >= SURE_BELOW)
            yield b.select(["a", "b"]).take(pa.array(keep))


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            c = b.slice(at, 256)
            sets = [s.view(np.int64) for s in shingles(c["text"].cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([c["node"], pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])


def _sets_of(nodes: DataFrame, texts: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(node, s): the full sets of nodes, a table of n tasks."""
    wanted = nodes.join(reps.select("node", "rep"), "node")
    return materialize(texts.join(wanted, texts.doc_id == wanted.rep).select("node", "text").mapInArrow(_sets, "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s")).coalesce(n), "near-sets")


def _confirm(pairs: DataFrame, texts: DataFrame, reps: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= share * union."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    n = tasks(pairs.sparkSession, pairs.count(), 20_000)
    sets = _sets_of(ends, texts, reps, n)
    # a centre with very many pairs gets copies of its set under SALTS keys
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    centres = salted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = salted.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(centres, ["a", "salt"])
    common = F.size(F.array_intersect("sa", "sb"))
    out = materialize(both.filter(100 * common >= share * (F.size("sa") + F.size("sb") - common)).select("a", "b").coalesce(n), "near-links")
    discard(sets)
    return out


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units and the bounds of each, from batches sorted by unit."""

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        return t, np.r_[0, np.flatnonzero(np.diff(t["unit"].to_numpy())) + 1, t.num_rows]

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        u = b["unit"].to_numpy()
        last = int(np.searchsorted(u, u[-1]))
        if held and (last or held[-1]["unit"][0].as_py() != u[0]):
            yield cut([*held, b.slice(0, last)])
            held = []
        elif last:
            yield cut([b.slice(0, last)])
        held.append(b.slice(last))
    if held:
        yield cut(held)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a unit's two blocks; a block that meets itself stands on both sides."""
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return one, two if len(two) else one


@lean
def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each unit, the nodes with a likely partner in another component; units left with the same nodes get one name."""
    for t, bounds in _whole_units(batches):
        node, comp, side = (t[c].to_numpy() for c in ("node", "comp", "side"))
        regs = np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
        rows, names = [], []
        for x, y in zip(bounds, bounds[1:], strict=False):
            c = comp[x:y]
            if (c == c[0]).all():
                continue
            one, two = _sides(side[x:y])
            ok = (c[one][:, None] != c[two][None]) & (estimate_all(regs[x:y][one], regs[x:y][two]) >= SURE_BELOW)
            at = x + np.union1d(one[ok.any(1)], two[ok.any(0)])
            if len(at):
                rows.append(at)
                names.append(np.full(len(at), mix(node[at].view(np.uint64) * np.uint64(2) + side[at].astype(np.uint64)).sum(dtype=np.uint64)))
        if rows:
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(node[at]), pa.array(comp[at]), pa.array(side[at])], names=["unit", "node", "comp", "side"])


def _joined(share: int):
    """Of each unit, pairs of nodes that meet the threshold and join its components; none that others already imply."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _whole_units(batches):
            node, comp, side = (t[c].to_numpy() for c in ("node", "comp", "side"))
            s = t["s"].combine_chunks()
            s = s.chunk(0) if isinstance(s, pa.ChunkedArray) else s
            ends, values = s.offsets.to_numpy(), s.values.to_numpy()
            a, b = [], []
            for x, y in zip(bounds, bounds[1:], strict=False):
                e, c = ends[x : y + 1], comp[x:y]
                one, two = _sides(side[x:y])
                n = np.diff(e).astype(np.int64)
                common = overlaps(values[e[0] : e[-1]], e - e[0], one, two)
                ok = (c[one][:, None] != c[two][None]) & (100 * common >= share * (n[one][:, None] + n[two][None] - common))
                up = {k: k for k in c.tolist()}
                for i, j in np.argwhere(ok).tolist():
                    p, q = c[one[i]], c[two[j]]
                    while up[p] != p:
                        p = up[p]
                    while up[q] != q:
                        q = up[q]
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        a.append(node[x + one[i]])
                        b.append(node[x + two[j]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _finish(members: DataFrame, comp: DataFrame, texts: DataFrame, able: DataFrame, share: int, n: int) -> DataFrame:
    """Links (a, b) that join all components whose nodes share a bucket of members and meet the threshold."""
    # a bucket in one piece is done, and so is one of two, whose pair is tried
    apart = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    torn = apart.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).filter("c0 <> c1 and n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    block, other = F.pmod(F.xxhash64("node", "key"), F.col("k")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = apart.join(torn, "key").select("key", "node", "comp", block.alias("block"), other.alias("other"))
    unit = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.select(unit.alias("unit"), "node", "comp", (F.col("block") > F.col("other")).cast("int").alias("side"))
    met = dealt.join(able.select("node", "regs"), "node").repartition("unit").sortWithinPartitions("unit")
    close = materialize(met.mapInArrow(_close, "unit long, node long, comp long, side int").distinct().coalesce(n), "near-close")
    sets = _sets_of(close.select("node").distinct(), texts, able, n)
    links = close.join(sets, "node").repartition("unit").sortWithinPartitions("unit").mapInArrow(_joined(share), "a long, b long")
    out = materialize(links.distinct().coalesce(n), "near-links")
    discard(close)
    discard(sets)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are split at ASCII white space, A-Z lower-cased. With fewer than 5 words
    the sequence is the one shingle; a null, empty or blank text has none and is
    linked with nothing, a component of its own. Repeated ids count as one
    document of their component, and every row with the least id is kept. A null
    id never names a component that has another id. An empty table gives no rows;
    other columns are not read.

    At the threshold a pair shares one of the BANDS bands with probability
    1 - (1 - 0.75^6)^42 = 0.9997, at 0.8 0.999997. All pairs that share one and are
    not yet in one component are tried.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    sig = materialize(d.mapInArrow(_signatures, "doc_id long, n_shingles long, node long, check long, regs binary"), "near-sig")
    sig = names_apart(sig)
    some = sig.filter("node is not null")
    n_docs = tasks(docs.sparkSession, sig.count(), 40_000)
    reps = materialize(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs")).coalesce(n_docs), "near-nodes")
    told = materialize(sig.select("doc_id", "n_shingles", "node").coalesce(n_docs), "near-told")
    discard(sig)
    bands = reps.select("node", "regs").mapInArrow(_bands, "key long, node long")
    full = materialize(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).filter("n > 1").select("key", "centre"), "near-centres")
    members = materialize(bands.join(full, "key"), "near-members")  # of buckets with two nodes or more
    discard(full)
    n = tasks(docs.sparkSession, members.count())
    able = materialize(reps.join(members.select("node").distinct(), "node", "left_semi").coalesce(n_docs), "near-able")
    names = materialize(reps.select("node", "rep").coalesce(n_docs), "near-names")
    discard(reps)
    regs = able.select("node", "regs")
    pairs = materialize(members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct().coalesce(n), "near-pairs")
    comp = names.select("node", F.col("node").alias("comp")).limit(0)
    if not pairs.isEmpty():
        likely = pairs.join(regs.withColumnsRenamed({"node": "a", "regs": "ra"}), "a").join(regs.withColumnsRenamed({"node": "b", "regs": "rb"}), "b")
        likely = materialize(likely.select("a", "b", "ra", "rb").coalesce(n).mapInArrow(_likely, "a long, b long"), "near-likely")
        discard(pairs)
        links = _confirm(likely, d, able, share)
        discard(likely)
        comp = components(links)
        more = _finish(members, comp, d, able, share, n)
        if not more.isEmpty():
            comp = components(links.union(more))
    named = names.join(comp, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    ids = materialize(named.join(least, "comp").select("node", "component_id"), "near-ids")
    out = told.join(ids, "node", "left")
    cid = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 75, broadcast: int = 1 << 20) -> DataFrame:
    """The rows of docs that near_dedup keeps, all columns as they are; rows of null id stay."""
    drops = materialize(near_dedup(docs, id_col, text_col, share).filter("not kept and doc_id is not null").select("doc_id").distinct(), "near-drops")
    drop = free_name(docs, "drop_id")
    drops = drops.withColumnRenamed("doc_id", drop)
    sized = F.broadcast(drops) if drops.count() <= broadcast else drops
    return docs.join(sized, F.col(id_col).cast("long") == F.col(drop), "left_anti")
