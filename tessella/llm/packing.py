"""Best-fit packing of documents into fixed-length sequences (operator 5).

Documents become pieces of at most `length` tokens. Bulk-synchronous supersteps place
them, one for each halving of the sizes, the largest first. In a superstep pieces and
gaps lie sorted in ranges of their sizes; every range is swept by a task of its own, in
which each piece takes its successor, the smallest gap that holds it, and conflicts are
settled by rank. What is left over in its range meets what is left in the others in one
small task, which also opens sequences for pieces that no gap holds. Gaps go on to the next
superstep through the shared folder. Pieces of a size are interchangeable, so the rows
of these tables are runs: a size, the first rank and how many; they depend on the
number of sizes, not of pieces. Each piece then finds its place by its size and rank.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import materialize
from ._text import lean, slices

LENGTH, RANGES = 2048, 8
EACH = 100_000  # pieces of one size that are ranked in one task, about
CACHE = 300_000  # distinct words a worker remembers
# Fixed value: the pre-tokenisation pattern of the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """ids of whole texts as little-endian uint32 bytes; equal to the tokenizer file's own.

    No pre-token crosses a space that stands between two non-spaces, so texts are
    cut there and the pieces' ids remembered. Texts with other white space before a
    space, or with a special token, go whole.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(keep)]
        byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.fast = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = regex.compile(r"\s |  ")
        self.first: dict[str, bytes] = {}
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                self[word] = out = outer.encode(" " + word)
                return out

        self.words = Words()

    def encode(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.odd.search(text):
            return self.encode(text)
        head, *tail = text.split(" ")
        if tail and not tail[-1]:  # a space at the end is a pre-token of its own
            return self.encode(text)
        return (self.encode(head) if head else b"") + b"".join(map(self.words.__getitem__, tail))


def _pieces(path: str, length: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for b in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = tokens(text) + b"\0\0\0\0"
                n = len(ids) // 4
                first = n if n <= length else n % length or length
                cuts = [0, *range(first, n, length), n] if n > first else [0, n]
                for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for out, v in zip(rows, (doc, i, x, y - x, zlib.crc32(ids[4 * x : 4 * y])), strict=True):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


PIECE, GAP, PLACED, NEXT = range(4)
_RUNS = "kind int, value long, at long, n long, first long, per long, offset long"
_NAMES = [c.split()[0] for c in _RUNS.split(", ")]


def sweep(rows: list[tuple], length: int, opening: bool = False) -> list[tuple]:
    """Rows after a sweep: each piece, from the largest, takes its successor, the smallest gap that holds it.

    Rows are runs (kind, value, at, n, first, per, offset): pieces of a size from the
    rank `at` on; gaps of a size, of the sequences from `at` on; placements, in which
    rank at + k is in sequence first + k // per at offset + k % per * size; and the
    NEXT free sequence. Conflicts are settled by rank: the pieces of a size fill the
    gaps of a size one after the other, and those beyond look on. Pieces that no gap
    holds are left as they are or, if opening, get new sequences.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # sizes of gaps, ascending
    out, free = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    for kind, value, at, n, *rest in sorted(rows):
        if kind == GAP:
            add(value, at, n)
        elif kind == PLACED:
            out.append((kind, value, at, n, *rest))
        elif kind == NEXT:
            free = at
    for _, size, rank, left, *_ in sorted((r for r in rows if r[0] == PIECE), key=lambda r: (-r[1], r[2])):
        while left:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            elif opening:
                gap, first, n = length, free, -(-left // (length // size))
                free += n
            else:
                out.append((PIECE, size, rank, left, 0, 0, 0))
                break
            per = gap // size
            full = min(n, left // per)
            if full:
                out.append((PLACED, size, rank, full * per, first, per, length - gap))
                add(gap - per * size, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:  # the last ones share one sequence
                out.append((PLACED, size, rank, left, first + full, left, length - gap))
                add(gap - left * size, first + full, 1)
                full, left = full + 1, 0
            add(gap, first + full, n - full)
    out += [(GAP, gap, first, n, 0, 0, 0) for gap, runs in gaps.items() for first, n in runs]
    return [*out, (NEXT, 0, free, 0, 0, 0, 0)] if opening else out


def _runs(fn):
    def run(t: pa.Table) -> pa.Table:
        rows = fn(list(zip(*(t[c].to_pylist() for c in _NAMES), strict=True)))
        return pa.table({c: pa.array([r[i] for r in rows], pa.int32() if c == "kind" else pa.int64()) for i, c in enumerate(_NAMES)})

    return run


def place(sizes: DataFrame, length: int = LENGTH, ranges: int = RANGES) -> DataFrame:
    """(size, rank0, ranks, first, per, at): the runs of a best-fit packing of pieces; sizes: length, n.

    A superstep is one job over runs; the driver only starts it.
    """
    spark = sizes.sparkSession
    runs = lambda kind, value, n: [F.lit(kind).alias("kind"), value.cast("long").alias("value"), F.lit(0).cast("long").alias("at"), n.cast("long").alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("first", "per", "offset")]]
    pieces = materialize(sizes.select(*runs(PIECE, F.col("length"), F.col("n"))), "pack-sizes")
    state = spark.createDataFrame([(NEXT, 0, 0, 0, 0, 0, 0)], _RUNS)
    placed, low = [], length
    while low:
        high, low = low, low // 2
        mine = pieces.filter((F.col("value") <= high) & (F.col("value") > low))
        # gaps too small for this superstep wait; the others are dealt with its pieces to ranges of sizes
        fits = (F.col("kind") == GAP) & (F.col("value") > low)
        near = mine.unionByName(state.filter(fits)).withColumn("range", F.floor(F.col("value") * ranges / (length + 1)))
        swept = near.groupBy("range").applyInArrow(_runs(lambda rows: sweep(rows, length)), _RUNS)
        rest = swept.filter(F.col("kind") != PLACED).unionByName(state.filter(F.col("kind") == NEXT))
        settled = rest.groupBy(F.lit(0).alias("one")).applyInArrow(_runs(lambda rows: sweep(rows, length, True)), _RUNS)
        out = swept.filter(F.col("kind") == PLACED).unionByName(settled).unionByName(state.filter((F.col("kind") == GAP) & ~fits))
        state = materialize(out.coalesce(1), "pack-runs")
        placed.append(state.filter(F.col("kind") == PLACED))
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    return every.select(F.col("value").alias("size"), F.col("at").alias("rank0"), F.col("n").alias("ranks"), "first", "per", F.col("offset").alias("at"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and a closing id 0; a null text counts as empty
    and has the closing id alone. Only documents longer than `length` are cut, the
    first piece taking the remainder. Repeated rows are packed each; which of them
    gets which place is open. An empty table gives no rows; other columns are not
    read. Ranks within a size come from counts per (size, hash bucket), as many
    buckets as the size needs, so a size shared by a third of all rows is ranked in
    many tasks.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    d = materialize(d.mapInArrow(_pieces(tokenizer, length), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pack-pieces")
    sizes = materialize(d.groupBy("length").agg(F.count("*").alias("n")).coalesce(1), "pack-counts")  # at most `length` rows
    runs = place(sizes, length)
    by_size = runs.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("rank0", "ranks", "first", "per", "at"))).alias("runs"))
    parts = sizes.select("length", F.ceil(F.col("n") / EACH).alias("parts"))
    dealt = d.join(F.broadcast(parts), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranks = materialize(counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).coalesce(1), "pack-ranks")  # a row for each EACH pieces
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    placed = dealt.withColumn("rn", F.row_number().over(within) - 1).join(ranks, ["length", "bucket"])
    placed = placed.withColumn("rank", F.col("rn") + F.col("before")).join(F.broadcast(by_size), F.col("length") == F.col("size"))
    run = F.filter("runs", lambda r: (r["rank0"] <= F.col("rank")) & (F.col("rank") < r["rank0"] + r["ranks"]))[0]
    placed = placed.withColumn("run", run).withColumn("k", F.col("rank") - F.col("run.rank0"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("run.first + k div run.per").alias("sequence_id"), F.expr("run.at + k % run.per * length").alias("offset"))
