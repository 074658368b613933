"""Exact dedup by a Golomb-coded fingerprint exchange (operator 7).

1. Rows are copied to the shared folder where they lie, bucketed by the partition that
   wrote them, their home.
2. Every task hashes its texts in the JVM and writes one slim table: a row per document
   (its place, SHA-256, fingerprint) and a message per owner, the task's sorted distinct
   fingerprints as Golomb-Rice coded gaps.
3. Messages are shuffled to their owners, each a range of fingerprints. An owner decodes
   them and answers every task with a bitmap of the fingerprints held by another message
   or by several rows of the sender.
4. The slim rows read their bit. Documents with a set bit are suspects; a bitmap of these
   goes back to each home, and suspects' texts alone leave it, to be grouped byte by
   byte. Equal texts combine before the shuffle, so a text held by a third of all rows
   costs one row a task. There is one way at every size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import delete, join_counted, materialize, new_path, shuffles
from ._text import lean

BITS = 48


def golomb_encode(gaps: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code with divisor 2**k: all quotients in unary (ones, then a zero), then all remainders of k bits."""
    q, r = (gaps >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    ends = np.cumsum(q + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 0
    places = np.arange(k - 1, -1, -1, dtype=np.uint64)
    return np.packbits(np.r_[unary, ((r[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()]).tobytes()


def golomb_decode(data: bytes, k: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    zeros = np.flatnonzero(bits == 0)[:n]
    q = (np.diff(zeros, prepend=-1) - 1).astype(np.uint64)
    start = int(zeros[-1]) + 1 if n else 0
    r = bits[start : start + n * k].reshape(n, k).astype(np.uint64) @ (np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64)) if k else np.zeros(n, np.uint64)
    return (q << np.uint64(k)) + r.astype(np.uint64)


def _send(owners: int):
    span = (1 << BITS) // owners + 1

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        fp = t["fp"].to_numpy().astype(np.uint64)
        known, place, count = np.unique(fp, return_inverse=True, return_counts=True)
        owner = (known // np.uint64(span)).astype(np.int64)
        starts = np.searchsorted(owner, np.arange(owners + 1))
        n, none = len(fp), lambda kind, m: pa.nulls(m, kind)
        yield pa.RecordBatch.from_arrays(
            [*(t[c].combine_chunks() for c in ("doc_id", "home", "at")), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(n, dtype=np.int64)), t["sha"].combine_chunks(), pa.array(owner[place]), pa.array((place - starts[owner[place]]).astype(np.int64)), none(pa.int32(), n), none(pa.int32(), n), none(pa.binary(), n), none(pa.binary(), n)],
            schema=_SLIM,
        )
        sent = [o for o in range(owners) if starts[o + 1] > starts[o]]
        messages = []
        for o in sent:
            own = known[starts[o] : starts[o + 1]]
            gaps = np.diff(own, prepend=np.uint64(o * span))
            k = max(0, int(np.log2(max(1.0, 0.69 * span / len(own)))))
            messages.append((k, len(own), golomb_encode(gaps, k), np.packbits(count[starts[o] : starts[o + 1]] > 1).tobytes()))
        m = len(sent)
        yield pa.RecordBatch.from_arrays(
            [*[none(pa.int64(), m)] * 3, pa.array(np.full(m, part, np.int64)), none(pa.int64(), m), none(pa.string(), m), pa.array(sent, pa.int64()), none(pa.int64(), m), *(pa.array(x, kind) for x, kind in zip(zip(*messages, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True))],
            schema=_SLIM,
        )

    return run


_SLIM = pa.schema([("doc_id", pa.int64()), ("home", pa.int64()), ("at", pa.int64()), ("part", pa.int64()), ("idx", pa.int64()), ("sha", pa.string()), ("owner", pa.int64()), ("pos", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("codes", pa.binary()), ("twice", pa.binary())])
_DDL = "doc_id long, home long, at long, part long, idx long, sha string, owner long, pos long, k int, n int, codes binary, twice binary"


def _answer(owners: int):
    span = (1 << BITS) // owners + 1

    def run(batch: pa.Table) -> pa.Table:
        o = batch["owner"][0].as_py()
        sets = [np.cumsum(golomb_decode(c, k, n)) + np.uint64(o * span) for c, k, n in zip(batch["codes"].to_pylist(), batch["k"].to_pylist(), batch["n"].to_pylist(), strict=True)]
        known, count = np.unique(np.concatenate(sets), return_counts=True)
        again = known[count > 1]
        maps = [np.packbits(np.isin(s, again, assume_unique=True) | np.unpackbits(np.frombuffer(t, np.uint8), count=len(s)).astype(bool)).tobytes() for s, t in zip(sets, batch["twice"].to_pylist(), strict=True)]
        return pa.table({"part": batch["part"], "owner": batch["owner"], "bitmap": pa.array(maps, pa.binary())})

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(home, at) sorted in; a bitmap of marked places for each home out."""
    home, held = None, []

    def row() -> pa.RecordBatch:
        at = np.concatenate(held)
        bits = np.zeros(at[-1] + 1, bool)
        bits[at] = True
        return pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["home", "bits"])

    for b in batches:
        homes, at = b["home"].to_numpy(), b["at"].to_numpy()
        starts = np.flatnonzero(np.r_[True, homes[1:] != homes[:-1]]) if len(homes) else []
        for x, y in zip(starts, [*starts[1:], len(homes)], strict=True):
            if homes[x] != home:
                if held:
                    yield row()
                home, held = homes[x], []
            held.append(at[x:y])
    if held:
        yield row()


class Homes:
    """A copy of rows in the shared folder, each known by its home, the partition that wrote it, and its place there.

    The copy is bucketed by home, so rows are marked where they lie: bitmaps move to
    their homes, one row a home, and no row of the copy does.
    """

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        placed = docs.select(F.struct("*").alias("row"), F.spark_partition_id().cast("long").alias("home"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
        name, self.path = f"tessella_{uuid.uuid4().hex}", new_path(spark, "dedup-homes")
        placed.write.option("path", self.path).bucketBy(shuffles(spark), "home").saveAsTable(name)
        self.rows = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # its name; the files stay

    def marked(self, places: DataFrame, yes: bool) -> DataFrame:
        """The rows at the places (home, at), or all others."""
        bits = places.select("home", "at").repartition("home").sortWithinPartitions("home", "at").mapInArrow(lean(_marks), "home long, bits binary")
        byte = F.conv(F.hex(F.expr("substring(bits, int(at div 8) + 1, 1)")), 16, 10).cast("int")
        bit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, int(7 - at % 8))")), F.lit(0))
        met = self.rows.join(bits.hint("shuffle_hash"), "home", "inner" if yes else "left")
        return met.filter(bit != 0 if yes else bit == 0).select("row")

    def delete(self) -> None:
        delete(self.rows.sparkSession, self.path)


def _decided(homes: Homes, ident: Column, text: Column, owners: int | None) -> DataFrame:
    """(doc_id, home, at, sha, copies, top): of a text with several rows the count and the place of the one that stays, else nulls."""
    owners = owners or shuffles(homes.rows.sparkSession)
    hashed = homes.rows.select(ident.alias("doc_id"), "home", "at", F.sha2(text, 256).alias("sha"))
    fp = F.conv(F.substring("sha", 1, BITS // 4), 16, 10).cast("long")
    slim = materialize(hashed.select("doc_id", "home", "at", fp.alias("fp"), "sha").mapInArrow(_send(owners), _DDL), "dedup-slim")
    rows = slim.filter("sha is not null").select("doc_id", "home", "at", "part", "idx", "sha", "owner", "pos")
    answers = slim.filter("codes is not null").select("part", "owner", "k", "n", "codes", "twice").groupBy("owner").applyInArrow(_answer(owners), "part long, owner long, bitmap binary")
    byte = F.conv(F.hex(F.expr("substring(bitmap, int(pos div 8) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, int(7 - pos % 8)) & 1")
    suspects = materialize(rows.join(answers, ["part", "owner"]).withColumn("byte", byte).filter(bit == 1).select("doc_id", "home", "at", "sha"), "dedup-suspects")
    # byte verification: suspects' texts leave their homes, and equal ones combine before they move
    texts = homes.marked(suspects, True).select(F.sha2(text, 256).alias("sha"), text.alias("text"))
    verified = texts.groupBy("sha", "text").agg(F.count("*").alias("copies")).filter("copies > 1").select("sha", "copies")
    top = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "home", "at")).alias("top"))
    groups = materialize(top.join(verified, "sha").select("sha", "copies", "top"), "dedup-groups")
    return join_counted(rows.select("doc_id", "home", "at", "sha"), groups, ["sha"], "copies", slim.count(), "left")


def _last() -> Column:
    return F.col("copies").isNull() | ((F.col("top.home") == F.col("home")) & (F.col("top.at") == F.col("at")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as the empty text. Texts are equal when their bytes are;
    the row with the largest id of a group stays, null ids come first. Of rows
    that repeat both id and text exactly one stays. An empty table gives no
    rows; columns other than the two named are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    homes = Homes(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")))
    made = _decided(homes, F.col("row.doc_id"), F.col("row.text"), owners)
    homes.delete()  # what is left to do needs no texts
    return made.select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        _last().alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns as they are, whatever their names.

    Of rows equal in id and text (null is the empty text) one stays: the first by the
    JSON of all its columns, a null text before an empty one.
    """
    homes = Homes(docs)
    ident, text = F.col("row")[id_col].cast("long"), F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    made = materialize(_decided(homes, ident, text, None).select("home", "at", "sha", "copies", _last().alias("kept"), F.col("doc_id").eqNullSafe(F.col("top.doc_id")).alias("same")), "dedup-made")
    ties = made.filter("copies IS NOT NULL AND same").groupBy("sha").agg(F.count("*").alias("rows")).filter("rows > 1")
    ties = materialize(ties, "dedup-ties")
    gone = made.filter("NOT kept").select("home", "at")
    if ties.isEmpty():
        return homes.marked(gone, False).select("row.*")
    tied = materialize(join_counted(made.filter("copies IS NOT NULL AND same").select("home", "at", "sha"), ties, ["sha"], "rows", made.count()).select("home", "at"), "dedup-tied")
    out = homes.marked(gone.union(tied), False).select("row.*")
    pick = homes.marked(tied, True).groupBy(ident.alias("tie_id"), F.sha2(text, 256).alias("tie_sha")).agg(F.min_by("row", F.struct(F.col("row")[text_col].isNotNull(), F.to_json("row"))).alias("row"))
    return out.unionByName(pick.select("row.*"))
