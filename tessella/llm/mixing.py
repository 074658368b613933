"""Mixing sources to target weights by a time-varying curriculum (operator 4, DataFrame functions only).

Every source s has a weight schedule w_s(t) = 1 + a_s (2 t - 1) over training time
t in [0, 1], with a slope a_s that cycles through SLOPES by the source's rank.
Its integral is the cumulative token demand D_s(t) = t + a_s (t^2 - t), a share of
the source's target. A document's place in its source's stream of words gives the
demand it meets; inverting D_s gives its training position, and the result is
range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import WORD, materialize

WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.0, 0.5)
SHARE, CAP = 1.5, 2.0
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, weight, rank, target) for a table (source, source_size), by water filling.

    With sources in order of cap / weight, the first k are full, and the others
    share what is left by weight; k is the least for which the next one isn't
    overfull. That is where resharing the excess again and again ends.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(pick, (F.col("rank") % len(weights) + 1).cast("int")))
    t = t.withColumn("full", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("full") / F.col("weight"), "rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("full_before", F.coalesce(F.sum("full").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("total", F.sum("source_size").over(every) * F.lit(share)).withColumn("weights", F.sum("weight").over(every))
    t = t.withColumn("level", (F.col("total") - F.col("full_before")) / (F.col("weights") - F.col("weight_before")))
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), F.col("rank"), F.col("level")))).over(every)
    t = t.withColumn("at", open_level["level"])
    return t.select("source", "source_size", "weight", "rank", F.least("full", F.coalesce(F.col("at") * F.col("weight"), F.col("full"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, slopes: tuple = SLOPES, sort: bool = True) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position (of the first pass), positions, copies, text_hash, sorted by position.

    A source's documents follow each other in the order of a hash of their id,
    size and text hash, and the stream is read again from its start until the
    target is met; the last document is cut there, so that the words taken miss
    the target by less than one. A null text has no words; the null source
    is a source of its own, the last. Rows that repeat each other are separate
    documents next to each other. A document of which nothing is taken has a
    null position and stands at the end. An empty table gives no rows; further
    columns are not read. Words taken are whole, at most twice a document's size.

    A hot source costs no hot task: places are prefix sums over hash buckets of
    a source, and then within a bucket.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    d = d.withColumn("hash", F.xxhash64("doc_id", "size", "text_hash")).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
    d = materialize(d.select("doc_id", "source", "size", "text_hash", "hash", "bucket"), "mix-docs")
    buckets = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    plan = materialize(offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "o.bucket", "o.offset", "t.source_size", "t.rank", "t.target"), "mix-plan")
    within = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    q = plan.withColumnsRenamed({"source": "ps", "bucket": "pb"})
    m = placed.join(q, placed.source.eqNullSafe(q.ps) & (placed.bucket == q.pb)).withColumn("start", F.col("offset") + F.col("before"))
    want = F.round("target").cast("long")

    def passed(n: int):
        return F.greatest(F.lit(0), F.least(F.col("size"), want - F.col("source_size") * n - F.col("start")))

    taken = sum((passed(n) for n in range(1, int(-(-cap // 1)))), passed(0))
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("rank") % len(slopes) + 1).cast("int"))
    # D(t) = a t^2 + (1 - a) t = u, solved for t in [0, 1] in the form without cancellation
    def place(n: int):
        u = F.least((F.col("start") + F.col("source_size") * n + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))
        return F.when(passed(n) > 0, 2 * u / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)))

    passes = range(int(-(-cap // 1)))
    out = m.withColumn("taken", taken.cast("long")).withColumn("positions", F.array(*[place(n) for n in passes])).withColumn("position", F.col("positions")[0])
    out = out.withColumn("copies", sum((F.when(2 * passed(n) >= F.greatest(F.col("size"), F.lit(1)), 1).otherwise(0) for n in passes), F.lit(0)))
    if sort:
        out = out.orderBy(F.coalesce("position", 2.0 + F.pmod("hash", F.lit(1 << 20)) / float(1 << 20)), "hash", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken", "position", "positions", "copies", "text_hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The training stream: rows of docs as often as the mix takes them, range-sorted by position.

    A pass that takes half of a document's words or more takes the document. Rows
    must differ in id or text, null being the empty text, as they do after exact
    dedup. All columns stay as they are, whatever their names; a document without
    words is taken by no pass. An empty table gives no rows.
    """
    mix = mix_sources(docs, id_col, text_col, source_col, sort=False, **options)
    mix = mix.filter("copies > 0").select(F.col("doc_id").alias("mix_id"), F.col("text_hash").alias("mix_hash"), F.slice("positions", 1, F.col("copies")).alias("at"))
    # one struct a row, so that no column's name can clash
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"))
    taken = rows.join(mix, F.col("id").eqNullSafe(F.col("mix_id")) & (F.col("hash") == F.col("mix_hash")))
    return taken.select("doc", "id", F.explode("at").alias("at")).orderBy("at", "id").select("doc.*")
