"""Checkpoints of generated traces, and the sentence-normalised retrieval trigger.

Observations are rows: keys, token_index, prefix, prefix_token_ids, triggered. What the
rules call state is windows over a trace in the order of token_index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

# The two patterns, and the order of types at one token.
ANSWER = r"(?i)(?<![\p{L}\p{N}_])the answer is(?![\p{L}\p{N}_])"
BOUNDARY = r"([.!?][\"')\]]?(?:\s|\z))"
PRIORITY = ("first_etc_trigger", "sentence_boundary", "first_sentence_boundary", "token_grid", "before_first_answer_marker")


def collect(observations: DataFrame, keys: list[str], dense: bool = False, stride: int = 0, most_grid: int = 0, trigger: bool = True, boundaries: bool = True, before_answer: bool = True) -> DataFrame:
    """keys, checkpoint_type, candidate_key, token_index, prefix, prefix_token_ids of all candidates.

    The first trigger, the first sentence boundary (dense: every boundary, and every
    stride-th token up to most_grid), and the last prefix that ends before the first
    answer marker. Dense candidates end with the marker; blank prefixes never count.
    """
    if dense and stride <= 0:
        raise ValueError("dense checkpoints need a positive stride")
    w = Window.partitionBy(*keys).orderBy("token_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    o = observations.withColumn("answer_at", F.regexp_instr("prefix", F.lit(ANSWER))).withColumn("n_bounds", F.regexp_count("prefix", F.lit(BOUNDARY)))
    o = o.withColumn("old_bounds", F.coalesce(F.max("n_bounds").over(before), F.lit(0))).withColumn("old_token", F.coalesce(F.max("token_index").over(before), F.lit(-1)))
    o = o.withColumn("answered", F.coalesce(F.max(F.col("answer_at") > 0).over(w), F.lit(False)))
    shown = ["token_index", "prefix", "prefix_token_ids"]
    pick = lambda df, kind, key: df.select(*keys, F.lit(kind).alias("checkpoint_type"), key.alias("candidate_key"), *shown)
    open_ = o.filter(~F.col("answered")) if dense else o
    solid = F.trim("prefix") != ""

    def first(df: DataFrame, kind: str) -> DataFrame:
        least = df.filter(solid).groupBy(*keys).agg(F.min_by(F.struct(*shown), "token_index").alias("x"))
        return least.select(*keys, F.lit(kind).alias("checkpoint_type"), F.lit(kind).alias("candidate_key"), "x.*")

    parts = []
    if trigger:
        parts.append(first(open_.filter("triggered"), "first_etc_trigger"))
    if boundaries and dense:
        new = open_.filter("n_bounds > old_bounds").withColumn("k", F.explode(F.sequence(F.col("old_bounds") + 1, F.col("n_bounds"))))
        parts.append(pick(new.filter(solid), "sentence_boundary", F.concat(F.lit("sentence_boundary_"), F.col("k"))))
    elif boundaries:
        parts.append(first(o.filter("n_bounds > 0"), "first_sentence_boundary"))
    if dense and most_grid:
        reached = lambda c: F.least(F.floor(F.col(c) / stride), F.lit(most_grid)).cast("int")
        new = open_.withColumn("hi", reached("token_index")).withColumn("lo", F.greatest(reached("old_token"), F.lit(0))).filter("hi > lo")
        new = new.withColumn("k", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))))
        parts.append(pick(new.filter(solid), "token_grid", F.concat(F.lit("token_grid_"), (F.col("k") * stride).cast("string"))))
    if before_answer:
        start = o.filter("answer_at > 0").groupBy(*keys).agg(F.min_by(F.struct("token_index", "answer_at"), "token_index").alias("a"))
        prior = o.join(start, keys).filter((F.col("token_index") < F.col("a.token_index")) & (F.length(F.rtrim("prefix")) < F.col("a.answer_at")))
        last = prior.groupBy(*keys).agg(F.max_by(F.struct(*shown), "token_index").alias("x")).select(*keys, "x.*").filter(solid)
        parts.append(pick(last, "before_first_answer_marker", F.lit("before_first_answer_marker")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def finalise(candidates: DataFrame, keys: list[str], most: int = 3, stratified: bool = False) -> DataFrame:
    """Candidates by token, then type; of equal token prefixes the first; `most` of them with a checkpoint_index from 0.

    stratified: the trigger and the state before the answer stay, and the others are
    taken at evenly spaced ranks, halves to even.
    """
    kind = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("checkpoint_type"))
    order = [F.coalesce("token_index", F.lit(10**12)), kind, "candidate_key"]
    first = F.row_number().over(Window.partitionBy(*keys, "prefix_token_ids").orderBy(*order))
    c = candidates.withColumn("again", first).filter("again = 1").drop("again")
    w = Window.partitionBy(*keys)
    if stratified:
        c = c.withColumn("all", F.count("*").over(w)).withColumn("anchor", F.col("checkpoint_type").isin(PRIORITY[0], PRIORITY[-1]))
        c = c.withColumn("anchors", F.sum(F.col("anchor").cast("int")).over(w)).withColumn("place", F.row_number().over(Window.partitionBy(*keys, "anchor").orderBy(*order)) - 1)
        slots, top = F.lit(most) - F.col("anchors"), F.col("all") - F.col("anchors") - 1
        even = F.exists(F.sequence(F.lit(0), F.greatest(slots - 1, F.lit(0))), lambda i: F.bround(i * top / F.greatest(slots - 1, F.lit(1))) == F.col("place"))
        mid = F.col("place") == F.floor((top + 1) / 2)
        keep = (F.col("all") <= most) | (F.col("anchor") & (F.col("place") < most)) | (~F.col("anchor") & (slots > 0) & F.when(slots == 1, mid).otherwise(even))
        c = c.filter(keep).drop("all", "anchor", "anchors", "place")
    c = c.withColumn("checkpoint_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return c.filter(F.col("checkpoint_index") < most)


def nearest_earlier(states: DataFrame, keys: list[str], kind: str = "sentence_boundary") -> DataFrame:
    """states with prior, the struct of the last state of the kind strictly before its token; null for none."""
    body = F.struct(*[c for c in states.columns if c not in keys])
    w = Window.partitionBy(*keys).orderBy("token_index").rangeBetween(Window.unboundedPreceding, -1)
    return states.withColumn("prior", F.last(F.when(F.col("checkpoint_type") == kind, body), ignorenulls=True).over(w))


def pool_spans(traces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target, attention as pool_attention() gives them, from a row a trace: no row of a token pair exists.

    traces: keys, attention (the row-major matrix of targets' tokens by sources' tokens,
    an array), targets and sources (the first token of each word, then the count of
    tokens). A word's tokens are those from its start up to the next.
    """
    def pool(batches):
        for b in batches:
            where, word, share = [], [], []
            for i, (flat, rows, columns) in enumerate(zip(b["attention"], b["targets"].to_pylist(), b["sources"].to_pylist(), strict=True)):
                if flat.as_py() is None or len(rows or ()) < 2 or len(columns or ()) < 2:
                    continue
                m = np.asarray(flat.values.to_numpy(zero_copy_only=False), np.float64).reshape(rows[-1], columns[-1])
                summed = np.add.reduceat(m, columns[:-1], axis=1)
                mean = np.add.reduceat(summed, rows[:-1], axis=0) / np.diff(rows)[:, None]
                total = mean.sum(1)
                where += [i] * len(mean)
                word += range(len(mean))
                share += np.divide(mean.max(1), total, out=np.zeros(len(mean)), where=total != 0).tolist()
            at = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[k].take(at) for k in keys), pa.array(word, pa.int32()), pa.array(share, pa.float64())], names=[*keys, "target", "attention"])

    schema = StructType([*traces.select(*keys).schema.fields, StructField("target", IntegerType()), StructField("attention", DoubleType())])
    return traces.select(*keys, F.col("attention").cast("array<double>").alias("attention"), "targets", "sources").mapInArrow(pool, schema)


def pool_attention(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target, attention: for each target word the greatest share of a source word.

    pairs: keys, target, target_token, source, weight of every token pair. Weights are
    summed over a source's tokens, averaged over the target's, divided by the target's sum.
    """
    summed = pairs.groupBy(*keys, "target", "target_token", "source").agg(F.sum("weight").alias("w"))
    mean = summed.groupBy(*keys, "target", "source").agg(F.avg("w").alias("w"))
    return mean.groupBy(*keys, "target").agg((F.max("w") / F.sum("w")).alias("attention"))


def sentence_trigger(words: DataFrame, keys: list[str], threshold: float, absolute: bool = False) -> DataFrame:
    """keys, pos, sentence, sentence_end, value: the first word whose trend, weighted by its attention's share of the sentence, passes the threshold.

    words: keys, pos, sentence, attention, trend. Traces without such a word have no row.
    """
    s = Window.partitionBy(*keys, "sentence")
    share = F.col("attention") * F.count("*").over(s) / (F.sum("attention").over(s) + 1e-10)
    v = words.withColumn("sentence_end", F.max("pos").over(s)).withColumn("value", share * F.coalesce("trend", F.lit(0.0)))
    hit = v.filter((F.abs("value") if absolute else F.col("value")) > threshold)
    return hit.groupBy(*keys).agg(F.min_by(F.struct("pos", "sentence", "sentence_end", "value"), "pos").alias("x")).select(*keys, "x.*")


# ---- queries and their SQL

def _trigger(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    w = e.select("user_id", pos.cast("long").alias("pos"), (F.col("event_id") % 17 + 1).cast("double").alias("attention"), (F.col("event_id") % 13 - 6).cast("double").alias("trend"))
    return sentence_trigger(w.withColumn("sentence", F.floor(F.col("pos") / 8)), ["user_id"], 14.0).withColumn("value", F.round("value", 6))


def _traces(spark, sf_dir):
    """A conversation's turns, one more at a time, are the prefixes of a trace."""
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    d = d.select("conv_id", F.col("turns.text").alias("lines"), F.posexplode("turns").alias("i", "turn"))
    k = F.col("i") + 1
    prefix = F.concat(F.array_join(F.slice("lines", F.lit(1), k), "\n"), F.when(F.col("i") >= 4, " So the answer is x").otherwise(""))
    return d.select("conv_id", (k * 5).cast("long").alias("token_index"), prefix.alias("prefix"), F.array(k).alias("prefix_token_ids"), (k % 3 == 2).alias("triggered"))


_SQL = r"""
WITH l AS (SELECT conv_id, row_number() OVER w AS k, list(text) OVER w AS ls FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
     o AS (SELECT conv_id, k * 5 AS t, array_to_string(ls[1:k], chr(10)) || CASE WHEN k >= 5 THEN ' So the answer is x' ELSE '' END AS prefix, k % 3 = 2 AS hit, k FROM l),
     b AS (SELECT *, len(regexp_extract_all(prefix, '[.!?]["'')\]]?(?:[\s\x0B]|\z)')) AS n FROM o WHERE trim(prefix) <> ''),
     c AS (SELECT conv_id, 'first_etc_trigger' AS checkpoint_type, 1 AS p, min(t) AS t FROM b WHERE hit GROUP BY conv_id UNION ALL SELECT conv_id, 'first_sentence_boundary', 3, min(t) FROM b WHERE n > 0 GROUP BY conv_id
       UNION ALL SELECT conv_id, 'before_first_answer_marker', 5, max(t) FROM b WHERE k < 5 AND conv_id IN (SELECT conv_id FROM b WHERE k = 5) GROUP BY conv_id),
     f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, t ORDER BY p) AS again FROM c)
SELECT conv_id, checkpoint_type, t AS token_index, row_number() OVER (PARTITION BY conv_id ORDER BY t, p) - 1 AS checkpoint_index FROM f WHERE again = 1"""

def _matrices(spark, sf_dir):
    """Events of a user's day: a matrix over their places, weights from the values, words of two tokens."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    t = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("es"))
    n, w = F.size("es"), F.col("es.value")
    starts = F.transform(F.sequence(F.lit(0), F.ceil(n / 2).cast("int")), lambda i: F.least(i * 2, n))
    flat = F.flatten(F.transform("es", lambda x, i: F.transform(w, lambda y, j: y + ((i + j) % 3) * 10.0)))
    return t.select("user_id", "day", flat.alias("attention"), starts.alias("targets"), starts.alias("sources"))


_POOLED = """
WITH t AS (SELECT user_id, ts::date AS day, value, row_number() OVER (PARTITION BY user_id, ts::date ORDER BY ts, event_id) - 1 AS i FROM events),
     p AS (SELECT a.user_id, a.day, a.i // 2 AS target, a.i, b.i // 2 AS source, sum(b.value + (a.i + b.i) % 3 * 10.0::double) AS w FROM t a JOIN t b ON a.user_id = b.user_id AND a.day = b.day GROUP BY ALL),
     m AS (SELECT user_id, day, target, source, avg(w) AS w FROM p GROUP BY ALL)
SELECT user_id, day, target::int AS target, round(CASE WHEN sum(w) <> 0 THEN max(w) / sum(w) ELSE 0 END, 6) AS attention FROM m GROUP BY user_id, day, target"""

CALLS = [
    ("pool_spans", lambda spark, sf_dir: pool_spans(_matrices(spark, sf_dir), ["user_id", "day"]).withColumn("attention", F.round("attention", 6)), _POOLED),
    ("sentence_trigger", _trigger, "WITH w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, (event_id % 17 + 1)::double AS a, (event_id % 13 - 6)::double AS m FROM events), s AS (SELECT *, pos // 8 AS sentence FROM w), v AS (SELECT user_id, pos, sentence, max(pos) OVER z AS sentence_end, a * count(*) OVER z / (sum(a) OVER z + 1e-10::double) * m AS value FROM s WINDOW z AS (PARTITION BY user_id, sentence)) SELECT user_id, pos, sentence, sentence_end, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k FROM v WHERE value > 14) q WHERE k = 1"),
    ("checkpoints", lambda spark, sf_dir: finalise(collect(_traces(spark, sf_dir), ["conv_id"]), ["conv_id"]).select("conv_id", "checkpoint_type", "token_index", "checkpoint_index"), _SQL),
]
