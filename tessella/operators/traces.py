"""Trends over traces of words, queries from attention, advantages and transitions, on any table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessella.streaming.detector import START, step


def trends(words: DataFrame, keys: list[str], order: list[str], entropy: str = "entropy", content: str = "content") -> DataFrame:
    """words with trend, by windows: the smoothed second difference of a content word's entropy, 0 for others.

    First differences are between neighbouring content words, second ones between
    neighbouring first ones that aren't 0. Smoothing weighs a second difference against
    the one before by their distances from the running mean.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    h = F.col(entropy).cast("double")
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    t = words.withColumn("h_", F.when(F.col(content), h)).withColumn("old_h_", last(F.col("h_")))
    t = t.withColumn("s1_", F.coalesce(F.col("h_") - F.col("old_h_"), F.lit(0.0)))
    t = t.withColumn("old_s1_", last(F.when(F.col("s1_") != 0, F.col("s1_"))))
    t = t.withColumn("s2_", F.when(F.col("s1_") != 0, F.coalesce(F.col("s1_") - F.col("old_s1_"), F.lit(0.0))).otherwise(0.0))
    some = F.when(F.col("s2_") != 0, F.col("s2_"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("m_", F.sum(some).over(upto) / F.count(some).over(upto)).withColumn("p_", F.coalesce(last(some), F.lit(0.0)))
    far = F.abs(F.col("p_") - F.col("m_"))
    gap = F.abs(F.col("s2_") - F.col("m_")) + far
    alpha = 0.9 + 0.1 * F.when(gap == 0, 0.0).otherwise(far / gap)
    trend = F.when(F.col("s2_") != 0, alpha * F.col("s2_") + (1 - alpha) * F.col("p_")).otherwise(0.0)
    return t.withColumn("trend", trend).select(*words.columns, "trend")


def folded_trends(words: DataFrame, keys: list[str], order: list[str], entropy: str = "entropy", content: str = "content") -> DataFrame:
    """trends() by the stream's own step: traces lie sorted in partitions and are folded with a few numbers of state, however long they are."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, START
        for b in batches:
            out = []
            for key, h, c in zip(zip(*(b[k].to_pylist() for k in keys), strict=True), b[entropy].to_pylist(), b[content].to_pylist(), strict=True):
                if key != at:
                    at, state = key, START
                state, trend = step(state, h, bool(c) and h is not None)
                out.append(trend)
            yield b.append_column("trend", pa.array(out, pa.float64()))

    dealt = words.withColumn(entropy, F.col(entropy).cast("double")).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(fold, StructType([*dealt.schema.fields, StructField("trend", DoubleType())]))


def formulate(words: DataFrame, keys: list[str], most: int | None = 35, ratio: float | None = None, order: str = "pos", word: str = "word", attention: str = "attention", content: str = "content") -> DataFrame:
    """keys, query: the content words of the most attention, in the order of the text, joined by spaces.

    `most` of them, or with most=None the whole part of `ratio` of their number. Equal
    attention is settled by place. Traces without such a word have an empty query.
    """
    if (most is None) == (ratio is None):
        raise ValueError("give most or ratio, not both")
    w = Window.partitionBy(*keys, content)
    place = F.row_number().over(w.orderBy(F.desc(attention), order))
    wanted = F.lit(most) if most is not None else F.floor(F.count("*").over(w) * F.lit(ratio))
    chosen = F.when(F.col(content) & (place <= wanted), F.struct(F.col(order), F.col(word)))
    return words.withColumn("at_", chosen).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("at_")), lambda x: x[word]), " ").alias("query"))


def step_advantages(tokens: DataFrame, group: list[str], outcome: str, step_score: str, mask: str, beta: float) -> DataFrame:
    """tokens with advantage = outcome + beta * the step score, normalised over the group's unmasked tokens and 0 where masked.

    The deviation is the population's, the root of the variance and 1e-8, and 1 in a group of one token.
    """
    w = Window.partitionBy(*group)
    own = F.when(F.col(mask), F.col(step_score))
    deviation = F.when(F.count(own).over(w) <= 1, 1.0).otherwise(F.sqrt(F.var_pop(own).over(w) + 1e-8))
    z = F.coalesce((own - F.avg(own).over(w)) / deviation, F.lit(0.0))
    return tokens.withColumn("advantage", F.col(outcome) + (beta * z if beta > 0 else 0.0))


def next_action(action: Column, response: Column, hop: Column, most: int) -> Column:
    """What follows an action of a reasoning loop; null where it ends.

    Reasoning leads to the analysis of documents unless the response has an answer,
    analysis leads back, and the last hop is always the answer's.
    """
    reasons = action.isin("begin_reasoning", "reasoning")
    open_ = ~F.coalesce(response.rlike(r"(?s)<answer>.*?</answer>"), F.lit(False))
    then = F.when(reasons & open_, "document_analysis").when(action == "document_analysis", "reasoning")
    return F.when(hop == most - 1, "answer_generation").when(hop < most - 1, then)


def join_gold(predictions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Predictions with the columns of their gold; a key without gold raises, whatever columns are read."""
    held = predictions.join(gold.withColumn("gold_", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no gold for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return held.filter(F.when(F.col("gold_"), F.lit(True)).otherwise(missing.cast("boolean"))).drop("gold_")


def zip_arrays(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys, pos and a row for each place of parallel arrays; arrays of unlike lengths raise, a null counts as empty."""
    sizes = [F.coalesce(F.size(F.col(c)), F.lit(0)) for c in columns]
    sizes = [F.greatest(s, F.lit(0)) for s in sizes]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    checked = df.filter(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("arrays of unlike lengths")).cast("boolean")))
    return checked.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("pos", "x")).select(*keys, "pos", *(F.col("x")[c].alias(c) for c in columns))


# ---- queries and their SQL


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("content", F.col("event_type").isin("click", "view", "purchase"))


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks whose value is known are the words of a client's trace."""
    c = spark.read.parquet(f"{sf_dir}/clicks.parquet").filter("client_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    return c.select("client_id", "click_id", "ts", "value", F.coalesce(F.col("kind") != "view", F.lit(False)).alias("content"))


_TRENDS = """
WITH e AS (SELECT client_id, click_id, ts, value AS h, coalesce(kind <> 'view', false) AS content FROM clicks WHERE client_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
     p AS (SELECT *, last_value(CASE WHEN content THEN h END IGNORE NULLS) OVER b AS prev FROM e WINDOW b AS (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id NULLS FIRST, h, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     a AS (SELECT *, CASE WHEN content AND prev IS NOT NULL THEN h - prev ELSE 0 END AS s1 FROM p),
     q AS (SELECT *, last_value(nullif(s1, 0) IGNORE NULLS) OVER b AS ps FROM a WINDOW b AS (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id NULLS FIRST, h, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     t AS (SELECT *, CASE WHEN s1 <> 0 AND ps IS NOT NULL THEN s1 - ps ELSE 0 END AS s2 FROM q),
     z AS (SELECT *, avg(nullif(s2, 0)) OVER (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id NULLS FIRST, h, content ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m, coalesce(last_value(nullif(s2, 0) IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id NULLS FIRST, h, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM t),
     w AS (SELECT *, 0.9::double + 0.1::double * coalesce(abs(p - m) / nullif(abs(s2 - m) + abs(p - m), 0), 0) AS a FROM z)
SELECT client_id, click_id, round(h, 6) AS value, round(CASE WHEN s2 <> 0 THEN a * s2 + (1 - a) * p ELSE 0 END, 6) + 0.0 AS trend FROM w"""
_ORDER = ["ts", "click_id", "value", "content"]


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})


def _query_sql(most: str) -> str:
    return f"""
     SELECT user_id, coalesce(string_agg(event_type, ' ' ORDER BY pos) FILTER (content AND r <= {most}), '') AS query
     FROM (SELECT *, row_number() OVER (PARTITION BY user_id, content ORDER BY value DESC, pos) AS r, count(*) OVER (PARTITION BY user_id, content) AS n FROM (SELECT user_id, event_type, value, event_type IN ('click', 'view', 'purchase') AS content, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) a) b GROUP BY user_id"""


def _formulated(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    words = _events(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return formulate(words, ["user_id"], word="event_type", attention="value", **how)


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kinds = F.array(*map(F.lit, ("begin_reasoning", "reasoning", "document_analysis", "answer_generation")))
    said = F.concat("text", F.when(F.length("text") % 3 == 0, F.concat(F.lit("<answer>"), "role", F.lit("\n</answer>"))).otherwise(""))
    step_ = F.element_at(kinds, (F.length("text") % 4 + 1).cast("int"))
    rows = c.select(F.col("turn").alias("hop"), next_action(step_, said, F.col("turn"), 5).alias("next"))
    return rows.groupBy("hop", F.coalesce("next", F.lit("end")).alias("next")).agg(F.count("*").alias("n"))


def _advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("valid", F.col("event_type") != "error").withColumn("outcome", (F.col("user_id") % 7).cast("double"))
    return _six(step_advantages(e, ["user_id"], "outcome", "value", "valid", 0.25).select("event_id", "advantage"), "advantage")


CALLS = [
    ("click_trends", lambda spark, sf_dir: _six(trends(_clicks(spark, sf_dir), ["client_id"], _ORDER, "value").select("client_id", "click_id", "value", "trend"), "value", "trend"), _TRENDS),
    ("click_trends_folded", lambda spark, sf_dir: _six(folded_trends(_clicks(spark, sf_dir), ["client_id"], _ORDER, "value").select("client_id", "click_id", "value", "trend"), "value", "trend"), _TRENDS),
    ("query_text_topk", lambda spark, sf_dir: _formulated(spark, sf_dir, most=35), _query_sql("35")),
    ("query_text_ratio", lambda spark, sf_dir: _formulated(spark, sf_dir, most=None, ratio=0.3), _query_sql("floor(n * 0.3::double)")),
    ("step_advantages", _advantages, """
     SELECT event_id, round((user_id % 7)::double + 0.25::double * CASE WHEN valid THEN (value - m) / CASE WHEN n <= 1 THEN 1 ELSE sqrt(v + 1e-8) END ELSE 0 END, 6) + 0.0 AS advantage
     FROM (SELECT *, avg(value) FILTER (valid) OVER w AS m, var_pop(value) FILTER (valid) OVER w AS v, count(*) FILTER (valid) OVER w AS n FROM (SELECT *, event_type <> 'error' AS valid FROM events) x WINDOW w AS (PARTITION BY user_id)) y"""),
    ("hop_transitions", _transitions, """
     WITH t AS (SELECT turn AS hop, length(text) % 4 AS k, length(text) % 3 = 0 AS answered FROM conversations)
     SELECT hop, CASE WHEN hop = 4 THEN 'answer_generation' WHEN hop > 4 OR k = 3 THEN 'end' WHEN k = 2 THEN 'reasoning' WHEN answered THEN 'end' ELSE 'document_analysis' END AS next, count(*) AS n FROM t GROUP BY ALL"""),
    ("order_gold", lambda spark, sf_dir: join_gold(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name"), "c_custkey"),
     "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    ("zipped_turns", lambda spark, sf_dir: zip_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts")), ["roles", "texts"], ["conv_id"]),
     "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::int AS pos, role AS roles, text AS texts FROM conversations"),
]
