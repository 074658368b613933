"""Selections, seeded shuffles, holdouts and splits that agree between runs, and filters of training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in order; all for -1."""
    return df if n == -1 else df.orderBy(*order).limit(n)


def _draw(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df in an order that only the key and the seed decide."""
    return df.orderBy(_draw(F.col(key), seed), key)


def holdout(df: DataFrame, n: int, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(n rows that come first when shuffled, the others)."""
    held = shuffled(df, key, seed).limit(n)
    return held, df.join(held.select(key), key, "left_anti")


def ratio_split(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """df with test, true for about that share of the keys: by a hash, so that rows of one key stay together."""
    u = F.conv(F.substring(_draw(F.col(key), seed), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))
    return df.withColumn("test", u < share)


def contiguous(df: DataFrame, index: str, start: int, size: int) -> DataFrame:
    """Rows of index start to start + size - 1, each of which must be there exactly once."""
    got = df.filter(F.col(index).between(start, start + size - 1))
    r = got.agg(F.count("*").alias("n"), F.count_distinct(index).alias("d")).first()
    if r["n"] != size or r["d"] != size:
        raise ValueError(f"{index} {start} to {start + size - 1} has {r['n']} rows of {r['d']} indices, not {size}")
    return got


def first_state(states: DataFrame, keys: list[str], kind: str, order: str, type_col: str = "checkpoint_type") -> DataFrame:
    """Each sample's state of a type, which may occur once, or else its first state."""
    hit = F.col(type_col) == kind
    n = F.sum(hit.cast("int")).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(hit, 0).otherwise(1), order))
    checked = F.when(F.col("hits") > 1, F.raise_error(F.lit(f"several states of type {kind}")).cast("int")).otherwise(F.col("rank"))
    return states.withColumn("hits", n).withColumn("rank", rank).filter(checked == 1).drop("hits", "rank")


def valid_chains(records: DataFrame, think: str = "think_process", chain: str = "chain") -> DataFrame:
    """Records with a chain and two thoughts a step and one more."""
    return records.filter(F.col(chain).isNotNull() & (F.size(chain) > 0) & (F.size(think) == 2 * F.size(chain) + 1))


def sft_steps(records: DataFrame, keys: list[str], chain: str = "chain") -> DataFrame:
    """keys, step, history, completion: each step of a chain (an array of strings) with the text of all before it."""
    steps = F.transform(chain, lambda x, i: F.struct(i.alias("step"), F.array_join(F.slice(chain, 1, i), "").alias("history"), x.alias("completion")))
    return records.select(*keys, F.inline(steps))


def evidence_paragraphs(records: DataFrame, paragraphs: DataFrame, keys: list[str], titles: str = "titles") -> DataFrame:
    """keys, text: paragraphs of the titles in their order; operation, no_evidence and unknown titles are left out."""
    flat = records.select(*keys, F.posexplode(titles).alias("at", "title")).filter(~F.col("title").isin("operation", "no_evidence"))
    met = flat.join(paragraphs.select("title", "paragraph"), "title")
    return met.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "paragraph"))), lambda p: p["paragraph"]), " ").alias("text"))


def support_paragraphs(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, question, answer, paragraph: each step of a decomposition with the first paragraph of its support index, or null."""
    steps = records.select(*keys, "paragraphs", F.posexplode("question_decomposition").alias("step", "d"))
    first = F.try_element_at(F.filter("paragraphs", lambda p: p["idx"] == F.col("d.paragraph_support_idx")), F.lit(1))
    return steps.select(*keys, "step", "d.question", "d.answer", first["paragraph_text"].alias("paragraph"))


def answered(records: DataFrame, kind: str = "answer.type") -> DataFrame:
    """Records whose answer has a type other than none."""
    return records.filter(F.col(kind) != "none")


def generation_statistics(rows: DataFrame, length: str, terminated: str) -> DataFrame:
    """One row: mean, least and greatest length, the clipped share, and the same of terminated rows alone."""
    on = F.col(terminated)
    value = F.col(length).cast("double")
    three = lambda c, p: [F.avg(c).alias(f"{p}mean"), F.min(c).alias(f"{p}min"), F.max(c).alias(f"{p}max")]
    return rows.agg(*three(value, ""), F.avg((~on).cast("double")).alias("clipped_ratio"), *three(F.when(on, value), "terminated_"))


def percentiles(rows: DataFrame, value: str, threshold: float) -> DataFrame:
    """One row: least, mean, greatest, interpolated 50th to 99th percentiles, and how many are over the threshold."""
    v = F.col(value).cast("double")
    named = [F.percentile(v, p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)]
    return rows.agg(F.min(v).alias("least"), F.avg(v).alias("mean"), *named, F.max(v).alias("most"), F.sum((v > threshold).cast("long")).alias("over"), F.avg((v > threshold).cast("double")).alias("over_ratio"))


# ---- queries and their SQL

def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(":"), x["text"])).alias("chain"))
    thoughts = F.transform(F.sequence(F.lit(1), 2 * F.size("chain") + 1 + (F.col("conv_id") % 3 == 0).cast("int")), lambda i: i.cast("string"))
    return valid_chains(c.withColumn("think_process", thoughts))


def _decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("ls"))
    rows = li.select("l_orderkey", F.transform("ls", lambda x, i: F.struct(x["l_partkey"].alias("question"), x["l_suppkey"].alias("answer"), (x["l_partkey"] % 4).alias("paragraph_support_idx"))).alias("question_decomposition"), F.transform("ls", lambda x, i: F.struct((x["l_suppkey"] % 4).alias("idx"), F.concat_ws("/", x["l_linenumber"], x["l_partkey"], x["l_suppkey"]).alias("paragraph_text"))).alias("paragraphs"))
    return support_paragraphs(rows, ["l_orderkey"])


_SEQ = "WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS step, l_linenumber, l_partkey, l_suppkey FROM lineitem)"
_DRAW = "('0x' || substr(md5('42:' || {k}), 1, 13))::bigint / 4503599627370496::double"

CALLS = [
    ("first_documents", lambda spark, sf_dir: first_rows(_read(spark, sf_dir, "documents"), 50, ["n_chars", "doc_id"]).select("doc_id", "n_chars"), "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 50"),
    ("seeded_holdout", lambda spark, sf_dir: holdout(_read(spark, sf_dir, "orders"), 100, "o_orderkey")[0].select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100"),
    ("seeded_rest", lambda spark, sf_dir: holdout(_read(spark, sf_dir, "orders"), 100, "o_orderkey")[1].select("o_orderkey"), "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k FROM orders) q WHERE k > 100"),
    ("ratio_split", lambda spark, sf_dir: ratio_split(_read(spark, sf_dir, "documents"), 0.02, "doc_id").select("doc_id", "test"), f"SELECT doc_id, {_DRAW.format(k='doc_id')} < 0.02::double AS test FROM documents"),
    ("contiguous_range", lambda spark, sf_dir: contiguous(_read(spark, sf_dir, "orders"), "o_orderkey", 100, 500).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 599"),
    ("sft_steps", lambda spark, sf_dir: sft_steps(_chains(spark, sf_dir), ["conv_id"]),
     "WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS step, concat(role, ':', text) AS completion FROM conversations WHERE conv_id % 3 <> 0) SELECT a.conv_id, a.step::int AS step, a.completion, coalesce((SELECT string_agg(b.completion, '' ORDER BY b.step) FROM c b WHERE b.conv_id = a.conv_id AND b.step < a.step), '') AS history FROM c a"),
    ("support_paragraphs", _decomposed, _SEQ + " SELECT l.l_orderkey, l.step::int AS step, l.l_partkey AS question, l.l_suppkey AS answer, (SELECT arg_min(concat_ws('/', p.l_linenumber, p.l_partkey, p.l_suppkey), p.step) FROM l p WHERE p.l_orderkey = l.l_orderkey AND p.l_suppkey % 4 = l.l_partkey % 4) AS paragraph FROM l"),
    ("evidence_paragraphs", lambda spark, sf_dir: evidence_paragraphs(_read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.when(x["turn"] % 4 == 3, "operation").when(x["turn"] % 5 == 4, "unknown").otherwise(x["role"])).alias("titles")), _read(spark, sf_dir, "conversations").groupBy(F.col("role").alias("title")).agg(F.min("text").alias("paragraph")), ["conv_id"]),
     "WITH p AS (SELECT role AS title, min(text) AS paragraph FROM conversations GROUP BY role), t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS at, CASE WHEN turn % 4 = 3 THEN 'operation' WHEN turn % 5 = 4 THEN 'unknown' ELSE role END AS title FROM conversations) SELECT conv_id, string_agg(paragraph, ' ' ORDER BY t.at) AS text FROM t JOIN p ON p.title = t.title GROUP BY conv_id"),
    ("generation_statistics", lambda spark, sf_dir: (lambda d: d.select(*[F.round(c, 6).alias(c) for c in d.columns]))(generation_statistics(_read(spark, sf_dir, "documents").withColumn("ended", F.col("text").endswith(".")), "n_chars", "ended")),
     "SELECT round(avg(n_chars), 6) AS mean, min(n_chars)::double AS min, max(n_chars)::double AS max, round(avg((NOT ends_with(text, '.'))::int), 6) AS clipped_ratio, round(avg(n_chars) FILTER (ends_with(text, '.')), 6) AS terminated_mean, min(n_chars) FILTER (ends_with(text, '.'))::double AS terminated_min, max(n_chars) FILTER (ends_with(text, '.'))::double AS terminated_max FROM documents"),
    ("length_percentiles", lambda spark, sf_dir: (lambda d: d.select(*[F.round(c, 6).alias(c) for c in d.columns]))(percentiles(_read(spark, sf_dir, "documents"), "n_chars", 1000.0)),
     "SELECT min(n_chars)::double AS least, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars::double, 0.5), 6) AS p50, round(quantile_cont(n_chars::double, 0.9), 6) AS p90, round(quantile_cont(n_chars::double, 0.95), 6) AS p95, round(quantile_cont(n_chars::double, 0.99), 6) AS p99, max(n_chars)::double AS most, count(*) FILTER (n_chars > 1000) AS over, round(avg((n_chars > 1000)::int), 6) AS over_ratio FROM documents"),
]
