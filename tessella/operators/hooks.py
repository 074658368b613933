"""Hooks for models outside the engine: generation, search backends, rewards, and loops over hops.

The models themselves are callables of the user. They run in Arrow batches on the
executors; what surrounds them, prompts, retries, salvage of answers, resumption and
the state of a loop, is declared here.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import extract as X
from tessella.functions import text as T
from tessella.operators.retrieval import BM25_SQL, BM25_TEXT, bm25, few


class Search(Protocol):
    """A search backend: hits (the query's id, doc_id, score, rank) for queries; a fake one serves in tests."""

    def __call__(self, queries: DataFrame, k: int) -> DataFrame: ...


def retrieve(rows: DataFrame, backend: Search, docs: DataFrame, k: int, row_id: str = "qid", doc_id: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """rows with passages, an array of struct(rank, title, text), and context, their one text."""
    hits = few(backend(rows, k)).join(docs.select(doc_id, F.col(title).alias("title"), F.col(text).alias("text")), doc_id)
    found = hits.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("rank", "title", "text"))).alias("passages"))  # k at most
    return rows.join(found, row_id, "left").withColumn("context", F.coalesce(T.passages_text(F.col("passages")), F.lit("")))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over Arrow batches of df."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield fn(f)

    return df.mapInPandas(run, schema)


def generate(df: DataFrame, prompt: Callable[[pd.DataFrame], pd.Series], call: Callable[[list[str]], list[str]], out: str = "response", retries: int = 6, wait: float = 1.0) -> DataFrame:
    """df with the model's response to each row's prompt.

    A batch that raises is tried again after wait, 2 wait, 4 wait, ...; after the last
    try its rows have a null response and the error's text in <out>_error.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts, error = prompt(frame).tolist(), None
        for n in range(retries + 1):
            try:
                return frame.assign(**{out: call(texts), f"{out}_error": None})
            except Exception as e:  # noqa: BLE001
                error = str(e)
                if n < retries:
                    time.sleep(wait * 2**n)
        return frame.assign(**{out: None, f"{out}_error": error})

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_batches(df, run, f"{ddl}, {out} string, {out}_error string")


def parsed(df: DataFrame, schema: str, response: str = "response", out: str = "result") -> DataFrame:
    """df with the JSON object that stands in the response, or null where there is none."""
    return df.withColumn(out, F.from_json(F.to_json(T.salvage_json(F.col(response))), schema))


def rewards(df: DataFrame, functions: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """df with a column for each reward and their sum, reward."""
    out = df.withColumns({name: fn(df) for name, fn in functions.items()})
    return out.withColumn("reward", sum((F.col(n) for n in functions), F.lit(0.0)))


def run_hops(rows: DataFrame, hop: Callable[[DataFrame], DataFrame], most: int, save: Callable[[DataFrame, int], DataFrame], done: str = "done") -> DataFrame:
    """rows after at most `most` hops: each takes those that aren't done; a row is done when hop says so.

    save writes a hop's rows to the shared folder and reads them back, so that a hop
    runs once and an executor lost later costs no call again.
    """
    finished, active = [], rows
    for n in range(most):
        active = save(hop(active), n)
        finished.append(active.filter(F.col(done)))
        active = active.filter(~F.col(done))
        if active.isEmpty():
            break
    out = active
    for f in finished:
        out = out.unionByName(f)
    return out


def keep_exact(rows: DataFrame, prediction: str, gold: str) -> DataFrame:
    """Trajectories whose tagged answer equals the gold in lower case."""
    return rows.filter(F.lower(T.strip(X.tagged(F.col(prediction), "answer"))) == F.lower(T.strip(F.col(gold))))


def keep_scored(rows: DataFrame, score: str, least: float = 0.0) -> DataFrame:
    return rows.filter(F.col(score) >= least)


def action_counts(rows: DataFrame, text: str) -> DataFrame:
    """(action, n): how often each class of action occurs."""
    return rows.groupBy(X.action_class(F.col(text)).alias("action")).agg(F.count("*").alias("n"))


def audit(actions: DataFrame, expected: DataFrame, keys: list[str], queries: str = "query_ids") -> DataFrame:
    """keys, missing, extra, repeated, incomplete, complete: what a state's retrieve actions lack against its expected queries.

    actions: keys, query_id, status, one row an action; expected: keys and an array of
    query ids. States that only one side has are listed with all their queries.
    """
    got = actions.groupBy(*keys).agg(F.collect_list("query_id").alias("got"), F.sum((F.col("status") != "complete").cast("long")).alias("bad"))
    both = expected.join(got, keys, "full_outer")
    none = F.array().cast("array<string>")
    want, have = F.coalesce(queries, none), F.coalesce("got", none)
    both = both.select(*keys, F.array_sort(F.array_except(want, have)).alias("missing"), F.array_sort(F.array_except(have, want)).alias("extra"), (F.size(have) - F.size(F.array_distinct(have))).cast("long").alias("repeated"), F.coalesce("bad", F.lit(0)).alias("incomplete"))
    return both.withColumn("complete", (F.size("missing") == 0) & (F.size("extra") == 0) & (F.col("repeated") == 0) & (F.col("incomplete") == 0))


def _bm25_context(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("title", F.col("source"))
    found = retrieve(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), lambda q, k: bm25(q, docs, {"text": F.col("text")}, k), docs, 1, "item_id")
    return found.select("item_id", F.md5(F.col("context").cast("binary")).alias("context"))


def _conv(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("x", F.concat("text", F.when(F.col("turn") % 4 == 0, "<query>q</query>").when(F.col("turn") % 4 == 1, F.concat(F.lit("<answer> "), F.upper("role"), F.lit("</answer>"))).otherwise("")))


def _audit(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    want = li.filter("l_linenumber < 5").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("query_ids"))
    have = li.filter("l_linenumber % 3 <> 0").select("l_orderkey", F.col("l_linenumber").cast("string").alias("query_id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("complete").alias("status"))
    a = audit(have, want, ["l_orderkey"])
    return a.select("l_orderkey", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "repeated", "incomplete", "complete")


CALLS = [
    ("retrieved_context", _bm25_context, BM25_SQL.format(docs=BM25_TEXT, out="item_id, md5(concat('Doc 1(Title: ', source, ') ', text, chr(10))) AS context", join="JOIN documents o ON o.doc_id = top.doc_id", skip=0).replace("rank <= 0 + 3", "rank <= 1")),
    ("action_counts", lambda spark, sf_dir: action_counts(_conv(spark, sf_dir), "x"), "SELECT CASE turn % 4 WHEN 0 THEN 'Query' WHEN 1 THEN 'Answer' ELSE 'Other' END AS action, count(*) AS n FROM conversations GROUP BY 1"),
    ("exact_trajectories", lambda spark, sf_dir: keep_exact(_conv(spark, sf_dir), "x", "role").select("conv_id", "turn", "role"), "SELECT conv_id, turn, role FROM conversations WHERE turn % 4 = 1"),
    ("rollout_query_audit", _audit, """
     WITH w AS (SELECT l_orderkey, l_linenumber::varchar AS q FROM lineitem WHERE l_linenumber < 5 GROUP BY ALL), h AS (SELECT l_orderkey, l_linenumber::varchar AS q, l_returnflag = 'R' AS bad FROM lineitem WHERE l_linenumber % 3 <> 0),
     d AS (SELECT l_orderkey, q, count(*) AS n, sum(bad::int) AS bad FROM h GROUP BY ALL), k AS (SELECT coalesce(w.l_orderkey, d.l_orderkey) AS l_orderkey, w.q AS wq, d.q AS dq, d.n, d.bad FROM w FULL JOIN d ON w.l_orderkey = d.l_orderkey AND w.q = d.q),
     g AS (SELECT l_orderkey, coalesce(string_agg(wq, ',' ORDER BY wq) FILTER (dq IS NULL), '') AS missing, coalesce(string_agg(dq, ',' ORDER BY dq) FILTER (wq IS NULL), '') AS extra, coalesce(sum(n - 1), 0)::bigint AS repeated, coalesce(sum(bad), 0)::bigint AS incomplete FROM k GROUP BY l_orderkey)
     SELECT *, missing = '' AND extra = '' AND repeated = 0 AND incomplete = 0 AS complete FROM g"""),
]
