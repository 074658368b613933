"""Lexical and dense top-k retrieval, its dispatch, candidates and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T

from ._dialect import pair
from ._shared import materialize, new_path
from .lexical import BROADCAST, bm25, build_index, search, terms
from .vectors import dense

__all__ = ["bm25", "build_index", "dense", "query_candidates", "rerank", "retriever", "search", "terms", "with_metadata"]


def retriever(name: str) -> Callable[..., DataFrame]:
    """The search of that name: bm25 or dense."""
    return {"bm25": bm25, "dense": dense}[name]


def few(hits: DataFrame) -> DataFrame:
    """hits in a table; where they are few they go to all tasks of a join, so that no document's text is shuffled or sorted."""
    hits = materialize(hits, "hits")
    return F.broadcast(hits) if hits.count() <= BROADCAST else hits


def with_metadata(hits: DataFrame, docs: DataFrame, doc_id: str, title: str, text: str) -> DataFrame:
    """hits with the documents' title, text and all other columns as a map of strings."""
    extra = [c for c in docs.columns if c not in (doc_id, title, text)]
    meta = F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]) if extra else F.create_map().cast("map<string,string>")
    return few(hits).join(docs.select(doc_id, F.col(title).alias("title"), F.col(text).alias("text"), meta.alias("raw_metadata")), doc_id)


def rerank(hits: DataFrame, keys: list[str], doc: str, score: str) -> DataFrame:
    """Each document once with its highest score, places from the least score to the best."""
    best = hits.groupBy(*keys, doc).agg(F.max(score).alias(score))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(score, doc)).cast("long"))


def query_candidates(states: DataFrame, sources: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """keys, source, text, normalized_text, candidate_id: candidates in the order of sources (name, column).

    Empty ones go, and of equal normalised texts all but the first.
    """
    every = F.array(*[F.struct(F.lit(n).alias("source"), T.strip(F.coalesce(F.col(c), F.lit(""))).alias("text"), T.normalize_query(F.coalesce(F.col(c), F.lit(""))).alias("normalized_text")) for n, c in sources])
    rows = states.select(*keys, F.filter(every, lambda q: q["normalized_text"] != "").alias("qs"))
    first = F.filter("qs", lambda q, i: F.array_position(F.col("qs.normalized_text"), q["normalized_text"]) == i + 1)
    flat = rows.select(*keys, F.inline(first))
    return flat.withColumn("candidate_id", T.stable_id("qry", {c: F.col(c) for c in (*keys, "source", "normalized_text")}))


# ---- queries and their SQL

BM25_SQL = """
WITH d AS ({docs}), q AS (SELECT item_id, lower(text) AS t FROM benchmark),
     tok AS (SELECT doc_id, field, unnest(regexp_split_to_array(t, '\\s+')) AS term FROM d),
     qt AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_split_to_array(t, '\\s+')) AS term FROM q) a WHERE term <> ''),
     tf AS (SELECT doc_id, field, term, count(*) AS tf FROM tok WHERE term <> '' GROUP BY ALL),
     len AS (SELECT doc_id, field, sum(tf) AS n FROM tf GROUP BY ALL), tot AS (SELECT field, count(*) AS docs, avg(n) AS mean FROM len GROUP BY field),
     df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
     one AS (SELECT qt.item_id, tf.doc_id, tf.field, sum((ln(1 + (tot.docs - df.df + 0.5::double) / (df.df + 0.5::double)) * tf.tf * 2.2::double / (tf.tf + 1.2::double * (0.25::double + 0.75::double * len.n / tot.mean)))::decimal(28,9))::double AS s
             FROM qt JOIN tf ON qt.term = tf.term JOIN df ON tf.term = df.term AND tf.field = df.field JOIN len ON tf.doc_id = len.doc_id AND tf.field = len.field JOIN tot ON tf.field = tot.field GROUP BY ALL),
     hit AS (SELECT item_id, doc_id, round(max(s) + 0.5::double * (sum(s::decimal(28,9))::double - max(s)), 6) AS score FROM one GROUP BY ALL),
     top AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hit)
SELECT {out} FROM top {join} WHERE rank > {skip} AND rank <= {skip} + 3"""
BM25_TEXT = "SELECT doc_id, 'text' AS field, lower(text) AS t FROM documents"
_BOTH = BM25_TEXT + " UNION ALL SELECT doc_id, 'title', lower(split_part(text, chr(10), 1)) FROM documents"
_PLAIN = "item_id, doc_id, round(score, 4) AS score, rank"


def _bm25(spark: SparkSession, sf_dir: str, fields: dict[str, Column], skip: int = 0) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return bm25(read("benchmark"), read("documents"), fields, 3, skip).withColumn("score", F.round("score", 4))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    index = build_index(read("documents"), new_path(spark, "index"), {"text": F.col("text")})
    return search(index, read("benchmark"), 3).withColumn("score", F.round("score", 4))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("head", F.substring_index("text", "\n", 1))
    hits = with_metadata(_bm25(spark, sf_dir, {"text": F.col("text")}, 2), docs, "doc_id", "head", "text")
    return hits.select("item_id", "doc_id", "rank", "title", F.length("text").cast("long").alias("size"), F.col("raw_metadata")["source"].alias("source"), F.size("raw_metadata").alias("fields"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return dense(e.filter("vec_id % 100 = 0"), e, 3)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("trend", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  "), F.lower("text"))).otherwise(F.concat("role", F.lit("  "), "text"))).withColumn("gap", F.when(F.col("turn") % 3 > 0, F.lit(" ")).otherwise(F.lower("role")))
    return query_candidates(c, [("question", "text"), ("trend", "trend"), ("gap", "gap")], ["conv_id", "turn", "role"]).drop("candidate_id")


_TRIM = rf"regexp_replace(t, '\A{T.SPACE}+|{T.SPACE}+\z', '', 'g')"
_NORM = rf"lower(regexp_replace(regexp_replace(t, '{T.SPACE}+', ' ', 'g'), '\A{T.SPACE}+|{T.SPACE}+\z', '', 'g'))"

CALLS = [
    ("bm25_top3", lambda spark, sf_dir: _bm25(spark, sf_dir, {"text": F.col("text")}), BM25_SQL.format(docs=BM25_TEXT, out=_PLAIN, join="", skip=0)),
    ("bm25_index_top3", _indexed, BM25_SQL.format(docs=BM25_TEXT, out=_PLAIN, join="", skip=0)),
    ("bm25_two_fields", lambda spark, sf_dir: _bm25(spark, sf_dir, {"text": F.col("text"), "title": F.substring_index("text", "\n", 1)}), BM25_SQL.format(docs=_BOTH, out=_PLAIN, join="", skip=0)),
    ("bm25_metadata", _metadata, BM25_SQL.format(docs=BM25_TEXT, out="item_id, top.doc_id, rank, split_part(text, chr(10), 1) AS title, length(text) AS size, source, 3 AS fields", join="JOIN documents o ON o.doc_id = top.doc_id", skip=2)),
    ("dense_top3", _dense, """
     WITH q AS (SELECT vec_id AS qid, embedding::double[] AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.qid, d.vec_id, round(list_inner_product(q.e, d.embedding::double[]), 6) AS score FROM q JOIN embeddings d ON q.qid <> d.vec_id),
     r AS (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) SELECT qid, vec_id, score, rank FROM r WHERE rank <= 3"""),
    ("rerank_dedup_max", lambda spark, sf_dir: rerank(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey"], "l_partkey", "l_extendedprice"),
     "WITH b AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey) AS place FROM b"),
    ("query_candidates", _candidates, f"""
     WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN concat('  ', lower(text)) ELSE concat(role, '  ', text) END AS u, CASE WHEN turn % 3 > 0 THEN ' ' ELSE lower(role) END AS g FROM conversations),
     x AS (SELECT conv_id, turn, role, 0 AS k, 'question' AS source, text AS t FROM c UNION ALL SELECT conv_id, turn, role, 1, 'trend', u FROM c UNION ALL SELECT conv_id, turn, role, 2, 'gap', g FROM c),
     y AS (SELECT conv_id, turn, role, k, source, {_TRIM} AS text, {_NORM} AS normalized_text FROM x)
     SELECT conv_id, turn, role, source, text, normalized_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role, normalized_text ORDER BY k) AS r FROM y WHERE normalized_text <> '') z WHERE r = 1"""),
]
QUERIES = [
    ("query_formulation_topk", *pair("""
        SELECT user_id, event_id, cast(pos AS bigint) AS pos FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
          row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS r FROM events WHERE event_type IN ('click', 'view', 'purchase')) q WHERE r <= 35""")),
]
