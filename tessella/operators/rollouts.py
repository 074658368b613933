"""Nested rollout bundles: layers, benefits, evidence attribution, matched interventions, bootstrap.

A bundle is a row: sample_index, qid, question, states array<struct<state_id, checkpoint_type>>,
queries array<struct<candidate_id, source, text>>, actions array<struct<action_id,
state_id, action_type, query_candidate_id, scores map<string, double>, metadata
map<string, string>, retrieved_documents array<struct<title, text, rank>>>>. What
belongs to one sample is joined inside its row, without a shuffle; a guard that fails
raises when the row is read.

The queries build bundles from customers (samples), orders (states) and lines (actions).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.ranks import global_rank

from ._shared import materialize

SAMPLE = ["sample_index", "qid"]
BUCKETS = ("positive", "zero", "negative")


def _guard(ok: Column, message: str, value: Column) -> Column:
    """value where ok holds; reading any other row raises."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def _sound(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df in which a row without ok raises, whatever columns are read of it."""
    return df.filter(_guard(ok, message, F.lit(True)))


def _by(entries: Column, key: str) -> Column:
    """Map of an array of structs by one field; a repeated key raises."""
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e[key], e)))


def unique_samples(bundles: DataFrame) -> DataFrame:
    """bundles, read with a guard against a sample that occurs twice."""
    n = bundles.groupBy(*SAMPLE).agg(F.count("*").alias("n"))
    return _sound(bundles.join(n, SAMPLE), F.col("n") == 1, "a sample occurs in two bundles").drop("n")


def layers(bundles: DataFrame) -> dict[str, DataFrame]:
    """states, queries, actions and retrievals as flat tables with the sample's keys."""
    flat = {k: bundles.select(*SAMPLE, F.inline(k)) for k in ("states", "queries", "actions")}
    docs = flat["actions"].select(*SAMPLE, "state_id", "action_id", F.posexplode("retrieved_documents").alias("position", "d")).select(*SAMPLE, "state_id", "action_id", "position", "d.*")
    ident = T.stable_id("ret", {k: F.col(k) for k in ("action_id", "position", "title")})
    return flat | {"retrievals": docs.withColumn("retrieval_id", ident)}


def benefits(bundles: DataFrame, metric: str = "f1", accuracy: str = "accuracy") -> DataFrame:
    """One row per retrieve action with its state's only skip: scores, benefit, buckets, flip, source, checkpoint."""
    of_kind = lambda kind: F.filter("actions", lambda a: a["action_type"] == kind)
    inner = bundles.select("*", _by(of_kind("skip"), "state_id").alias("skips"), _by(F.col("states"), "state_id").alias("at"), _by(F.col("queries"), "candidate_id").alias("asked"))
    rows = inner.select(*SAMPLE, "question", "skips", "at", "asked", F.explode(of_kind("retrieve")).alias("a"))
    skip, state, query = (F.try_element_at(F.col(m), F.col(k)) for m, k in (("skips", "a.state_id"), ("at", "a.state_id"), ("asked", "a.query_candidate_id")))
    rows = _sound(rows, skip.isNotNull() & state.isNotNull() & query.isNotNull(), "an action lacks its skip, state or query")
    rows = rows.select(*SAMPLE, "question", "a", skip.alias("s"), state["checkpoint_type"].alias("checkpoint"), query["source"].alias("source"))
    score = lambda c, m: F.col(f"{c}.scores")[m]
    gain = score("a", metric) - score("s", metric)
    return rows.select(
        *SAMPLE, "question", "a.action_id", "a.state_id", "source", "checkpoint", score("a", metric).alias("score"), score("s", metric).alias("skip_score"), gain.alias("benefit"),
        T.benefit_bucket(gain).alias("bucket"), T.score_bucket(score("s", metric)).alias("skip_bucket"), T.accuracy_flip(score("s", accuracy), score("a", accuracy)).alias("flip"), F.col("a.retrieved_documents").alias("documents"),
    )


def benefit_summary(rows: DataFrame) -> DataFrame:
    """Counts, mean benefit and rates over all, by source and by checkpoint, in one pass."""
    rate = lambda b: F.avg((F.col("bucket") == b).cast("double"))
    flips = [F.sum((F.col("flip") == k).cast("long")).alias(k) for k in ("wrong_to_correct", "correct_to_wrong")]
    return rows.groupingSets([[], ["source"], ["checkpoint"]], "source", "checkpoint").agg(F.count("*").alias("n"), F.avg("benefit").alias("mean_benefit"), rate("positive").alias("positive_rate"), rate("negative").alias("negative_rate"), *flips)


def oracle_gains(rows: DataFrame, baseline: str = "skip_score") -> DataFrame:
    """Per sample: the mean gain of the best action of each state over its skip, and how many states gain."""
    state = rows.groupBy(*SAMPLE, "state_id").agg((F.greatest(F.max("score"), F.max(baseline)) - F.max(baseline)).alias("gain"))
    return state.groupBy(*SAMPLE).agg(F.avg("gain").alias("state_gain"), F.max("gain").alias("sample_gain"), F.sum((F.col("gain") > 1e-12).cast("long")).alias("positive_states"))


def gold_index(gold: DataFrame) -> DataFrame:
    """Per normalised question: answer, distinct titles and support sentences, and the documents with rank, in first-seen order.

    gold: question, answer, supporting_facts array<struct<title, sent_id>>, context
    array<struct<title, sentences>>. Repeated titles of a context, unknown titles and
    sentences out of range raise.
    """
    g = gold.select("question", "answer", "supporting_facts", T.normalize_titles(F.col("context.title")).alias("ct"), F.col("context.sentences").alias("cs"), T.normalize_titles(F.col("supporting_facts.title")).alias("st"))
    g = g.withColumn("sentences_of", F.map_from_arrays("ct", "cs"))
    fact = F.transform("supporting_facts", lambda f, i: F.struct(F.get("st", i).alias("key"), f["title"].alias("title"), f["sent_id"].alias("sent_id"), F.element_at(F.col("sentences_of"), F.get("st", i)).alias("group")))
    sound = lambda f: f["group"].isNotNull() & (f["sent_id"] >= 0) & (f["sent_id"] < F.size(f["group"]))
    g = g.withColumn("facts", fact)
    g = g.withColumn("facts", _guard(F.forall("facts", sound), "a supporting fact isn't in its context", F.transform("facts", lambda f: F.struct(f["key"].alias("key"), f["title"].alias("title"), f["sent_id"].alias("sent_id"), F.get(f["group"], f["sent_id"]).alias("sentence")))))
    g = g.withColumn("titles", F.array_distinct("facts.key"))
    own = lambda k: F.filter("facts", lambda f: f["key"] == k)
    documents = F.transform("titles", lambda k, i: F.struct(own(k)["title"][0].alias("title"), F.array_join(own(k)["sentence"], " ").alias("text"), own(k)["sent_id"].alias("sentence_ids"), (i + 1).alias("rank")))
    return g.select(T.normalize_query(F.col("question")).alias("question_key"), T.normalize_text("answer").alias("answer_key"), "titles", F.array_remove(F.array_distinct(T.normalize_texts(F.col("facts.sentence"))), "").alias("support"), documents.alias("documents"))


def attribute(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """rows of benefits() with title hits, recall, first rank, support and answer hits, and the label retrieval__outcome."""
    index = gold_index(gold).groupBy("question_key").agg(F.count("*").alias("n"), F.any_value(F.struct("answer_key", "titles", "support")).alias("g")).select("question_key", "n", "g.*")
    # a row a question: the actions, many more, aren't sorted for it
    r = rows.withColumn("question_key", T.normalize_query(F.col("question"))).join(index.hint("shuffle_hash"), "question_key", "left")
    r = _sound(r, F.col("n") == 1, "a question has no gold or several")
    r = r.withColumn("seen", T.normalize_titles(F.col("documents.title"))).withColumn("texts", T.normalize_texts(F.col("documents.text")))
    found, wanted = F.size(F.array_intersect("seen", "titles")), F.size("titles")
    ranks = F.filter(F.transform("documents", lambda d, i: F.when(F.array_contains("titles", F.get("seen", i)), F.coalesce(d["rank"], i + 1))), lambda x: x.isNotNull())
    holds = lambda needles: F.exists("texts", lambda t: F.exists(needles, lambda s: (s != "") & F.contains(t, s)))
    r = r.select(*rows.columns, (found > 0).alias("any_hit"), ((found == wanted) & (wanted > 0)).alias("full_hit"), F.when(wanted > 0, found / wanted).otherwise(0.0).alias("recall"), F.array_min(ranks).alias("first_rank"), holds(F.col("support")).alias("support_hit"), holds(F.array("answer_key")).alias("answer_hit"))
    stage = F.when(~F.col("any_hit"), "gold_title_miss").when(~F.col("support_hit"), "gold_title_hit_but_support_sentence_miss").otherwise("support_sentence_retrieved")
    outcome = F.when(F.col("bucket") == "positive", "gain").when(F.col("bucket") == "negative", "harm").when(F.col("skip_bucket") == "correct", "metric_ceiling_no_change").when(F.col("answer_hit"), "answer_present_but_no_gain").otherwise("answer_absent_and_no_gain")
    return r.withColumn("label", F.concat(stage, F.lit("__"), outcome))


def evidence_summary(rows: DataFrame) -> DataFrame:
    """Per benefit bucket, empty ones with zeros: actions, samples and the means of the indicators."""
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    got = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct(*SAMPLE).alias("samples"), *[mean(c) for c in ("benefit", "any_hit", "full_hit", "support_hit", "answer_hit", "recall")])
    every = rows.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return every.join(got, "bucket", "left").fillna(0)


def compare_interventions(source: DataFrame, restart: DataFrame, revision: DataFrame | None = None, metric: str = "f1", accuracy: str = "accuracy") -> DataFrame:
    """One row per matched action: sample, action_id, and the scores keep, append, restart (and revision).

    Then each one's accuracy flip against keep, and with a revision whether it fell back
    to a full restart (its metadata["fallback_to_full_restart"]).

    The runs must hold the same samples; restart and revision actions name their
    source action in metadata["original_action_id"] and must have its state and
    documents. Anything else raises.
    """
    # of an action what is compared, its documents as a digest: so much is joined and sorted, and no text
    same_documents = lambda d: F.unhex(F.sha2(F.to_json(F.struct(d.alias("d")), {"ignoreNullFields": "false"}).cast("binary"), 256))
    said = lambda a, name, kind: F.when(a["action_type"] == "retrieve", a["metadata"][name].cast(kind)).alias(name)

    def lean(a: Column, name: str) -> Column:
        more = [said(a, "original_action_id", "long")] if name != "append" else []
        more += [said(a, "fallback_to_full_restart", "boolean")] if name == "revision" else []
        documents = F.when(a["retrieved_documents"].isNotNull(), same_documents(a["retrieved_documents"]))
        return F.struct(a["action_id"].alias("action_id"), a["state_id"].alias("state_id"), a["action_type"].alias("action_type"), a["scores"][metric].alias("score"), a["scores"][accuracy].alias("accuracy"), documents.alias("documents"), *more)

    pick = lambda df, name: df.select(*SAMPLE, F.transform("actions", lambda a: lean(a, name)).alias(name))
    runs = {"append": source, "restart": restart} | ({"revision": revision} if revision is not None else {})
    both = None
    for name, df in runs.items():
        both = pick(df, name) if both is None else both.join(pick(df, name), SAMPLE, "full_outer")
    whole = F.lit(True)
    for name in runs:
        whole = whole & F.col(name).isNotNull()
    both = _sound(both, whole, "the runs hold different samples").withColumn("append", _by(F.col("append"), "action_id"))
    kind = lambda c, k: F.filter(c, lambda a: a["action_type"] == k)
    keeps = kind("restart", "skip")
    both = _sound(both, F.size(keeps) == 1, "a restart sample has no single KEEP").withColumn("keep", keeps[0]["score"])
    both = both.withColumn("keep_accuracy", keeps[0]["accuracy"])
    original = lambda a: a["original_action_id"]
    if revision is not None:
        both = both.withColumn("revised", F.map_from_entries(F.transform(kind("revision", "retrieve"), lambda a: F.struct(original(a), a))))
    rows = both.select("*", F.explode(kind("restart", "retrieve")).alias("r"))
    rows = rows.withColumn("a", F.try_element_at("append", original(F.col("r"))))

    if revision is not None:
        rows = rows.withColumn("v", F.try_element_at("revised", F.col("a.action_id")))
    others = {"restart": "r"} | ({"revision": "v"} if revision is not None else {})
    for name, c in others.items():
        same = (F.col(f"{c}.state_id") == F.col("a.state_id")) & (F.col(f"{c}.documents") == F.col("a.documents"))
        rows = _sound(rows, same, f"{name} doesn't match its source action in state and documents")
    every = {"append": "a"} | others
    scores = [F.col(f"{c}.score").alias(name) for name, c in every.items()]
    flips = [T.accuracy_flip(F.col("keep_accuracy"), F.col(f"{c}.accuracy")).alias(f"{name}_flip") for name, c in every.items()]
    fell = [F.coalesce(F.col("v.fallback_to_full_restart"), F.lit(False)).alias("fallback")] if revision is not None else []
    return rows.select(*SAMPLE, F.col("a.action_id"), F.col("keep"), *scores, *flips, *fell)


def intervention_counts(matched: DataFrame) -> DataFrame:
    """kind, name, actions, samples of compare_interventions(): preference of restart over append, accuracy flips, and strata of the revision."""
    gain = F.col("restart") - F.col("append")
    kinds = [F.struct(F.lit("preference").alias("kind"), F.when(gain > 0, "restart_better").when(gain < 0, "append_better").otherwise("tie").alias("name"))]
    kinds += [F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in ("append_flip", "restart_flip", "revision_flip") if c in matched.columns]
    if "fallback" in matched.columns:
        kinds.append(F.struct(F.lit("revision_stratum").alias("kind"), F.when(F.col("fallback"), "fallback_to_full_restart").otherwise("true_local_revision").alias("name")))
    rows = matched.select("sample_index", F.inline(F.array(*kinds)))
    # a sample's actions combine first, so a distinct count moves one row a sample and name
    return rows.groupBy("kind", "name", "sample_index").agg(F.count("*").alias("n")).groupBy("kind", "name").agg(F.sum("n").alias("actions"), F.count("*").alias("samples"))


def paired_gains(matched: DataFrame) -> DataFrame:
    """matched with each later intervention's gain over each earlier one, as restart_over_keep; a bootstrap of such a column by sample gives its interval."""
    names = [n for n in ("keep", "append", "restart", "revision") if n in matched.columns]
    return matched.withColumns({f"{b}_over_{a}": F.col(b) - F.col(a) for i, b in enumerate(names) for a in names[:i]})


def best_operators(matched: DataFrame) -> DataFrame:
    """(operator, mean, best, alone): mean score, how often it is best, ties included, and how often it alone is."""
    names = [c for c in matched.columns if c in ("keep", "append", "restart", "revision")]
    top = F.greatest(*names)
    ties = sum(((F.col(n) == top).cast("int") for n in names), F.lit(0))
    long = matched.select(top.alias("top"), ties.alias("ties"), *names).unpivot(["top", "ties"], names, "operator", "score")
    hit = F.col("score") == F.col("top")
    return long.groupBy("operator").agg(F.avg("score").alias("mean"), F.sum(hit.cast("long")).alias("best"), F.sum((hit & (F.col("ties") == 1)).cast("long")).alias("alone"))


def cluster_bootstrap(rows: DataFrame, cluster: list[str], value: str, samples: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: mean, low, high, clusters. Means of clusters are drawn with replacement by MD5 hashes, so that runs agree.

    Draw i of a replicate takes the cluster of rank hash mod clusters, in the order of
    the cluster's keys; percentiles are elements int(p * samples) of the sorted estimates.
    """
    spark = rows.sparkSession
    means = materialize(rows.groupBy(*cluster).agg(F.avg(value).alias("m")), "bootstrap-means")  # rows are worked out once
    means = materialize(global_rank(means, cluster, "i").select("i", "m"), "bootstrap-ranks")
    n = means.count()
    if not n:
        return spark.createDataFrame([(0.0, 0.0, 0.0, 0)], "mean double, low double, high double, clusters long")
    draws = spark.range(n * samples).select((F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("k"))
    digits = F.substring(F.md5(F.concat_ws(":", "b", "k").cast("binary")), 1, 8)
    drawn = draws.select("b", (F.conv(digits, 16, 10).cast("long") % n).alias("i"))
    # nearly every draw of a replicate is another cluster: counting them first would combine nothing, sorting them for the join neither
    estimates = drawn.join(means.hint("shuffle_hash"), "i").groupBy("b").agg((F.sum("m") / n).alias("e"))
    at = lambda p: F.element_at(F.array_sort(F.collect_list("e")), min(samples - 1, max(0, int(p * samples))) + 1)
    return estimates.agg(at(low).alias("low"), at(high).alias("high")).crossJoin(means.agg(F.avg("m").alias("mean"), F.count("*").alias("clusters"))).select("mean", "low", "high", "clusters")


def _fmix(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser in 64-bit words: the SQL form is in poisson_sql()."""
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        x ^= x >> np.uint64(shift)
        x = (x * np.uint64(times)) & np.uint64(0xFFFFFFFF)
    return x


POISSON = np.floor(np.cumsum([np.exp(-1) / math.factorial(i) for i in range(13)]) * 2**32).astype(np.uint64)  # cut so late that 2^32 draws miss less than one
PARTS = 10**6  # cluster means are summed as whole numbers of its parts


def poisson_bootstrap(rows: DataFrame, cluster: list[str], value: str, samples: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: mean, low, high, clusters, by replicates that merge.

    A cluster stands in a replicate as often as a Poisson variable of mean 1 says, drawn
    from a hash of the cluster's key and the replicate; an estimate is the weighted mean.
    A task makes one row of `samples` weights and sums, whatever it reads, and these are
    added up: no row per cluster and replicate exists. For n clusters the estimates'
    variance is that of cluster_bootstrap(), the exact grid, but for a share of about
    1 / n. Means count to six decimals; their sum may reach 9 * 10^12.
    """
    digits = F.md5(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cluster)).cast("binary"))
    word = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    means = rows.groupBy(*cluster).agg(F.avg(value).alias("m")).select(word(1).alias("a"), word(9).alias("b"), F.round(F.col("m") * PARTS).cast("long").alias("m"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, mean = np.zeros((2, samples), np.int64), 0, 0
        steps = np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B9)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                a, b, m = (batch.slice(at, 1000)[c].to_numpy() for c in ("a", "b", "m"))
                x = _fmix((a.astype(np.uint64)[:, None] + steps) & np.uint64(0xFFFFFFFF))
                times = np.searchsorted(POISSON, _fmix(x ^ b.astype(np.uint64)[:, None]), "right")
                total += np.stack([times.sum(0), (times * m[:, None]).sum(0)])
                count, mean = count + len(m), mean + int(m.sum())
        lists = [pa.array([t.tolist()], pa.list_(pa.int64())) for t in total]
        yield pa.RecordBatch.from_arrays([*lists, pa.array([count]), pa.array([mean])], names=["weights", "sums", "n", "m"])

    parts = materialize(means.filter("m IS NOT NULL").mapInArrow(weigh, "weights array<long>, sums array<long>, n long, m long"), "bootstrap")
    each = parts.filter("n > 0").select(F.posexplode(F.arrays_zip("weights", "sums")).alias("i", "x")).groupBy("i").agg((F.sum("x.sums") / F.greatest(F.sum("x.weights"), F.lit(1)) / PARTS).alias("e"))
    at = lambda p: F.coalesce(F.try_element_at(F.array_sort(F.collect_list("e")), F.lit(min(samples - 1, max(0, int(p * samples))) + 1)), F.lit(0.0))
    whole = parts.agg(F.sum("n").alias("clusters"), F.sum("m").alias("m"))
    mean = F.coalesce(F.try_divide("m", F.col("clusters") * PARTS), F.lit(0.0))
    return each.agg(at(low).alias("low"), at(high).alias("high")).crossJoin(whole).select(mean.alias("mean"), "low", "high", F.coalesce("clusters", F.lit(0)).alias("clusters"))


# ---- queries and their SQL

_BASE = """
WITH s AS (SELECT o_custkey AS sample_index, o_orderkey AS state_id, o_orderstatus AS checkpoint, (o_orderkey % 5) / cast(4 AS double) AS skip FROM orders),
     l AS (SELECT l_orderkey AS state_id, l_linenumber AS line, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber),
     a AS (SELECT s.sample_index, s.state_id, s.checkpoint, s.skip, l.line, l.part, s.state_id * 10 + l.line AS action_id, CASE l.line % 3 WHEN 0 THEN 'question' WHEN 1 THEN 'trend' ELSE 'gap' END AS source, ((s.state_id * 7 + l.line * 3) % 5) / cast(4 AS double) AS score FROM s JOIN l ON s.state_id = l.state_id)"""


def _bundles(spark: SparkSession, sf_dir: str, kind: str = "source") -> DataFrame:
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    shift = {"source": 0, "restart": 1, "revision": 2}[kind]
    key = F.col("o_orderkey")
    scores = lambda x: F.create_map(F.lit("f1"), x, F.lit("accuracy"), F.floor(x).cast("double"))
    doc = lambda p, rank: F.struct(F.concat(F.lit("Part_"), p.cast("string")).alias("title"), F.concat(F.lit("The part "), p.cast("string"), F.lit(" text!")).alias("text"), F.lit(rank).alias("rank"))
    action = lambda i, k, t, q, s, d, m: F.struct(i.alias("action_id"), k.alias("state_id"), F.lit(t).alias("action_type"), q.alias("query_candidate_id"), scores(s).alias("scores"), d.alias("retrieved_documents"), m.alias("metadata"))
    none = F.lit(None).cast("string")
    per = lines.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("part"))
    per = per.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("line", "part"))).alias("ls")).join(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    # only keys and numbers are shuffled, the same for every kind of run, and by both keys of a sample, as whoever joins samples needs them
    per = per.select(F.col("o_custkey").alias("sample_index"), F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("qid"), F.struct(key.alias("key"), F.col("o_orderstatus").alias("status"), "ls").alias("o"))
    got = per.groupBy(*SAMPLE).agg(F.collect_list("o").alias("os"))
    flat = F.flatten(F.transform("os", lambda o: F.transform(o["ls"], lambda x: F.struct(o["key"].alias("key"), x["line"].alias("line"), x["part"].alias("part")))))
    got = got.withColumn("xs", flat)

    def retrieve(x: Column) -> Column:
        key, line, part = x["key"], x["line"], x["part"]
        ident = key * 10 + line
        return action(ident + 1000000000 * shift, key, "retrieve", F.concat_ws("-", key, line), ((key * 7 + line * 3 + shift) % 5) / F.lit(4.0), F.array(doc(part, 1), doc(part + 1, 2)), F.create_map(F.lit("original_action_id"), ident.cast("string"), F.lit("fallback_to_full_restart"), (ident % 3 == 0).cast("string")))

    def query(x: Column) -> Column:
        line = x["line"]
        return F.struct(F.concat_ws("-", x["key"], line).alias("candidate_id"), F.when(line % 3 == 0, "question").when(line % 3 == 1, "trend").otherwise("gap").alias("source"), F.lit("text").alias("text"))

    def skip(k: Column) -> Column:
        return action(k * 10, k, "skip", none, (k % 5) / F.lit(4.0), F.array().cast("array<struct<title:string,text:string,rank:int>>"), F.create_map(F.lit("original_action_id"), none))

    keys = F.array_sort(F.array_distinct(F.transform("os", lambda o: o["key"])))
    states = F.array_distinct(F.transform("os", lambda o: F.struct(o["key"].alias("state_id"), o["status"].alias("checkpoint_type"))))
    keeps = F.transform(F.slice(keys, 1, 1) if kind != "source" else keys, skip)
    return got.select(*SAMPLE, F.concat(F.lit("Which  part of "), F.col("sample_index").cast("string")).alias("question"), states.alias("states"), F.transform("xs", query).alias("queries"), F.concat(F.transform("xs", retrieve), keeps).alias("actions"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and the greatest part of a customer's actions are its gold titles."""
    rows = layers(_bundles(spark, sf_dir))["actions"].filter("action_type = 'retrieve'")
    part = F.substring(F.col("retrieved_documents")[0]["title"], 6, 20).cast("long")
    ends = rows.groupBy("sample_index").agg(F.min(part).alias("lo"), F.max(part).alias("hi"))
    name = lambda c: F.concat(F.lit("part  "), F.col(c).cast("string"))
    said = lambda c: F.array(F.concat(F.lit("the part "), F.col(c).cast("string"), F.lit(" text")), F.lit("other"))
    fact = lambda c, k: F.struct(name(c).alias("title"), F.lit(k).alias("sent_id"))
    page = lambda c: F.struct(name(c).alias("title"), said(c).alias("sentences"))
    two = F.col("lo") < F.col("hi")
    return ends.select(F.concat(F.lit("which part OF "), F.col("sample_index").cast("string")).alias("question"), F.concat(F.lit("Part "), F.col("hi").cast("string"), F.lit(" Text")).alias("answer"), F.when(two, F.array(fact("lo", 1), fact("hi", 0), fact("lo", 0))).otherwise(F.array(fact("lo", 1))).alias("supporting_facts"), F.when(two, F.array(page("lo"), page("hi"))).otherwise(F.array(page("lo"))).alias("context"))


_B = _BASE + ", b AS (SELECT *, score - skip AS benefit, CASE WHEN score - skip > 1e-12 THEN 'positive' WHEN score - skip < -1e-12 THEN 'negative' ELSE 'zero' END AS bucket FROM a)"
# a document's parts are the action's and the next one; of the gold's sentences the least part's come only if it isn't the greatest
_HITS = _B + """,
     g AS (SELECT sample_index, min(part) AS lo, max(part) AS hi FROM a GROUP BY sample_index),
     d AS (SELECT b.*, lo, hi, CASE WHEN lo < hi THEN 2 ELSE 1 END AS wanted, (lo IN (part, part + 1))::int + (lo < hi AND hi IN (part, part + 1))::int AS found, CASE WHEN part IN (lo, hi) THEN 1 WHEN part + 1 IN (lo, hi) THEN 2 END AS first_rank,
       (lo < hi AND (contains(concat('the part ', part, ' text'), concat('the part ', lo, ' text')) OR contains(concat('the part ', part + 1, ' text'), concat('the part ', lo, ' text')) OR hi IN (part, part + 1))) AS support_hit,
       (contains(concat('the part ', part, ' text'), concat('part ', hi, ' text')) OR contains(concat('the part ', part + 1, ' text'), concat('part ', hi, ' text'))) AS answer_hit FROM b JOIN g ON b.sample_index = g.sample_index),
     e AS (SELECT *, found > 0 AS any_hit, found = wanted AS full_hit, found / wanted::double AS recall FROM d)"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(benefits(_bundles(spark, sf_dir)), _gold(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_interventions(*(_bundles(spark, sf_dir, k) for k in ("source", "restart", "revision")))


_M = _BASE + ", k AS (SELECT sample_index, min(state_id) AS first FROM a GROUP BY sample_index), m AS (SELECT a.sample_index, a.action_id, (k.first % 5) / 4.0::double AS keep, score AS append, ((state_id * 7 + line * 3 + 1) % 5) / 4.0::double AS restart, ((state_id * 7 + line * 3 + 2) % 5) / 4.0::double AS revision FROM a JOIN k ON a.sample_index = k.sample_index)"
_SAMPLES = 200
_GAINS = ("append_over_keep", "restart_over_keep", "restart_over_append", "revision_over_keep", "revision_over_append", "revision_over_restart")


def _flip_sql(c: str) -> str:
    return f"CASE WHEN floor(keep) < 1 AND floor({c}) >= 1 THEN 'wrong_to_correct' WHEN floor(keep) >= 1 AND floor({c}) < 1 THEN 'correct_to_wrong' ELSE 'same' END"


_COUNTS = ", n AS (SELECT sample_index, 'preference' AS kind, CASE WHEN restart > append THEN 'restart_better' WHEN restart < append THEN 'append_better' ELSE 'tie' END AS name FROM m" + "".join(f" UNION ALL SELECT sample_index, '{c}_flip', {_flip_sql(c)} FROM m" for c in ("append", "restart", "revision")) + " UNION ALL SELECT sample_index, 'revision_stratum', CASE WHEN action_id % 3 = 0 THEN 'fallback_to_full_restart' ELSE 'true_local_revision' END FROM m) SELECT kind, name, count(*) AS actions, count(DISTINCT sample_index) AS samples FROM n GROUP BY kind, name"

def poisson_sql(base: str, cluster: str, value: str) -> str:
    word = lambda at: f"('0x' || substr(md5({cluster}::varchar), {at}, 8))::ubigint"
    steps, last = "", "p0"
    for i, (shift, times) in enumerate(((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)) * 2):
        x = f"xor(x, x >> {shift}) * {times}::ubigint & 4294967295::ubigint"
        steps += f", p{i + 1} AS (SELECT r, m, b, {'xor(' + x + ', b)' if i == 2 else x} AS x FROM p{i})"
        last = f"p{i + 1}"
    times = " + ".join(f"(x >= {v}::ubigint)::int" for v in POISSON.tolist())
    return base + f""", c AS (SELECT {word(1)} AS a, {word(9)} AS b, round(avg({value}) * {PARTS})::bigint AS m FROM b GROUP BY {cluster}),
     p0 AS (SELECT r.range AS r, m, b, (a + r.range::ubigint * 2654435769::ubigint) & 4294967295::ubigint AS x FROM c, range({_SAMPLES}) r){steps},
     e AS (SELECT r, sum(({times}) * m) / greatest(sum({times}), 1) / {PARTS}::double AS e FROM {last} GROUP BY r), o AS (SELECT list(e ORDER BY e) AS es FROM e)
     SELECT round((SELECT sum(m) / count(*) / {PARTS}::double FROM c), 6) AS mean, round(es[{int(0.025 * _SAMPLES) + 1}], 6) AS low, round(es[{int(0.975 * _SAMPLES) + 1}], 6) AS high, (SELECT count(*) FROM c) AS clusters FROM o"""


CALLS = [
    ("poisson_bootstrap", lambda spark, sf_dir: _rounded(poisson_bootstrap(benefits(_bundles(spark, sf_dir)), ["sample_index"], "benefit", _SAMPLES), "mean", "low", "high"), poisson_sql(_B, "sample_index", "benefit")),
    ("bundle_layers", lambda spark, sf_dir: (lambda t: t["retrievals"].groupBy("sample_index").agg(F.count("*").alias("retrievals"), F.count_distinct("retrieval_id").alias("ids")).join(t["states"].groupBy("sample_index").agg(F.count("*").alias("states")), "sample_index").join(t["queries"].groupBy("sample_index").agg(F.count("*").alias("queries")), "sample_index"))(layers(unique_samples(_bundles(spark, sf_dir)))),
     _BASE + " SELECT sample_index, 2 * count(*) AS retrievals, 2 * count(*) AS ids, count(DISTINCT state_id) AS states, count(*) AS queries FROM a GROUP BY sample_index"),
    ("bundle_benefits", lambda spark, sf_dir: benefits(_bundles(spark, sf_dir)).select("sample_index", "action_id", "source", "checkpoint", "score", "skip_score", "benefit", "bucket", "skip_bucket", "flip"),
     _B + " SELECT sample_index, action_id, source, checkpoint, score, skip AS skip_score, benefit, bucket, CASE WHEN skip >= 1 THEN 'correct' WHEN skip > 0 THEN 'partial' ELSE 'wrong' END AS skip_bucket, CASE WHEN skip < 1 AND score >= 1 THEN 'wrong_to_correct' WHEN skip >= 1 AND score < 1 THEN 'correct_to_wrong' ELSE 'same' END AS flip FROM b"),
    ("benefit_summary", lambda spark, sf_dir: _rounded(benefit_summary(benefits(_bundles(spark, sf_dir))), "mean_benefit", "positive_rate", "negative_rate"),
     _B + " SELECT source, checkpoint, count(*) AS n, round(avg(benefit), 6) AS mean_benefit, round(avg((bucket = 'positive')::int), 6) AS positive_rate, round(avg((bucket = 'negative')::int), 6) AS negative_rate, count(*) FILTER (skip < 1 AND score >= 1) AS wrong_to_correct, count(*) FILTER (skip >= 1 AND score < 1) AS correct_to_wrong FROM b GROUP BY GROUPING SETS ((), (source), (checkpoint))"),
    ("bundle_oracle_gains", lambda spark, sf_dir: _rounded(oracle_gains(benefits(_bundles(spark, sf_dir))).drop("qid"), "state_gain", "sample_gain"),
     _B + ", o AS (SELECT sample_index, state_id, greatest(max(score), max(skip)) - max(skip) AS gain FROM b GROUP BY sample_index, state_id) SELECT sample_index, round(avg(gain), 6) AS state_gain, round(max(gain), 6) AS sample_gain, count(*) FILTER (gain > 1e-12) AS positive_states FROM o GROUP BY sample_index"),
    ("gold_documents", lambda spark, sf_dir: gold_index(_gold(spark, sf_dir)).select("question_key", F.inline("documents")).withColumn("sentence_ids", F.array_join("sentence_ids", ",")),
     _BASE + ", g AS (SELECT sample_index, min(part) AS lo, max(part) AS hi FROM a GROUP BY sample_index) SELECT concat('which part of ', sample_index) AS question_key, concat('part  ', lo) AS title, CASE WHEN lo < hi THEN concat('other the part ', lo, ' text') ELSE 'other' END AS text, CASE WHEN lo < hi THEN '1,0' ELSE '1' END AS sentence_ids, 1 AS rank FROM g UNION ALL SELECT concat('which part of ', sample_index), concat('part  ', hi), concat('the part ', hi, ' text'), '0', 2 FROM g WHERE lo < hi"),
    ("evidence_attribution", lambda spark, sf_dir: _rounded(_attributed(spark, sf_dir).select("sample_index", "action_id", "any_hit", "full_hit", "recall", "first_rank", "support_hit", "answer_hit", "label"), "recall"),
     _HITS + " SELECT sample_index, action_id, any_hit, full_hit, round(recall, 6) AS recall, first_rank, support_hit, answer_hit, concat(CASE WHEN NOT any_hit THEN 'gold_title_miss' WHEN NOT support_hit THEN 'gold_title_hit_but_support_sentence_miss' ELSE 'support_sentence_retrieved' END, '__', CASE WHEN bucket = 'positive' THEN 'gain' WHEN bucket = 'negative' THEN 'harm' WHEN skip >= 1 THEN 'metric_ceiling_no_change' WHEN answer_hit THEN 'answer_present_but_no_gain' ELSE 'answer_absent_and_no_gain' END) AS label FROM e"),
    ("evidence_summary", lambda spark, sf_dir: _rounded(evidence_summary(_attributed(spark, sf_dir)), "benefit", "any_hit", "full_hit", "support_hit", "answer_hit", "recall"),
     _HITS + " SELECT v.bucket, count(e.action_id) AS n, count(DISTINCT e.sample_index) AS samples, " + ", ".join(f"round(coalesce(avg({c}::double), 0), 6) AS {c}" for c in ("benefit", "any_hit", "full_hit", "support_hit", "answer_hit", "recall")) + " FROM (VALUES ('positive'), ('zero'), ('negative')) v(bucket) LEFT JOIN e ON e.bucket = v.bucket GROUP BY v.bucket"),
    ("evidence_label_counts", lambda spark, sf_dir: _attributed(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("sample_index").alias("samples")),
     _HITS + " SELECT concat(CASE WHEN NOT any_hit THEN 'gold_title_miss' WHEN NOT support_hit THEN 'gold_title_hit_but_support_sentence_miss' ELSE 'support_sentence_retrieved' END, '__', CASE WHEN bucket = 'positive' THEN 'gain' WHEN bucket = 'negative' THEN 'harm' WHEN skip >= 1 THEN 'metric_ceiling_no_change' WHEN answer_hit THEN 'answer_present_but_no_gain' ELSE 'answer_absent_and_no_gain' END) AS label, count(*) AS n, count(DISTINCT sample_index) AS samples FROM e GROUP BY 1"),
    ("matched_interventions", lambda spark, sf_dir: _matched(spark, sf_dir).select("sample_index", "action_id", "keep", "append", "restart", "revision"), _M + " SELECT sample_index, action_id, keep, append, restart, revision FROM m"),
    ("intervention_counts", lambda spark, sf_dir: intervention_counts(_matched(spark, sf_dir)), _M + _COUNTS),
    ("paired_gains", lambda spark, sf_dir: _rounded(paired_gains(_matched(spark, sf_dir)).groupBy("sample_index").agg(*(F.avg(c).alias(c) for c in _GAINS)), *_GAINS), _M + " SELECT sample_index, " + ", ".join(f"round(avg({c.replace('_over_', ' - ')}), 6) AS {c}" for c in _GAINS) + " FROM m GROUP BY sample_index"),
    ("best_operators", lambda spark, sf_dir: _rounded(best_operators(_matched(spark, sf_dir)), "mean"),
     _M + ", t AS (SELECT *, greatest(keep, append, restart, revision) AS top FROM m), u AS (SELECT *, (keep = top)::int + (append = top)::int + (restart = top)::int + (revision = top)::int AS ties FROM t), x AS (" + " UNION ALL ".join(f"SELECT '{o}' AS operator, {o} AS score, top, ties FROM u" for o in ("keep", "append", "restart", "revision")) + ") SELECT operator, round(avg(score), 6) AS mean, count(*) FILTER (score = top) AS best, count(*) FILTER (score = top AND ties = 1) AS alone FROM x GROUP BY operator"),
    ("cluster_bootstrap", lambda spark, sf_dir: _rounded(cluster_bootstrap(benefits(_bundles(spark, sf_dir)), ["sample_index"], "benefit", _SAMPLES), "mean", "low", "high"),
     _B + f", c AS (SELECT sample_index, avg(benefit) AS m, row_number() OVER (ORDER BY sample_index) - 1 AS i FROM b GROUP BY sample_index), n AS (SELECT count(*) AS n FROM c), d AS (SELECT r.range AS b, ('0x' || substr(md5(concat(r.range, ':', k.i)), 1, 8))::bigint % n.n AS i FROM range({_SAMPLES}) r, c k, n), e AS (SELECT b, avg(m) AS e FROM d JOIN c ON c.i = d.i GROUP BY b), o AS (SELECT list(e ORDER BY e) AS es FROM e) SELECT round((SELECT avg(m) FROM c), 6) AS mean, round(es[{int(0.025 * _SAMPLES) + 1}], 6) AS low, round(es[{int(0.975 * _SAMPLES) + 1}], 6) AS high, (SELECT n FROM n) AS clusters FROM o"),
]
