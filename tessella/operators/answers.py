"""Scoring of generated answers: exact match, token F1 over several golds, metric reports, rewards.

The queries take each turn of a conversation as generated text: the whole turn, a
marker, the whole next turn as the answer, and a tail. The golds are the next turn and
the turn itself.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import extract as X
from tessella.functions import text as T

GUARDED = ("yes", "no", "noanswer")


def exact_match(prediction: Column, golds: Column) -> Column:
    """1 if any gold equals the prediction after normalisation, else 0."""
    mine = T.normalize_answer(prediction)
    return F.exists(golds, lambda g: T.normalize_answer(g) == mine).cast("int")


def token_scores(rows: DataFrame, keys: list[str], prediction: str, golds: str, articles: bool = False, guard: bool = True, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """keys, f1, precision, recall: each the best over the golds by itself.

    Tokens overlap as multisets. With guard a gold counts only if it and the
    prediction are equal, should either be yes, no or noanswer. tokens: how a text
    is cut, in place of the normalisation. Overlaps are counted by joins on tokens,
    so that texts may be long; rows without golds have zeros.
    """
    cut = tokens or (lambda c: T.answer_tokens(c, articles))
    base = rows.select(*keys, cut(F.col(prediction)).alias("p"), F.posexplode_outer(golds).alias("g", "gold")).withColumn("q", cut(F.col("gold")))
    first = rows.select(*keys, F.explode(cut(F.col(prediction))).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("np"))
    second = base.select(*keys, "g", F.explode("q").alias("w")).groupBy(*keys, "g", "w").agg(F.count("*").alias("nq"))
    same = second.join(first, [*keys, "w"]).groupBy(*keys, "g").agg(F.sum(F.least("np", "nq")).alias("same"))
    joined = lambda c: F.array_join(c, " ")
    barred = (joined(F.col("p")).isin(*GUARDED) | joined(F.col("q")).isin(*GUARDED)) & (joined(F.col("p")) != joined(F.col("q"))) if guard else F.lit(False)
    per = base.select(*keys, "g", F.size("p").alias("sp"), F.size("q").alias("sq"), barred.alias("barred")).join(same, [*keys, "g"], "left")
    hit = (F.col("same") > 0) & ~F.col("barred")
    part = lambda c: F.coalesce(F.max(F.when(hit, c)), F.lit(0.0))
    return per.groupBy(*keys).agg(part(2 * F.col("same") / (F.col("sp") + F.col("sq"))).alias("f1"), part(F.col("same") / F.col("sp")).alias("precision"), part(F.col("same") / F.col("sq")).alias("recall"))


def metric_report(scored: DataFrame, metrics: list[str], correct: str) -> DataFrame:
    """(metric, value): the mean of each metric, and Accuracy, the share of rows that are correct."""
    means = scored.agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics], F.avg((F.col(correct) >= 1).cast("double")).alias("Accuracy"))
    return means.unpivot([], [*metrics, "Accuracy"], "metric", "value")


def with_aliases(rows: DataFrame, aliases: DataFrame, golds: str = "golds", on: str = "answer_id") -> DataFrame:
    """rows with the aliases (an array column of that name) of their answer's id added to the golds."""
    return rows.join(aliases, on, "left").withColumn(golds, F.array_union(golds, F.coalesce("aliases", F.array().cast("array<string>")))).drop("aliases")


def outcome_rewards(rows: DataFrame, keys: list[str], completion: str, gold: str) -> DataFrame:
    """keys, reward: twice the tagged answer's F1, or nothing below 0.2, and the format's reward."""
    plain = lambda c: F.filter(F.split(F.lower(c), rf"{T.SPACE}+"), lambda w: w != "")
    told = rows.select(*keys, T.strip(F.regexp_extract(completion, r"(?is)<answer>(.*?)</answer>", 1)).alias("p"), F.array(gold).alias("gs"), X.format_reward(F.col(completion)).alias("fmt"))
    f1 = token_scores(told, keys, "p", "gs", guard=False, tokens=plain).select(*keys, "f1")
    return told.join(f1, keys).select(*keys, (F.when(F.col("f1") < 0.2, 0.0).otherwise(2 * F.col("f1")) + F.col("fmt")).alias("reward"))


# ---- queries and their SQL

KEYS = ["conv_id", "turn"]
_PUNCT = string.punctuation.replace("'", "''")
_SP = T.SPACE
_TURNS = """
WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM conversations),
     x AS (SELECT conv_id, turn, text, coalesce(nxt, 'Yes') AS nxt, role FROM t),
     g AS (SELECT conv_id, turn, text, nxt, role, concat(text, CASE turn % 4 WHEN 0 THEN ' So the answer is ' WHEN 1 THEN ' The answer is ' WHEN 2 THEN ' so the answer is ' ELSE ' hence ' END, nxt,
       CASE turn % 3 WHEN 0 THEN '. Question: next' WHEN 1 THEN '.</s> Note: done' ELSE '. So the answer is no. #10000000' END) AS pred FROM x)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = t.withColumn("nxt", F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")), F.lit("Yes")))
    k, e = F.col("turn") % 4, F.col("turn") % 3
    mark = F.when(k == 0, " So the answer is ").when(k == 1, " The answer is ").when(k == 2, " so the answer is ").otherwise(" hence ")
    tail = F.when(e == 0, ". Question: next").when(e == 1, ".</s> Note: done").otherwise(". So the answer is no. #10000000")
    return t.withColumn("pred", F.concat("text", mark, "nxt", tail))


def _per_turn(name: str, column: Callable[[DataFrame], Column], sql: str, out: str = "answer"):
    return name, lambda spark, sf_dir: _turns(spark, sf_dir).select(*KEYS, column(F.col("pred")).alias(out)), _TURNS + sql


def _d_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_SP}+|{_SP}+\z', '', 'g')"


def _d_norm(x: str, articles: bool = False) -> str:
    keep = "w <> ''" if articles else "w NOT IN ('', 'a', 'an', 'the')"
    return f"array_to_string([w for w in regexp_split_to_array(translate(lower({x}), '{_PUNCT}', ''), '{_SP}+') if {keep}], ' ')"


_CUT = ",".join(f"""
     s{i + 1} AS (SELECT conv_id, turn, CASE WHEN instr(p, '{w}') > 1 THEN substr(p, 1, instr(p, '{w}') - 1) ELSE p END AS p FROM s{i})""" for i, w in enumerate(X.TAILS))
_TAIL = f""",
     s0 AS (SELECT conv_id, turn, pred AS p FROM g),{_CUT}"""
_EDGE = r"(?:[^\p{L}\p{N}_]|\z)"
_SPAN = _TAIL + f""",
     a AS (SELECT conv_id, turn, {_d_strip(r"regexp_extract(p, '(?is)(?:\A|[^\p{L}\p{N}_])the answer is(\z|[^\p{L}\p{N}_].*)\z', 1)")} AS p FROM s3),
     b AS (SELECT conv_id, turn, {_d_strip(r"regexp_replace(p, '(?is)(\A|[^\p{L}\p{N}_])(?:so\s+)?the answer is(?:\z|[^\p{L}\p{N}_].*)\z', '\1')")} AS p FROM a),
     c AS (SELECT conv_id, turn, {_d_strip(r"regexp_replace(p, '(?is)([\s.])question(?:\z|[^\p{L}\p{N}_].*)\z', '\1')")} AS p FROM b),
     d AS (SELECT conv_id, turn, {_d_strip(r"regexp_replace(" + _d_strip(r"regexp_replace(p, '</s>\z', '')") + r", '<\|endoftext\|>\z', '')")} AS p FROM c),
     f AS (SELECT conv_id, turn, {_d_strip(r"regexp_replace(p, '\.\z', '')")} AS answer FROM d)"""


def _span_sql(missing: str, ends: tuple = (*X.ENDS, ".")) -> str:
    steps, last = "", "b0"
    for i, e in enumerate(ends):
        e = e.replace("\n", "' || chr(10) || '")
        steps += f", b{i + 1} AS (SELECT conv_id, turn, pred, pos, CASE WHEN ends_with(b, '{e}') THEN left(b, length(b) - length('{e}')) ELSE b END AS b FROM b{i})"
        last = f"b{i + 1}"
    return f", b0 AS (SELECT conv_id, turn, pred, instr(pred, 'the answer is') AS pos, substr(pred, instr(pred, 'the answer is') + 14) AS b FROM g){steps} SELECT conv_id, turn, CASE WHEN pos > 0 THEN b ELSE {missing} END AS answer FROM {last}"


_COUNTS = """,
     e AS (SELECT conv_id, turn, 0 AS k, {norm} AS v FROM (SELECT conv_id, turn, {pred} AS s FROM g) z UNION ALL SELECT conv_id, turn, 1, {norm} FROM (SELECT conv_id, turn, nxt AS s FROM g) z UNION ALL SELECT conv_id, turn, 2, {norm} FROM (SELECT conv_id, turn, text AS s FROM g) z),
     w AS (SELECT conv_id, turn, k, unnest(regexp_split_to_array(v, ' ')) AS w FROM e), n AS (SELECT conv_id, turn, k, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
     z AS (SELECT conv_id, turn, k, v, CASE WHEN v = '' THEN 0 ELSE len(regexp_split_to_array(v, ' ')) END AS size FROM e),
     m AS (SELECT q.conv_id, q.turn, q.k, sum(least(p.n, q.n)) AS same FROM n p JOIN n q ON p.k = 0 AND q.k > 0 AND p.conv_id = q.conv_id AND p.turn = q.turn AND p.w = q.w GROUP BY ALL),
     y AS (SELECT q.conv_id, q.turn, CASE WHEN {guard} THEN NULL ELSE m.same END::double AS same, p.size AS sp, q.size AS sq FROM z p JOIN z q ON p.k = 0 AND q.k > 0 AND p.conv_id = q.conv_id AND p.turn = q.turn LEFT JOIN m ON m.conv_id = q.conv_id AND m.turn = q.turn AND m.k = q.k)
SELECT conv_id, turn, round(coalesce(max(2 * same / (sp + sq)), 0), 9) AS f1, round(coalesce(max(same / sp), 0), 9) AS "precision", round(coalesce(max(same / sq), 0), 9) AS recall FROM y GROUP BY conv_id, turn"""
_GUARD = "(p.v IN ('yes', 'no', 'noanswer') OR q.v IN ('yes', 'no', 'noanswer')) AND p.v <> q.v"


def _scores(spark: SparkSession, sf_dir: str, articles: bool, prediction: str = "text") -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("golds", F.array("nxt", "text")).withColumn("p", X.first_answer_span(F.col("pred")) if prediction == "span" else F.col("pred"))
    return token_scores(t, KEYS, "p", "golds", articles).select(*KEYS, *[F.round(c, 9).alias(c) for c in ("f1", "precision", "recall")])


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("golds", F.array("nxt", "text")).withColumn("p", X.first_answer_span(F.col("pred")))
    t = t.withColumn("em", exact_match(F.col("p"), F.col("golds"))).withColumn("tokens", T.token_length(F.col("pred")))
    return metric_report(t, ["em", "tokens"], "em").withColumn("value", F.round("value", 9))


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("done", _completion(F.col("turn"), F.col("text"), F.col("nxt")))
    return outcome_rewards(t, KEYS, "done", "nxt").withColumn("reward", F.round("reward", 9))


def _completion(turn: Column, text: Column, nxt: Column) -> Column:
    step = F.concat(text, F.lit("</step>"))
    hop = F.concat(step, F.lit("<subquery>"), nxt, F.lit("</subquery><retrieval>"), text, F.lit("</retrieval><step>"), nxt, F.lit("</step><subanswer>x</subanswer><step>"))
    end = F.concat(F.lit("y</step><answer>"), F.when(turn % 2 == 0, nxt).otherwise(text), F.lit("</answer>"))
    return F.when(turn % 3 == 0, F.concat(step, F.lit("<answer>"), nxt, F.lit("</answer>"))).when(turn % 3 == 1, F.concat(hop, end)).otherwise(F.concat(hop, text))


_D_STEP = "concat(text, '</step>')"
_D_HOP = f"concat({_D_STEP}, '<subquery>', nxt, '</subquery><retrieval>', text, '</retrieval><step>', nxt, '</step><subanswer>x</subanswer><step>')"
_D_DONE = f"CASE turn % 3 WHEN 0 THEN concat({_D_STEP}, '<answer>', nxt, '</answer>') WHEN 1 THEN concat({_D_HOP}, 'y</step><answer>', CASE WHEN turn % 2 = 0 THEN nxt ELSE text END, '</answer>') ELSE concat({_D_HOP}, text) END"
_D_TAGS = "array_to_string(regexp_extract_all(concat('<step>', chr(10), done), '(</?[a-zA-Z]+>)', 1), '')"
_D_FORMAT = f"CASE WHEN regexp_full_match({_D_TAGS}, '(<step></step><subquery></subquery><retrieval></retrieval><step></step><subanswer></subanswer>)*<step></step><answer></answer>') THEN 1.0 ELSE -1.0 END"
_D_PLAIN = f"array_to_string([w for w in regexp_split_to_array(lower(s), '{_SP}+') if w <> ''], ' ')"
_REWARD = f""",
     done AS (SELECT conv_id, turn, nxt, {_D_DONE} AS done FROM g),
     e AS (SELECT conv_id, turn, k, {_D_PLAIN} AS v FROM (SELECT conv_id, turn, 0 AS k, regexp_extract(done, '(?is)<answer>(.*?)</answer>', 1) AS s FROM done UNION ALL SELECT conv_id, turn, 1, nxt FROM done) z),
     w AS (SELECT conv_id, turn, k, unnest(regexp_split_to_array(v, ' ')) AS w FROM e), n AS (SELECT conv_id, turn, k, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
     l AS (SELECT conv_id, turn, sum(n) AS size FROM n GROUP BY ALL),
     m AS (SELECT p.conv_id, p.turn, sum(least(p.n, q.n))::double AS same FROM n p JOIN n q ON p.k = 0 AND q.k = 1 AND p.conv_id = q.conv_id AND p.turn = q.turn AND p.w = q.w GROUP BY ALL),
     f AS (SELECT m.conv_id, m.turn, 2 * m.same / l.size AS f1 FROM m JOIN l ON m.conv_id = l.conv_id AND m.turn = l.turn)
SELECT d.conv_id, d.turn, round((CASE WHEN coalesce(f.f1, 0) < 0.2 THEN 0 ELSE 2 * f.f1 END + {_D_FORMAT})::double, 9) AS reward FROM done d LEFT JOIN f ON f.conv_id = d.conv_id AND f.turn = d.turn"""
_D_EM = f"CASE WHEN {_d_norm('answer')} IN ({_d_norm('nxt')}, {_d_norm('text')}) THEN 1 ELSE 0 END"

_WRAPPED = f"""
SELECT conv_id, turn, concat(CASE WHEN turn % 2 = 0 THEN concat('So the next query is <query>', replace(regexp_replace({_d_strip("text || '\".'")}, '[."]+\\z', ''), '"', ''), '</query>') ELSE concat('Then ', text, '".') END,
  ' So the answer is <answer>', regexp_replace({_d_strip("nxt || '\".'")}, '[."]+\\z', ''), '</answer> So the answer is <answer>', nxt, '</answer>') AS answer FROM x"""


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = F.when(F.col("turn") % 2 == 0, 'So the next query is "').otherwise("Then ")
    text = F.concat(opening, F.col("text"), F.lit('". So the answer is '), "nxt", F.lit('". So the answer is “'), "nxt", F.lit("”"))
    return _turns(spark, sf_dir).select(*KEYS, X.wrap_clauses(text).alias("answer"))


CALLS = [
    ("wrapped_clauses", _clauses, _TURNS + _WRAPPED),
    _per_turn("answer_span_v1", X.first_answer_span, _SPAN + " SELECT conv_id, turn, answer FROM f"),
    _per_turn("answer_sentence_v2", X.first_answer_sentence, _SPAN + rf""" SELECT conv_id, turn, CASE WHEN regexp_matches(answer, '(?is)\A(yes|no){_EDGE}') THEN regexp_extract(answer, '(?i)\A(yes|no)', 1) ELSE {_d_strip(r"regexp_replace(answer, '(?s)[.!?]\s+[A-Z0-9].*\z', '')")} END AS answer FROM f"""),
    _per_turn("answer_raw_v1", X.extractor("raw_v1"), _TAIL + f" SELECT conv_id, turn, {_d_strip('p')} AS answer FROM s3"),
    _per_turn("answer_span_whole", lambda c: X.answer_span(c, "whole"), _span_sql("pred")),
    _per_turn("answer_span_empty", X.answer_span, _span_sql("''")),
    _per_turn("answer_span_lines", lambda c: X.answer_span(c, ends=(*X.ENDS, "\n", ".")), _span_sql("''", (*X.ENDS, "\n", "."))),
    _per_turn("extract_yes_no", X.yes_no, " SELECT conv_id, turn, CASE WHEN instr(pred, 'the answer is') = 0 THEN '' WHEN substr(pred, instr(pred, 'the answer is') + 14, 3) = 'yes' THEN 'yes' ELSE 'no' END AS answer FROM g"),
    _per_turn("strip_generation_tail", X.strip_generation_tail, _TAIL + " SELECT conv_id, turn, p AS answer FROM s3"),
    _per_turn("normalize_answer", T.normalize_answer, f" SELECT conv_id, turn, {_d_norm('pred')} AS answer FROM g"),
    _per_turn("normalize_answer_articles", lambda c: T.normalize_answer(c, True), f" SELECT conv_id, turn, {_d_norm('pred', True)} AS answer FROM g"),
    _per_turn("first_sentence", T.first_sentence, rf""" SELECT conv_id, turn, regexp_replace({_d_strip('pred')}, '(?s)([.!?]){_SP}.*\z', '\1') AS answer FROM g"""),
    _per_turn("last_integer", lambda c: X.last_integer(F.concat(F.col("turn"), F.lit(" of "), F.col("conv_id"), F.lit(" "), c)), " SELECT conv_id, turn, regexp_extract_all(concat(turn, ' of ', conv_id, ' ', pred), '[+-]?\\d+')[-1]::double AS value FROM g", "value"),
    _per_turn("token_length", T.token_length, f" SELECT conv_id, turn, len([w for w in regexp_split_to_array(pred, '{_SP}+') if w <> ''])::int AS n FROM g", "n"),
    _per_turn("stable_ids", lambda c: T.stable_id("qry", {"turn": F.col("turn"), "conv": F.col("conv_id"), "text": c}), " SELECT conv_id, turn, concat('qry_', substr(sha256(json_object('conv', conv_id, 'text', pred, 'turn', turn)::varchar), 1, 20)) AS id FROM g", "id"),
    _per_turn("few_shot_prompts", lambda c: T.few_shot_prompt(c, [("a?", "b")]), " SELECT conv_id, turn, concat('Question: a?', chr(10), 'Answer: b', chr(10), chr(10), 'Question: ', pred, chr(10), 'Answer:') AS prompt FROM g", "prompt"),
    _per_turn("tagged_answers", lambda c: X.tagged(F.concat(F.lit("<query>q</query><answer>"), c, F.lit("</answer><answer>z</answer>")), "answer"), " SELECT conv_id, turn, pred AS answer FROM g"),
    _per_turn("last_tagged_answers", lambda c: X.last_tagged_answer(F.concat(c, F.lit("<answer>one</answer> <answer>"), F.col("role"), F.lit(" two. three</answer>"))), rf""",
     h AS (SELECT conv_id, turn, role, concat(pred, '<answer>one</answer> <answer>', role, ' two. three</answer>') AS p FROM g), i AS (SELECT conv_id, turn, CASE WHEN contains(p, 'So the answer is') THEN {_d_strip("split_part(p, 'So the answer is', 2)")} ELSE p END AS p FROM h),
     j AS (SELECT conv_id, turn, coalesce(regexp_extract_all(p, '<answer>([^\n]*?)</answer>', 1)[-1], p) AS p FROM i)
     SELECT conv_id, turn, {_d_strip("split_part(p, '.', 1)")} AS answer FROM j"""),
    _per_turn("answer_clauses", lambda c: X.clause(c, "answer"), rf""" SELECT conv_id, turn, {_d_strip("regexp_replace(regexp_extract(pred, '(?i)So the answer is[ \t\n\r\f\x0b]*([^\n]*)', 1), '</?(answer|query|evidence)>', '', 'g')")} AS answer FROM g"""),
    _per_turn("next_query_clauses", lambda c: X.clause(F.concat(F.lit("So the next query is <query>"), c, F.lit("</query>")), "next query"), rf""" SELECT conv_id, turn, {_d_strip("regexp_replace(regexp_extract(concat('So the next query is <query>', pred, '</query>'), '(?i)So the next query is[ \t\n\r\f\x0b]*([^\n]*)', 1), '</?(answer|query|evidence)>', '', 'g')")} AS answer FROM g"""),
    ("step_formats", lambda spark, sf_dir: (lambda t: t.select(*KEYS, X.well_formed_step(F.concat(F.lit("<step>"), "done")).alias("ok"), X.step_reward(F.col("done")).alias("step"), X.format_reward(F.col("done")).alias("format")))(_turns(spark, sf_dir).withColumn("done", _completion(F.col("turn"), F.col("text"), F.col("nxt")))),
     _TURNS + f", done AS (SELECT conv_id, turn, {_D_DONE} AS done FROM g), k AS (SELECT conv_id, turn, done, {_D_TAGS} IN ('<step></step><subquery></subquery><retrieval></retrieval>', '<step></step><subanswer></subanswer>', '<step></step><answer></answer>') AS ok FROM done) SELECT conv_id, turn, ok, (CASE WHEN ok THEN 1 ELSE -2 END)::double AS step, ({_D_FORMAT})::double AS format FROM k"),
    ("exact_match", lambda spark, sf_dir: _turns(spark, sf_dir).select(*KEYS, exact_match(X.first_answer_span(F.col("pred")), F.array("nxt", "text")).alias("em")), _TURNS + _SPAN + f" SELECT f.conv_id, f.turn, {_D_EM} AS em FROM f JOIN g ON f.conv_id = g.conv_id AND f.turn = g.turn"),
    ("token_scores_multi", lambda spark, sf_dir: _scores(spark, sf_dir, False), _TURNS + _COUNTS.format(norm=_d_norm("s"), pred="pred", guard=_GUARD)),
    ("token_scores_articles", lambda spark, sf_dir: _scores(spark, sf_dir, True), _TURNS + _COUNTS.format(norm=_d_norm("s", True), pred="pred", guard=_GUARD)),
    ("metric_report", _report, _TURNS + _SPAN + f", o AS (SELECT {_D_EM} AS em, len([w for w in regexp_split_to_array(pred, '{_SP}+') if w <> '']) AS tokens FROM f JOIN g ON f.conv_id = g.conv_id AND f.turn = g.turn) SELECT 'em' AS metric, round(avg(em), 9) AS value FROM o UNION ALL SELECT 'tokens', round(avg(tokens), 9) FROM o UNION ALL SELECT 'Accuracy', round(avg(em), 9) FROM o"),
    ("outcome_rewards", _rewards, _TURNS + _REWARD),
]
