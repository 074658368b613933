"""Search trees as adjacency tables (tree, node, parent, depth, ...), worked by path doubling.

In round k a node knows its ancestor 2^k steps up and what lies between, so a tree of
depth d takes log2(d) rounds, and neither a closure of ancestors nor a plan a level is
built. Each round is a table in the shared folder. Sums to ancestors first take off the
leaves, level by level, while that takes away much, so that a bushy tree's rows are
moved about twice in all and only what is left of it is doubled. The queries take a user's events in
order as a heap: the parent of node k is (k - 1) div 2.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T

from ._shared import discard, materialize

KEY = ["tree", "node"]
EXACT = "decimal(28,12)"  # sums of it don't depend on order
WEIGHT = "decimal(20,16)"


def _deepest(nodes: DataFrame) -> int:
    return nodes.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]


def _longer_jumps(state: DataFrame, span: int, *carried: str) -> DataFrame:
    """state with up_jump and the carried columns of the ancestor at jump, null where there is none; only nodes deeper than span have one."""
    ancestors = state.select("tree", F.col("node").alias("jump"), *(F.col(c).alias(f"up_{c}") for c in ("jump", *carried)))
    deep = state.filter(F.col("depth") >= span).join(ancestors, ["tree", "jump"])
    return deep.unionByName(state.filter(F.col("depth") < span), allowMissingColumns=True)


def _with_kids(nodes: DataFrame) -> DataFrame:
    """nodes and in kids how many children each has, as a table."""
    kids = nodes.filter("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    return materialize(nodes.join(kids, KEY, "left").withColumn("kids", F.coalesce("kids", F.lit(0))), "tree-nodes")


def to_ancestors(nodes: DataFrame, values: dict[str, tuple[Column, Column]], keep: tuple[str, ...] = ()) -> DataFrame:
    """tree, node, what to keep and for each (value, weight) the sum over the node and all its descendants, each times the weights on its way up.

    A weight is a node's on the step to its parent. A sum keeps its value's type, so
    decimals don't depend on order. Nodes need depth, 0 at the root; those with kids,
    their children's number, must be a table. Leaves are done: while they are a quarter
    of the rows they hand their sums to their parents and stay where they are; the rest,
    which has long branches, goes by doubling.
    """
    start = [*KEY, "depth", F.col("parent").alias("jump"), *(F.col(c).alias(f"keep_{c}") for c in keep), *(c for name, (v, w) in values.items() for c in (v.alias(name), w.alias(f"w_{name}")))]
    if "kids" in nodes.columns:
        state = nodes.select(*start, F.col("kids").alias("left"))
    else:
        state = _with_kids(nodes.select(*start).withColumnRenamed("jump", "parent")).withColumnsRenamed({"parent": "jump", "kids": "left"})
    kinds, out = dict(state.dtypes), [*KEY, *(F.col(f"keep_{c}").alias(c) for c in keep), *values]
    kept, weights = [f"keep_{c}" for c in keep], [f"w_{c}" for c in values]

    def given(some: DataFrame) -> DataFrame:
        sums = (F.sum((F.col(c) * F.col(f"w_{c}")).cast(kinds[c])).cast(kinds[c]).alias(f"add_{c}") for c in values)
        return some.filter("jump IS NOT NULL").groupBy("tree", F.col("jump").alias("node")).agg(*sums, F.count(F.lit(1)).alias("gone"))

    sums = [(F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).cast(kinds[c]).alias(c) for c in values]
    done = []
    while True:
        rows, leaves, deepest = state.agg(F.count(F.lit(1)), F.count_if(F.col("left") == 0), F.coalesce(F.max("depth"), F.lit(-1))).first()
        if deepest < 2 or 4 * leaves < rows:
            break
        leaf = state.filter("left = 0")
        done.append(leaf.select(*out))
        left = (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left")
        state = materialize(state.filter("left > 0").join(given(leaf), KEY, "left").select(*KEY, "depth", "jump", *kept, *sums, *weights, left), "tree-sums")

    span = 1
    while span <= deepest:
        if 2 * span <= deepest:
            longer = _longer_jumps(state, span, *weights)
        else:
            longer = state.withColumns({"up_jump": F.lit(None).cast("long")} | {f"up_{w}": F.lit(None).cast(kinds[w]) for w in weights})
        ways = ((F.col(w) * F.col(f"up_{w}")).cast(kinds[w]).alias(w) for w in weights)
        new = materialize(longer.join(given(state), KEY, "left").select(*KEY, "depth", F.col("up_jump").alias("jump"), *kept, *sums, *ways), "tree-sums")
        if done or span > 1:  # else it is the caller's table
            discard(state)
        state, span = new, 2 * span
    return functools.reduce(DataFrame.unionAll, [*done, state.select(*out)])


def backpropagate(nodes: DataFrame, gamma: float, mean: bool = False) -> DataFrame:
    """tree, node, visits, q: every node's reward goes to itself and, times gamma a step, to all its ancestors.

    mean: q is the running mean of what came, which ends as the sum over the visits.
    """
    one = F.lit(1).cast("long")
    sums = to_ancestors(nodes, {"visits": (one, one), "q": (F.col("reward").cast(EXACT), F.lit(gamma).cast(WEIGHT))})
    q = F.col("q").cast("double")
    return sums.select(*KEY, "visits", (q / F.col("visits") if mean else q).alias("q"))


def bottom_up_reward(nodes: DataFrame, beta: float) -> DataFrame:
    """tree, node, reward: leaves have f1 * beta^step or null without an answer, others the visit-weighted mean of their children's.

    nodes has visits, step and f1, null where a node has no answer. Children without a
    reward don't count; without visits in those that do, the reward is null. A node so
    has a reward if an answered leaf lies below it, with visits all the way, and the
    reward is the sum of such leaves' times each step's share of the siblings' visits.
    """
    n = nodes.select(*KEY, "parent", "depth", F.coalesce("visits", F.lit(0)).alias("visits"), (F.col("f1") * F.pow(F.lit(beta), F.col("step"))).alias("leaf"))
    n = _with_kids(n)
    leaf = F.when(F.col("kids") == 0, F.col("leaf"))
    known = to_ancestors(n, {"answers": (leaf.isNotNull().cast("double"), (F.col("visits") > 0).cast("double"))}, ("parent", "depth", "visits", "leaf", "kids"))
    known = known.withColumn("has", F.col("answers") > 0).drop("answers")
    counted = known.filter("has AND visits > 0 AND parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.sum("visits").alias("all"))
    # reward is the sum over the children until it is divided by their visits, so leaves need not meet their parents for a share
    inner = known.filter("kids > 0").join(counted, KEY, "left")
    known = materialize(inner.unionByName(known.filter("kids = 0"), allowMissingColumns=True), "tree-answers")
    down = F.when(F.col("kids") == 0, 1.0).otherwise(F.col("all"))
    weight = F.when(F.col("has") & (down > 0), F.col("visits") / down).otherwise(0.0)
    sums = to_ancestors(known, {"reward": (F.coalesce(leaf, F.lit(0.0)), weight)}, ("has", "kids", "all"))
    return sums.select(*KEY, F.when(F.col("has"), F.col("reward") / down).alias("reward"))


def best_child(nodes: DataFrame, rule: str = "puct", c: float = 1.4) -> DataFrame:
    """tree, parent, node: each parent's child of the highest score, the first of equals.

    puct: q / (n + 1e-8) + c * prior * sqrt(parent's n) / (1 + n); uct: q + c * sqrt(ln(parent's n) / n),
    unvisited ones first; visits: n. nodes has n, q and prior.
    """
    up = nodes.select("tree", F.col("node").alias("parent"), F.col("n").alias("pn"))
    n, q = F.col("n").cast("double"), F.col("q").cast("double")
    scores = {
        "puct": q / (n + 1e-8) + c * F.col("prior") * F.sqrt(F.col("pn")) / (1 + n),
        "uct": F.when(n > 0, q + c * F.sqrt(F.log(F.greatest(F.col("pn"), F.lit(1)).cast("double")) / n)).otherwise(float("inf")),
        "visits": n,
    }
    both = nodes.filter("parent IS NOT NULL").join(up, ["tree", "parent"]).withColumn("score", F.round(scores[rule], 9))
    # combines before the shuffle: the highest score, then the least node
    return both.groupBy("tree", "parent").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("node"))


def preference_pairs(nodes: DataFrame, gap: float = 0.01) -> DataFrame:
    """tree, parent, chosen, rejected, gap of siblings whose rewards differ by the gap or more.

    The contents must differ, and the chosen node's class must not be Other.
    """
    side = lambda p: nodes.filter("parent IS NOT NULL").select("tree", "parent", *[F.col(x).alias(p + x) for x in ("node", "reward", "content", "kind")])
    both = side("a_").join(side("b_"), ["tree", "parent"])  # a parent's children are few
    wider = F.round(F.col("a_reward") - F.col("b_reward"), 9)
    return both.filter((wider >= gap) & (F.col("a_content") != F.col("b_content")) & (F.col("a_kind") != "Other")).select("tree", "parent", F.col("a_node").alias("chosen"), F.col("b_node").alias("rejected"), wider.alias("gap"))


def candidate(candidates: Column, ident: Column) -> Column:
    """The first candidate of an array of structs with that id; null without one."""
    return F.try_element_at(F.filter(candidates, lambda c: c["id"] == ident), F.lit(1))


def flatten(nodes: DataFrame, least: int = 1, descend: int = 3, joint: str = " > ") -> DataFrame:
    """tree, node, depth, path: nodes reached from the root through nodes of `descend` visits, with the text on the way.

    Children need `least` visits and be well formed; nodes has n, content and well_formed.
    In each round a path grows at its front by its first node's ancestors' of the same
    length; nodes whose way is broken are dropped as soon as that is known.
    """
    parents = nodes.filter(F.col("n") >= descend).select("tree", F.col("node").alias("parent"))
    reached = nodes.filter((F.col("depth") > 0) & (F.col("n") >= least) & F.col("well_formed")).join(parents, ["tree", "parent"], "left_semi")
    every = nodes.filter("depth = 0").unionByName(reached)
    state = materialize(every.select(*KEY, "depth", F.col("parent").alias("jump"), F.col("content").alias("path")), "tree-paths")
    deepest, span = _deepest(state), 1
    while span <= deepest:
        longer = _longer_jumps(state, span, "path")
        new = longer.select(*KEY, "depth", F.col("up_jump").alias("jump"), F.concat(F.coalesce(F.concat("up_path", F.lit(joint)), F.lit("")), F.col("path")).alias("path"))
        new = materialize(new, "tree-paths")
        discard(state)
        state, span = new, 2 * span
    return state.select(*KEY, "depth", "path")


# ---- queries and their SQL

def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.withColumn("node", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1)
    parent = F.when(F.col("node") > 0, F.expr("(node - 1) div 2"))
    depth = F.length(F.bin(F.col("node") + 1)) - 1
    n = F.col("event_id") % 6
    return e.select(F.col("user_id").alias("tree"), "node", parent.alias("parent"), depth.alias("depth"), F.col("value").alias("reward"), n.alias("n"), n.alias("visits"), depth.alias("step"), F.when(F.col("event_type") != "error", (F.col("event_id") % 11) / 10.0).alias("f1"), (F.col("value") / 100).alias("q"), ((F.col("event_id") % 7) / 7.0).alias("prior"), F.col("event_type").alias("content"), F.when(F.col("event_type") == "error", "Other").otherwise("Query").alias("kind"), (F.col("event_type") != "signup").alias("well_formed"))


_N = """
WITH RECURSIVE n AS (SELECT user_id AS tree, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS node, event_id, value, event_type FROM events),
     t AS (SELECT tree, node, CASE WHEN node > 0 THEN (node - 1) // 2 END AS parent, length(bin(node + 1)) - 1 AS depth, value AS reward, event_id % 6 AS n, CASE WHEN event_type <> 'error' THEN (event_id % 11) / 10::double END AS f1, value / 100 AS q, (event_id % 7) / 7::double AS prior, event_type FROM n)"""
_UP = """, up AS (SELECT tree, node, node AS anc, 0 AS dist, reward FROM t UNION ALL SELECT tree, node, (anc - 1) // 2, dist + 1, reward FROM up WHERE anc > 0)
SELECT tree, anc AS node, count(*) AS visits, round(sum((reward * power(0.9::double, dist))::decimal(28,12)), 6)::double AS q FROM up GROUP BY tree, anc"""
_LEVELS = 24  # the SQL's levels; a heap of 2^24 nodes


def _six(c: str) -> Column:
    """Six decimals, rounded as a decimal: halves are exact."""
    return F.round(F.col(c).cast(EXACT), 6).cast("double")


def _bottom_up_sql() -> str:
    text = _N.replace("RECURSIVE ", "")
    for d in range(_LEVELS, -1, -1):
        kids = "(SELECT NULL::bigint AS tree, NULL::bigint AS parent, 0 AS kids, 0 AS w, 0::double AS s WHERE false)" if d == _LEVELS else f"(SELECT tree, parent, count(*) AS kids, sum(CASE WHEN r IS NOT NULL THEN n END) AS w, sum(CASE WHEN r IS NOT NULL THEN r * n END)::double AS s FROM l{d + 1} GROUP BY tree, parent)"
        text += f", l{d} AS (SELECT t.tree, t.node, t.parent, t.n, CASE WHEN k.kids IS NULL THEN t.f1 * power(0.9::double, t.depth) WHEN k.w > 0 THEN k.s / k.w END::decimal(28,12) AS r FROM t LEFT JOIN {kids} k ON k.tree = t.tree AND k.parent = t.node WHERE t.depth = {d})"
    return text + " " + " UNION ALL ".join(f"SELECT tree, node, round(r, 6)::double AS reward FROM l{d}" for d in range(_LEVELS + 1))


def _child_sql(score: str) -> str:
    return _N + f", s AS (SELECT c.tree, c.parent, c.node, round({score}, 9) AS score FROM t c JOIN t p ON p.tree = c.tree AND p.node = c.parent) SELECT tree, parent, node FROM (SELECT *, row_number() OVER (PARTITION BY tree, parent ORDER BY score DESC, node) AS k FROM s) z WHERE k = 1"


CALLS = [
    ("tree_backprop", lambda spark, sf_dir: backpropagate(_nodes(spark, sf_dir), 0.9).withColumn("q", _six("q")), _N + _UP),
    ("tree_running_mean", lambda spark, sf_dir: backpropagate(_nodes(spark, sf_dir), 1.0, True).withColumn("q", _six("q")), _N + _UP.replace("power(0.9::double, dist)", "1").replace("round(sum((reward * 1)::decimal(28,12)), 6)::double AS q", "round((sum((reward * 1)::decimal(28,12))::double / count(*))::decimal(28,12), 6)::double AS q")),
    ("tree_bottom_up", lambda spark, sf_dir: bottom_up_reward(_nodes(spark, sf_dir), 0.9).withColumn("reward", _six("reward")), _bottom_up_sql()),
    ("best_child_puct", lambda spark, sf_dir: best_child(_nodes(spark, sf_dir), "puct"), _child_sql("c.q / (c.n + 1e-8) + 1.4::double * c.prior * sqrt(p.n) / (1 + c.n)")),
    ("best_child_uct", lambda spark, sf_dir: best_child(_nodes(spark, sf_dir), "uct"), _child_sql("CASE WHEN c.n > 0 THEN c.q + 1.4::double * sqrt(ln(greatest(p.n, 1)) / c.n) ELSE 'infinity'::double END")),
    ("best_child_visits", lambda spark, sf_dir: best_child(_nodes(spark, sf_dir), "visits"), _child_sql("c.n::double")),
    ("sibling_pairs", lambda spark, sf_dir: preference_pairs(_nodes(spark, sf_dir)).withColumn("gap", F.round("gap", 6)),
     _N + " SELECT a.tree, a.parent, a.node AS chosen, b.node AS rejected, round(a.reward - b.reward, 6) AS gap FROM t a JOIN t b ON a.tree = b.tree AND a.parent = b.parent WHERE round(a.reward - b.reward, 9) >= 0.01 AND a.event_type <> b.event_type AND a.event_type <> 'error'"),
    ("tree_flatten", lambda spark, sf_dir: flatten(_nodes(spark, sf_dir)),
     _N + ", f AS (SELECT tree, node, depth, n, event_type AS path FROM t WHERE depth = 0 UNION ALL SELECT c.tree, c.node, c.depth, c.n, concat(f.path, ' > ', c.event_type) FROM f JOIN t c ON c.tree = f.tree AND c.parent = f.node AND f.n >= 3 AND c.n >= 1 AND c.event_type <> 'signup') SELECT tree, node, depth, path FROM f"),
    ("tree_values", lambda spark, sf_dir: _nodes(spark, sf_dir).select(*KEY, F.round(T.tree_value(F.col("reward"), F.col("n")), 6).alias("value")), _N + " SELECT tree, node, round(CASE WHEN n > 0 THEN reward / n ELSE 0 END, 6) AS value FROM t"),
]
