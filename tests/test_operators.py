"""Guards and small cases of bundles, trees, checkpoints, samples, search and the online detector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import answers, checkpoints, ranks, rollouts, samples, traces, trees

BUNDLE = """sample_index long, qid string, question string, states array<struct<state_id string, checkpoint_type string>>, queries array<struct<candidate_id string, source string, text string>>,
 actions array<struct<action_id long, state_id string, action_type string, query_candidate_id string, scores map<string, double>, metadata map<string, string>, retrieved_documents array<struct<title string, text string, rank int>>>>"""


def action(i, kind, f1, state="s", original=None, title="Alpha_Page", text="First sentence here."):
    docs = [(title, text, 1)] if kind == "retrieve" else []
    return (i, state, kind, "c" if kind == "retrieve" else None, {"f1": f1, "accuracy": float(f1 >= 1)}, {"original_action_id": str(original)}, docs)


def bundle(spark, actions, index=1):
    return spark.createDataFrame([(index, "q", "Who  is it?", [("s", "trigger")], [("c", "question", "t")], actions)], BUNDLE)


def test_benefits(spark):
    got = rollouts.benefits(bundle(spark, [action(1, "skip", 0.0), action(2, "retrieve", 1.0), action(3, "retrieve", 0.0)])).orderBy("action_id").collect()
    assert [(r.bucket, r.flip, r.source) for r in got] == [("positive", "wrong_to_correct", "question"), ("zero", "same", "question")]
    for bad in ([action(2, "retrieve", 1.0)], [action(1, "skip", 0.0), action(4, "skip", 0.5), action(2, "retrieve", 1.0)], [action(1, "skip", 0.0), action(2, "retrieve", 1.0, "other")]):
        with pytest.raises(Exception):  # noqa: B017
            rollouts.benefits(bundle(spark, bad)).collect()
    twice = bundle(spark, [action(1, "skip", 0.0)]).union(bundle(spark, [action(1, "skip", 0.0)]))
    with pytest.raises(Exception, match="two bundles"):
        rollouts.unique_samples(twice).collect()
    with pytest.raises(Exception, match="two bundles"):  # whatever is read of it
        rollouts.unique_samples(twice).select("question").collect()
    with pytest.raises(Exception, match="lacks its skip"):
        rollouts.benefits(bundle(spark, [action(2, "retrieve", 1.0)])).select("question").collect()


GOLD = "question string, answer string, supporting_facts array<struct<title string, sent_id int>>, context array<struct<title string, sentences array<string>>>"


def test_attribution(spark):
    gold = lambda facts, q="who is IT?": spark.createDataFrame([(q, "Ada", facts, [("alpha  PAGE", ["First sentence here.", "Second."]), ("Beta", ["Third."])])], GOLD)
    rows = rollouts.benefits(bundle(spark, [action(1, "skip", 0.0), action(2, "retrieve", 0.0)]))
    r = rollouts.attribute(rows, gold([("Alpha Page", 0), ("Beta", 0)])).first()
    assert (r.any_hit, r.full_hit, r.recall, r.first_rank, r.support_hit, r.label) == (True, False, 0.5, 1, True, "support_sentence_retrieved__answer_absent_and_no_gain")
    for bad in ([("Gamma", 0)], [("Beta", 1)]):
        with pytest.raises(Exception, match="supporting fact"):
            rollouts.attribute(rows, gold(bad)).collect()
    with pytest.raises(Exception, match="no gold"):
        rollouts.attribute(rows, gold([("Beta", 0)], "another?")).collect()
    empty = {r.bucket: r.n for r in rollouts.evidence_summary(rollouts.attribute(rows, gold([("Beta", 0)]))).collect()}
    assert empty == {"positive": 0, "zero": 1, "negative": 0}


def test_interventions(spark):
    source = bundle(spark, [action(1, "skip", 0.0), action(2, "retrieve", 1.0)])
    restart = lambda **k: bundle(spark, [action(7, "skip", 0.25), action(8, "retrieve", 0.5, original=2, **k)])
    r = rollouts.compare_interventions(source, restart()).first()
    assert (r.keep, r.append, r.restart) == (0.25, 1.0, 0.5)
    with pytest.raises(Exception, match="state and documents"):
        rollouts.compare_interventions(source, restart(text="changed")).collect()
    with pytest.raises(Exception, match="different samples"):
        rollouts.compare_interventions(source, bundle(spark, [action(7, "skip", 0.0)], 2)).collect()


def test_trees(spark):
    rows = [(1, 0, None, 0, 5, 0.0, "root", True), (1, 1, 0, 1, 2, 0.5, "a", True), (1, 2, 0, 1, 4, None, "b", True), (1, 3, 2, 2, 1, 1.0, "c", True), (1, 4, 2, 2, 0, 0.3, "d", True), (1, 5, 1, 2, 3, None, "e", True)]
    n = spark.createDataFrame(rows, "tree int, node int, parent int, depth int, n long, f1 double, content string, well_formed boolean").withColumns({"visits": F.col("n"), "step": F.col("depth"), "reward": F.coalesce("f1", F.lit(0.0)), "q": F.lit(0.0), "prior": F.lit(1.0)})
    got = {r.node: r.reward for r in trees.bottom_up_reward(n, 0.5).collect()}
    assert got[3] == 0.25 and got[2] == 0.25 and got[5] is None and got[1] is None and got[0] == 0.25
    back = {r.node: (r.visits, round(r.q, 6)) for r in trees.backpropagate(n, 0.5).collect()}
    assert back[2] == (3, 0.65) and back[0] == (6, 0.5 * 0.5 + 0.5 * 0.65)
    mean = {r.node: round(r.q, 6) for r in trees.backpropagate(n, 1.0, True).collect()}
    assert mean[2] == round(1.3 / 3, 6) and mean[0] == round(1.8 / 6, 6)
    assert {r.path for r in trees.flatten(n).collect()} == {"root", "root > a", "root > b", "root > b > c"}
    assert [r.node for r in trees.best_child(n, "uct").filter("parent = 2").collect()] == [4]
    cands = spark.sql("SELECT array(named_struct('id', 1, 'a', 'x'), named_struct('id', 2, 'a', 'y'), named_struct('id', 2, 'a', 'z')) AS c")
    assert cands.select(trees.candidate(F.col("c"), F.lit(2))["a"], trees.candidate(F.col("c"), F.lit(9))).first()[:] == ("y", None)


@pytest.mark.parametrize("parts", [1, 5])
def test_deep_chain(spark, parts):
    """A chain 5000 deep: 13 rounds, and a plan that doesn't depend on the depth."""
    n, gamma = 5000, 0.999
    c = spark.range(n).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.col("id").cast("int").alias("depth"), F.lit(1.0).alias("reward"))
    q = trees.backpropagate(c.repartition(parts), gamma)
    got = {r.node: (r.visits, r.q) for r in q.filter("node IN (0, 1, 4999, 2500)").collect()}
    for node, (visits, value) in got.items():
        assert visits == n - node and value == pytest.approx((1 - gamma ** (n - node)) / (1 - gamma), abs=1e-6)
    plan = lambda df: len(df._jdf.queryExecution().toString())
    shallow = trees.backpropagate(c.filter("node < 3"), gamma)
    assert plan(q) < 1.2 * plan(shallow)
    c = c.withColumns({"visits": F.lit(2), "step": F.lit(0), "f1": F.when(F.col("node") == n - 1, 0.5), "n": F.lit(3), "content": F.lit("x"), "well_formed": F.lit(True)})
    assert {r.reward for r in trees.bottom_up_reward(c, 0.9).collect()} == {0.5}
    short = trees.flatten(c.filter("node < 700")).orderBy("depth").collect()
    assert len(short) == 700 and short[-1].path == " > ".join("x" * 700)


def test_bushy_trees_move_little(spark, monkeypatch):
    """A heap, a chain, a comb and a lone root against sums node by node; of a heap no row is written more than twice a pass, however deep it is."""
    heap = [(1, k, (k - 1) // 2 if k else None) for k in range(4095)]
    chain = [(2, k, k - 1 if k else None) for k in range(300)]
    comb = [(3, k, (k - 1) // 2 * 2 if k else None) for k in range(401)]  # even nodes are its back
    depth, rows = {}, []
    for tree, node, parent in [*heap, *chain, *comb, (4, 0, None)]:
        depth[tree, node] = 0 if parent is None else depth[tree, parent] + 1
        rows.append((tree, node, parent, depth[tree, node], (7 * node + tree) % 5, None if node % 7 == 3 else (node % 11) / 10))
    forest = spark.createDataFrame(rows, "tree int, node long, parent long, depth int, visits long, f1 double").withColumns({"step": F.col("depth") % 9, "reward": F.coalesce("f1", F.lit(0.0))})
    kids, sums, rewards = {}, {}, {}
    for tree, node, parent, deep, visits, f1 in reversed(rows):
        below = kids.pop((tree, node), [])
        n, q = 1 + sum(sums[k][0] for k in below), (f1 or 0.0) + sum(0.9 * sums[k][1] for k in below)
        sums[tree, node] = (n, q)
        known = [k for k in below if rewards[k][0] is not None]
        weight = sum(rewards[k][1] for k in known)
        leaf = None if f1 is None else f1 * 0.9 ** (deep % 9)
        rewards[tree, node] = ((sum(r * v for r, v in map(rewards.get, known)) / weight if weight else None) if below else leaf, visits)
        kids.setdefault((tree, parent), []).append((tree, node))
    written, write = [], trees.materialize

    def counted(df, name):
        out = write(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(trees, "materialize", counted)
    back = {(r.tree, r.node): (r.visits, r.q) for r in trees.backpropagate(forest, 0.9).collect()}
    assert back.keys() == sums.keys() and all(back[k][0] == n and back[k][1] == pytest.approx(q, abs=1e-6) for k, (n, q) in sums.items())
    up = {(r.tree, r.node): r.reward for r in trees.bottom_up_reward(forest, 0.9).collect()}
    assert up.keys() == rewards.keys() and all(up[k] == (None if r is None else pytest.approx(r, abs=1e-9)) for k, (r, _) in rewards.items())
    assert any(r is None for r, _ in rewards.values())
    written.clear()
    trees.backpropagate(forest.filter("tree = 1"), 0.9)
    assert sum(written) <= 2.2 * len(heap)
    written.clear()
    trees.bottom_up_reward(forest.filter("tree = 1"), 0.9)
    assert sum(written) <= 4.4 * len(heap)


OBS = "qid string, token_index long, prefix string, prefix_token_ids array<int>, triggered boolean"


def test_checkpoints(spark):
    rows = [("q", 3, "First fact.", [1], False), ("q", 7, "First fact. Second uncertain fact", [2], True), ("q", 9, "First fact. So", [3], False), ("q", 12, "First fact. So the answer is x", [4], False)]
    o = spark.createDataFrame(rows, OBS)
    got = checkpoints.finalise(checkpoints.collect(o, ["qid"]), ["qid"]).orderBy("checkpoint_index").collect()
    assert [r.checkpoint_type for r in got] == ["first_sentence_boundary", "first_etc_trigger", "before_first_answer_marker"] and got[-1].prefix == "First fact. So"
    same = spark.createDataFrame([("q", 4, "A fact.", [1, 2], True)], OBS)
    assert checkpoints.finalise(checkpoints.collect(same, ["qid"]), ["qid"]).count() == 1
    dense = spark.createDataFrame([("q", 5 * i, " ".join("A b." for _ in range(i)), [i], i == 4) for i in range(1, 12)], OBS)
    all_ = checkpoints.collect(dense, ["qid"], True, 10, 3)
    assert all_.filter("checkpoint_type = 'token_grid'").count() == 3 and all_.filter("checkpoint_type = 'sentence_boundary'").count() == 11
    kept = [r.token_index for r in checkpoints.finalise(all_, ["qid"], 4, True).orderBy("checkpoint_index").collect()]
    assert len(kept) == 4 and 20 in kept and kept[0] == 5 and kept[-1] == 55
    s = spark.createDataFrame([("q", "sentence_boundary", 8), ("q", "sentence_boundary", 19), ("q", "first_etc_trigger", 24), ("q", "first_etc_trigger", 8)], "qid string, checkpoint_type string, token_index int")
    near = {r.token_index: r.prior and r.prior.token_index for r in checkpoints.nearest_earlier(s, ["qid"]).filter("checkpoint_type = 'first_etc_trigger'").collect()}
    assert near == {24: 19, 8: None}


def test_attention(spark):
    rows = [("s", t, tok, src, w) for t, tok, src, w in ((0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 1, 0, 1.0), (0, 1, 1, 1.0))]
    got = checkpoints.pool_attention(spark.createDataFrame(rows, "seq string, target int, target_token int, source int, weight double"), ["seq"]).collect()
    assert got[0].attention == pytest.approx(2 / 3)


def test_pooled_spans(spark):
    """pool_spans() over matrices gives what pool_attention() gives over token pairs."""
    r = np.random.default_rng(5)
    traces_, pairs = [], []
    for t in range(6):
        rows, columns = np.r_[0, np.cumsum(r.integers(1, 4, 5))].tolist(), np.r_[0, np.cumsum(r.integers(1, 3, 7))].tolist()
        m = r.random((rows[-1], columns[-1]))
        traces_.append((t, m.ravel().tolist(), rows, columns))
        word = lambda at, bounds: int(np.searchsorted(bounds, at, "right")) - 1
        pairs += [(t, word(i, rows), i, word(j, columns), float(m[i, j])) for i in range(rows[-1]) for j in range(columns[-1])]
    traces_ += [(90, None, [0, 1], [0, 1]), (91, [], [], [])]
    for parts in (1, 3):
        got = checkpoints.pool_spans(spark.createDataFrame(traces_, "seq int, attention array<double>, targets array<int>, sources array<int>").repartition(parts), ["seq"]).collect()
        want = checkpoints.pool_attention(spark.createDataFrame(pairs, "seq int, target int, target_token int, source int, weight double"), ["seq"]).collect()
        assert {(x.seq, x.target): round(x.attention, 12) for x in got} == {(x.seq, x.target): round(x.attention, 12) for x in want}


def test_trends_agree(spark):
    """The windows, the fold and the stream's step give the same bits."""
    from tessella.streaming import detector

    r = np.random.default_rng(3)
    rows = [(s, p, float(r.integers(0, 40)) / 8 if r.random() < 0.95 else None, bool(r.random() < 0.7)) for s in range(5) for p in range(200)]
    want = {}
    for s in range(5):
        state = detector.START
        for _, p, h, c in [x for x in rows if x[0] == s]:
            state, want[s, p] = detector.step(state, h, c and h is not None)
    w = spark.createDataFrame(rows, "seq long, pos long, entropy double, content boolean")
    for parts in (1, 4):
        for form in (traces.trends, traces.folded_trends):
            assert {(x.seq, x.pos): x.trend for x in form(w.repartition(parts), ["seq"], ["pos"]).collect()} == want


def test_traces(spark):
    w = spark.createDataFrame([("q", 1, "a", 0.1, True), ("q", 2, "b", 0.9, True), ("q", 3, "c", 0.9, False), ("q", 4, "d", 0.5, True), ("p", 1, "x", 1.0, False)], "k string, pos int, word string, attention double, content boolean")
    assert {r.k: r.query for r in traces.formulate(w, ["k"], 2).collect()} == {"q": "b d", "p": ""}
    assert {r.k: r.query for r in traces.formulate(w, ["k"], None, 0.4).collect()} == {"q": "b", "p": ""}
    with pytest.raises(ValueError):
        traces.formulate(w, ["k"], 2, 0.4)
    t = spark.createDataFrame([(1, 2.0, 1.0, True), (1, 3.0, 3.0, True), (1, 4.0, 9.0, False), (2, 1.0, 5.0, True)], "g int, outcome double, score double, mask boolean")
    got = sorted(r.advantage for r in traces.step_advantages(t, ["g"], "outcome", "score", "mask", 0.5).collect())
    assert got == pytest.approx([1.0, 1.5, 3.5, 4.0], abs=1e-6)
    gold = spark.createDataFrame([(1, "a")], "qid int, gold string")
    asked = spark.createDataFrame([(1, "p"), (2, "q")], "qid int, pred string")
    assert traces.join_gold(asked.filter("qid = 1"), gold, "qid").first()[:] == (1, "p", "a")
    with pytest.raises(Exception, match="no gold for 2"):
        traces.join_gold(asked, gold, "qid").select("pred").collect()
    z = spark.createDataFrame([(1, ["a", "b"], [1, 2]), (2, [], None)], "k int, x array<string>, y array<int>")
    assert sorted(tuple(r) for r in traces.zip_arrays(z, ["x", "y"], ["k"]).collect()) == [(1, 0, "a", 1), (1, 1, "b", 2)]
    with pytest.raises(Exception, match="unlike"):
        traces.zip_arrays(spark.createDataFrame([(1, ["a"], [1, 2])], z.schema), ["x", "y"], ["k"]).select("k").collect()


def test_poisson_bootstrap(spark):
    """Merged replicates give the exact grid's interval, within a tenth of its width at 400 clusters, and don't depend on the partitions."""
    r = np.random.default_rng(2)
    rows = [(int(c), float(v)) for c, n, m in zip(range(400), r.integers(1, 5, 400), r.normal(0.2, 1.0, 400), strict=True) for v in r.normal(m, 0.1, n)]
    df = spark.createDataFrame(rows, "c long, v double")
    exact = rollouts.cluster_bootstrap(df, ["c"], "v", 500).first()
    got = [rollouts.poisson_bootstrap(df.repartition(p), ["c"], "v", 500).first() for p in (1, 6)]
    assert got[0] == got[1] and got[0].clusters == 400 and got[0].mean == pytest.approx(exact.mean, abs=1e-6)
    width = exact.high - exact.low
    assert abs(got[0].low - exact.low) < width / 10 and abs(got[0].high - exact.high) < width / 10
    assert rollouts.poisson_bootstrap(df.filter("false"), ["c"], "v", 10).first().clusters == 0


def test_samples(spark):
    df = spark.createDataFrame([(i, "x") for i in range(10)], "i long, checkpoint_type string")
    assert samples.contiguous(df, "i", 2, 5).count() == 5
    with pytest.raises(ValueError):
        samples.contiguous(df, "i", 8, 5)
    states = spark.createDataFrame([("q", 1, "b"), ("q", 2, "t"), ("p", 3, "b"), ("p", 4, "c")], "qid string, k int, checkpoint_type string")
    assert {r.qid: r.k for r in samples.first_state(states, ["qid"], "t", "k").collect()} == {"q": 2, "p": 3}
    with pytest.raises(Exception, match="several states"):
        samples.first_state(states.withColumn("checkpoint_type", F.lit("t")), ["qid"], "t", "k").collect()
    assert samples.first_rows(df, -1, ["i"]).count() == 10
    placed = ranks.global_rank(df, ["i"], buckets=3).collect()
    assert all(r["rank"] == r["i"] for r in placed)


def test_answers(spark):
    df = spark.createDataFrame([(1, "yes", ["no", "Yes."]), (2, "a cat sat", ["the cat", "sat down there"]), (3, "x", [])], "k long, p string, gs array<string>")
    got = {r.k: (round(r.f1, 6), round(r.precision, 6), round(r.recall, 6)) for r in answers.token_scores(df, ["k"], "p", "gs").collect()}
    assert got == {1: (1, 1, 1), 2: (round(2 / 3, 6), 0.5, 1), 3: (0, 0, 0)}
    al = spark.createDataFrame([("Q1", ["b", "c"])], "answer_id string, aliases array<string>")
    rows = spark.createDataFrame([(1, "Q1", ["a"]), (2, None, ["a"])], "k int, answer_id string, golds array<string>")
    assert {r.k: r.golds for r in answers.with_aliases(rows, al).collect()} == {1: ["a", "b", "c"], 2: ["a"]}


def test_detector_streams_as_in_one_batch(spark, tmp_path):
    from tessella.streaming import detector

    r = np.random.default_rng(3)
    rows = [(s, p, float(r.integers(0, 40)) / 4, bool(r.random() < 0.7)) for s in range(5) for p in range(60)]
    want = {}
    for s in range(5):
        state = detector.START
        for _, p, h, c in [x for x in rows if x[0] == s]:
            state, trend = detector.step(state, h, c)
            if trend > 6:
                want[s] = (p, round(trend, 9))
                break
    for k in range(4):
        spark.createDataFrame([x for x in rows if x[1] // 15 == k], "seq_id long, pos long, entropy double, content boolean").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id long, pos long, entropy double, content boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = detector.detect(stream, lambda pos, trend: trend > 6).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {x.seq_id: (x.pos, round(x.trend, 9)) for x in spark.table("found").collect()} == want and len(want) > 2
    table = spark.createDataFrame(rows, "seq_id long, pos long, entropy double, content boolean")
    assert {x.seq_id: (x.pos, round(x.trend, 9)) for x in detector.detect(table, lambda pos, trend: trend > 6).collect()} == want
    obs = spark.createDataFrame([("q", 3, "First fact.", False), ("q", 7, "First fact. Second", True), ("q", 9, "First fact. So", False), ("q", 12, "First fact. So the answer is x", False)], "qid string, token_index long, prefix string, triggered boolean")
    got = sorted((x.token_index, x.checkpoint_type) for x in detector.checkpoint_observer(obs).collect())
    assert got == [(3, "first_sentence_boundary"), (7, "first_etc_trigger"), (9, "before_first_answer_marker")]


def test_bundles_shuffle_keys_not_texts(spark):
    """A run of bundles is dealt out by sample once, before its texts are made; of the joins of samples only the second deals again."""
    from tessella.operators import rollouts

    plan = rollouts._matched(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "hashpartitioning(sample_index" in x]
    assert len(dealt) <= 4, plan
    layers = rollouts.layers(rollouts.unique_samples(rollouts._bundles(spark, "/root/testdata/sf0.001")))["states"]
    assert sum("hashpartitioning(sample_index" in x for x in layers._jdf.queryExecution().executedPlan().toString().splitlines()) == 2


def test_bootstrap_and_attribution_join_without_sorting_the_many(spark):
    from tessella.operators import rollouts

    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "c long, v double")
    for df in (rollouts.cluster_bootstrap(rows, ["c"], "v", 40), rollouts._attributed(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan, plan


def test_hit_diagnostics_holds_no_table_of_parts(spark):
    from tessella.plans.registry import QUERIES

    plan = QUERIES["hit_diagnostics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and " HashAggregate" not in plan and plan.count("Exchange") == 1, plan
