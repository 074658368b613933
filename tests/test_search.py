"""Index-backed search against whole scans; what is skipped is counted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import lexical, multimatch, retrieval, vectors
from tessella.operators._shared import materialize


def corpus(spark):
    r = np.random.default_rng(4)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    rows = []
    for i in range(3000):
        words = [common[min(29, int(r.exponential(5)))] for _ in range(int(r.integers(1, 40)))] + [rare[int(r.integers(400))] for _ in range(3)]
        rows.append((i, " ".join(words), " ".join(words[:2]).upper()))
    rows += [(5000, None, None), (5001, "", "c0"), (5002, "  c1\tc1\n", "c1"), (5003, rows[7][1], rows[7][2])]
    queries = [(i, f"C{i} c1 r{i} r{2 * i + 1}") for i in range(20)] + [(50, "nowhere"), (51, ""), (52, "c0 c0 c1 c2"), (53, None)]
    return rows, queries


def scored(rows, queries, fields, k, skip, tie):
    """BM25 by the formula over every document."""
    texts = {f: {d: (t[f] or "").lower().split() for d, *t in rows} for f in fields}
    out = {}
    stats = {}
    for f in fields:
        sizes = [len(w) for w in texts[f].values() if w]
        df = {}
        for w in texts[f].values():
            for t in set(w):
                df[t] = df.get(t, 0) + 1
        stats[f] = (len(sizes), sum(sizes) / len(sizes), df)
    for q, text in queries:
        hits = []
        for d, *_ in rows:
            per = []
            for f in fields:
                n, mean, df = stats[f]
                w = texts[f][d]
                s = [np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set((text or "").lower().split()) if t in w]
                if s:
                    per.append(sum(s))
            if per:
                hits.append((-round(max(per) + tie * (sum(per) - max(per)), 6), d))
        out[q] = [(d, -s) for s, d in sorted(hits)[skip : skip + k]]
    return out


@pytest.mark.parametrize(("parts", "k", "skip", "tie", "fields"), [(1, 3, 0, 0.5, [0]), (5, 4, 3, 0.5, [0, 1]), (3, 2, 0, 0.0, [0])])
def test_bm25_from_the_index(spark, tmp_path, parts, k, skip, tie, fields):
    rows, queries = corpus(spark)
    docs = spark.createDataFrame(rows, "doc long, body string, title string").repartition(parts)
    asked = spark.createDataFrame(queries, "q long, text string")
    columns = {("body", "title")[f]: F.col(("body", "title")[f]) for f in fields}
    index = lexical.build_index(docs, f"{tmp_path}/i", columns, "doc")
    index = lexical.open_index(spark, f"{tmp_path}/i")
    want = {q: hits for q, hits in scored(rows, queries, fields, k, skip, tie).items() if hits}
    for got in (lexical.search(index, asked, k, skip, tie, "q", "text", "doc"), retrieval.bm25(asked, docs, columns, k, skip, tie, "q", "text", "doc")):
        found = {}
        for r in got.orderBy("q", "rank").collect():
            found.setdefault(r.q, []).append((r.doc, pytest.approx(r.score, abs=2e-6)))
        assert {q: [d for d, _ in hits] for q, hits in found.items()} == {q: [d for d, _ in hits] for q, hits in want.items()}
        assert all(a[1] == b[1] for q in want for a, b in zip(found[q], want[q], strict=True))


def test_bm25_skips_postings(spark, tmp_path):
    rows, queries = corpus(spark)
    index = lexical.build_index(spark.createDataFrame(rows, "doc long, body string, title string"), f"{tmp_path}/i", {"body": F.col("body")}, "doc")
    asked = spark.createDataFrame([(i, f"c1 c2 c3 r{i} r{i + 9}") for i in range(20)], "qid long, text string").select("qid", F.explode(lexical.terms(F.col("text"))).alias("term"))
    known = materialize(asked.join(index.words.select(*lexical.KEY, "idf"), "term"), "test")
    hits, rest = lexical.chosen_ranges(index, known, 3, 0.5)
    every = lexical.bounds(index, known, 0.5)
    sizes = index.blocks.select(*lexical.KEY, "range", F.size("posts").alias("n")).join(known, lexical.KEY)
    touched = sizes.join(rest, ["qid", "range"], "left_semi").agg(F.sum("n")).first()[0] or 0
    whole = sizes.join(every, ["qid", "range"], "left_semi").agg(F.sum("n")).first()[0]
    first = hits.count()
    assert touched + first < 0.7 * whole, (touched, first, whole)


def test_bm25_odd(spark):
    none = spark.createDataFrame([], "doc long, body string")
    asked = spark.createDataFrame([(1, "a")], "q long, text string")
    assert retrieval.bm25(asked, none, {"body": F.col("body")}, 3, 0, 0.5, "q", "text", "doc").count() == 0
    assert retrieval.bm25(asked.filter("false"), none, {"body": F.col("body")}, 3, 0, 0.5, "q", "text", "doc").count() == 0
    with pytest.raises(ValueError):
        retrieval.bm25(asked, none, {"body": F.col("body")}, 0)
    assert retrieval.retriever("dense") is retrieval.dense and retrieval.retriever("bm25") is retrieval.bm25


def test_bm25_scores_where_the_text_is(spark, tmp_path, monkeypatch):
    """No posting is shuffled or grouped by document, a range's documents stand together, and queries too many for one scan take several."""
    rows, queries = corpus(spark)
    docs = spark.createDataFrame(rows, "doc long, body string, title string")
    asked = spark.createDataFrame(queries, "q long, text string")
    run = lambda: retrieval.bm25(asked, docs, {"body": F.col("body"), "title": F.col("title")}, 3, 1, 0.5, "q", "text", "doc")
    one = run()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and plan.count("Exchange") == 1, plan
    monkeypatch.setattr(lexical, "BROADCAST", 40)
    monkeypatch.setattr(lexical, "CELLS", 100)
    several = run()
    assert several._jdf.queryExecution().executedPlan().toString().count("MapInArrow") > 2
    assert sorted(map(tuple, several.collect())) == sorted(map(tuple, one.collect()))
    monkeypatch.undo()
    hits = retrieval.with_metadata(one, docs, "doc", "title", "body")
    assert "BroadcastHashJoin" in hits._jdf.queryExecution().executedPlan().toString()
    blocks = lexical.build_index(docs, f"{tmp_path}/i", {"body": F.col("body"), "title": F.col("title")}, "doc").blocks
    ranges = blocks.select("range", F.explode("posts").alias("doc")).groupBy("range").agg(F.count_distinct("doc").alias("n")).collect()
    assert max(r.n for r in ranges) <= lexical.RANGE
    assert blocks.count() == blocks.select(*lexical.KEY, "range").distinct().count()


def clusters():
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 6)) * 4
    v = np.round(centres[r.integers(0, 12, 1500)] + r.normal(size=(1500, 6)) * 0.2, 3)
    v[700:1200] = v[700]  # a third of all lies in one place
    return v


@pytest.mark.parametrize(("parts", "block"), [(1, 4096), (4, 64)])
def test_dense_equals_brute_force(spark, monkeypatch, parts, block):
    v = clusters()
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(9001, None), (9002, [1.0] * 5), (9003, [float("nan")] * 6), (9004, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9005, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    v = {i: np.array(x) for i, x in rows if i < 9000 or i == 9005}
    ids = np.array(sorted(v))
    m = np.stack([v[i] for i in ids])
    got = {}
    for r in retrieval.dense(df.filter("vec_id % 7 = 0 OR vec_id > 9000"), df, 4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.vec_id, round(r.score, 6)))
    want = {}
    for q in [i for i in ids if i % 7 == 0 or i > 9000]:
        s = np.round(m @ v[q], 6) + 0.0
        want[q] = [(int(j), float(x)) for x, j in sorted((-x, j) for x, j in zip(s, ids, strict=True) if j != q)[:4] for x in [-x + 0.0]]
    assert got == want


def test_dense_prunes_cells(spark, tmp_path):
    v = clusters()
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    vectors.build_cells(df, f"{tmp_path}/v", cells=24)
    index = vectors.open_cells(spark, f"{tmp_path}/v")
    asked = df.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    _, first, rest = vectors.chosen_cells(index, asked, 3)
    opened = first.unionByName(rest).join(index.cells.select("cell", "n"), "cell").agg(F.sum("n")).first()[0]
    assert first.join(rest, ["qid", "cell"]).count() == 0
    assert opened < 0.6 * 150 * len(v)
    assert index.vectors.count() == len(v) and index.cells.agg(F.sum("n")).first()[0] == len(v)
    empty = retrieval.dense(df.filter("false"), df.filter("false"), 3)
    assert empty.count() == 0


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_needles(spark, most):
    texts = [(i, t) for i, t in enumerate(["abcab", "", None, "xyz", "日本語 text", "aaaa", "nothing", "ab"])]
    needles = [(1, "ab"), (2, "abc"), (2, "yz"), (3, ""), (4, None), (5, "本語"), (6, "aa"), (7, "ab"), (8, "b" * 30), (9, "c" * 30)]
    got = multimatch.find_needles(spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame(needles, "k long, w string"), "id", "text", "k", "w", most)
    assert sorted((r.id, r.needle_id) for r in got.collect()) == sorted({(i, k) for i, t in texts for k, w in needles if t and w and w in t})
