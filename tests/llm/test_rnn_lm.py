"""Operator 1: counts against brute force, lanes against single steps, better than the base on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np


def test_scores(spark):
    from tessella.llm.rnn_lm import lm_score

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(200)
    odd = spark.createDataFrame([(100001, None), (100002, ""), (100003, " \n"), (None, "the of"), (100004, "new-word " * 3), (100004, "new-word " * 3)], "doc_id long, text string")
    df = docs.union(odd).repartition(3)
    rows = df.collect()
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for r in rows if not out(r.doc_id) for w in tok(r.text))
    total = sum(c.values())
    want = sorted((str(r.doc_id), out(r.doc_id), len(tok(r.text)), sum(c[w] > 0 for w in tok(r.text)), total, round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in tok(r.text)), 5)) for r in rows)
    res = lm_score(df, warm_docs=120).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in res)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-4 for g, w in zip(got, want, strict=True))
    assert all(math.isfinite(r.score) and r.score < 0 for r in res)
    held = [r for r in res if r.held_out]
    print(sum(r.score for r in held), sum(r.base_score for r in held))
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score(df.limit(0)).count() == 0


def test_every_training_token_is_read(spark, monkeypatch):
    from tessella.llm import rnn_lm

    read, rounds = [], rnn_lm.train_rounds
    monkeypatch.setattr(rnn_lm, "train_rounds", lambda *a: read.append(rounds(*a)))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3)
    res = rnn_lm.lm_score(docs).collect()  # with the parameters of the query
    assert read == [res[0].train_tokens] and read[0] > 10_000
    held = [r for r in res if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model():
    from tessella.llm.rnn_lm import CLASSES, LEXICON, TAILS, Model

    r = np.random.default_rng(0)
    m = Model(np.ones(CLASSES + TAILS), np.ones(LEXICON))
    docs = [r.integers(0, 40, int(r.integers(1, 300))) for _ in range(40)]
    for k in ("wc", "wo"):
        setattr(m, k, r.normal(0, 0.1, getattr(m, k).shape).astype(np.float32))
    h = r.normal(size=(1, m.u.shape[0])).astype(np.float32)
    every = np.arange(LEXICON + TAILS)
    assert abs(np.exp(m.log_prob(np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-4
    one = []
    for d in docs:  # lanes and windows give what a token at a time does
        h, s = np.zeros((1, m.u.shape[0]), np.float32), 0.0
        for t in d:
            s += m.log_prob(h, np.array([t]))[0]
            h = m.step(np.array([t]), h)[0]
        one.append(s)
    assert np.allclose(m.score(docs), one, rtol=1e-3, atol=1e-2)
    before = m.score(docs).sum()
    for k in range(3):
        m.train(docs, seed=k)
    assert m.score(docs).sum() > before
    copy = Model(np.ones(CLASSES + TAILS), np.ones(LEXICON)).load(m.dump())
    assert np.allclose(copy.score(docs), m.score(docs))


def test_gradients_equal_finite_differences():
    from tessella.llm.rnn_lm import CLASSES, LEXICON, TAILS, Model

    r = np.random.default_rng(0)
    m = Model(np.ones(CLASSES + TAILS), np.ones(LEXICON))
    for k in m.NAMES:
        setattr(m, k, getattr(m, k).astype(np.float64) + r.normal(0, 0.1, getattr(m, k).shape))
    x, new, start = r.integers(0, 40, (5, 3)), r.random((5, 3)) < 0.3, r.normal(0, 0.5, (3, m.u.shape[0]))
    x[2] = LEXICON + 3

    def loss():
        total, h = 0.0, start
        for t in range(5):
            h = np.where(new[t][:, None], 0, h)
            total -= m.log_prob(h, x[t]).sum()
            h = m.step(x[t], h)[0]
        return total / x.size

    grads, _ = m.gradients(x, new, start)
    for k in m.NAMES:
        a = getattr(m, k)
        for i in range(10):
            at = np.unravel_index(np.argmax(np.abs(grads[k])) if not i else r.integers(a.size), a.shape)
            old, sides = a[at], []
            for e in (1e-5, -1e-5):
                a[at] = old + e
                sides.append(loss())
            a[at] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - grads[k][at]) < 1e-7


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Clashing columns, repeated rows and a very long text in a table cut and shuffled in two ways."""
    from tessella.llm import rnn_lm

    monkeypatch.setattr(rnn_lm, "SHARE", 1 << 12)  # several replicas
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(100001, "wort " * 200_000), (100002, "a b"), (100002, "a b")], "doc_id long, text string")
    df = docs.union(odd).selectExpr("*", "1 AS slot", "2 AS replica", "'x' AS uid", "3 AS h", "4 AS n", "true AS held_out")
    got, old = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, shuffle in ((2, "3"), (7, "8")):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            got.append(sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3), round(r.score, 3)) for r in rnn_lm.lm_score(df.repartition(parts)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] and (100001, 200_001) in {x[:2] for x in got[0]}
