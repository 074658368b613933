"""Operators 2 and 8 against brute force over all pairs of small tables."""

import itertools

import numpy as np


def roots_of(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def least_ids(ids, links):
    r = roots_of(len(ids), links)
    low = {}
    for i, x in enumerate(ids):
        low[r[i]] = min(low.get(r[i], x), x)
    return [low[x] for x in r]


def test_e8_decoder_is_nearest():
    from tessella.llm.vector_dedup import decode_e8, roots

    assert len(roots()) == 240
    x = np.random.default_rng(0).normal(0, 2, (500, 8))
    p = decode_e8(x)
    d = ((x - p) ** 2).sum(1)
    assert d.max() <= 1 + 1e-9  # the covering radius
    near = ((x[:, None] - p[:, None] - roots()[None]) ** 2).sum(2).min(1)
    assert (d <= near + 1e-9).all()


def test_register_estimate():
    from tessella.llm.near_dedup import estimate, registers

    r = np.random.default_rng(1)
    for n in (1, 3, 20, 300, 20000):
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 3 // 4], r.integers(0, 2**64, len(a) - len(a) * 3 // 4, dtype=np.uint64)]))
        x, y = registers([a]), registers([b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (x > 0).all() and abs(estimate(x, y)[0] - true) < 0.2
        assert estimate(x, x)[0] > 0.99


def test_near_dedup(spark):
    from tessella.llm.near_dedup import near_dedup

    r = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(4000)]
    texts = [None, "", " \n", "one two", "One  TWO", "a b c d", "a b c d e", "é " * 10]
    passage = " ".join(r.choice(vocab, 60))
    for _ in range(25):
        base = list(r.choice(vocab, int(r.integers(5, 400))))
        for _ in range(int(r.integers(1, 6))):
            t = list(base)
            for _ in range(int(r.integers(0, max(1, len(t) // 60) + 1))):
                t[int(r.integers(len(t)))] = str(r.choice(vocab))
            texts.append(" ".join(t) + (" " + passage if r.random() < 0.3 else ""))
    texts += [" ".join(r.choice(vocab, 25)) + " " + passage for _ in range(60)]
    texts.append(" ".join(r.choice(vocab, 30000)))
    ids = [int(x) for x in r.permutation(len(texts)) * 3]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert len(links) > 30
    want = {d: (len(s), c, d == c) for d, s, c in zip(ids, sets, least_ids(ids, links), strict=True)}
    df = spark.createDataFrame([(d, t, "n") for d, t in zip(ids, texts, strict=True)], "doc_id long, text string, node string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(df).collect()}
    assert got == want
    again = df.union(df.limit(5))
    assert near_dedup(again).count() == len(texts) + 5
    assert near_dedup(df.limit(0)).count() == 0


def test_near_dedup_hot_bucket(spark):
    """A passage makes all texts 0.747 alike, linked with none; two true pairs, at 0.757, are among them."""
    from tessella.llm.near_dedup import near_dedup

    r = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(140)]
    tails = [[f"t{i}-{k}" for k in range(23)] for i in range(3000)]
    hidden = [(40, 1500), (700, 2900)]
    for i, j in hidden:
        tails[j][0] = tails[i][0]
    texts = [" ".join(passage + t) for t in tails]
    ids = [int(x) for x in r.permutation(len(texts))]
    seen, sizes, cells = {}, np.zeros(len(texts), int), []
    for i, t in enumerate(texts):
        w = t.split()
        mine = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        sizes[i] = len(mine)
        cells += [(i, seen.setdefault(x, len(seen))) for x in mine]
    rows, cols = np.array(cells).T
    often = np.flatnonzero(np.bincount(cols) > 1)
    has = np.zeros((len(texts), len(often)), np.float32)
    keep = np.isin(cols, often)
    has[rows[keep], np.searchsorted(often, cols[keep])] = 1
    common = (has @ has.T).astype(int)
    links = [(i, j) for i, j in np.argwhere(100 * common >= 75 * (sizes[:, None] + sizes[None] - common)).tolist() if i < j]
    assert links == hidden
    want = dict(zip(ids, least_ids(ids, links), strict=True))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in near_dedup(df).collect()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_overlaps():
    from tessella.llm.near_dedup import estimate, estimate_all, overlaps, registers

    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, int(n))) for n in r.integers(1, 200, 40)]
    ends = np.cumsum([0] + [len(s) for s in sets])
    one, two = np.arange(0, 25), np.arange(20, 40)
    got = overlaps(np.concatenate(sets), ends, one, two, wide=64)
    assert (got == [[len(np.intersect1d(sets[i], sets[j])) for j in two] for i in one]).all()
    regs = registers([s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets])
    for a, b in ((regs[:9], regs[5:]), (np.repeat(regs, 3, 0), regs)):
        assert np.allclose(estimate_all(a, b), [estimate(np.repeat(x[None], len(b), 0), b) for x in a])


def test_vector_dedup(spark):
    from tessella.llm.vector_dedup import vector_dedup

    r = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        c = r.normal(size=64)
        c /= np.linalg.norm(c)
        for _ in range(int(r.integers(1, 12))):
            rows.append(((c + r.normal(0, 0.017, 64)) * r.uniform(0.1, 9)).astype(np.float32).tolist())
    hub = r.normal(size=64)
    rows += [(hub / np.linalg.norm(hub) + r.normal(0, 0.01, 64)).astype(np.float32).tolist() for _ in range(150)]
    rows += [rows[0]] * 5 + [None, [0.0] * 64, [float("nan")] * 64, [1.0, None] * 32, [], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [float("inf")] + [1.0] * 63]
    labels = [None if i % 50 == 49 else i % 2 for i in range(len(rows))]
    ids = [int(x) for x in r.permutation(len(rows))]
    n, links = len(rows), []
    x = [np.array(v, float) if v and None not in v else None for v in rows]
    ok = [v is not None and np.isfinite(v).all() and v.any() and lab is not None for v, lab in zip(x, labels, strict=True)]
    near_edge = 0
    for i, j in itertools.combinations(range(n), 2):
        if ok[i] and ok[j] and labels[i] == labels[j] and len(x[i]) == len(x[j]):
            c = x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j]))
            near_edge += abs(c - 0.98) < 1e-12
            if c >= 0.98:
                links.append((i, j))
    assert not near_edge and len(links) > 1000
    degree = np.bincount(np.array(links).ravel(), minlength=n)
    want = {d: (int(k), c, d == c) for d, k, c in zip(ids, degree, least_ids(ids, links), strict=True)}
    df = spark.createDataFrame([(d, v, lab, 0) for d, v, lab in zip(ids, rows, labels, strict=True)], "vec_id long, embedding array<float>, label int, node int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup(df).collect()}
    assert len(got) == n
    assert sum(g[0] for g in got.values()) >= 0.999 * sum(w[0] for w in want.values())
    assert all(got[k][0] <= want[k][0] for k in got)
    assert sum(got[k][1:] == want[k][1:] for k in got) >= 0.995 * n
    assert vector_dedup(df.limit(0)).count() == 0


def test_vector_scheme_reaches_its_recall():
    """Pairs at the threshold meet with any number of blocks, and unlike vectors seldom."""
    from tessella.llm.vector_dedup import cells, scheme

    r, none = np.random.default_rng(4), np.zeros(600, np.uint64)
    for largest, dim, most in ((500, 64, 2), (5_000, 64, 3), (10**7, 64, 5), (10**7, 12, 2)):
        tables, blocks = scheme(largest, dim)
        assert blocks <= most
        a, b = r.normal(size=(2, 600, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        (oa, pa), (ob, pb) = cells(a, none, tables, blocks), cells(b, none, tables, blocks)
        met = ((oa[:, :, None] == pb).any((1, 2)) | (ob[:, :, None] == pa).any((1, 2))).mean()
        assert met >= 0.995


def test_vectors_in_a_large_label(spark):
    """Planted pairs among thousands of unlike vectors of one label, against brute force."""
    from tessella.llm.vector_dedup import vector_dedup

    r = np.random.default_rng(9)
    v = r.normal(size=(4000, 32))
    v[3000:] = v[:1000] + r.normal(size=(1000, 32)) * 0.18 * r.random((1000, 1))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & ~np.eye(len(u), dtype=bool)
    df = spark.createDataFrame([(i, 1, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, label int, embedding array<double>")
    got = np.zeros(len(v), int)
    for row in vector_dedup(df).collect():
        got[row.vec_id] = row.n_links
    assert near.sum() > 500 and (got <= near.sum(1)).all() and got.sum() >= 0.999 * near.sum()


def test_names_that_collide_are_told_apart(spark):
    from tessella.llm._tables import names_apart

    df = spark.createDataFrame([(1, 7, 5), (2, 7, 5), (3, 7, 6), (4, 8, 5), (5, None, None)], "id int, node long, check long")
    got = {r.id: r.node for r in names_apart(df).collect()}
    assert got[1] == got[2] == 7 and got[3] not in (7, 8) and got[4] == 8 and got[5] is None
