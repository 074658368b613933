"""The pipeline's stages against brute force on the smallest tables."""

from collections import Counter, defaultdict

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns
        seen.append(docs.collect())
    start = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {r.doc_id for r in seen[0]} >= {r.doc_id for r in start if any(c.isalpha() for c in r.text or "") and len(r.text) > 200}
    last = {}
    for r in seen[0]:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in seen[1]) == sorted(last.values())
    sets = {r.doc_id: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(r.text.encode().lower().split()) for r in seen[1]}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in seen[2]) == sorted(i for i in sets if find(i) == i)
    copies = Counter(r.doc_id for r in seen[3])
    assert set(copies) <= {r.doc_id for r in seen[2]} and max(copies.values()) == 2
    words = sum(len(r.text.split()) for r in seen[3])
    assert abs(words - 1.5 * sum(len(r.text.split()) for r in seen[2])) < 0.2 * words
    assert Counter(r.doc_id for r in seen[4] if r.piece == 0) == copies
    fill = defaultdict(int)
    for r in seen[4]:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= sum(fill.values()) // 2048 + 2
    assert cp.run(spark, SF).count() == len(seen[4])


ODD = "doc_id long, text string, lang string, source string, n_chars long, at double, id string, hash string, doc string, row string, name string, drop_id long, mix_id long, text_sha256 string, __at string"


def _odd_rows():
    long = " ".join(f"wort{i % 977}x{i}" for i in range(30000))
    texts = ["", None, "12 34 !", "one two three four five six", "one two three four five six", "one two three four five six seven", long, long + " ende", "\n \t", "ünï cödé 日本語 ω"]
    rows = [(i, t, None if i % 3 else "en", [None, "a", "b"][i % 3], None, 0.5, "i", "h", "d", str(i % 2), "n", 7, 8, "s", "a") for i, t in enumerate(texts * 2)]
    rows += [rows[3], rows[3]]  # repeated rows
    rows += [(1, "", "en", "a", 1, 0.1, "z", None, None, "other", None, None, None, None, None)]  # the id of a null text with an empty one
    rows += [(None, "null id text goes here today", "en", "a", 1, 0.1, "z", None, None, None, None, None, None, None, None)]
    return rows


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeats, empty tables and clashing names in every stage."""
    rows = _odd_rows()
    table = spark.createDataFrame(rows, ODD).repartition(3)
    for name, stage in cp.STAGES:
        out = stage(spark, table, SF)
        got = out.collect()
        assert stage(spark, table.limit(0), SF).count() == 0
        if name != "pack":
            assert out.columns == table.columns
        if name == "language":
            assert {r.text for r in got} <= {t for _, t, *_ in rows if t and any(c.isalpha() for c in t)}
        if name == "exact":
            assert sorted(r.text or "" for r in got) == sorted({r[1] or "" for r in rows})
            assert all(r.doc_id == max((x[0] for x in rows if (x[1] or "") == (r.text or "")), key=lambda i: -1 if i is None else i) for r in got)
        if name == "near":
            assert sum((r.text or "").startswith("wort") for r in got) == 1 and any(r.doc_id is None for r in got)
            # texts without words are linked with nothing; of the equal texts the rows of the least id stay, three of id 3 and one of id 5
            assert {r.doc_id for r in got} >= {0, 1, 8, 10, 11, 18} and sum((r.text or "").startswith("one two") for r in got) == 4
        if name == "mix":
            kept = {(r[0], r[1]) for r in rows}
            assert {(r.doc_id, r.text) for r in got} <= kept and all((r.text or "").split() for r in got)
        if name == "pack":
            assert sum(r.piece == 0 for r in got) == len(rows)


def test_repeats_of_null_and_empty_leave_one(spark):
    from tessella.llm.exact_dedup import without_copies

    df = spark.createDataFrame([(1, None, "b"), (1, "", "a"), (1, "", "c"), (2, "x", "q"), (2, "x", "p")], "doc_id long, text string, row string")
    got = sorted((r.doc_id, r.text, r.row) for r in without_copies(df).collect())
    assert got == [(1, None, "b"), (2, "x", "p")]


def test_a_broken_run_resumes(spark, monkeypatch, tmp_path):
    calls = []

    def stage(name, fails=False):
        def run(s, docs, sf_dir):
            calls.append(name)
            if fails and calls.count(name) == 1:
                raise RuntimeError
            return docs.limit(5)

        return run

    monkeypatch.setattr(cp, "STAGES", [("one", stage("one")), ("two", stage("two", True))])
    key = f"test-{tmp_path.name}-{id(calls)}"
    try:
        cp.run(spark, SF, key)
    except RuntimeError:
        pass
    assert cp.run(spark, SF, key).count() == 5 and calls == ["one", "two", "two"]
