"""Operators 11 to 13 against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

WHITE = " \t\n\v\f\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# ---- operator 11


def distance(a, b):
    """Unrestricted Damerau-Levenshtein distance over the whole table."""
    far = len(a) + len(b)
    d = {(i, j): far for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1)}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    seen = {}
    for i, x in enumerate(a, 1):
        last = 0
        for j, y in enumerate(b, 1):
            k, at = seen.get(y, 0), last
            if x == y:
                last = j
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i - 1, j] + 1, d[i, j - 1] + 1, d[k - 1, at - 1] + i - k + j - at - 1 if k and at else far)
        seen[x] = i
    return d[len(a), len(b)]


@pytest.mark.parametrize(("letters", "longest"), [("ab", 6), ("abc", 9), ("añ日d", 12)])
def test_trie_and_shards(letters, longest):
    from tessella.llm.name_join import Trie, held_segments, segments

    rnd = random.Random(longest)
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, longest)))
    names = sorted({word() for _ in range(80)})
    trie = Trie(names)
    for k in range(4):
        for q in [word() for _ in range(25)]:
            want = {i: d for i, n in enumerate(names) if (d := distance(n, q)) <= k}
            assert dict(trie.within(q, k)) == want
            for i in want:
                cut = segments(len(names[i]), k)
                assert any(q[at : at + size] == names[i][cut[s][0] : cut[s][0] + size] for s, at, size in held_segments(len(q), len(names[i]), k))


@pytest.mark.parametrize(("k", "limit"), [(1, 4096), (1, 2), (2, 3), (0, 1)])
def test_join_names(spark, k, limit):
    from tessella.llm.name_join import join_names

    rnd = random.Random(7)
    stems = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    left = [(i, rnd.choice(stems) + " Co") for i in range(150)] + [(i, "hot name") for i in range(200, 300)] + [(400, None), (401, " \t"), (402, "X"), (None, "hot name"), (7, "a" * 3000)]
    right = [(i, "".join(rnd.sample(s, len(s))) + "co") for i, s in enumerate(stems)] + [(60, "hot NAME"), (60, "hot NAME"), (61, "hto name"), (62, "Hot\tnames"), (63, None), (64, ""), (65, "y"), (None, "hotname"), (66, "a" * 2999 + "b")]
    got = join_names(
        spark.createDataFrame(left, "client_id long, name string").selectExpr("*", "1 AS form", "2 AS salt", "3 AS key").repartition(3),
        spark.createDataFrame(right, "vendor_id long, name string").selectExpr("*", "1 AS id", "2 AS n").repartition(2),
        max_distance=k,
        limit=limit,
    ).collect()
    form = lambda s: lower("".join(c for c in s if c not in WHITE)) if s else ""
    want = defaultdict(list)
    for v, name in set(right):
        for c, other in left:
            a, b = form(name), form(other)
            if a and b and abs(len(a) - len(b)) <= k and (a == b or (max(len(a), len(b)) < 50 or a[:2990] == b[:2990])):
                d = distance(a[-12:], b[-12:]) if max(len(a), len(b)) >= 50 else distance(a, b)
                if d <= k:
                    want[v, a, d].append(c)
    rows = {(r.right_id, r.form, r.distance): (r.n_left, r.first_left_id, r.left_crc) for r in got}
    assert len(rows) == len(got)
    assert rows == {key: (len(ids), min((i for i in ids if i is not None), default=None), sum(zlib.crc32(str(i).encode()) for i in ids if i is not None)) for key, ids in want.items()}


def test_join_names_hot_rest(spark):
    """Names that differ only behind a long common start are cut again until their shards are small."""
    from tessella.llm.name_join import join_names

    left = [(i, f"customer number {i:06d}") for i in range(3000)]
    right = [(i, f"customer number {i:06d}") for i in range(0, 3000, 100)]
    got = join_names(spark.createDataFrame(left, "client_id long, name string"), spark.createDataFrame(right, "vendor_id long, name string"), limit=40).collect()
    assert {(r.right_id, r.distance, r.n_left) for r in got} >= {(i, 0, 1) for i in range(0, 3000, 100)}
    want = {(v, 1): sum(distance(f"{v:06d}", f"{c:06d}") == 1 for c, _ in left) for v, _ in right[:4]}
    assert {(r.right_id, 1): r.n_left for r in got if r.distance == 1 and r.right_id <= 300} == want


def test_join_names_empty(spark):
    from tessella.llm.name_join import join_names

    none = spark.createDataFrame([], "client_id long, name string")
    some = spark.createDataFrame([(1, "ab")], "vendor_id long, name string")
    assert join_names(none, some).count() == 0
    assert join_names(some.withColumnRenamed("vendor_id", "client_id"), none.withColumnRenamed("client_id", "vendor_id")).count() == 0


# ---- operator 12

TEXTS = ["", None, "a b c", "a b c", "Grüße aus Köln", "x" * 3000, "日本語 テキスト\n\nnext", "  two  spaces ", "<|endoftext|> and <s> plain", "mark ▁ inside", "tab\tand other", "naïve café 🙂🙂", "word " * 500, "\x00 nul", "ａｂ ﬁ ½"]


def slow_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(v): v for v in keep} | {chr(256 + i): v for i, v in enumerate(sorted(set(range(256)) - set(keep)))}
    docs = []
    for doc, text in rows:
        whole = " " + (text or "")
        xs = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(whole, add_special_tokens=False).ids] if text else []
        ys = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]] if text else []
        if b"".join(s for _, s in xs) != whole.encode() or b"".join(s for _, s in ys) != whole.encode():
            xs = ys = []
        groups, i, j, at, to = [], 0, 0, 0, 0
        ga, gb = [], []
        while i < len(xs) or j < len(ys):
            if at <= to and i < len(xs):
                at += len(xs[i][1])
                ga.append(xs[i][0])
                i += 1
            else:
                to += len(ys[j][1])
                gb.append(ys[j][0])
                j += 1
            if at == to:
                groups.append((ga, gb))
                ga, gb = [], []
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        text_of = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        docs.append((doc, len(xs), len(ys), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if groups else ""))
    count = Counter(pair for d in docs for pair in d[4])
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return sorted((d, na, nb, ng, sum(ls.values()), sum(n for p, n in ls.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in ls.items()), sha) for d, na, nb, ng, ls, sha in docs)


def test_align_tokens(spark):
    import public_tokenizers as P

    from tessella.llm.token_alignment import align_tokens

    table = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a b c")]
    table += [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    want = slow_alignment(table)
    assert any(w[1] == 0 and w[0] == 9 for w in want)
    docs = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS pair", "3 AS a")
    for parts in (1, 5):
        got = align_tokens(docs.repartition(parts), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
        rows = got.collect()
        assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows) == want
        assert all(len(r.groups) == r.n_groups for r in rows)


def test_align_tokens_empty(spark):
    import public_tokenizers as P

    from tessella.llm.token_alignment import align_tokens

    none = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokens(none, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0


def test_align_tokens_in_parts(spark, monkeypatch):
    """A text's groups are those the digest is of, pairs of one text come in several rows, and no step interprets a function an element of an array."""
    import public_tokenizers as P

    from tessella.llm import token_alignment as A

    plans, write = [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or write(df, name))
    mixed = "".join(chr(0x4E00 + (i * i) % 211) + "qzxj"[i % 4] for i in range(400))
    table = [(i, t) for i, t in enumerate([*TEXTS, mixed, mixed + " " + mixed, "q" * 700])]
    want = slow_alignment(table)
    got = A.align_tokens(spark.createDataFrame(table, "doc_id long, text string").coalesce(1), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    rows = got.collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows) == want
    for r in rows:
        text = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups)
        assert (hashlib.sha256(text.encode()).hexdigest() if text else "") == r.groups_sha256
    assert not [p for p in plans if "lambdafunction" in p]


def test_groups_pairs_in_parts(monkeypatch):
    import numpy as np

    from tessella.llm import token_alignment as A

    rng = np.random.default_rng(5)
    sides = []
    for _ in "ab":  # two texts of 4000 bytes each, whose tokens end at bytes of their own or at multiples of 200
        ends = np.unique(np.r_[np.arange(200, 8001, 200), rng.choice(8000, 900, replace=False) + 1])
        sides.append((rng.integers(0, 40, len(ends)).astype(np.int32), ends, np.array([(ends <= 4000).sum(), (ends > 4000).sum()])))
    g = A.Groups(*sides)
    want = Counter()
    for k in range(len(g.links)):
        xs, ys = (g.ids[j][g.group[j] == k].tolist() for j in (0, 1))
        want += Counter((int(g.text[k]), x, y) for x in xs for y in ys)
    assert (g.links > A.LARGE).any()
    for block, parts in ((1 << 22, 1), (500, None)):
        monkeypatch.setattr(A, "BLOCK", block)
        found = list(g.pairs())
        assert len(found) == 1 if parts else len(found) > 3
        got = [((t, x, y), w) for counts, a, b, ws in found for t, x, y, w in zip(np.repeat([0, 1], counts).tolist(), a.tolist(), b.tolist(), ws.tolist(), strict=True)]
        assert len(got) == len(want) and dict(got) == want


# ---- operator 13


def slow_lines(rows):
    texts = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: lower(line.strip(WHITE))
    small = lambda d: -(1 << 63) if d is None else d
    owner = {}
    for d, lines in texts:
        for line in lines:
            k = key(line)
            owner[k] = min(owner.get(k, small(d)), small(d))
    out = []
    for d, lines in texts:
        kept = [line for line in lines if len(key(line)) < 10 or owner[key(line)] == small(d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_table():
    rnd = random.Random(3)
    pool = ["All rights reserved.", " all RIGHTS reserved.\t", "short", "ÄÖÜäöüßéèêë", "äöüäöüßéèêë", "a b c d e f", "123456789", "1234567890", "", "line\rwith cr inside"] + [f"unique line {i} of many" for i in range(40)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))) for i in range(120)]
    rows += [(i, "The hot license line of a third\n" * 3 + f"own text {i}") for i in range(200, 290)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "y" * 200000 + "\n" + "All rights reserved."), (5, rows[5][1]), (6, "other text for an id\nAll rights reserved."), (None, "All rights reserved.\nnull id")]
    return rows


@pytest.mark.parametrize("parts", [1, 6])
def test_dedup_lines(spark, parts):
    from tessella.llm.line_dedup import dedup_lines

    rows = line_table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS version", "'x' AS dropped", "3 AS kind").repartition(parts)
    got = dedup_lines(docs).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got], key=str) == slow_lines(rows)
    assert all((r.dropped is None) == (r.n_dropped == 0) for r in got)


def test_lines_across_partitions(spark):
    """One key over many range partitions, with the borders inside of it."""
    from tessella.llm.line_dedup import dedup_lines

    rows = [(i, "the very same long line") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id for r in got if not r.n_dropped} == {0} and len(got) == 400


def test_drop_repeated_lines(spark):
    from tessella.llm.line_dedup import drop_repeated_lines

    rows = line_table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS row", "text", "1 AS doc", "2 AS m_doc")
    out = drop_repeated_lines(docs, id_col="row")
    assert out.columns == docs.columns
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(((r.row, sha(r.text)) for r in out.collect()), key=str) == sorted(((d, s) for d, _, _, s in slow_lines(rows)), key=str)
    assert out.filter("text is null").count() == 1


def test_lines_empty(spark):
    from tessella.llm.line_dedup import dedup_lines, drop_repeated_lines

    none = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(none).count() == 0 and drop_repeated_lines(none).count() == 0


@pytest.mark.parametrize("name", ["op11_name_join", "op13_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from tessella.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for table in ("clients", "vendors", "documents"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.01/{table}.parquet'")
    got, want = QUERIES[name](spark, "/root/testdata/sf0.01"), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall())
