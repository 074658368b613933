"""Operators 4 to 7, 9 and 10 against brute force on small tables."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, part long, comp string"
LONG = "word " * 5000
TEXTS = ["", None, "a b c", "a b c", "A b c", "  spaced   out \n\n text ", LONG, LONG, "ünï cödé 日本語", "x" * 9000, "<|endoftext|> here", "tail ", "1 2 3", "\n \t"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, [None, "b", "a", "é"][i % 4], 0, "x", 1, "y") for i, t in enumerate(TEXTS * 3)]
    rows.append(rows[2])  # a repeated row
    rows.append((None, "null id", "en", "a", 0, "x", 1, "y"))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_golomb_round_trip():
    from tessella.llm.exact_dedup import golomb_decode, golomb_encode

    gaps = np.random.default_rng(1).integers(0, 5000, 300).astype(np.uint64)
    for k in (0, 3, 9):
        assert (golomb_decode(golomb_encode(gaps, k), k, len(gaps)) == gaps).all()


def test_exact_dedup(spark, docs):
    from tessella.llm.exact_dedup import exact_dedup

    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    want = sorted((str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    got = exact_dedup(docs, owners=3).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(empty(spark)).count() == 0


def test_mix_sources(spark, docs):
    from tessella.llm.mixing import mix_sources

    rows = docs.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = defaultdict(int)
    for r in rows:
        sources[r.source] += size(r.text)
    names = sorted((s for s in sources if s is not None), key=lambda s: s.encode("utf-32-be")) + [None]
    weight = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(names)}
    target, left, opened = {s: Fraction(0) for s in names}, Fraction(3, 2) * sum(sources.values()), set(names)
    while left and opened:
        share = left / sum(weight[s] for s in opened)
        left = Fraction(0)
        for s in list(opened):
            target[s] += share * weight[s]
            if target[s] >= 2 * sources[s]:
                left += target[s] - 2 * sources[s]
                target[s] = Fraction(2 * sources[s])
                opened.discard(s)
    got = mix_sources(docs).collect()
    by = {}
    for s in names:
        by[sources[s], float(target[s])] = s
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        match = [k for k in by if k[0] == r.source_size and abs(k[1] - r.target) < 1e-6 * max(1, k[1])]
        assert match and 0 <= r.taken <= 2 * r.size
        taken[match[0]] += r.taken
    assert all(abs(taken[k] - k[1]) <= 1 for k in taken)
    again = mix_sources(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert mix_sources(empty(spark)).count() == 0


def test_pack(spark, docs):
    from tokenizers import Tokenizer

    from tessella.llm.packing import NEXT, PIECE, PLACED, pack, place, sweep
    from tessella.llm.queries import tokenizer_path

    tk = Tokenizer.from_file(tokenizer_path())
    want = defaultdict(list)
    for r in docs.collect():
        ids = [*tk.encode(r.text or "", add_special_tokens=False).ids, 0]
        n = len(ids)
        cuts = [0, n] if n <= 64 else [0, *range(n % 64 or 64, n, 64), n]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id].append((i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = pack(docs, tokenizer_path(), length=64).collect()
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in have.items()}
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 1
    assert pack(empty(spark), tokenizer_path()).count() == 0
    for seed in range(5):
        r = np.random.default_rng(seed)
        counts = {int(s): int(n) for s, n in zip(r.choice(64, 20, False) + 1, r.integers(1, 50, 20), strict=True)}
        fill, seen = defaultdict(int), defaultdict(int)
        whole = sweep([(NEXT, 0, 0, 0, 0, 0, 0)] + [(PIECE, s, 0, n, 0, 0, 0) for s, n in counts.items()], 64, True)
        plans = [[(v, a, n, f, p, o) for k, v, a, n, f, p, o in whole if k == PLACED]]
        if seed < 2:  # all supersteps
            plans.append([tuple(x) for x in place(spark.createDataFrame(list(counts.items()), "length long, n long"), 64, 3).collect()])
        for plan in plans:
            fill, seen = defaultdict(int), defaultdict(int)
            for s, r0, n, first, per, at in sorted(plan, key=lambda x: x[5]):
                seen[s] += n
                for k in range(n):
                    b = first + k // per
                    assert fill[b] == at + k % per * s
                    fill[b] += s
            assert dict(seen) == counts and max(fill.values()) <= 64
            for size in counts:  # ranks of a size follow each other
                spans = sorted((r0, n) for s, r0, n, *_ in plan if s == size)
                assert [r for r, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]


def test_supersteps_reach_the_bound(spark):
    """Sizes of the generated documents, many and mixed: no more sequences than tokens need, or one for each piece over half."""
    from tessella.llm.packing import LENGTH, place

    r = np.random.default_rng(8)
    for sizes in (r.integers(1, 700, 3000), np.r_[r.integers(1, LENGTH + 1, 2000), r.integers(1, 200, 9000)], np.full(500, 2048), np.full(700, 1100), np.full(5000, 1)):
        counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
        plan = place(spark.createDataFrame(list(counts.items()), "length long, n long")).collect()
        bins = {x.first + k // x.per for x in plan for k in range(x.ranks)}
        assert len(bins) <= max(-(-int(sizes.sum()) // LENGTH) + 1, int((sizes * 2 > LENGTH).sum()))


def test_tokens_equal_the_file():
    from tokenizers import Tokenizer

    from tessella.llm.packing import Tokens
    from tessella.llm.queries import tokenizer_path

    tk, fast = Tokenizer.from_file(tokenizer_path()), Tokens(tokenizer_path())
    for t in [t or "" for t in TEXTS] + ["a\n b", "a \nb", " lead", "it's  two", "\u00a0 nb\u00a0sp x", "a \u2003b c", "tab\t tab", "e\u0301 \U0001f600 ok", "a\u0085 b"]:
        assert np.frombuffer(fast(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_secrets(spark):
    from tessella.llm.secrets import scan_secrets

    texts = ["password=abcdefgh1 token: short secret='longenough'", "AKIA" + "B" * 12 + " AKIA123 " + "0af" * 12, None, "", "api_key = \"ABCDEFGH\" ü Apikey:zzzzzzzzz", "token: secret: abcdefgh12", "tokſen=abcdefghijk K", "x" * 50000 + " passwd:" + "y" * 40000]
    df = spark.createDataFrame([(i, t, f"s{i % 3}", 1) for i, t in enumerate(texts)] + [(0, texts[0], "s0", 1)], "doc_id long, text string, source string, secrets int")
    got = {r.doc_id: r for r in scan_secrets(df).collect()}
    pats = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 8, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 16, 0), ("hex", re.compile("[0-9a-f]+"), 32, 0))
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, n, m.end()) for k, (n, p, least, g) in enumerate(pats) for m in p.finditer(t or "") if len(m[g]) >= least)
        digest = ",".join(f"{n}:{a}:{b}" for a, _, n, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
    assert scan_secrets(df).count() == len(texts) + 1
    assert scan_secrets(df.limit(0)).count() == 0


def test_language_id(spark):
    from tessella.llm.language_id import fit_language_id, held_out, identify_language
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_language_id(docs.filter(~held_out(F.col("doc_id"))), sample=400)
    got = identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    odd = spark.createDataFrame([(1, None, None), (2, "123 !", "en"), (3, "", None), (None, "hello", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in identify_language(odd, model).collect() if r.doc_id} == {k: ("und", 0.0) for k in (1, 2, 3)}
    assert fit_language_id(odd.limit(0)) is None
    assert {r.lang_pred for r in identify_language(odd, None).collect()} == {"und"}
    assert identify_language(odd.limit(0), model).count() == 0


def test_url_filter(spark):
    from tessella.llm.url_filter import RULES, filter_urls

    urls = [None, "", "nourl", "http://A.Example.com/en/7x?q=1", "https://example.com/en/1#top", "x://net/de/1", "x://sub.net/de/1", "http://notnet/de/1", "http://m.example.net/de/8/9", "http://a.org", "http://a.org?x=/es/1", "http://a.org/es/1", "http:///p", "http://h/" + "a/" * 3000]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, rule string")
    got = filter_urls(df).collect()
    assert len(got) == len(urls) * 2
    for r in got:
        u = urls[r.page_id % len(urls)] or ""
        host, path = "", ""
        if "://" in u:
            rest = re.split("[?#]", u.split("://", 1)[1], maxsplit=1)[0]
            host, _, path = rest.partition("/")
            path = "/" + path if "/" in rest else ""
            host = host.lower()
        best = max((x for x in RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])), key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (best and best[0] + best[1])
        assert r.verdict == (best[2] if best else "allow")
    assert filter_urls(df.limit(0)).count() == 0


def test_url_filter_rules_are_the_contracts(spark):
    """Each rule's word as the contract lists it, spelled out here, on the host, a subdomain and in company of a longer rule."""
    from tessella.llm.url_filter import filter_urls

    urls = {"x://net/de/1": ("net/de/", "allow"), "x://sub.net/de/": ("net/de/", "allow"), "x://example.net/de/7": ("net/de/", "allow"), "x://example.net/de/8": ("example.net/de/8", "block")}
    urls |= {"x://m.example.net/de/8/9": ("example.net/de/8", "block"), "x://a.com/en/7": ("com/en/", "block"), "x://example.com/en/8": ("com/en/", "block")}
    urls |= {"x://example.com/en/7": ("example.com/en/7", "allow"), "x://m.example.com/en/70": ("example.com/en/7", "allow"), "x://a.org/es/1": ("org/es/", "block")}
    names = list(urls)
    got = {names[r.page_id]: (r.rule, r.verdict) for r in filter_urls(spark.createDataFrame(list(enumerate(names)), "page_id long, url string")).collect()}
    assert got == urls


def test_url_filter_rejects_without_a_rule(spark):
    from tessella.llm.url_filter import filter_urls

    urls = {f"http://bad.com/en/{i}": "block" for i in range(40)}
    urls |= {f"http://bad.com/fr/{i}": "allow" for i in range(9)}  # no rule: the labelled branch of this shape says nothing of it
    urls |= {"http://bad.com/about": "allow"}  # no rule, and one branch is too little evidence for the host
    urls |= {f"http://good.example.com/en/7{i}": "allow" for i in range(40)} | {f"http://good.example.com/fr/{i}": "allow" for i in range(9)}
    urls |= {f"http://both.example.com/en/7{i}": "allow" for i in range(30)} | {f"http://both.example.com/en/1{i}": "block" for i in range(10)}
    urls |= {f"http://both.example.com/fr/{i}": "allow" for i in range(9)}
    urls |= {"http://few.com/en/1": "block", "http://few.com/about": "allow"}  # one label is too little
    urls |= {f"http://none.edu/fr/{i}": "allow" for i in range(9)}
    names = list(urls)
    df = spark.createDataFrame(list(enumerate(names)), "page_id long, url string")
    got = {names[r.page_id]: (r.verdict, r.rule) for r in filter_urls(df).collect()}
    assert {u: v for u, (v, _) in got.items()} == urls
    assert got["http://bad.com/fr/1"][1] is None and got["http://bad.com/about"][1] is None


def test_url_filter_rejects_by_many_branches(spark):
    """A branch without labels is blocked where the labels of many branches of its host agree, and in wildcards it shares with them."""
    from tessella.llm.url_filter import filter_urls

    rules = tuple(("com", f"/b{i}/", "block") for i in range(9)) + (("org", "/7/a", "block"),)
    urls = [f"http://x.com/b{i}/{k}" for i in range(9) for k in range(3)] + ["http://x.com/new/1", "http://y.com/b1/1", "http://y.com/new/1"]
    urls += [f"http://z.org/7/a{k}" for k in range(20)] + ["http://z.org/8/a5"]
    got = {urls[r.page_id]: (r.rule, r.verdict) for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    assert got["http://x.com/new/1"] == (None, "block") and got["http://y.com/new/1"] == (None, "allow")
    assert got["http://z.org/8/a5"] == (None, "block")


def _brute_templates(urls, fan_out, strength=4.0):
    """(template, purity) of each url by the method, from plain dictionaries."""
    from tessella.llm.url_filter import RULES

    info = []
    for u in urls:
        host, _, path = u.split("://", 1)[1].partition("/")
        path = "/" + path
        best = max((x for x in RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])), key=lambda x: len(x[0] + x[1]), default=None)
        kind = lambda s: "{n}" if re.fullmatch("[0-9]+", s) else "{x}" if re.fullmatch("[0-9a-fA-F-]{8,}", s) else s
        info.append((host, tuple(kind(s) for s in path.split("/") if s), best and best[2]))
    labels = defaultdict(lambda: [0, 0])
    for h, segs, v in info:
        labels[h, segs][0] += v is not None
        labels[h, segs][1] += v == "block"
    live, final = {k: () for k in labels}, {}
    for level in range(max(len(s) for _, s in labels)):
        groups = defaultdict(lambda: defaultdict(list))
        for (h, segs), tpl in live.items():
            if len(segs) > level:
                groups[h, tpl][segs[level]].append((h, segs))
            else:
                final[h, segs] = tpl
        live = {}
        for (h, tpl), sibs in groups.items():
            stat = {}
            for seg, keys in sibs.items():
                shape = max("/".join(x if re.fullmatch(r"\{.\}", x) else "*" for x in s[level + 1 :]) for _, s in keys)
                stat[seg] = (sum(labels[k][0] for k in keys), sum(labels[k][1] for k in keys), shape)
            pm, pb = sum(x[0] for x in stat.values()), sum(x[1] for x in stat.values())
            p = (pb + 1) / (pm + 2)
            like = {s: m > 0 and abs(b - m * p) <= 2 * (m * p * (1 - p) + 0.25) ** 0.5 for s, (m, b, _) in stat.items()}
            for seg, keys in sibs.items():
                m, _, shape = stat[seg]
                name = "*" if len(sibs) >= fan_out else seg if re.fullmatch(r"\{.\}", seg) else "*:" + shape if like[seg] else "?:" + shape if m == 0 else seg
                for k in keys:
                    if sum(map(len, sibs.values())) == 1:
                        final[k] = (*tpl, name, *k[1][level + 1 :])
                    else:
                        live[k] = (*tpl, name)
    final |= live
    stats, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, t in final.items():
        for i in range(2):
            stats[k[0], t][i] += labels[k][i]
            hosts[k[0]][i] += labels[k][i]
    branches = defaultdict(lambda: [0, 0])
    for (h, segs), (m, b) in labels.items():
        branches[h, segs[:1]][0] += m
        branches[h, segs[:1]][1] += b
    out = []
    for h, segs, v in info:
        t = final[h, segs]
        (m, b), (hm, hb) = stats[h, t], hosts[h]
        prior = (hb + 1) / (hm + 2)
        purity = 0.0 if hm == 0 else (b + strength * prior) / (m + strength)
        if m == 0:
            known = [b / m for (g, _), (m, b) in branches.items() if g == h and m]
            share = (sum(known) + 1) / (len(known) + 2)
            purity = max(0.0, share - 2 * (share * (1 - share) / (len(known) + 3)) ** 0.5) if hm else 0.0
        out.append(("/" + "/".join(t), round(purity, 9), v or ("block" if purity > 0.5 else "allow")))
    return out


def test_templates_equal_brute_force(spark, monkeypatch):
    from tessella.llm import _tables
    from tessella.llm.url_filter import filter_urls

    r = np.random.default_rng(6)
    urls = [f"http://{h}/" + "/".join(str(r.choice(["en", "de", "es", "blog", "tag", "7", "12", "abcdef0123", "x1", "x2"])) for _ in range(int(r.integers(0, 6)))) for h in r.choice(["a.com", "b.net", "c.org", "d.edu"], 600, p=[0.7, 0.1, 0.1, 0.1])]
    urls += ["http://a.com/en/" + "/".join(["deep"] * 40 + [str(k)]) for k in ("x", "y")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = _brute_templates(urls[:600], 6)
    for hot in (1000, 3):  # with hot keys and without
        monkeypatch.setattr(_tables, "HOT", hot)
        got = {x.page_id: (x.template, round(x.purity, 9), x.verdict) for x in filter_urls(df.filter("page_id < 600"), fan_out=6).collect()}
        assert [got[i] for i in range(600)] == want
    deep = {x.page_id: x.template for x in filter_urls(df, fan_out=6).filter("page_id >= 600").collect()}
    assert len(deep) == 2 and len(set(deep.values())) == 1  # fifty levels down they are one template


def test_secrets_are_told_by_owners_and_repositories(spark, monkeypatch):
    """n_live and n_example against a count over the corpus, with hot hashes and without."""
    from tessella.llm import _tables
    from tessella.llm.secrets import EXAMPLE_OWNERS, EXAMPLE_REPOS, LIVE_BITS, bits_per_char, scan, scan_secrets

    r = np.random.default_rng(2)
    keys = ["".join(r.choice(list("abcdefghij0123456789KLMN"), 20)) for _ in range(12)] + ["aaaaaaaaaaaa"]
    rows = [(i, f"token = {keys[min(int(r.geometric(0.25)) - 1, 12)]} and AKIA{'ABCDEFGHIJKLMNOP'[: int(r.integers(8, 16))]}", f"o{int(r.integers(0, 9))}", f"r{int(r.integers(0, 5))}") for i in range(80)]
    owners, repos = defaultdict(set), defaultdict(set)
    for _, t, o, p in rows:
        for *_, s in scan(t):
            owners[s].add(o)
            repos[s].add((o, p))
    example = lambda s: len(owners[s]) >= EXAMPLE_OWNERS or len(repos[s]) >= EXAMPLE_REPOS
    want = {i: (sum(not example(s) and bits_per_char(s) >= LIVE_BITS for *_, s in scan(t)), sum(example(s) for *_, s in scan(t))) for i, t, *_ in rows}
    assert 0 < sum(a for a, _ in want.values()) and 0 < sum(b for _, b in want.values())
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    for hot in (1000, 5):
        monkeypatch.setattr(_tables, "HOT", hot)
        assert {x.doc_id: (x.n_live, x.n_example) for x in scan_secrets(df, repo_col="repo").collect()} == want


def test_a_string_is_a_span_by_its_owners(spark):
    """The same random string is a span where one owner holds it, and none once others do."""
    from tessella.llm.secrets import loose, scan, scan_secrets

    mine, ours, word = "Zk3fQ9xT7bLw2Rv8NpYa", "h7Gd2Kq9Wm4Xs6Jt1Vc5", "internationalisation_of_documents"
    rows = [(0, f"é {mine} and token=abcdefgh12", "o1"), (1, f"{mine}{'!'} {word}", "o1"), (2, ours, "o1"), (3, f"x {ours}", "o2"), (4, f"token={mine}{ours}", "o3"), (5, "123456789-" * 5, "o4")]
    got = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()}
    assert got[0].spans == "own:2:22,assign:27:43" and got[0].n_live == 2
    assert got[1].spans == "own:0:20" and got[2].spans == got[3].spans == "" and got[5].spans == ""
    assert got[4].spans == "assign:0:46" and got[4].n_assign == 1
    text = rows[4][1] + " " + mine
    assert [x[1:3] for x in loose(text, scan(text))] == [(47, 67)]


def test_hot_keys_join_as_others(spark, monkeypatch):
    from tessella.llm import _tables
    from tessella.llm.exact_dedup import exact_dedup

    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 50 + ["b"] * 3 + ["c", None])], "k string, i int")
    facts = spark.createDataFrame([("a", 50, "A"), ("b", 3, "B"), ("z", 0, "Z")], "k string, n long, v string")
    for hot in (1000, 10, 0):
        monkeypatch.setattr(_tables, "HOT", hot)
        for how in ("inner", "left"):
            got = sorted((x.i, x.v) for x in _tables.join_counted(rows, facts, ["k"], "n", 55, how).collect())
            assert got == sorted((x.i, x.v) for x in rows.join(facts, "k", how).collect())
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(60)], "doc_id long, text string")
    kept = []
    for hot in (1000, 5):
        monkeypatch.setattr(_tables, "HOT", hot)
        kept.append(sorted((x.doc_id, x.keep_id, x.group_size, x.kept) for x in exact_dedup(docs).collect()))
    assert kept[0] == kept[1] and sum(x[3] for x in kept[0]) == 21


def test_language_network_equals_the_direct_convolution():
    """Tables of byte pairs give what every filter gives slid over every window."""
    from tessella.llm.language_id import FILTERS, WIDTHS, ByteCNN, windows

    m = ByteCNN(["a", "b", "c"], seed=3)
    texts = [b"short", "Grüße aus Köln, 日本語".encode(), bytes(range(256)) * 3, b"x"]
    x, owner, weight = windows(texts, 64)
    assert [int(weight[owner == i].sum()) for i in range(len(texts))] == [len(t) for t in texts]
    got = m.predict(x, m.pair_tables())
    for row, have in zip(x, got, strict=True):
        hidden = [max(sum(float(t[k][row[s + k], f]) for k in range(w)) for s in range(len(row) - w + 1)) for w, t in zip(WIDTHS, m.tables, strict=True) for f in range(FILTERS)]
        z = [sum(np.tanh(h) * float(m.out[i, j]) for i, h in enumerate(hidden)) + float(m.bias[j]) for j in range(3)]
        e = np.exp(np.array(z) - max(z))
        assert np.abs(have - e / e.sum()).max() < 1e-4


def test_sweep_equals_best_fit_decreasing():
    """Runs fill the gaps that a best fit of single pieces, the largest first, would fill."""
    from tessella.llm.packing import GAP, NEXT, PIECE, PLACED, sweep

    r = np.random.default_rng(8)
    for _ in range(40):
        length = int(r.integers(5, 60))
        sizes = r.integers(1, length + 1, int(r.integers(1, 80)))
        gaps = sorted(int(g) for g in r.integers(1, length, int(r.integers(0, 10))))
        free, opened = list(gaps), 0
        for size in sorted(sizes, reverse=True):
            fits = [g for g in free if g >= size]
            if fits:
                free.remove(min(fits))
            else:
                opened += 1
            rest = (min(fits) if fits else length) - size
            if rest:
                free.append(int(rest))
        values, counts = np.unique(sizes, return_counts=True)
        rows = [(PIECE, int(v), 0, int(n), 0, 0, 0) for v, n in zip(values, counts, strict=True)] + [(GAP, g, 100 + i, 1, 0, 0, 0) for i, g in enumerate(gaps)] + [(NEXT, 0, 1000, 0, 0, 0, 0)]
        out = sweep(rows, length, True)
        left = sorted(v for k, v, _, n, *_ in out if k == GAP for _ in range(n))
        assert left == sorted(free)
        assert [at for k, _, at, *_ in out if k == NEXT] == [1000 + opened]
        assert sum(n for k, _, _, n, *_ in out if k == PLACED) == len(sizes)
