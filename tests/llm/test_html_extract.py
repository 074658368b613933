"""Operator 3: labelled generated pages, decoding against brute force, odd inputs."""

import itertools
import time

import numpy as np
import pytest
from tessella.llm.html_extract import MARK, Page, decode, features, main_text_model, main_texts, sample_page

PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Title &amp; more</h1><p><b>First  line.<br>\n<p>Second &eacute; line of text, with words.</p><p>Third line goes on and on, here.</p></article><footer>&copy; me</footer></body></html>'


def test_generated_pages_are_told_apart():
    r, m, hit, wrong = np.random.default_rng(123), main_text_model(), 0, 0
    for _ in range(150):
        p = Page(sample_page(r))
        keep = decode(p.parent, m.log_odds(features(p)))
        for t, k in zip(p.text, keep, strict=True):
            if t:
                hit += (MARK in t) == k
                wrong += (MARK in t) != k
    assert wrong < 0.02 * hit


def test_decode_is_the_best_consistent_labelling():
    r = np.random.default_rng(5)
    for _ in range(30):
        n = 9
        parent = [-1, *(int(r.integers(0, i)) for i in range(1, n))]
        odds = r.normal(0, 2, n)
        keep = decode(parent, odds)
        assert all(not keep[i] or keep[parent[i]] for i in range(1, n))
        best = max(sum(o for o, k in zip(odds[1:], ks, strict=True) if k) for ks in itertools.product((0, 1), repeat=n - 1) if all(not k or parent[i] == 0 or ks[parent[i] - 1] for i, k in enumerate(ks, 1)))
        assert abs(odds[1:][keep[1:]].sum() - best) < 1e-9


def test_pages(spark):
    from tessella.llm.html_extract import extract_main_text

    want = "Title & more First line. Second é line of text, with words. Third line goes on and on, here."
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", PAGE[:-60], "x"), (5, "u", "<p" * 5000, "x"), (6, "u", PAGE.replace("on and on", "on " * 20000), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == want and by[4].text.startswith("Title & more First line.")
    assert by[2].text == by[3].text == "" and by[2].n_chars == 0
    assert by[6].n_chars == len(" ".join(want.replace("on and on", "on " * 20000).split()))
    assert extract_main_text(df.limit(0)).count() == 0


def test_truncation_never_fails():
    m = main_text_model()
    assert len(main_texts([PAGE[:k] for k in range(len(PAGE))], m)) == len(PAGE)


def test_letters_that_grow_in_lower_case_lose_no_text():
    m = main_text_model()
    page = PAGE.replace("First", "\u0130" * 40 + "First").replace("<p>Second", "<SCRIPT>x = 1;</Script><p>Second")
    assert main_texts([page], m) == ["Title & more " + "\u0130" * 40 + "First line. Second é line of text, with words. Third line goes on and on, here."]


def test_unclosed_and_stray_tags_cost_linear_time():
    began = time.perf_counter()
    p = Page("<div>" * 100_000 + "x" + "</section>" * 100_000)
    assert len(p.group) == 100_002 and time.perf_counter() - began < 20


@pytest.mark.parametrize("part", ["<p", "<p ", "<a '", '<a "', "<a b='\"", "<", "</", "<!", "<!--", "<a/", "<script", "class=", "<x class = "])
def test_tags_that_never_end_cost_linear_time(part):
    began = time.perf_counter()
    for end in ("", ">", "x</p>"):
        Page(part * (10**6 // len(part)) + end)
    assert time.perf_counter() - began < 15
    assert time.perf_counter() - began < 5 or part != "<p"


def test_text_of_generated_pages_equals_the_marked_runs():
    """Pages that the decoder labels rightly give exactly the marked blocks, in page order."""
    r, m, whole = np.random.default_rng(77), main_text_model(), 0
    for _ in range(60):
        source = sample_page(r)
        got = main_texts([source], m)[0]
        whole += got == " ".join(t for t in Page(source).text if MARK in t)
    assert whole >= 50
