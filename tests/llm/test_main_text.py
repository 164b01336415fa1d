"""Main text of pages; minimum cuts against all labellings."""

import itertools
import random

import numpy as np
import pytest

from specflow.llm import main_text
from specflow.llm.main_text import Page, minimum_cut

from .conftest import rows_of

NONE = np.zeros(7)


def cut_cost(label, cost, edges):
    return sum(max(0, c) if not y else max(0, -c) for y, c in zip(label, cost)) + sum(w for u in edges for v, w in edges[u].items() if u < v and label[u] != label[v])


def test_cuts_are_minimal():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 9)
        cost, edges = [rng.randint(-9, 9) for _ in range(n)], {u: {} for u in range(n)}
        for u, v in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                edges[u][v] = edges[v][u] = rng.randint(1, 8)
        kept = {u: dict(e) for u, e in edges.items()}
        got = minimum_cut(list(cost), edges)
        assert cut_cost(got, cost, kept) == min(cut_cost(x, cost, kept) for x in itertools.product([False, True], repeat=n))


def test_flow_labels_what_no_cost_decides():
    n, rng = 3000, random.Random(1)
    cost = [rng.choice([-3, 3, 2, -2]) for _ in range(n)]
    edges = {u: {v: 4 for v in (u - 1, u + 1) if 0 <= v < n} for u in range(n)}
    kept = {u: dict(e) for u, e in edges.items()}
    best = [(0.0, 0.0)]  # of a chain, by dynamic programming
    for c in cost:
        a, b = best[-1]
        best.append((min(a, b + 4) + max(0, c), min(b, a + 4) + max(0, -c)))
    assert cut_cost(minimum_cut(list(cost), edges), cost, kept) == min(best[-1]) - 0


PAGE = """<!DOCTYPE html><html class="has-sidebar"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="nav-open">
<header><a href="/">Site</a></header><div id="cookie-notice"><p>We use cookies on this site to improve it for you.</p></div>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="page-header-wrap"><main>
<article><header><h1>Head &amp; tail&nbsp;&am</h1></header><p><b>One  <i>two</i>
three.<br><p>Four &lt;b&gt; five<!-- no --><ul><li>Item<li>Item</ul><div class="advert">Buy this now.</div><p>No.<div hidden>gone</div>
<footer>Tags</footer><section id="comments"><h2>Comments</h2><article class="comment"><p>I liked this text a lot, really.</p></article></section></article></main></div>
<aside><p>Elsewhere on this site there are more texts.</p></aside><form><label>Name</label><input><button>Send</button></form><footer>&copy; Site</footer></body></html>"""


def test_parts_of_a_page():
    assert main_text.main_text(PAGE, NONE) == "Head & tail &am\nOne two three.\nFour <b> five\nItem\nItem\nNo."
    blocks = [b[1] for b in Page("a<div>b<p>c</div>d<table><tr><td>e<td>f</table><script>x").blocks]
    assert blocks == ["a", "b", "c", "d", "e", "f"]


def test_pages_without_marks_are_labelled_by_their_text():
    rng = np.random.default_rng(1)
    x = [main_text.features("Long text that goes on for some time, and ends well. It does." * int(rng.integers(1, 4)), 0, False) for _ in range(80)] + [main_text.features("Home" + str(i), 5, False) for i in range(80)]
    weights = main_text.fitted(np.array(x), np.array([1.0] * 80 + [0.0] * 80))
    body = "".join(f"<p>Here is a paragraph of some length about subject {i}, and it ends here. So it is.</p>" for i in range(5))
    links = "".join(f'<div><a href="/{i}">Link {i}</a></div>' for i in range(8))
    got = main_text.main_text(f"<div><div>{links}</div><div>{body}<p>Yes.</p>{body}</div><div>{links}</div></div>", weights)
    assert got.count("\n") == 10 and "Link" not in got and "\nYes.\n" in got
    assert (main_text.fitted(np.array(x[:9]), np.ones(9)) == 0).all()


@pytest.mark.parametrize("html", [None, "", " ", "<", "<p", "<div><p>", "</div></p>", "<!--", "<script>", "a<b", "&#x110000; &bogus; &amp", "<p/>x", "<article>" * 3000 + "deep", "<div>" * 2000 + "</p>" * 2000, "\x00<p>\x00"])
def test_broken_pages(html):
    assert isinstance(main_text.main_text(html, NONE), str)


def test_long_pages():
    rows = "".join(f"<p>Paragraph {i}.</p><div class='ad'>x</div>" for i in range(20_000))
    got = main_text.main_text(f"<article>{rows}</article>", NONE)
    assert got.split("\n") == [f"Paragraph {i}." for i in range(20_000)]


def test_extraction(spark):
    rows = [(1, "u", PAGE, 1, "t"), (1, "u", PAGE, 1, "t"), (2, None, None, 2, "t"), (None, "v", "", 3, "t"), (4, "w", "<article><p>A</p><p>B</p></article>", 4, "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string")
    weights = main_text.fit(df)
    assert (weights == 0).all()
    got = main_text.extract(df, weights)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = rows_of(got)
    assert sorted((str(r["page_id"]), r["url"], r["n_chars"]) for r in found) == sorted([*[("1", "u", len("Head & tail &am\nOne two three.\nFour <b> five\nItem\nItem\nNo."))] * 2, ("2", None, 0), ("None", "v", 0), ("4", "w", 3)])
    assert main_text.extract(df.limit(0), main_text.fit(df.limit(0))).count() == 0
