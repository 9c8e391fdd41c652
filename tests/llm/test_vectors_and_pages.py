import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from lodestack.llm import pages, vectors  # noqa: E402


def brute(rows, threshold=0.98):
    """By row number: links and component of the rows that can link."""
    ok = [(k, i, v, lab) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    units = [np.array(v, dtype="<f4").astype(float) / np.linalg.norm(np.array(v, dtype="<f4").astype(float)) for _, _, v, _ in ok]
    root, links = list(range(len(ok))), [0] * len(ok)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(len(ok)):
            if a != b and ok[a][3] == ok[b][3] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                links[a] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for a in range(len(ok)):
        least[find(a)] = min(least.get(find(a), 1 << 60), ok[a][1])
    return {ok[a][0]: (links[a], least[find(a)]) for a in range(len(ok))}


@pytest.mark.parametrize(("block", "recall"), [(vectors.BLOCK, 1.0), (5, 1.0), (5, vectors.RECALL)])
def test_all_links_are_found(spark, monkeypatch, block, recall):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.2])).tolist(), int(c % 3)))
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]  # one vector many times
    rows += [(3, rows[0][1], 0), (3, rows[1][1], 1), (3, rows[-1][1], 2), (5, rows[0][1], None)]  # one id with several vectors and labels
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] * 16, 1), (2005, [float("inf")] + [0.0] * 15, 1), (2006, rows[0][1], None), (2007, [1.0, 0.0, 2.0], 1), (2008, [2.0, 0.0, 4.0], 1), (2009, [1.0], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, component_id int, v string")
    out = vectors.near_duplicates(df, recall=recall).collect()
    found = brute(rows)
    want = sorted((i if i is not None else -1, *found.get(k, (0, i if i is not None else -1))) for k, (i, _, _) in enumerate(rows))
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in out) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_the_traversal_and_its_visits():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * away / np.linalg.norm(away, axis=1)[:, None]  # pairs at the threshold itself
    books = vectors.k_means(x[:2000, :32], 16), vectors.k_means(x[:2000, 32:], 16)
    limit, exact = (vectors.stop_at(x[:2000], books, 0.98, r) for r in (vectors.RECALL, 1.0))
    own = [vectors.bounds(y[:, p], c) for c, p in zip(books, (slice(None, 32), slice(32, None)), strict=True)]
    asked = [vectors.bounds(x[:, p], c)[1] for c, p in zip(books, (slice(None, 32), slice(32, None)), strict=True)]
    total = asked[0][np.arange(3000), own[0][0]] + asked[1][np.arange(3000), own[1][0]]
    assert (total <= limit).mean() >= 0.999 and (total <= exact).all()
    visits = [sum(1 for _ in vectors.multi_sequence(asked[0][i], asked[1][i], limit)) for i in range(300)]
    assert np.mean(visits) < 20  # of 256


def test_cells_come_nearest_first():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    got = list(vectors.multi_sequence(a, b, 0.9))
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and len(set(got)) == len(got) == int((a[:, None] + b[None] <= 0.9).sum())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div id="sidebar">side</div>
<article class="post"><header><h1>Head &amp; line &eacute;</h1></header><p>One <i>two</i>\n three<p>Four&nbsp;five<form><input value="a>b">Send</form><ul><li>a<li>b</ul>
<!-- note --><div class="ad">buy</div><section id="comments"><p>nice!</p></section></article><aside>x</aside><div role="navigation">more</div><footer>&copy; 2024</footer></body></html>"""


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, text string, host int")
    return {r.page_id: r for r in pages.main_text(df).collect()}


def test_article_without_the_rest(spark):
    out = texts(spark, [(1, "http://h.example/a", PAGE), (2, None, None), (3, "no url", ""), (4, "http://h.example/b", "plain < 3 &lt; text"), (5, "http://x/", "<p>unclosed <b>bold"), (6, "http://x/", "<div>a<br>b</div><script>never closed")])
    want = "Head & line é\n\nOne two three\n\nFour five\n\na\n\nb"
    assert (out[1].text, out[1].n_chars, out[1].url) == (want, len(want), "http://h.example/a")
    assert (out[2].text, out[3].text, out[5].text, out[6].text) == ("", "", "unclosed bold", "a b")
    assert out[4].text == "plain < 3 < text"


def test_template_of_a_host_is_left_out(spark):
    rows = [(i, f"http://one.example/{i}", f"<body><div>Welcome to our site</div><div><p>Story {i} begins.</p><p>And ends {i}.</p></div><div>All rights reserved</div></body>") for i in range(6)]
    rows += [(100, "http://two.example/", "<body><div>Welcome to our site</div><p>Only page</p></body>")]
    out = texts(spark, rows)
    assert all(out[i].text == f"Story {i} begins.\n\nAnd ends {i}." for i in range(6))
    assert out[100].text == "Welcome to our site\n\nOnly page"  # one page shows no template


def test_repeated_paragraphs_of_articles_stay(spark):
    rows = [(i, "http://one.example/", f"<article><p>Same words.</p><p>{'Own' if i else 'Other'} {i}</p></article>") for i in range(4)] + [(3, "http://one.example/", "<article><p>Same words.</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = pages.main_text(df).collect()
    assert len(out) == 5 and all(r.text.startswith("Same words.") for r in out)
    assert pages.main_text(df.limit(0)).count() == 0


def brute_template(sources):
    """The tokens of the valid classes, from explicit occurrence vectors and every pair of neighbours."""
    sequences = [[page.blocks[~x][0] if x < 0 else x for x in page.order] for page in map(pages.Page, sources)]
    words = {}
    for page in map(pages.Page, sources):
        for x in page.order:
            words[page.blocks[~x][0] if x < 0 else x] = page.blocks[~x][4].count(" ") + 1 if x < 0 else 1
    vectors = {t: tuple(s.count(t) for s in sequences) for t in words if t}
    found = {}
    for t, v in vectors.items():
        if sum(map(bool, v)) >= max(pages.LEAST_PAGES, pages.SUPPORT * len(sources)):
            found.setdefault(v, []).append(t)
    found = [ts for ts in found.values() if sum(words[t] for t in ts) >= pages.LARGE]
    order = []
    for ts in found:
        first = next(s for s in sequences if ts[0] in s)
        order.append(sorted(ts, key=first.index))
    valid = set()
    for ts in order:
        ok, parents = True, set()
        for s in sequences:
            own = [x for x in s if x in ts]
            ok &= own == ts * (len(own) // len(ts))
        if ok:
            valid.update(ts)
    return valid


def test_template_of_small_hosts_equals_brute_force(spark):
    r = np.random.default_rng(7)
    hosts = {}
    for h in range(8):
        notice, menu = f"Notice number {h} stands here", "<ul>" + "".join(f"<li><a href=x>word{h}{k}</a></li>" for k in range(3)) + "</ul>"
        hosts[f"h{h}"] = ["<html><body>" + (f"<div>{notice}</div>" if r.random() < 0.8 else "") + menu + "".join(f"<p>Own text {h} {i} {k}</p>" for k in range(r.integers(1, 5))) + ("<i>x</i><hr>Twice told words<br>" if r.random() < 0.3 else "") + "<div>All rights are kept</div></body></html>" for i in range(int(r.integers(1, 9)))]
    rows = [(100 * n + i, h, source) for n, (h, sources) in enumerate(hosts.items()) for i, source in enumerate(sources)]
    df = spark.createDataFrame(rows + rows[:5], "page_id long, host string, html string")
    got = {x.on_host: set(x.template) for x in pages.templates(df).collect()}
    for h, sources in hosts.items():
        assert got.get(h, set()) == (brute_template(sources) if len(sources) >= pages.LEAST_PAGES else set()), h
    assert any(got.values())


def test_classes_that_are_not_ordered_or_overlap_are_not_valid():
    places = {1: (0, 0, 3), 2: (0, 1, 3), 3: (0, 2, 3), 7: (1, 0, 2), 8: (1, 1, 2)}
    assert pages.broken([1, 9, 2, 7, 8, 3, 1, 2, 7, 8, 3], places) == ({0: 0, 1: 1}, set())
    assert pages.broken([1, 3, 2], places)[1] == {0}
    assert pages.broken([1, 7, 2, 8, 3], places)[1] == {1}  # it overlaps
    assert pages.broken([1, 7, 8, 2, 7, 8, 3], places)[1] == {1}  # it nests in two gaps
    assert pages.broken([1, 2], places)[1] == {0} and pages.broken([2, 3], places)[1] == {0}
    assert pages.broken([], places) == ({}, set())


def test_menus_are_slots_of_links(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(9):
        menu = "".join(f"<div><a href=/{k}>entry {r.integers(1000)}</a></div>" for k in range(r.integers(2, 6)))
        rows.append((i, "http://m.example/", f"<body><div class=box>{menu}</div><div class=rest><h2>Head {i}</h2><p>Story {i} with <a href=x>a link</a> inside.</p><p><a href=y>link {i}</a></p></div></body>"))
    out = texts(spark, rows)
    assert all(out[i].text.startswith(f"Head {i}\n\nStory {i} with a link inside.") and "entry" not in out[i].text for i in range(9))


def test_names_of_side_matter_are_whole_names(spark):
    source = """<main><p>Before.</p><article><h1>Head</h1><div class="related-work"><p>Earlier work.</p></div><section id="header-files"><p>Files.</p></section>
    <div class="post-header"><p>By line</p></div><div class="post-comments"><p>nice</p></div><div class="ad-unit-2 left"><p>buy</p></div><p hidden>secret</p></article><p>After.</p></main><div class="site-footer">foot</div>"""
    assert texts(spark, [(1, "http://a/", source)])[1].text == "Before.\n\nHead\n\nEarlier work.\n\nFiles.\n\nBy line\n\nAfter."


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_planted_articles_are_found_whole(spark):
    import html
    import re

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in pages.main_text(df).join(df.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.DOTALL).group(1)
        words = html.unescape(re.sub(r"<[^>]*>", " ", article)).split()
        assert r.text.split() == words, r.page_id


def test_copies_of_a_page_keep_their_text(spark):
    inside = "<body><article><h1>Head</h1><p>Short text.</p></article></body>"
    outside = "<body><h1>Head</h1><p>Short text.</p></body>"
    rows = [(i, "http://copies.example/", inside) for i in range(12)]
    rows += [(100 + i, "http://plain.example/", outside) for i in range(5)] + [(100, "http://plain.example/", outside)]
    rows += [(200 + i, "http://series.example/", f"<body><div>Menu</div><article><h1>Column</h1><p>Text {i}.</p><p>To be continued</p></article></body>") for i in range(12)]
    out = texts(spark, rows)
    assert {out[i].text for i in [*range(12), *range(100, 105)]} == {"Head\n\nShort text."}
    assert all(out[200 + i].text == f"Column\n\nText {i}.\n\nTo be continued" for i in range(12))


def test_long_repeated_notices_are_template(spark):
    notice = "These words stand on every page of the host. " * 20
    rows = [(i, "http://n.example/", f"<body><div>{notice}</div><p>Story {i}.</p></body>") for i in range(6)]
    out = texts(spark, rows)
    assert all(out[i].text == f"Story {i}." for i in range(6))


def test_long_and_broken_markup_is_linear():
    for source in ("<" * 200_000, "<div " * 50_000, "<div class='" * 20_000, "a" * 500_000, "<p>" * 50_000, "<!--" * 50_000, "<script>" * 20_000, "&amp" * 50_000):
        pages.Page(source)
