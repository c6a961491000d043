"""Main texts of pages: whole sites of known texts, classes against plain occurrence vectors, odd pages."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from editstrata.llm import registry
from editstrata.llm import template_extraction as op

SCHEMA = "page_id long, url string, html string, text string"


def got(spark, rows):
    return {r.page_id: r.text for r in op.main_texts(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()}


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def site(kind, n, seed=1):
    """Pages of a host with their main texts."""
    rng = random.Random(seed)
    for k in range(n):
        title, parts = words(rng, 4), [words(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 5))]
        body = "".join(f"<p>{p}</p>" for p in parts)
        links = "".join(f"<li><a href=/{k}>{words(rng, 1)}</a>" for _ in range(rng.randint(2, 5)))
        want = " ".join([title, *parts])
        if kind == "marked":
            html = f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul>{links}</ul></nav>
<div id="cookie-notice">We use cookies</div><aside>{words(rng, 9)}</aside><article class="post"><h1>{title}</h1>{body}<form>Your name <input></form><p class="advert">{words(rng, 3)}
<section class="comments"><p>{words(rng, 30)}</p></section></article><script>if (a < b) document.write("<article>no</article>")</script><footer>{words(rng, 5)}</footer></body></html>"""
        elif kind == "unmarked":  # nothing says what is the article: classes of tokens must
            html = f"""<html><body><div class=a1><div class=a2>Home of the site</div></div><div class=b1><div class=b2><h1>{title}</h1>{body}<div class=b3>Follow us on all channels</div></div>
<div class=b4>Made with care in a place far away</div></div></body></html>"""
        elif kind == "nested":
            html = f"""<body><main><article id="post-{k}"><header><h1>{title}</h1></header>{body}<article><p>first! {words(rng, 20)}</p></article></article></main><div class="sidebar">{words(rng, 50)}</div>"""
        yield html, want


@pytest.mark.parametrize("kind", ["marked", "unmarked", "nested"])
@pytest.mark.parametrize("limit", [100_000, 0])
def test_sites(spark, monkeypatch, kind, limit):
    """Three hosts, templates broadcast or joined in parts."""
    monkeypatch.setattr(op, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(op, "HOT", 5)
    rows, want = [], {}
    for h, n in (("a.net", 30), ("b.net", 12), ("c.net", 1)):
        for k, (html, text) in enumerate(site(kind, n, seed=len(h) + n)):
            if kind != "unmarked" or n > 1:
                rows.append((len(rows), f"http://{h}/{k}", html))
                want[len(rows) - 1] = text
    assert got(spark, rows) == want


def test_article_that_repeats(spark):
    """Copies of one article fill a host, and share a line with another's pages: their words stay."""
    html, text = next(site("marked", 1))
    shared = [f"<article><p>The same line.</p><p>{k} of many</p></article>" for k in range(7)]
    rows = [(k, "http://a.net/x", html) for k in range(20)] + [(100 + k, "http://b.net/y", h) for k, h in enumerate(shared)]
    out = got(spark, rows)
    assert all(out[k] == text for k in range(20)) and all(out[100 + k] == f"The same line. {k} of many" for k in range(7))


def test_classes_are_vectors(spark):
    """Classes hold exactly the tokens of equal counts on every page that half of the pages have."""
    rng = random.Random(3)
    pages = [h for h, _ in site("marked", 9)] + [h for h, _ in site("unmarked", 4)]
    rows = spark.createDataFrame([(rng.getrandbits(62), "a.net", h) for h in pages] + [(1, "few.net", pages[0])], "page long, host string, html string")
    sizes = rows.groupBy("host").agg(F.count("*").alias("n_pages"))
    found = {r.host: r.classes for r in op.classes(rows, sizes).collect()}
    counts = defaultdict(Counter)
    for k, h in enumerate(pages):
        for e in op.events(h):
            if e.text is None:
                counts[e.token][k] += 1
            elif not e.token and not e.dropped:
                counts[op.text_token(e)][k] += 1
    vectors = defaultdict(set)
    for token, on in counts.items():
        if 2 * len(on) >= len(pages):
            vectors[tuple(sorted(on.items()))].add(token)
    assert set(found) == {"a.net"}
    assert {frozenset(t.token for t in c.tokens) for c in found["a.net"]} == {frozenset(v) for v in vectors.values() if len(v) > 1} != set()


def test_walk():
    """Order and nesting of classes on a page."""
    def walked(sequence, classes=([1, 2, 3], [4, 5])):
        w = op.Walk([list(c) for c in classes])
        for t in sequence:
            w.step(t)
        w.end()
        return w.broken, w.parents

    assert walked([1, 4, 5, 4, 5, 2, 9, 3]) == (set(), {0: {-1}, 1: {0}})
    assert walked([1, 4, 5, 2, 4, 5, 3])[1][1] == {0, 1}  # lies in two slots
    assert walked([1, 3, 2])[0] == {0} and walked([1, 4, 2, 5, 3])[0] == {1} and walked([1, 2])[0] == {0}
    assert walked([1, 2, 3, 1, 2, 3]) == (set(), {0: {-1}})


def test_markup():
    """References, inline tags, unclosed and broken tags, comments, case and white space."""
    for html, want in (
        ("<ARTICLE>a<b>b</b>c<br>d &amp; e&nbsp;f &#233;&lt;</ARTICLE>out", "abc d & e f é<"),
        ("<article>1 < 2 and 3 > 2<p>x\n\t y<p>z", "1 < 2 and 3 > 2 x y z"),
        ("<article><p title='a > b'>in</p><!-- <p>no --><p don't>yes</p><p", "in yes"),
        ("<article><script>var t='</p>';</script>a<style>b</style><textarea>c</textarea>d", "ad"),
        ("<p>no article<div class='menu'>m</div>at all", "no article at all"),
        ("<article>a<div class='ad'>b<div>c</div></div>d</article><article>e</article>", "a d e"),
        ("<div class='content'>main</div><div class='x'>else</div>", "main"),
        ("plain text", "plain text"),
        ("<script>never closed", ""),
        ("<article><ul class='share'><li>x<li>y</ul>z</article>", "z"),
    ):
        assert op.extracted(html) == want, html


def test_odd_rows(spark):
    long = "<article>" + "<p>word</p>" * 60_000 + "</article>"
    rows = [(1, None, "<article>a</article>"), (2, "http://x.net/", None), (3, "no host", ""), (None, "http://x.net/", "<article>n</article>"), (4, "http://x.net/", long), (5, "http://x.net/", "<b>x" * 3)]
    out = got(spark, rows + rows)
    assert out == {1: "a", 2: "", 3: "", None: "n", 4: " ".join(["word"] * 60_000), 5: "xxx"}
    assert op.main_texts(spark.createDataFrame(rows + rows, "page_id long, url string, html string")).count() == 12
    assert got(spark, []) == {}


def test_query(spark, sf_dir):
    """Each page of the table has one article element, and its text is the result's."""
    import html as references
    import re

    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want[r.page_id] = " ".join(references.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inside))).split())
    found = registry.op11_template_extraction(spark, sf_dir).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in found} == {k: (v, len(v)) for k, v in want.items()}
