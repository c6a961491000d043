"""Character models against dictionaries of strings, and the limit against a search over all bins."""

import math
from collections import Counter

import numpy as np
import pytest

from editstrata.llm import url_filter
from editstrata.llm.url_filter import BINS, LIMIT, ORDER, PRIOR


def dictionaries(urls, bits):
    """Counts of strings and of contexts that a class keeps."""
    strings, size = Counter(), 0
    for u in urls:
        text = b"\x01" * ORDER + (u or "").encode() + b"\x02"
        for at in range(ORDER, len(text)):
            size += 1
            strings.update(text[at - k : at + 1] if k else text[at : at + 1] for k in range(ORDER + 1))
    kept = {s: n for s, n in strings.items() if n * 2**bits >= size}
    contexts = Counter()
    for s, n in kept.items():
        contexts[s[:-1]] += n
    return kept, contexts


def likelihood(model, u):
    kept, contexts = model
    text, out = b"\x01" * ORDER + (u or "").encode() + b"\x02", []
    for at in range(ORDER, len(text)):
        p = 1 / 256
        for k in range(ORDER + 1):
            p = (kept.get(text[at - k : at + 1], 0) + PRIOR * p) / (contexts.get(text[at - k : at], 0) + PRIOR)
        out.append(math.log(p))
    return sum(out) / len(out)


@pytest.mark.parametrize(("bits", "piece"), [(17, 1 << 18), (8, 100)])
def test_scores(spark, sf_dir, bits, piece, monkeypatch):
    """Strings of every count, and only frequent ones; pieces shorter than a URL give the same."""
    monkeypatch.setattr(url_filter, "BITS", bits)
    monkeypatch.setattr(url_filter, "PIECE", piece)
    rows = url_filter.with_rule(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url"), url_filter.RULES).filter("ruled is not null").selectExpr("url", "ruled = 'block' as blocked")
    urls = [(r.url, r.blocked) for r in rows.collect()]
    models = [dictionaries([u for u, b in urls if b == c], bits) for c in (False, True)]
    model = url_filter.trained(rows)
    asked = [u for u, _ in urls[:60]] + [None, "", "no scheme", "http://é.net/" + "a" * 700]
    want = [likelihood(models[1], u) - likelihood(models[0], u) for u in asked]
    assert model.score(asked) == pytest.approx(want, abs=1e-9)


def test_limit():
    rng = np.random.default_rng(8)
    scores = [rng.normal(-0.3, 0.4, 500), rng.normal(0.5, 0.4, 300)]
    seen = np.array([np.histogram(s, BINS + 1, (-LIMIT, LIMIT + 2 * LIMIT / BINS))[0] for s in scores])
    limit = url_filter.best_limit(seen)
    wrong = lambda x: np.mean(scores[0] >= x) + np.mean(scores[1] < x)
    assert wrong(limit) <= min(wrong(x) for x in np.linspace(-LIMIT, LIMIT, BINS + 1)) + 1e-9


def test_long_urls(spark):
    rows = [(k, f"http://a.{'net/de' if k % 2 else 'org/es'}/{k}") for k in range(40)] + [(99, "http://x.fr/" + "b/" * 400_000)]
    got = {r.page_id: r for r in url_filter.judged_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 41 and len(got[99].path) == 800_001 and got[1].verdict == "allow" and got[0].verdict == "block"
