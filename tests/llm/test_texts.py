"""Chat formatting, quality rules, decontamination, toxicity and language-model scores."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from editstrata.llm import chat_format, decontamination, lm_scoring, quality_rules, toxicity
from editstrata.llm._boosting import fit_forest
from editstrata.llm._text import hashed_words

SPACE = " \t\n\v\f\r"
control = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[\\INST]", "[OUT]", "[SYS]", "[/SYS]", "[ROLE:", "[/ROLE]", "<", "[", "\\", "]", "x", "é", "\n"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a]b%"]), st.lists(control, max_size=8).map("".join)), max_size=6))
def test_round_trip(turns):
    out = chat_format.BEGIN + "".join(chat_format.render_turn(r, t)[0] for r, t in turns)
    parser = chat_format.Parser()
    found = [x for k in range(0, len(out), 2) for x in parser.feed(out[k : k + 2])]
    assert [x[:2] for x in found] == turns and not parser.rest


def test_digests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    data = [(r.conv_id, r.turn, r.role, r.text, "clash") for r in rows] + [(900, 0, None, None, ""), (900, 1, "assistant", None, ""), (900, 1, "assistant", None, ""), (None, 0, "assistant", "</s>[INST]", "")]
    got = chat_format.digests(chat_format.formatted_turns(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, segment string"))).collect()
    by = {}
    for c, _, role, text, _ in sorted(data, key=lambda x: (str(x[0]), x[1], x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert len(got) == len(by)
    for r in got:
        turns = by[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r.formatted for r in chat_format.formatted(chat_format.formatted_turns(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, x string"))).collect()}
    assert {r.conv_id: r.formatted_chars for r in got} == {c: len(t) for c, t in whole.items()}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.formatted_turns(empty)).count() == 0


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(windows)
    repeat = {j for k, w in enumerate(windows) if n[w] > 1 for j in range(k, k + 3)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat), failed)


def test_quality_base(spark, sf_dir, docs, texts, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for r in quality_rules.quality_verdicts(docs, labels).collect():
        assert tuple(r[1:7]) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    rows = quality_rules.quality_verdicts(odd, labels.limit(0)).collect()
    assert len(rows) == 8 and not any(r.kept for r in rows) and all(r.base_failed for r in rows)
    assert quality_rules.passing(odd, labels).count() == 0
    assert quality_rules.quality_verdicts(odd.limit(0), labels).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "B", "1", "%", "é", "zürich", " ", "\t", "\n", "\x0b", "\u00a0", "\u2003", "\x00", "the", "!"]), max_size=60).map("".join)), max_size=8), st.sampled_from([8, 1 << 18]))
def test_statistics_are_exact(texts, piece):
    """Base statistics of any texts, in slices and with long texts in pieces."""
    from editstrata.llm import _text

    before, _text.PIECE = _text.PIECE, piece
    try:
        got = [row for numbers, _ in quality_rules.statistics(pa.array(texts, pa.string())) for row in numbers.tolist()]
    finally:
        _text.PIECE = before
    assert got == [list(base(t)[:5]) for t in texts]


def plain_tree_score(forest, row):
    """A forest's score, node by node."""
    total = forest.base
    for root in forest.roots:
        node = root
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return 1 / (1 + math.exp(-total))


def test_boosting_against_plain_code():
    """Node arrays score as the trees do; the first tree's root is the split of greatest gain by plain search."""
    rng = np.random.default_rng(2)
    x, signs = rng.integers(0, 12, (400, 3)).astype(float), np.array([1, -1, 0])
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 4, 400) > 0).astype(float)
    forest = fit_forest(x, y, signs, trees=7)
    assert np.allclose(forest.score(x[:50]), [plain_tree_score(forest, r) for r in x[:50]])
    p = y.mean()
    g, h = y - p, np.full(400, p * (1 - p))
    best = (-np.inf,)
    for f in range(3):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 49)[1:-1])):
            a = x[:, f] <= t
            if min(a.sum(), (~a).sum()) >= 10:
                vl, vr = g[a].sum() / (h[a].sum() + 1), g[~a].sum() / (h[~a].sum() + 1)
                if signs[f] * (vr - vl) >= 0:
                    best = max(best, (g[a].sum() * vl + g[~a].sum() * vr, f, -t))
    assert forest.feature[forest.roots[0]] == best[1]
    left = x[:, best[1]] <= forest.threshold[forest.roots[0]]
    gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left))
    assert gain == pytest.approx(best[0])


def test_quality_verdicts(spark):
    """Held out by doc_id: the trees, fitted on the others, agree with the labels."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(docs, labels.filter("doc_id % 3 <> 0")).collect()}
    held = [(r.quality, got[r.doc_id].kept) for r in labels.filter("doc_id % 3 = 0").collect() if not got[r.doc_id].base_failed]
    assert np.mean([bool(q) == k for q, k in held]) > 0.97
    kept = {r.doc_id for r in quality_rules.passing(docs, labels.filter("doc_id % 3 <> 0")).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_forest_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * np.sin(9 * x[:, 2]) + rng.normal(0, 0.3, 2000)) > 0).astype(float)
    f = fit_forest(x, y, np.array([1, -1, 0]))
    grid = np.repeat(rng.random((50, 3)), 20, 0)
    for k, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, k] = np.tile(np.linspace(0, 1, 20), 50)
        assert (sign * np.diff(f.score(g).reshape(50, 20), axis=1) >= -1e-12).all()
    assert ((f.score(x) > 0.5) == y).mean() > 0.8


def test_hashed_words_are_words(monkeypatch):
    from editstrata.llm import _text

    texts = ["Ab  cd\tAB\n", "", None, "é é x", "long " * 400 + "tail"]
    for piece in (16, 1 << 20):
        monkeypatch.setattr(_text, "PIECE", piece)
        seen, n = {}, []
        for _, hashes, counts in hashed_words(pa.array(texts)):
            n += counts.tolist()
            seen.setdefault("all", []).extend(hashes.tolist())
        assert n == [len((t or "").split()) for t in texts]
        words = [w.lower() for t in texts for w in (t or "").split()]
        assert [words.index(w) for w in words] == [seen["all"].index(h) for h in seen["all"]]


def test_leaks(spark, sf_dir, docs, texts, odd):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    norm = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = {r.item_id: norm(r.text).split(" ", 1)[1].rsplit(" ", 1)[0] for r in bench.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in norm(t)}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(docs, bench).collect()}
    assert want and got == want
    kept = {r.doc_id for r in decontamination.clean(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in want}
    planted = bench.limit(1).selectExpr("cast(null as bigint) as doc_id", "concat('before ', upper(text), ' after') as text")
    assert decontamination.contaminations(odd.select("doc_id", "text").unionByName(planted), bench).collect()[0].doc_id is None
    assert decontamination.clean(odd, bench).count() == 8 and decontamination.contaminations(odd, bench.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "share", "entries"), [(1, 0.5, 1 << 19), (2, 0.3, 1 << 19), (4, 0.2, 50), (60, 0.1, 1 << 19), (400, 0.2, 300), (400, 0.5, 1 << 19)])
def test_bounds_lose_nothing(spark, sf_dir, texts, n, share, entries, monkeypatch):
    """Retrieval against BM25 scores of all items for all passages, from counters; in pieces of entries too."""
    monkeypatch.setattr(decontamination, "ENTRIES", entries)
    items = dict(sorted({r.text: r.item_id for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}.items())[:n])
    items |= {t[:300]: 10_000 + k for k, t in texts.items() if len(t or "") > 400 and len(items) + k < n}
    tokens = {i: Counter(decontamination.term_hashes([t])[0].tolist()) for t, i in items.items()}
    freq = Counter(w for ws in tokens.values() for w in ws)
    mean = sum(sum(x.values()) for x in tokens.values()) / len(tokens)
    impact = {i: {w: math.log(1 + (len(tokens) - freq[w] + 0.5) / (freq[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sum(ws.values()) / mean)) for w, c in ws.items()} for i, ws in tokens.items()}
    shards = list(decontamination.indexes(spark.createDataFrame([(i, t) for t, i in items.items()], "item_id long, text string"), share=share, shard_bytes=1 << 20 if n < 400 else 20_000))
    assert sum(len(x.ids) for x in shards) == len(items) and (len(shards) > 1) == (n == 400)
    for text in list(texts.values())[:60]:
        words = decontamination.term_hashes([(text or "").lower()])[0]
        for index in shards:
            want = set()
            for p in range(0, len(words) // index.span + 1):
                have = set(words[p * index.span : (p + 2) * index.span].tolist())
                want |= {i for (i,) in index.ids if sum(impact[i].get(w, 0.0) for w in have) >= share * sum(impact[i].values()) - 1e-9 and have & set(impact[i])}
            got = {index.ids[k][0] for _, hashes, counts in hashed_words(pa.array([(text or "").lower()]), marks=True) for _, k in index.retrieve(hashes, counts)}
            assert got == want


def test_shards_of_items_are_one_search(spark, sf_dir, docs, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.contaminations(docs, bench).collect()))
    clean = sorted(r.doc_id for r in decontamination.clean(docs, bench).collect())
    monkeypatch.setattr(decontamination.indexes, "__kwdefaults__", decontamination.indexes.__kwdefaults__ | {"shard_bytes": 5_000})
    assert len(list(decontamination.indexes(bench))) > 1
    assert whole == sorted(map(tuple, decontamination.contaminations(docs, bench).collect())) and clean == sorted(r.doc_id for r in decontamination.clean(docs, bench).collect())


def test_short_items(spark):
    """Items of one or two words are found where these stand as such."""
    bench = spark.createDataFrame([(1, "zyxwv"), (2, "quokka wombat"), (3, "..."), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a Zyxwv, here"), (2, "zyxwvu"), (3, "the quokka wombat ran"), (4, "wombat and quokka"), (5, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminations(docs, bench).collect()} == {(1, 1), (3, 2)}


def test_toxicity(spark, odd):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(x.toxic, got[x.doc_id].predicted) for x in labels.collect() if got[x.doc_id].held_out]
    hits = sum(a and b for a, b in held)
    assert hits / sum(a for a, _ in held) > 0.85 and hits / sum(b for _, b in held) > 0.75
    rows = toxicity.toxicity_scores(odd, labels.limit(0)).collect()
    assert len(rows) == 8 and all(r.score < 0.01 for r in rows)
