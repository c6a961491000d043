"""URL filter: host and path rules, then the ratio of two character language models.

The rules decide where they fit, and the URLs that they decide train the models: one on
accepted, one on rejected URLs. Each is a variable-order Markov model over bytes: an order's
counts are smoothed by PRIOR pseudo-counts from the next lower order, so that rare contexts fall
back to shorter ones. Strings up to ORDER bytes and a next one are counted exactly, by 64-bit hash, and an order keeps those
that make up at least 1 / 2**BITS of its class's characters; what is rarer is left to the shorter contexts. So the models have
the same strings at every size, and at most 2**BITS an order and class, which bounds what is sent to the tasks. A URL's score is the
difference of the two log-likelihoods per character; it is rejected above a limit chosen
on a fold of the URLs that the rules decide, which the models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import sent
from ._text import mix

#: Longest context in bytes, and least share of a class's characters that a string is kept from.
ORDER, BITS = 5, 17
#: Bytes of URLs that are read at once; one of FOLDS folds is held out for the limit.
PIECE, FOLDS = 1 << 18, 5
#: Pseudo-counts that a context takes from the next shorter one.
PRIOR = 2.0
#: Bins of the score for calibration, over [-LIMIT, LIMIT] nats a character.
BINS, LIMIT = 400, 4.0


@dataclass(frozen=True)
class Rule:
    """A rule fits a host and all its subdomains where the path starts with the rule's."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


RULES = (Rule("com/en/", "block"), Rule("example.com/en/7", "allow"), Rule("net/de/", "allow"), Rule("example.net/de/8", "block"), Rule("org/es/", "block"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def with_rule(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds host, path, rule and ruled (the rule's verdict); the longest rule that fits wins, then the one with the longer host."""
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule = ruled = None
    for r in sorted(rules, key=lambda r: (-len(r.rule), -len(r.host), r.rule)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.rule) if rule is None else rule.when(fits, r.rule)
        ruled = F.when(fits, r.verdict) if ruled is None else ruled.when(fits, r.verdict)
    missing = F.lit(None).cast("string")
    return out.withColumns({"rule": missing if rule is None else rule, "ruled": missing if ruled is None else ruled})


def _parts(urls: list[str | None]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(owners, segments) of about PIECE bytes: each URL with its begin and end marks, long ones in segments that begin with ORDER bytes of context."""
    owners, segments, held = [], [], 0
    for k, u in enumerate(urls):
        text = b"\x01" * ORDER + (u or "").encode("utf-8", "surrogatepass") + b"\x02"
        for at in range(ORDER, len(text), PIECE):
            segments.append(text[at - ORDER : at + PIECE])
            owners.append(k)
            held += len(segments[-1])
            if held >= PIECE:
                yield np.array(owners), segments
                owners, segments, held = [], [], 0
    if segments:
        yield np.array(owners), segments


def _strings(owners: np.ndarray, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte after the context: hashes of the contexts of lengths 0 to ORDER, of each with the byte, and the URL's number."""
    data = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint64)
    size = np.array([len(t) for t in segments])
    owner = np.repeat(np.arange(len(segments)), size)
    at = np.flatnonzero(np.arange(len(data)) - (np.cumsum(size) - size)[owner] >= ORDER)
    contexts, strings = np.empty((ORDER + 1, len(at)), np.uint64), np.empty((ORDER + 1, len(at)), np.uint64)
    h = np.zeros(len(at), np.uint64)
    byte = (data[at] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    for k in range(ORDER + 1):
        contexts[k] = mix(h + np.uint64(k))
        strings[k] = mix(contexts[k] ^ byte)
        if k < ORDER:
            h = (h ^ (data[at - k - 1] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return contexts, strings, owners[owner[at]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of strings by class, with their contexts, piece by piece; rows are (url, blocked)."""
    for batch in batches:
        blocked = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for part in _parts(batch.column(0).to_pylist()):
            contexts, strings, owner = _strings(*part)
            for c in (False, True):
                mine = blocked[owner] == c
                keys, at, n = np.unique(strings[:, mine].ravel(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c)), pa.array(contexts[:, mine].ravel()[at].view(np.int64)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["blocked", "context", "string", "n"])


def _found(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts (class, place) of the wanted keys, 0 for others."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[:, at], 0)


@dataclass(frozen=True)
class Model:
    """Sorted hashes of strings and contexts with their counts by class: accepted, rejected."""

    strings: np.ndarray
    string_counts: np.ndarray
    contexts: np.ndarray
    context_counts: np.ndarray
    limit: float = 0.0

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Log-likelihood as a rejected URL less that as an accepted one, per character."""
        total, n = np.zeros(len(urls)), np.zeros(len(urls))
        for part in _parts(urls):
            contexts, strings, owner = _strings(*part)
            p = np.full((2, len(owner)), 1 / 256)
            for k in range(ORDER + 1):
                p = (_found(self.strings, self.string_counts, strings[k]) + PRIOR * p) / (_found(self.contexts, self.context_counts, contexts[k]) + PRIOR)
            total += np.bincount(owner, np.log(p[1] / p[0]), len(urls))
            n += np.bincount(owner, minlength=len(urls))
        return total / np.maximum(n, 1)


def best_limit(seen: np.ndarray) -> float:
    """The score at which the share of accepted URLs at or above it and of rejected ones below it are least; seen[class, bin] counts URLs."""
    share = seen / np.maximum(seen.sum(1, keepdims=True), 1)
    errors = np.concatenate([[0], share[1].cumsum()]) + 1 - np.concatenate([[0], share[0].cumsum()])  # a limit at each bin's lower edge
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(best[(len(best) - 1) // 2]) / BINS * 2 * LIMIT - LIMIT


def trained(rows: DataFrame) -> Model | None:
    """Models from all `rows` (url, blocked); None unless both classes occur."""
    totals = {r["blocked"]: r["n"] for r in rows.groupBy("blocked").agg(F.sum(F.octet_length(F.coalesce("url", F.lit(""))) + 1).alias("n")).collect()}
    if len(totals) < 2:
        return None
    counts = rows.mapInArrow(_count, "blocked boolean, context long, string long, n long").groupBy("blocked", "context", "string").agg(F.sum("n").alias("n"))
    often = F.col("n") * (1 << BITS) >= F.when(F.col("blocked"), totals[True]).otherwise(totals[False])
    known = counts.filter(often).toPandas()

    def table(column: str) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(known[column].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        n = np.zeros((2, len(keys)))
        np.add.at(n, (known["blocked"].to_numpy().astype(np.int64), at), known["n"].to_numpy())
        return keys, n

    return Model(*table("string"), *table("context"))


def fit(ruled: DataFrame) -> Model | None:
    """Models from rows (url, ruled) that a rule decides, and the limit from a fold of them; None unless both verdicts occur among those learnt from."""
    rows = ruled.filter("ruled is not null").select("url", (F.col("ruled") == "block").alias("blocked"))
    aside = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    model = trained(rows.filter(~aside))
    if model is None:
        return None
    held = sent(ruled.sparkSession, model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BINS + 1), np.int64)
        for batch in batches:
            score = np.clip(held().score(batch.column(0).to_pylist()), -LIMIT, LIMIT)
            at = np.floor((score + LIMIT) / (2 * LIMIT) * BINS).astype(np.int64)
            np.add.at(seen, (batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), at), 1)
        c, at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at, pa.int32()), pa.array(seen[c, at])], ["class", "at", "n"])

    seen = np.zeros((2, BINS + 1))
    for r in rows.filter(aside).mapInArrow(bins, "class int, at int, n long").groupBy("class", "at").agg(F.sum("n").alias("n")).collect():
        seen[r["class"], r["at"]] = r["n"]
    return replace(model, limit=best_limit(seen) if seen.sum(1).all() else 0.0)


def judged_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, score and verdict for every row of `pages` (page_id, url).

    The verdict is the longest fitting rule's; where none fits it is block if the score
    reaches the calibrated limit, else allow. A null url, or one without ://, has an empty host and
    path and is scored as it is (null as the empty text). If the rules do not show
    both verdicts, nothing is learnt: scores are 0 and the verdict allow. Repeated rows
    get equal results; other columns are ignored; an empty table gives an empty result.
    """
    rows = with_rule(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), rules)
    fitted = fit(rows)
    held = sent(pages.sparkSession, fitted)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        for batch in batches:
            urls = batch.column(1).to_pylist()
            score = np.zeros(len(urls)) if model is None else model.score(urls)
            own = np.full(len(urls), "allow", object) if model is None else np.where(score >= model.limit, "block", "allow").astype(object)
            verdict = [r or o for r, o in zip(batch.column(5).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(k) for k in (2, 3, 4)), pa.array(score), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "score", "verdict"])

    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, score double, verdict string")
