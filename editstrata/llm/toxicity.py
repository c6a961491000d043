"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings (found once, twice, three times or more)
is trained in numpy from confirmed toxic documents
and from unlabelled text. The risk of the negative class is estimated on the unlabelled
texts less the class prior's share of positives, and is kept from falling below zero; so
the logistic output estimates the probability of being toxic although no clean document is marked as such.

All unlabelled texts count. A sample (FIT_ROWS positives and as many unlabelled texts, those with the least hash of
doc_id) names the candidates for words and gives the shape of the risk; the words are chosen by document frequencies over all
texts, and in each of ROUNDS rounds the unlabelled risk and its gradient are summed over all texts, and the sample's risk is
tilted by what it lacks to them, so that the minimum follows all texts. Texts are read twice: for the frequencies, and for a
slim table of the model's words in each text, from which risk, gradient and scores are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import kept, scratch, sent, written
from ._text import hashed_stems

#: Most positives, and most unlabelled texts, of the sample.
FIT_ROWS = 8_000
#: Most words and beginnings in the model, and documents that one must be in.
WORDS, LEAST_DOCS = 400, 4
#: Candidates for words: those that tell the classes apart best in the sample.
CANDIDATES = 20_000
#: Times that the sample's risk is tilted to that of all texts, and steps of descent in each.
ROUNDS, STEPS = 3, 200
#: Lengths of word beginnings in bytes, and counts in a text that make features.
PREFIXES, LEVELS = (5, 6, 7), (1, 2, 3)
#: Score from which a text is predicted toxic.
CUT = 0.3


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learnt from: crc32 of the id as text is 2 modulo 4. Null ids are not in it."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def _present(words: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index of word, times) for each of `words` (sorted) in each row."""
    if not len(words) or not len(hashes):
        return (np.empty(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    hit = words[at] == hashes
    both, n = np.unique(owner[hit] * len(words) + at[hit], return_counts=True)
    return both // len(words), both % len(words), n


@dataclass(frozen=True)
class Rows:
    """Texts by what they hold: entry e says that text owner[e] has feature feature[e]; feature word * levels + k is a word found LEVELS[k] times or more."""

    owner: np.ndarray
    feature: np.ndarray
    n: int

    @staticmethod
    def of(packed: pa.Array) -> Rows:
        """From lists of word * levels + level reached."""
        n = len(packed)
        owner = np.repeat(np.arange(n), packed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        codes = packed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        level = codes % len(LEVELS)
        parts = [(owner[level >= k], codes[level >= k] - level[level >= k] + k) for k in range(len(LEVELS))]
        return Rows(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]), n)

    def margin(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.feature], self.n) + w[-1]

    def back(self, each: np.ndarray, size: int) -> np.ndarray:
        """Sum of each text's number over its features, and over all texts for the bias."""
        return np.append(np.bincount(self.feature, each[self.owner], size - 1), each.sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def as_negative(rows: Rows, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the logistic losses of `rows` as negatives, and its gradient."""
    p = _sigmoid(rows.margin(w))
    return float(-np.log1p(-p + 1e-12).sum()), rows.back(p, len(w))


def train(positive: Rows, unlabelled: Rows, prior: float, w: np.ndarray, tilt: np.ndarray, more: float, *, steps: int = STEPS, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Minimises prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)) with logistic losses from `w` on, by Adam over all rows; R_U is the sample's plus more + tilt * (w - start)."""
    start, m, v = w.copy(), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp = _sigmoid(positive.margin(w))
        risk, g_u = as_negative(unlabelled, w)
        risk, g_u = risk / unlabelled.n + more + float(tilt @ (w - start)), g_u / unlabelled.n + tilt
        negative = risk - prior * float(np.mean(-np.log1p(-sp + 1e-12)))
        g_negative = g_u - prior * positive.back(sp, len(w)) / positive.n
        g = -g_negative if negative < 0 else prior * positive.back(sp - 1, len(w)) / positive.n + g_negative
        g = g + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _word_counts(words: np.ndarray):
    """By class (0 unlabelled, 1 positive), word and level: texts of a task that have it. Rows are (text, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, len(words) * len(LEVELS)), np.int64)
        for batch in batches:
            of = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, _, hashes, owner in hashed_stems(batch.column(0), PREFIXES):
                r, k, n = _present(words, hashes, owner)
                for level, least in enumerate(LEVELS):
                    for c in (0, 1):
                        mine = (n >= least) & (of[row + r] == c)
                        seen[c] += np.bincount(k[mine] * len(LEVELS) + level, minlength=seen.shape[1])
        c, at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at, pa.int32()), pa.array(seen[c, at])], ["class", "at", "n"])

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words and beginnings of each text (text, role), with the role."""
    for batch in batches:
        role = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
        for row, _, hashes, owner in hashed_stems(batch.column(0), PREFIXES):
            order = np.lexsort((hashes, owner))
            h, o = hashes[order], owner[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))) if len(h) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(role[row + o[first]])], ["word", "role"])


def chosen_words(sample: DataFrame, texts: DataFrame, sizes: tuple[int, int]) -> np.ndarray:
    """Hashes (sorted) of the words that tell positive texts from unlabelled ones best, by document frequencies over all of `texts` (text, positive); sizes: number of unlabelled and of positive texts."""
    named = sample.select("text", "role").mapInArrow(_distinct, "word long, role int").groupBy("word").agg(*(F.count_if(F.col("role").bitwiseAND(k) > 0).alias(c) for k, c in ((1, "p"), (2, "u"))))
    n_p, n_u = sample.agg(F.greatest(F.count_if(F.col("role").isin(1, 3)), F.lit(1)), F.greatest(F.count_if(F.col("role").isin(2, 3)), F.lit(1))).first()
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    apart = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)))
    named = named.filter(F.col("p") + F.col("u") >= LEAST_DOCS).orderBy(F.desc(apart), "word").limit(CANDIDATES).select("word")
    candidates = np.sort(named.toPandas()["word"].to_numpy(np.int64).view(np.uint64))
    if not len(candidates):
        return candidates
    held = sent(texts.sparkSession, candidates)
    counted = texts.select("text", "positive").mapInArrow(lambda batches: _word_counts(held())(batches), "class int, at int, n long").groupBy("class", "at").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((2, len(candidates) * len(LEVELS)))
    seen[counted["class"].to_numpy(), counted["at"].to_numpy()] = counted["n"].to_numpy()
    u, p = (seen[c] / max(sizes[c], 1) for c in (0, 1))
    share = seen.sum(0) / sum(sizes)
    z = np.abs(p - u) / np.sqrt(np.maximum(share * (1 - share + 1e-9), 1e-12) * (1 / max(sizes[0], 1) + 1 / max(sizes[1], 1)))
    best = np.where(seen.sum(0) >= LEAST_DOCS, z, 0).reshape(-1, len(LEVELS)).max(1)
    order = np.lexsort((candidates, -best))[:WORDS]
    return np.sort(candidates[order[best[order] > 4]])


def _held_words(words: np.ndarray):
    """Of each row (doc_id, held_out, role, text) the model's words with the level that each reaches, as word * levels + level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, rows, hashes, owner in hashed_stems(batch.column(3), PREFIXES):
                r, k, n = _present(words, hashes, owner)
                at = np.searchsorted(r, np.arange(rows + 1)).astype(np.int32)
                packed = k * len(LEVELS) + np.minimum(n, LEVELS[-1]) - 1
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, rows) for c in range(3)), pa.ListArray.from_arrays(at, pa.array(packed.astype(np.int32)))], ["doc_id", "held_out", "role", "words"])

    return run


def _risk_sums(w: np.ndarray):
    """A task's sums of loss and gradient over rows (words): place -1 is the loss, then the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient = 0.0, np.zeros(len(w))
        for batch in batches:
            x, g = as_negative(Rows.of(batch.column(0)), w)
            loss, gradient = loss + x, gradient + g
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(w)), pa.int32()), pa.array(np.append(loss, gradient))], ["place", "x"])

    return run


def fit(rows: DataFrame, size: int, prior: float, *, rounds: int = ROUNDS, steps: int = STEPS) -> np.ndarray:
    """Weights by feature, and the bias, from `rows` (doc_id, role, words): role 1 confirmed, 2 in the sample of unlabelled texts, 3 both, 0 neither. All of them, the confirmed too, are texts whose label the unlabelled risk does not ask for."""
    sample = rows.filter("role > 0").select("doc_id", "role", "words").toArrow()
    order = np.lexsort((sample.column("doc_id").to_numpy(), sample.column("role").to_numpy()))  # the same sums whatever the order of rows
    sample = sample.take(pa.array(order)).combine_chunks()
    role, words = sample.column("role").to_numpy(), sample.column("words").combine_chunks()
    positive, unlabelled = (Rows.of(words.filter(pa.array((role & k) > 0))) for k in (1, 2))
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    everything = rows.filter("role >= 0").select("words")
    n = everything.count()
    tilt, more = np.zeros_like(w), 0.0
    for k in range(rounds):
        if k:  # all texts' risk at this point, less what the sample says
            held = w.copy()
            sums = everything.mapInArrow(lambda batches: _risk_sums(held)(batches), "place int, x double").groupBy("place").agg(F.sum(F.round("x", 6)).alias("x")).toPandas().sort_values("place")["x"].to_numpy()
            loss, g = as_negative(unlabelled, w)
            more, tilt = sums[0] / n - loss / unlabelled.n, sums[1:] / n - g / unlabelled.n
        w = train(positive, unlabelled, prior, w, tilt, more, steps=steps)
    return w


def toxicity_scores(documents: DataFrame, labels: DataFrame, *, cut: float = CUT, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= cut) for every row of `documents` (doc_id, text).

    Scores depend on the words of the whole text alone. Null and empty texts have no words
    and get the score of the bias. Repeated rows get equal scores. Labels that are null, held
    out or of unknown documents teach nothing; without a confirmed toxic document all
    scores are about 0. Rows without an id are scored and teach nothing. Other columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    doc_id = F.col("doc_id").cast("long")
    docs = documents.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text")
    none = docs.select("doc_id", "held_out", F.lit(float(_sigmoid(np.array(-30.0)))).alias("score"), F.lit(0).alias("predicted"))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.agg(F.avg("toxic").alias("prior"), F.sum("toxic").alias("n")).first()
    if not total["n"]:
        return none
    prior = float(np.clip(total["prior"], 0.001, 0.9))

    def least(ids: DataFrame) -> DataFrame:
        return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    with scratch(spark):
        teaches = F.col("doc_id").isNotNull() & ~F.col("held_out")
        confirmed = least(known.filter("toxic = 1").select("doc_id")).withColumn("role", F.lit(1))
        unlabelled = least(docs.filter(teaches).select("doc_id")).distinct().withColumn("role", F.lit(2))
        chosen = written(confirmed.unionByName(unlabelled).groupBy("doc_id").agg(F.sum("role").cast("int").alias("role")), "chosen")
        marked = docs.join(F.broadcast(chosen), "doc_id", "left").withColumn("role", F.when(teaches, F.coalesce("role", F.lit(0))).otherwise(F.lit(-1)))
        sizes = {r["positive"]: r["count"] for r in marked.filter("role >= 0").groupBy(F.col("role").isin(1, 3).alias("positive")).count().collect()}
        if not (sizes.get(True) and sizes.get(False)):
            return none
        words = chosen_words(marked.filter("role > 0"), marked.filter("role >= 0").withColumn("positive", F.col("role").isin(1, 3)), (sizes[False], sizes[True]))
        rows = kept(marked.select("doc_id", "held_out", "role", "text").mapInArrow(_held_words(words), "doc_id long, held_out boolean, role int, words array<int>"), "held-words")
        w = fit(rows, len(words) * len(LEVELS), prior, rounds=rounds)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _sigmoid(Rows.of(batch.column(2)).margin(w))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "words").mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
