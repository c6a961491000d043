"""Cross-entropy difference between a target and a background language model.

Every document belongs to the target or to the background, and both models are class bigram models over one vocabulary,
all words of the corpus. A word of more than 1 / HOT of all tokens is a class of its own, the others are one class, in
which a word has its share of the class's tokens:

    P(w | h) = (n(h, c) + PRIOR * P(c)) / (n(h) + PRIOR) * P(w | c),  h and c the classes of both words

The background's counts are scaled to the target's number of tokens, so that smoothing weighs alike in both models. A
document's own tokens are taken out of its model's counts (of pairs, histories and rare words) before it is scored. A document's
score is its loss per token (bits) under the target model less that under the background model: the lower, the more like the target.

Tasks count words, then pairs of classes, in pieces, and Spark sums the pieces into written tables, which grow with the
corpus. Frequent words and pairs (those over 1 / HOT and 1 / HOT_PAIRS of all tokens, so less than HOT and HOT_PAIRS of them: 26 MB at most) are broadcast; what a
text holds besides meets the tables in one join by key. A key outside the broadcast has so few rows that no task of that join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import sent, written
from ._text import hashed_words

#: A word of more than 1 / HOT of all tokens is frequent, and a pair of more than 1 / HOT_PAIRS.
HOT, HOT_PAIRS = 1 << 16, 1 << 20
PRIOR = 4.0
#: Tokens gathered before they are counted.
_GATHER = 1 << 20
#: Class numbers of rare words and of a text's beginning, and bits of a class number.
_RARE, _START, _BITS = 0, 1, 20
_COUNTS = "key long, t long, b long"


def _counted(keys: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """Each key with how often it occurs in target texts and in others."""
    order = np.argsort(keys, kind="stable")
    keys, own = keys[order], own[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    t = np.add.reduceat(own.astype(np.int64), first)
    n = np.diff(np.append(first, len(keys)))
    return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(t), pa.array(n - t)], ["key", "t", "b"])


def _count(keys_of):
    """Counts of the keys that keys_of(hashes, words of each row) gives; rows are (text, target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owns, held = [], [], 0
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for at, hashes, counts in hashed_words(batch.column(0)):
                if len(hashes):
                    keys.append(keys_of(hashes, counts))
                    owns.append(np.repeat(target[at : at + len(counts)], counts))
                    held += len(hashes)
                if held >= _GATHER:
                    yield _counted(np.concatenate(keys), np.concatenate(owns))
                    keys, owns, held = [], [], 0
        if held:
            yield _counted(np.concatenate(keys), np.concatenate(owns))

    return run


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words by sorted hash (class k + 2 is the k-th), counts by class (row 0 target, 1 background) as histories and as words, and sizes."""

    frequent: np.ndarray
    history: np.ndarray
    word: np.ndarray
    rare: int  # distinct rare words
    scale: float  # of the background's counts

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.full(len(hashes), _RARE)
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == hashes, at + 2, _RARE)

    def pairs(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and number of the class pair that it ends."""
        now = self.classes(hashes)
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[(np.cumsum(counts) - counts)[counts > 0]] = _START
        return now, before << _BITS | now

    def prior(self) -> np.ndarray:
        """PRIOR times each class's share of the tokens, by model."""
        n = self.word * np.array([[1.0], [self.scale]])
        return PRIOR * (n + 1) / (n.sum(1, keepdims=True) + n.shape[1])


def _distinct(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key) in order, and how often each occurs."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))) if len(keys) else np.empty(0, np.int64)
    return owner[first], keys[first], np.diff(np.append(first, len(keys)))


def vocabulary(texts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of `texts` (text, target), and the counts (key, t, b) of its rare words."""
    words = written(texts.mapInArrow(_count(lambda hashes, _: hashes), _COUNTS).groupBy("key").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "words")
    whole = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("t", "b")), F.count("*").alias("words")).first()
    often = F.col("t") + F.col("b") > (whole["t"] + whole["b"]) / HOT
    top = words.filter(often).toPandas()
    top["key"] = top["key"].to_numpy(np.int64).view(np.uint64)
    top = top.sort_values("key")
    counts = np.zeros((2, len(top) + 2), np.int64)
    counts[:, 2:] = top[["t", "b"]].to_numpy().T
    counts[:, _RARE] = np.array([whole["t"], whole["b"]]) - counts.sum(1)
    scale = whole["t"] / whole["b"] if whole["t"] and whole["b"] else 1.0
    return Vocabulary(top["key"].to_numpy(np.uint64), np.zeros_like(counts), counts, whole["words"] - len(top), scale), words.filter(~often)


def cross_entropy_differences(documents: DataFrame, target: Column) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score for every row of `documents` (doc_id, text).

    `target` is true for the rows that the target model is counted over; all others, nulls too, are the background's.
    Losses are bits per token over the whole text; score is their difference. A word is
    a run of characters other than space and U+0009 to U+000D, A-Z lower-cased.
    Null and empty texts have no token and losses and score of 0. Repeated rows count each time and get
    equal scores. A model without texts is left with the smoothing alone; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("text").alias("text"), F.coalesce(target, F.lit(False)).alias("target"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text", "target"))  # by content: a task that runs again tells the same
    texts = rows.select("text", "target")
    words, rare = vocabulary(texts)
    plain = sent(spark, words)
    pairs = texts.mapInArrow(_count(lambda hashes, counts: plain().pairs(hashes, counts)[1]), _COUNTS).groupBy("key").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    pairs = written(pairs, "pairs")
    before = pairs.groupBy(F.shiftright("key", _BITS).alias("h")).agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toPandas()
    words.history[:, before["h"].to_numpy(np.int64)] = before[["t", "b"]].to_numpy(np.int64).T
    known = sent(spark, words)
    often = F.col("t") + F.col("b") > float(words.word.sum()) / HOT_PAIRS
    top = pairs.filter(often).toPandas().sort_values("key")
    hot = sent(spark, (top["key"].to_numpy(np.int64), top[["t", "b"]].to_numpy(np.int64).T))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text (kind 2) with its tokens and what its classes and frequent pairs add to its losses, and rows of its other pairs (kind 0) and rare words (kind 1), whose number is negative in the background."""
        v, (hot_keys, hot_counts) = known(), hot()
        prior, scale = v.prior(), np.array([1.0, v.scale])
        for batch in batches:
            in_target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for at, hashes, counts in hashed_words(batch.column(0)):
                rows = len(counts)
                mine = in_target[at : at + rows]
                sums = np.zeros((2, rows))
                owner = np.repeat(np.arange(rows), counts)
                now, pair = v.pairs(hashes, counts) if len(hashes) else (np.empty(0, np.int64),) * 2
                h_owner, h, h_n = _distinct(owner, pair >> _BITS)
                seldom = now == _RARE
                r_owner, r_word, r_n = _distinct(owner[seldom], hashes[seldom])
                r_all = np.bincount(owner[seldom], minlength=rows)
                p_owner, p, p_n = _distinct(owner, pair)
                place = np.minimum(np.searchsorted(hot_keys, p), max(len(hot_keys) - 1, 0))
                is_hot = hot_keys[place] == p if len(hot_keys) else np.zeros(len(p), bool)
                for m in (0, 1):
                    own = (mine if m == 0 else ~mine).astype(np.int64)
                    sums[m] += np.bincount(h_owner, h_n * np.log2((v.history[m, h] - h_n * own[h_owner]) * scale[m] + PRIOR), rows)
                    sums[m] += r_all * np.log2((v.word[m, _RARE] - r_all * own) * scale[m] + max(v.rare, 1))
                    if is_hot.any():
                        n, o = p_n[is_hot], p_owner[is_hot]
                        sums[m] -= np.bincount(o, n * np.log2((hot_counts[m, place[is_hot]] - n * own[o]) * scale[m] + prior[m, p[is_hot] & ((1 << _BITS) - 1)]), rows)
                names = ["row", "kind", "key", "k", "doc_id", "t_sum", "b_sum"]
                here, ids = batch.column(3).slice(at, rows), batch.column(2).slice(at, rows)
                yield pa.RecordBatch.from_arrays([here, pa.array(np.full(rows, 2, np.int8)), here, pa.array(counts.astype(np.int32)), ids, pa.array(sums[0]), pa.array(sums[1])], names)
                for kind, o, key, n in ((0, p_owner[~is_hot], p[~is_hot], p_n[~is_hot]), (1, r_owner, r_word.view(np.int64), r_n)):
                    empty, place = [pa.nulls(len(o), pa.float64())] * 2, pa.array(o)
                    yield pa.RecordBatch.from_arrays([here.take(place), pa.array(np.full(len(o), kind, np.int8)), pa.array(key), pa.array(np.where(mine[o], n, -n).astype(np.int32)), ids.take(place), *empty], names)

    items = rows.select("text", "target", "doc_id", "row").mapInArrow(read, "row long, kind byte, key long, k int, doc_id long, t_sum double, b_sum double")
    counts = pairs.filter(~often).select(F.lit(0).cast("byte").alias("kind"), "key", "t", "b").unionByName(rare.select(F.lit(1).cast("byte").alias("kind"), "key", "t", "b"))
    prior = words.prior()
    classes = spark.createDataFrame([(k, float(prior[0, k]), float(prior[1, k])) for k in range(prior.shape[1])], "class long, t_prior double, b_prior double")
    found = items.join(counts, ["kind", "key"], "left").withColumn("class", F.when(F.col("kind") == 0, F.col("key").bitwiseAND((1 << _BITS) - 1))).join(F.broadcast(classes), "class", "left")
    left = {"t": F.col("t") - F.greatest("k", F.lit(0)), "b": (F.col("b") + F.least("k", F.lit(0))) * words.scale}
    losses = [F.sum(F.when(F.col("kind") == 2, F.col(f"{m}_sum")).otherwise(-F.abs("k") * F.log2(left[m] + F.when(F.col("kind") == 0, F.col(f"{m}_prior")).otherwise(1.0)))).alias(m) for m in ("t", "b")]
    scored = found.groupBy("doc_id", "row").agg(F.max(F.when(F.col("kind") == 2, F.col("k"))).cast("long").alias("n_tokens"), F.count_if(F.col("kind") == 2).alias("copies"), *losses)
    scored = scored.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))  # repeated rows meet in one sum
    mean = {f"{name}_loss": F.col(m) / F.col("copies") / F.greatest("n_tokens", F.lit(1)) for m, name in (("t", "target"), ("b", "background"))}
    return scored.withColumns(mean).select("doc_id", "n_tokens", *mean, (F.col("target_loss") - F.col("background_loss")).alias("score"))
