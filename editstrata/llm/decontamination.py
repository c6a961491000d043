"""Benchmark decontamination: BM25 with block-max pruning, then overlap checks.

The test items are the indexed collection: postings by term, in blocks of items of like thresholds, each with the
largest impact that any item of the block has. Training texts are cut into overlapping passages, which are the queries; those of
a slice of texts are searched at once. As in WAND, a passage whose terms' largest impacts do not add up to the least threshold is
skipped whole. Of another the terms of least impact that together stay below it cannot lift an item alone: only
the blocks of its other terms are opened, and of these only where block maxima and the rest's largest impacts reach
the least threshold in the block. Items of open blocks are scored in full. So nothing that reaches its threshold is passed over,
whatever the number of items and however common their terms. An item is retrieved if the passage's score reaches `share` of the
score that the item gets from its own text, and reported if enough of the word n-grams of its question
and of its answer occur in the document (the whole of an item that is shorter). Items of equal text are searched for once.

Terms are counted by Spark; the index goes to the tasks in shards of about SHARD_BYTES of item text, as arrays, so a benchmark
of any size is searched in bounded memory. The texts are read once a shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import fresh, scratch, sent, written
from ._text import hashed_words

#: Items in a block.
BLOCK = 4
#: Share of an item's own score from which it is retrieved, and of its n-grams from which it is confirmed.
SHARE, OVERLAP = 0.5, 0.6
#: Words in a n-gram of the confirmation.
GRAM = 3
#: Words that question and answer must have to be cut by sentences.
LEAST_PART = 8
#: Text of items in one shard of the index.
SHARD_BYTES = 8 << 20
K1, B = 1.2, 0.75
#: Hashes of leaking rows up to this number are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Entries of passages, blocks and items that are worked on at once.
ENTRIES = 1 << 19
#: Slack for sums in another order.
_EPS = 1e-9

_WORD = re.compile(r"\w+")
_ENDS = re.compile(r"[.?!\n]\s*")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


def term_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashed terms of each text: lower-cased runs of bytes other than ASCII punctuation and spaces."""
    out = []
    for _, hashes, counts in hashed_words(pc.utf8_lower(pa.array(texts, pa.string())), marks=True):
        out += np.split(hashes, np.cumsum(counts)[:-1])
    return out


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence, and those of the last sentence; where either is short, the last third of the words is the answer."""
    parts = [w for w in map(words_of, _ENDS.split(text)) if w]
    flat = [w for p in parts for w in p]
    if parts and LEAST_PART <= len(parts[-1]) <= len(flat) - LEAST_PART:
        return flat[: -len(parts[-1])], parts[-1]
    cut = len(flat) - len(flat) // 3
    return flat[:cut], flat[cut:]


def _grams(words: list[str], size: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size > 0 else set()


def _ranges(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start[w] to start[w + 1] for each w of `which`, one after another, and how many each has."""
    n = start[which + 1] - start[which]
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[which], n), n


def _cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of entries whose sizes sum to about ENTRIES."""
    if not len(sizes):
        return []
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // ENTRIES)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)], strict=True))


@dataclass(frozen=True)
class Index:
    """An inverted index of items, in blocks of BLOCK; terms are sorted hashes."""

    ids: list[list[int]]  # of each text
    texts: list[str]
    terms: np.ndarray
    start: np.ndarray  # of each term's postings
    item: np.ndarray
    impact: np.ndarray
    keys: np.ndarray  # of the postings: term number times items, and item
    term_max: np.ndarray
    block_start: np.ndarray  # of each term's blocks
    block: np.ndarray
    block_max: np.ndarray
    needed: np.ndarray  # by item
    block_needed: np.ndarray
    span: int  # words of a passage's half

    @staticmethod
    def build(ids: list[list[int]], texts: list[str], owner: np.ndarray, term: np.ndarray, n: np.ndarray, freq: np.ndarray, share: float, total: int, mean: float) -> Index:
        """From postings (owner: number of the text; term, times, texts of the whole benchmark with the term), the number of all texts and their mean length."""
        length = np.bincount(owner, n, len(texts))
        norm = K1 * (1 - B + B * length / max(mean, 1e-9))
        impact = np.log(1 + (total - freq + 0.5) / (freq + 0.5)) * n * (K1 + 1) / (n + norm[owner])
        needed = np.maximum(share * np.bincount(owner, impact, len(texts)), 1e-9)
        rank = np.argsort(needed, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        order = np.lexsort((place[owner], term))
        item, impact, term = place[owner][order], impact[order], term[order]
        terms, start = np.unique(term, return_index=True)
        at = np.searchsorted(terms, term)
        pair, first = np.unique(at * (len(texts) // BLOCK + 1) + item // BLOCK, return_index=True)
        blocks = -(-len(texts) // BLOCK)
        return Index(
            [ids[k] for k in rank], [texts[k] for k in rank], terms, np.append(start, len(term)), item, impact, at * len(texts) + item,
            np.maximum.reduceat(impact, start) if len(term) else impact,
            np.searchsorted(at[first], np.arange(len(terms) + 1)), item[first] // BLOCK, np.maximum.reduceat(impact, first) if len(term) else impact,
            needed[rank], needed[rank][np.arange(blocks) * BLOCK], int(max([16, *length])),
        )

    def _passages(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (passage, term) of known terms, in order, and the number of the first passage of each row; passage p of a row has its words from p * span to (p + 2) * span."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        word = np.flatnonzero(self.terms[at] == hashes)
        begin = np.cumsum(counts) - counts
        row = np.searchsorted(begin + counts, word, side="right")
        half = (word - begin[row]) // self.span
        base = np.cumsum(counts // self.span + 1) - (counts // self.span + 1)
        passage, term, back = base[row] + half, at[word], half > 0
        both = np.unique(np.concatenate([passage, passage[back] - 1]) * len(self.terms) + np.concatenate([term, term[back]]))
        return both // len(self.terms), both % len(self.terms), base

    def retrieve(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) for the items that some passage of a row reaches the threshold of."""
        if not len(hashes) or not len(self.terms):
            return []
        passage, term, base = self._passages(hashes, counts)
        least = self.needed[0] - _EPS
        may = np.bincount(passage, self.term_max[term], passage[-1] + 1 if len(passage) else 0) >= least
        live = may[passage]
        passage, term = passage[live], term[live]
        if not len(passage):
            return []
        number = np.cumsum(np.append(False, passage[1:] != passage[:-1]))  # passages left, counted from 0
        names = passage[np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))]
        order = np.lexsort((self.term_max[term], number))
        top, heavy = self.term_max[term[order]], np.empty(len(term), bool)
        upto = np.cumsum(top)
        first = np.searchsorted(number, np.arange(len(names) + 1))
        heavy[order] = upto - np.append(0, upto)[first[number]] >= least - _EPS * upto[-1]
        rest = np.bincount(number[~heavy], self.term_max[term[~heavy]], len(names))
        found = []
        some = np.flatnonzero(heavy)
        for lo, hi in _cuts(self.block_start[term[some] + 1] - self.block_start[term[some]]):
            # a passage that a cut parts is opened in both parts, its other heavy terms counted with their largest impacts
            here = some[lo:hi]
            slots, n = _ranges(self.block_start, term[here])
            pair, back = np.unique(np.repeat(number[here], n) * len(self.block_needed) + self.block[slots], return_inverse=True)
            p, b = pair // len(self.block_needed), pair % len(self.block_needed)
            away = np.bincount(number[some], self.term_max[term[some]], len(names)) - np.bincount(number[here], self.term_max[term[here]], len(names))
            opened = np.flatnonzero(np.bincount(back, self.block_max[slots]) + rest[p] + away[p] >= self.block_needed[b] - _EPS)
            found.append(pair[opened])
        pair = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        out = [self._reached(pair[lo:hi], term, first) for lo, hi in _cuts((first[pair // len(self.block_needed) + 1] - first[pair // len(self.block_needed)]) * BLOCK)]
        reached = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 2
        rows = np.searchsorted(base, names[reached[0]], side="right") - 1
        return sorted(set(zip(rows.tolist(), reached[1].tolist(), strict=True)))

    def _reached(self, pair: np.ndarray, term: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of open pairs of passage and block, by full scores."""
        p, b = np.repeat(pair // len(self.block_needed), BLOCK), (pair % len(self.block_needed))[:, None] * BLOCK + np.arange(BLOCK)
        item = b.ravel()
        p, item = p[item < len(self.needed)], item[item < len(self.needed)]
        at, n = _ranges(first, p)
        which = np.repeat(np.arange(len(p)), n)
        wanted = term[at] * len(self.needed) + item[which]
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        score = np.bincount(which, np.where(self.keys[place] == wanted, self.impact[place], 0.0), len(p))
        hit = score >= self.needed[item] - _EPS
        return p[hit], item[hit]

    def leaks(self, texts: pa.Array, overlap: float) -> Iterator[tuple[int, int, float, float]]:
        """(row, item, share of its question's n-grams, share of its answer's) for confirmed items."""
        for first, hashes, counts in ((at + f, *rest) for at in range(0, len(texts), 1024) for f, *rest in hashed_words(pc.utf8_lower(texts.slice(at, 1024)), marks=True)):
            last, words, have = -1, [], {}
            for row, k in self.retrieve(hashes, counts):
                if row != last:
                    last, words, have = row, words_of(texts[first + row].as_py()), {}
                shares = []
                for part in question_and_answer(self.texts[k]):
                    size = min(GRAM, len(part))
                    if size not in have:
                        have[size] = _grams(words, size)
                    wanted = _grams(part, size)
                    shares.append(len(wanted & have[size]) / len(wanted) if wanted else 1.0)
                if min(shares) >= overlap:
                    for item in self.ids[k]:
                        yield first + row, item, *shares


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each text (number, text) with how often it has them."""
    for batch in batches:
        for row, hashes, counts in hashed_words(pc.utf8_lower(batch.column(1)), marks=True):
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((hashes, owner))
            o, h = owner[order], hashes[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))) if len(h) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + o[first])), pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(h))).astype(np.int64))], ["number", "term", "n"])


def indexes(benchmark: DataFrame, *, share: float = SHARE, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """Index shards of `benchmark` (item_id, text); one is on the driver at a time. Equal texts are one item with several ids.

    Items that are null, without an id or without a word are not searched for.
    """
    with scratch(benchmark.sparkSession):
        rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
        rows = written(rows.filter(F.col("text").rlike(r"[\p{L}\p{N}_]")).withColumn("number", F.xxhash64("text")), "items")
        size = rows.agg(F.sum(F.octet_length("text") + 8 * F.size("ids"))).first()[0] or 0
        shards = -(-size // shard_bytes) if size > shard_bytes else 1
        of = F.pmod(F.col("number"), F.lit(shards)).alias("shard")
        terms = written(rows.select("number", "text").mapInArrow(_postings, "number long, term long, n long"), "terms")
        whole = terms.agg(F.sum("n").alias("words"), F.count_distinct("number").alias("texts")).first()
        if not whole["texts"]:
            return
        freq = terms.groupBy("term").agg(F.count("*").alias("freq"))
        postings = written(terms.join(freq, "term").select(of, "number", "term", "n", "freq"), "postings")
        for shard in range(shards):
            items = {r["number"]: (r["ids"], r["text"]) for r in rows.filter(of == shard).orderBy(F.col("ids")[0], "text").collect()}
            found = postings.filter(F.col("shard") == shard).toArrow()
            number, term, n, freq_of = (found.column(c).to_numpy() for c in ("number", "term", "n", "freq"))
            order = {k: i for i, k in enumerate(k for k in items if k in set(number.tolist()))}
            if order:
                owner = np.array([order[k] for k in number.tolist()], np.int64)
                yield Index.build([items[k][0] for k in order], [items[k][1] for k in order], owner, term.view(np.uint64), n, freq_of, share, whole["texts"], whole["words"] / whole["texts"])


def contaminations(documents: DataFrame, benchmark: DataFrame, *, share: float = SHARE, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, question_overlap and answer_overlap for every leaked item of every row of `documents` (doc_id, text).

    Null and empty texts leak nothing. Repeated rows are reported each; a row with a null doc_id is reported
    with a null. An empty benchmark or table gives an empty result. Other columns are ignored.
    """
    schema = "doc_id long, item_id long, question_overlap double, answer_overlap double"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [rows.mapInArrow(_reporting(sent(documents.sparkSession, index), overlap), schema) for index in indexes(benchmark, share=share)]
    if not found:
        return documents.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _reporting(index, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(index().leaks(batch.column(1), overlap))
            ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64())))], ["doc_id", "item_id", "question_overlap", "answer_overlap"])

    return run


def clean(documents: DataFrame, benchmark: DataFrame, *, share: float = SHARE, overlap: float = OVERLAP) -> DataFrame:
    """The rows of `documents` in which no item leaks, with all their columns.

    With one shard of items in one pass without a shuffle; with more, the leaking rows' hashes are gathered first, and rows
    with one of them go. Null and empty texts stay, repeated rows are judged alike.
    """
    columns = documents.columns
    found = [sent(documents.sparkSession, index) for index in indexes(benchmark, share=share)]
    if not found:
        return documents
    if len(found) > 1:
        row = fresh(documents, "row")
        marked = documents.withColumn(row, F.xxhash64("doc_id", "text"))
        hashes = marked.select(F.col(row).alias("doc_id"), "text")
        leaking = [hashes.mapInArrow(_reporting(index, overlap), "doc_id long, item_id long, question_overlap double, answer_overlap double").select(F.col("doc_id").alias(row)) for index in found]
        gone = written(reduce(DataFrame.unionByName, leaking).distinct(), "leaking")
        return marked.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, row, "left_anti").select(*columns)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            keep[[x[0] for x in found[0]().leaks(batch.column(columns.index("text")), overlap)]] = False
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(without, documents.schema)
