"""Quality rules: base limits, then gradient-boosted trees over document statistics.

The trees are fitted on labelled documents (labels.quality), at most `fit_rows` of them,
the ones with the least hash of doc_id. The score falls with symbols, repeated lines and
repeated words by constraint. Fitted trees are small node arrays that travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._boosting import Forest, fit_forest
from ._text import mix, placed_words

#: Most labelled rows that the trees are fitted on.
FIT_ROWS = 20_000
#: Share of the labelled good documents, of a fold held out, that the trees may reject.
LOST_GOOD = 0.002
#: Feature name and the sign of its effect on quality (0: free).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "distinct_words": 0, "digits": 0, "capitals": 0, "marks": 0, "words_a_line": 0, "no_letter_words": -1, "shouts": -1}

def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_CLASSES = {"symbols": _class(b"#*$%&|<>"), "digits": _class(b"0123456789"), "capitals": _class(bytes(range(65, 91))), "marks": _class(b".,;:"), "shouts": _class(b"!?"), "lines": _class(b"\n")}
#: Bytes that begin a character other than a space, and those that make a word more than digits and ASCII marks.
_BEGINS = 1 - _class(b" \t\n\v\f\r" + bytes(range(128, 192)))
_LETTER = 1 - _class(bytes(range(1, 65)) + b"[\\]^_`{|}~")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ", ".join(f"{c} long" for c in ("doc_id", *BASE)) + ", base_failed boolean, features array<double>"


def _by_row(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; row k has those from begins[k] to begins[k + 1]."""
    out = np.zeros(len(begins) - 1, np.int64)
    some = np.flatnonzero(np.diff(begins))
    if len(some):
        out[some] = np.add.reduceat(values, begins[some], dtype=np.int64)
    return out


def _repeated(hashes: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Words of each row that lie in a 3-word window found twice or more in it."""
    if len(hashes) < 3:
        return np.zeros(rows, np.int64)
    spread = np.uint64(0xD6E8FEB86659FD93)
    window = mix((hashes[:-2] * spread + hashes[1:-1]) * spread + hashes[2:])
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    window, of = window[inside], owner[inside]
    order = np.lexsort((window, of))
    same = (window[order][1:] == window[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(hashes), bool)
    at = inside[order[twice]]
    for k in range(3):
        covered[at + k] = True
    return np.bincount(owner[covered], minlength=rows)


def statistics(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The base statistics and the features (a row a text) of slices of texts, in order. Words and windows are compared by 64-bit hash, lines as they are."""
    for _, data, begins, hashes, start, end in placed_words(texts):
        rows = len(begins) - 1
        words = np.searchsorted(start, begins)
        n = np.diff(words)
        owner = np.repeat(np.arange(rows), n)
        count = {c: _by_row(table[data], begins) for c, table in _CLASSES.items()}
        chars = _by_row(_BEGINS[data], begins)
        lines, dup = np.minimum(n, 1), np.zeros(rows, np.int64)
        for k in np.flatnonzero(count["lines"]).tolist():
            found = [x for x in data[begins[k] : begins[k + 1]].tobytes().split(b"\n") if x.strip()]
            lines[k], dup[k] = len(found), len(found) - len(set(found))
        repeat = _repeated(hashes, owner, rows)
        order = np.lexsort((hashes, owner))
        new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])) if len(hashes) else np.empty(0, bool)
        distinct = np.bincount(owner[order[new]], minlength=rows)
        letters = np.add.reduceat(np.append(_LETTER[data], np.uint8(0)), np.stack([start, end], 1).ravel(), dtype=np.int64)[::2] if len(start) else np.empty(0, np.int64)
        letterless = np.bincount(owner[(letters == 0) & (end - start < 4)], minlength=rows)
        each, per_line, per_char = 1 / np.maximum(n, 1), 1 / np.maximum(lines, 1), 1 / np.maximum(chars, 1)
        features = [np.log1p(n), chars * each, count["symbols"] * each, dup * per_line, repeat * each, distinct * each, count["digits"] * per_char, count["capitals"] * per_char, count["marks"] * each, n * per_line, letterless * each, count["shouts"] * each]
        yield np.stack([n, chars, count["symbols"], dup, repeat], 1).astype(np.int64), np.stack(features, 1).astype(np.float64)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for numbers, features in statistics(batch.column(1)):
            failed = (numbers[:, 0] < 50) | (100 * numbers[:, 4] > 50 * numbers[:, 0])
            ends = np.arange(0, features.size + 1, len(FEATURES), dtype=np.int32)
            ids = batch.column(0).slice(at, len(numbers))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(numbers[:, k]) for k in range(len(BASE))), pa.array(failed), pa.ListArray.from_arrays(ends, pa.array(features.ravel()))], ["doc_id", *BASE, "base_failed", "features"])
            at += len(numbers)


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and the features of every row's whole text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, _SCHEMA)


def fit(documents: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, lost_good: float = LOST_GOOD) -> tuple[Forest, float] | None:
    """Trees and the score from which a document is kept; None where labels show one class only."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = document_statistics(documents.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(sample), "doc_id")
    rows = rows.filter("not base_failed").select("doc_id", "features", "quality").toPandas().sort_values("doc_id", kind="stable")
    y = rows["quality"].to_numpy(np.float64)
    if len(rows) < 50 or y.min() == y.max():
        return None
    x = np.array(rows["features"].tolist())
    signs = np.array(list(FEATURES.values()))
    aside = np.arange(len(y)) % 5 == 0
    good = np.sort(fit_forest(x[~aside], y[~aside], signs).score(x[aside & (y == 1)])) if (y[~aside].min() < y[~aside].max()) else np.empty(0)
    limit = min(0.5, float(good[int(lost_good * len(good))])) if len(good) else 0.0
    return fit_forest(x, y, signs), limit


def quality_verdicts(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Base statistics, base_failed, score and kept for every row of `documents` (doc_id, text).

    A word is a run of characters other than space and U+0009 to U+000D. A text fails the
    base with under 50 words or with over half of its words in repeated 3-word windows; it
    is kept if it passes the base and its score reaches the calibrated limit.
    Null and empty texts count no words and fail. Repeated rows get equal results.
    Labels that are null, or of unknown documents, teach nothing; without labels of both
    classes every document that passes the base is kept (score 1). An empty table gives an empty result.
    """
    model = fit(documents, labels, **options)

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _statistics(batches):
            score, kept = _judged(batch, model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(score), pa.array(kept)], ["doc_id", *BASE, "base_failed", "score", "kept"])

    schema = _SCHEMA.replace("features array<double>", "score double, kept boolean")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(verdict, schema)


def _judged(batch: pa.RecordBatch, model: tuple[Forest, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Score and verdict for a batch of statistics."""
    passed = ~batch.column(6).to_numpy(zero_copy_only=False)
    if model is None:
        return np.ones(len(batch)), passed
    score = model[0].score(batch.column(7).flatten().to_numpy().reshape(-1, len(FEATURES)))
    return score, passed & (score >= model[1])


def passing(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `documents` that quality_verdicts keeps, with all their columns, in one pass without a shuffle."""
    model = fit(documents, labels, **options)
    columns = documents.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for judged in _statistics(iter([pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(columns.index("text"))], ["doc_id", "text"])])):
                yield batch.slice(at, len(judged)).filter(pa.array(_judged(judged, model)[1]))
                at += len(judged)

    return documents.mapInArrow(keep, documents.schema)
