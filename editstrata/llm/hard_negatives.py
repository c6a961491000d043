"""Hard negatives: vertical scans of columnar blocks, with bounds from the dimensions not yet read (BOND).

A task turns its rows into blocks, one array for each dimension. An anchor reads a block's dimensions in the falling order of its own
magnitudes, STEP at a time. The least and greatest value of every dimension in the block bound what the unread dimensions can still
add to a row's inner product; rows that cannot reach what is asked leave the bitmap of candidates, the others are read on until their
scores are exact. The first scan finds each anchor's positives: the bound to reach is the last score of the list so far. The second
looks for negatives in the windows of scores that the positives open: the bounds are the windows, and the lists found so far in each.
A task's lists go on from block to block, so that later blocks are cut by what earlier ones gave; Spark merges the tasks' lists.

The anchors are a stated set of queries against all rows. They are sent to the tasks in groups of at most about GROUP_VALUES numbers,
and every group scans the rows once; rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import sent

#: Rows of a block, dimensions that are read between two looks at the bounds.
BLOCK, STEP = 8192, 8
#: Components of all anchors in a group: what is broadcast at once, 8 bytes each.
GROUP_VALUES = 1 << 20
#: Larger components are taken as this, with their sign.
LARGEST = 1 << 52
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Block:
    """Rows of one length: values[d] holds dimension d of all rows."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    unique: bool = field(init=False)
    least: np.ndarray = field(init=False)
    most: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        for name, value in (("unique", len(np.unique(self.ids)) == len(self.ids)), ("least", self.values.min(1)), ("most", self.values.max(1))):
            object.__setattr__(self, name, value)


def whole_numbers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * value) in double precision, at most LARGEST in magnitude."""
    return np.clip(np.floor(scale * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[Block]:
    """Blocks of the rows (id, label, vector) of all batches; vectors of another length come in blocks of their own."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    count: dict[int, int] = {}

    def block(size: int) -> Block:
        count.pop(size)
        ids, labels, rows = (np.concatenate(x) for x in zip(*held.pop(size), strict=True))
        return Block(ids, labels, np.ascontiguousarray(rows.T))

    for batch in batches:
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        vectors = batch.column(2)
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
        for size in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == size)
            for at in range(0, len(mine), BLOCK):
                part = mine[at : at + BLOCK]
                rows = whole_numbers(flat[(ends[part] - size)[:, None] + np.arange(size)], scale)
                held.setdefault(size, []).append((ids[part], labels[part], rows))
                count[size] = count.get(size, 0) + len(part)
                if count[size] >= BLOCK:
                    yield block(size)
    for size in list(held):
        yield block(size)


def _bounds(block: Block, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The order of dimensions, and the least and most that those from each place on add; None where that may not fit 64 bits."""
    reach = np.maximum(np.abs(block.least), np.abs(block.most)).astype(np.float64) @ np.abs(anchor).astype(np.float64)
    if reach >= 2**62:
        return None
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * block.least, anchor * block.most])[:, order]
    rest = np.zeros((2, len(order) + 1), np.int64)
    rest[:, :-1] = np.stack([ends.min(0), ends.max(0)])[:, ::-1].cumsum(1)[:, ::-1]
    return order, rest[0], rest[1]


def _nth(values: np.ndarray, n: int) -> int:
    """The n-th greatest, or less than everything where there are fewer."""
    return int(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else _NONE


def scanned(block: Block, anchor: np.ndarray, alive: np.ndarray, windows: np.ndarray, reached: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of those `alive` rows that may be among the first n of a window (lowest, highest score); reached: the n-th score known in each."""
    reached = np.maximum(windows[:, 0], reached)
    bounds = _bounds(block, anchor)
    rows = np.flatnonzero(alive)
    if bounds is None:  # the sums wrap around; the whole product is right modulo 2**64
        return rows, anchor @ block.values[:, rows]
    order, least, most = bounds
    score = np.zeros(len(rows), np.int64)
    for at in range(0, len(order), STEP):
        dims = order[at : at + STEP]
        every = len(rows) == alive.size
        for d in dims:
            column = block.values[d]
            score += anchor[d] * (column if every else column[rows])
        low, high = score + least[at + len(dims)], score + most[at + len(dims)]
        wanted = np.zeros(len(rows), bool)
        for k, (first, last) in enumerate(windows):
            if block.unique:  # rows of one id count once; then n rows are n ids
                inside = low[(low >= max(first, reached[k])) & (high <= last)]
                reached[k] = max(reached[k], _nth(inside, n))
            wanted |= (high >= reached[k]) & (low <= last)
        if not wanted.all():
            rows, score = rows[wanted], score[wanted]
        if not len(rows):
            break
    return rows, score


def first_of(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n ids by falling score, then by id; an id that repeats counts once, with its best score."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    if len(ids) > 1:
        once = np.sort(np.unique(ids, return_index=True)[1])
        ids, scores = ids[once], scores[once]
    return ids[:n], scores[:n]


@dataclass(frozen=True)
class Anchor:
    """One query; windows[k] belongs to the positive k."""

    id: int
    label: int
    vector: np.ndarray
    windows: np.ndarray
    same: bool

    def candidates(self, block: Block) -> np.ndarray:
        return ((block.labels == self.label) == self.same) & (block.ids != self.id)


_LISTS = "anchor_id long, window int, other_id long, score long"


def _scan(rows: DataFrame, anchors: list[Anchor], scale: float, n: int) -> DataFrame:
    """Each anchor's first n rows in each of its windows, merged over all tasks; place counts from 1."""
    held = sent(rows.sparkSession, anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held()
        lists = [[(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in a.windows] for a in asked]
        for block in blocks(batches, scale):
            for a, found in zip(asked, lists, strict=True):
                if len(a.vector) != len(block.values) or not len(a.windows):
                    continue
                reached = np.array([scores[-1] if len(scores) == n else _NONE for _, scores in found])
                at, score = scanned(block, a.vector, a.candidates(block), a.windows, reached, n)
                for k, (first, last) in enumerate(a.windows):
                    mine = np.flatnonzero((score >= max(first, reached[k])) & (score <= last))
                    if len(mine):
                        if block.unique and len(mine) > n:  # ties with the n-th stay
                            mine = mine[score[mine] >= _nth(score[mine], n)]
                        found[k] = first_of(np.concatenate([found[k][0], block.ids[at[mine]]]), np.concatenate([found[k][1], score[mine]]), n)
        out = [(a.id, k, int(i), int(s)) for a, found in zip(asked, lists, strict=True) for k, (ids, scores) in enumerate(found) for i, s in zip(ids, scores, strict=True)]
        for at in range(0, len(out), 10_000):
            part = list(zip(*out[at : at + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "window", "other_id", "score"])

    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "other_id")
    once = rows.mapInArrow(scan, _LISTS).repartition("anchor_id", "window").groupBy("anchor_id", "window", "other_id").agg(F.max("score").alias("score"))
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def hard_negatives(vectors: DataFrame, anchors: Column, *, scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of `vectors` (vec_id, embedding, label) where `anchors` holds.

    A component x counts as floor(scale * x) in double precision (at most 2**52 in magnitude); a score is the inner product of these
    whole numbers with the anchor's, and has to fit a long. An anchor's positives are its first `positives` other rows of its
    label, by falling score and then by vec_id. For each, the first `negatives` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score are returned, ranked from 1.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. Vectors are compared with those of
    their own length; all empty ones score 0. Rows that repeat an id are one other row to an anchor, with the best score
    among them; of repeated anchors the least (label, vector) asks. An anchor's own id is never its positive or negative. A
    positive with no row in its window, as all with a negative score, has no rows in the result. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    marked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", anchors.alias("asks"))
    rows = marked.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    asking = rows.filter("asks").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")
    groups = (asking.agg(F.coalesce(F.sum(F.size("embedding") + 8), F.lit(0))).first()[0] // GROUP_VALUES) + 1
    compared = rows.select("vec_id", "label", "embedding")
    found = []
    for g in range(groups):
        table = asking.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).collect()
        asked = {r["vec_id"]: (r["label"], whole_numbers(np.array(r["embedding"], np.float64), scale)) for r in table}
        every = np.array([[_NONE, np.iinfo(np.int64).max]])
        known: dict[int, list[tuple[int, int]]] = {}
        for r in _scan(compared, [Anchor(i, label, v, every, True) for i, (label, v) in asked.items()], scale, positives).orderBy("place").collect():
            known.setdefault(r["anchor_id"], []).append((r["other_id"], r["score"]))
        windows = {i: np.array([(-(-low * s // 100), high * s // 100) for _, s in p], np.int64) for i, p in known.items()}
        lists = _scan(compared, [Anchor(i, asked[i][0], asked[i][1], w, False) for i, w in windows.items()], scale, negatives)
        pairs = [(i, k, other, s) for i, p in known.items() for k, (other, s) in enumerate(p)]
        opened = F.broadcast(spark.createDataFrame(pairs, "anchor_id long, window int, positive_id long, positive_score long"))
        found.append(lists.join(opened, ["anchor_id", "window"]).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


#: The query's rows in DuckDB: all pairs of an anchor and another row, which is feasible for small tables only.
NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
           FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other_id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
found AS (SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, n.other_id AS negative_id, n.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS place
          FROM positives AS p JOIN scored AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE place <= 3
"""
