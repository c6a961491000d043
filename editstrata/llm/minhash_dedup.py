"""Near-duplicate groups by MinHash with tensored banding.

Two collections of `halves` small hashes are kept for each text, each small hash
made of `width` minhashes. Table (i, j) is keyed by the pair (A_i, B_j), so
`halves`**2 tables of 2 * `width` minhashes each need only 2 * halves * width
minhashes. Rows are dealt by A_i; the B half of a table key is compared where the
rows of one A_i meet, so that a text is sent `halves` times and not halves**2 times.

Two texts of similarity s share a table with probability (1 - (1 - s**width)**halves)**2:
with the defaults 0.9991 at 0.8 and 0.99996 at 0.85.

1. Texts with equal shingle sets form a class; all later steps see one row a class.
2. In each bucket of A_i every class is compared with the bucket's hub, the class that
   shares most buckets; the pairs are confirmed on the full sets of the texts, each of which is sent once, that of a hub
   once for every `TOGETHER` classes.
3. Buckets that still hold several components compare their classes in blocks, across
   components only, with a sketch that is exact up to `SKETCH` shingles; what the sketch
   leaves possible is confirmed on the full sets.
4. Components of the confirmed links.

No bucket is capped: large ones are cut in blocks, and all pairs of blocks are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._store import fresh, written
from ._text import exact_shingles, hashed_words, mix, shingle_hashes

WIDTH, HALVES = 4, 15
#: Shingle hashes kept of a class for the comparison in blocks.
SKETCH = 512
#: How far below the threshold the estimate of longer sets' similarity may lie for them to be confirmed. None: all are, so that no estimate loses a link.
SLACK: float | None = None
#: Classes in a block; a task holds two blocks.
BLOCK = 512
#: Rows with texts or sketches that are turned into Python objects at once.
READ_ROWS = 256
#: Classes that are confirmed against one other in one task; its text goes to as many tasks as it takes.
TOGETHER = 256
#: Ids up to this number are broadcast (16 bytes each), more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_FEATURES = "doc_id long, row long, n_shingles long, fp binary, a array<long>, b array<long>"


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(1, 2**64, n, dtype=np.uint64), rng.integers(1, 2**64, n, dtype=np.uint64) | np.uint64(1)


def _small_hashes(sets: list[np.ndarray], width: int, halves: int) -> np.ndarray:
    """For each non-empty set its 2 * halves small hashes."""
    x, a = _seeds(2 * halves * width)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    mins = np.empty((len(sets), len(x)), np.uint64)
    work = np.empty_like(flat)
    for k in range(len(x)):
        np.bitwise_xor(flat, x[k], out=work)
        np.multiply(work, a[k], out=work)
        mins[:, k] = np.minimum.reduceat(work, starts)
    key = np.zeros((len(sets), 2 * halves), np.uint64)
    for k in range(width):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + mins[:, k::width])
    return key


def _fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a set of hashes."""
    if not len(s):
        return b""
    return np.array([np.add.reduce(mix(s)), np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64).astype(">u8").tobytes()


def _features(size: int, width: int, halves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, words, counts in hashed_words(batch.column(1)):
                sets = shingle_hashes(words, counts, size)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), 2 * halves), np.uint64)
                if full:
                    keys[full] = _small_hashes([sets[k] for k in full], width, halves)
                keys = keys.view(np.int64)
                n, at = len(sets), np.arange(0, (len(sets) + 1) * halves, halves, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, n), batch.column(2).slice(row, n), pa.array([len(s) for s in sets], pa.int64()), pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(at, pa.array(keys[:, :halves].ravel())), pa.ListArray.from_arrays(at, pa.array(keys[:, halves:].ravel()))],
                    ["doc_id", "row", "n_shingles", "fp", "a", "b"],
                )

    return run


def _confirm(size: int, percent: int):
    """Links among rows (u, part, role, v, text), sorted: the text of u (role 0), then those of the v that it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = set()
        for batch in (b.slice(at, READ_ROWS) for b in batches for at in range(0, len(b), READ_ROWS)):
            yes = []
            role, text = batch.column(2).to_numpy(), batch.column(4)
            for k in range(len(batch)):
                other = exact_shingles(text[k].as_py(), size)
                if role[k] == 0:
                    kept = other
                    continue
                both = len(kept & other)
                if 100 * both >= percent * (len(kept) + len(other) - both):
                    yes.append(k)
            found = batch.take(pa.array(yes, pa.int64()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(3)], ["u", "v"])

    return run


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words, counts in hashed_words(batch.column(1)):
                sets = shingle_hashes(words, counts, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary())], ["fp", "sketch"])

    return run


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _links_in_block(rows: list[dict], index: int, percent: int, slack: float | None) -> list[tuple[bytes, bytes]]:
    """Pairs of one block pair that may be links and join different components; certain ones only where they join anew."""
    n = np.array([r["n"] for r in rows])
    a, b = np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows])
    comp = np.unique(np.array([r["comp"] for r in rows], dtype=object).astype("S16"), return_inverse=True)[1] if rows else n
    side = np.array([r["side"] for r in rows])
    g = len(rows)
    may = np.triu(comp[:, None] != comp[None, :], 1)
    may &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    may &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    for k in range(index):  # a pair is taken in the first table that it shares
        may &= a[:, k][:, None] != a[:, k][None, :]
    share = np.zeros((g, g), bool)
    for k in range(b.shape[1]):
        share |= b[:, k][:, None] == b[:, k][None, :]
    pairs = np.argwhere(may & share)
    sets = [np.frombuffer(r["sketch"], np.uint64) for r in rows]
    parent = list(range(int(comp.max()) + 1 if g else 0))
    out = []
    for x, y in pairs.tolist():
        if _find(parent, comp[x]) == _find(parent, comp[y]):
            continue
        if n[x] <= SKETCH and n[y] <= SKETCH:
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both < percent * (n[x] + n[y] - both):
                continue
            parent[_find(parent, comp[x])] = _find(parent, comp[y])
        elif slack is not None:
            union = np.union1d(sets[x], sets[y])[:SKETCH]
            seen = len(np.intersect1d(np.intersect1d(sets[x], union, assume_unique=True), np.intersect1d(sets[y], union, assume_unique=True), assume_unique=True))
            if seen < (percent / 100 - slack) * len(union):
                continue
        out.append((rows[x]["fp"], rows[y]["fp"]))
    return out


def _in_blocks(percent: int, slack: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.binary()), pa.array([max(x) for x in found], pa.binary())], ["u", "v"])

        now, rows = None, []
        for batch in (b.slice(at, READ_ROWS) for b in batches for at in range(0, len(b), READ_ROWS)):
            for r in batch.to_pylist():
                key = (r["i"], r["key"], r["p"], r["q"])
                if key != now:
                    if len(rows) > 1:
                        yield result(_links_in_block(rows, now[0], percent, slack))
                    now, rows = key, []
                rows.append(r)
        if len(rows) > 1:
            yield result(_links_in_block(rows, now[0], percent, slack))

    return run


def _texts_of(documents: DataFrame, feats: DataFrame, fps: DataFrame) -> DataFrame:
    """(fp, text) of the classes in `fps` (distinct): the text of the class's least document."""
    few = fps.count() <= BROADCAST_IDS
    ids = feats.filter(F.length("fp") > 0).join(F.broadcast(fps) if few else fps, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("row", "doc_id")).alias("at"))
    ids = ids.select("fp", F.col("at.row").alias("_row"), F.col("at.doc_id").alias("_id"))
    same = (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return documents.join(F.broadcast(ids) if few else ids, same).select("fp", "text")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """`comps` (node, component) after more links (u, v): the components are the nodes of a smaller graph."""
    at = comps.select("node", "component")
    both = links.join(at.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(at.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    both = both.select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv"))
    found = written(connected_components(both.select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "joined")
    named = found.select(F.col("node").alias("component"), F.col("component").alias("_final"))
    alone = found.join(at.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    old = at.join(named, "component", "left").select("node", F.coalesce("_final", "component").alias("component"))
    return written(old.unionByName(alone), "components")


def _grouped(documents: DataFrame, shingle_words: int, percent: int, width: int, halves: int, slack: float | None) -> DataFrame:
    """row (a hash of id and text), doc_id, n_shingles, component_id and first (the row that stands for the component) of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"))
    feats = written(docs.mapInArrow(_features(shingle_words, width, halves), _FEATURES), "features")
    classes = feats.filter(F.length("fp") > 0).groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rank"), "row", "doc_id")).alias("least"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = written(classes, "classes")
    slim = classes.select("fp", F.posexplode("a").alias("i", "key"))
    shared = slim.groupBy("i", "key").agg(F.count("*").alias("size")).filter("size > 1")
    met = written(slim.join(shared, ["i", "key"]), "buckets")

    weight = met.groupBy("fp").agg(F.sum("size").alias("weight"))
    hubs = met.join(weight, "fp").groupBy("i", "key").agg(F.max(F.struct("weight", "fp")).getField("fp").alias("hub"))
    stars = met.join(hubs, ["i", "key"]).filter("fp != hub").select("hub", "fp").distinct()
    side = classes.select("fp", "n", "b")
    stars = stars.join(side, "fp").join(side.select(F.col("fp").alias("hub"), F.col("n").alias("m"), F.col("b").alias("c")), "hub")
    stars = stars.filter((100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & F.exists(F.zip_with("b", "c", lambda x, y: x == y), lambda x: x))
    stars = written(stars.select(F.col("hub").alias("u"), F.col("fp").alias("v")), "stars")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
        texts = written(_texts_of(docs, feats, written(ends, "ends")), "texts").dropDuplicates(["fp"])
        parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
        dealt = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"), "v")
        heads = dealt.select("u", "part").distinct().join(texts.withColumnRenamed("fp", "u"), "u").select("u", "part", F.lit(0).alias("role"), F.lit(None).cast("binary").alias("v"), "text")
        rows = heads.unionByName(dealt.join(texts.withColumnRenamed("fp", "v"), "v").select("u", "part", F.lit(1).alias("role"), "v", "text"))
        rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", "role")
        return written(rows.mapInArrow(_confirm(shingle_words, percent), "u binary, v binary"), name)

    links = confirmed(stars, "links")
    comps = written(connected_components(links), "components")

    placed = met.filter("size > 2").join(comps, met["fp"] == comps["node"], "left").select("i", "key", "size", "fp", F.coalesce("component", "fp").alias("comp"))
    mixed = placed.groupBy("i", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("i", "key")
    open_rows = written(placed.join(mixed, ["i", "key"]), "open")
    if not open_rows.isEmpty():
        fps = written(open_rows.select("fp").distinct(), "open-ids")
        sketches = _texts_of(docs, feats, fps).dropDuplicates(["fp"]).mapInArrow(_sketches(shingle_words), "fp binary, sketch binary")
        sketches = written(sketches.join(classes.select("fp", "n", "a", "b"), "fp"), "sketches")
        blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        rows = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.select("i", "key", "fp", "comp", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
        rows = rows.join(sketches, "fp").repartition("i", "key", "p", "q").sortWithinPartitions("i", "key", "p", "q")
        rest = written(rows.mapInArrow(_in_blocks(percent, slack), "u binary, v binary").distinct(), "rest")
        if not rest.isEmpty():
            comps = _joined(comps, confirmed(rest, "rest-links"))

    named = classes.select("fp", "least").join(comps, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("comp"))
    named = written(named, "named")
    least = named.groupBy("comp").agg(F.min("least").alias("first"))
    named = named.join(least, "comp").select("fp", "first")
    out = feats.select("row", "doc_id", "n_shingles", "fp").join(named, "fp", "left")
    alone = F.length("fp") == 0
    return out.select("row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), F.when(alone, F.col("row")).otherwise(F.col("first.row")).alias("first"))


def near_duplicates(documents: DataFrame, *, shingle_words: int = 5, percent: int = 80, width: int = WIDTH, halves: int = HALVES, slack: float | None = SLACK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `documents` (doc_id, text).

    A text's set holds its distinct word shingles (A-Z lower-cased); with fewer words than
    `shingle_words` the whole sequence is its only shingle. Texts whose sets have
    100 * intersection >= percent * union are linked; component_id is the least doc_id
    reachable over links and kept marks the documents whose id it is.

    Null and empty texts have an empty set, are linked with nothing and kept. Rows with a
    null doc_id are grouped but never name a component while another id is there.
    Repeated rows of one doc_id each get a row. Other columns are ignored; an empty table gives an empty result.
    """
    found = _grouped(documents, shingle_words, percent, width, halves, slack)
    component = F.col("component_id")
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def deduplicated(documents: DataFrame, *, shingle_words: int = 5, percent: int = 80, width: int = WIDTH, halves: int = HALVES, slack: float | None = SLACK) -> DataFrame:
    """The rows of `documents` of which one stays for each group of near duplicates; all columns are kept.

    The row of the group's least doc_id stays, null ids last; of rows that repeat its id and text one stays.
    Rows with null or empty texts are groups of their own. Texts are shuffled only if very many rows go.
    """
    found = written(_grouped(documents, shingle_words, percent, width, halves, slack).select("row", "first"), "grouped")
    own = fresh(documents, "row")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    gone = found.filter("row != first").select(F.col("row").alias(own)).distinct()
    few = gone.count() <= BROADCAST_IDS
    kept = documents.withColumn(own, row).join(F.broadcast(gone) if few else gone, own, "left_anti")
    twice = written(found.filter("row = first").groupBy(F.col("row").alias(own)).count().filter("count > 1").select(own), "twice")
    if twice.isEmpty():
        return kept.select(*documents.columns)
    side = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
    one = kept.join(side, own, "left_semi").dropDuplicates([own])
    return kept.join(side, own, "left_anti").unionByName(one).select(*documents.columns)
