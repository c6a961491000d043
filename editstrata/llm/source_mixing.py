"""Mixing to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The cell weights are raked in turn
to each dimension's target shares until all marginals agree. A cell's probability is
its weight per token times a factor that makes the expected sample as large as asked for, 1 at
most; a document is taken where a hash of its id falls below its cell's probability.

Only the cell table is iterated over. Factors of dimensions with few values go out as one array; where a dimension has
many, its steps are joined and written, so plans stay short.
Documents are read twice: for the sums, and for the sample, which needs no shuffle.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import fresh, written

#: Target shares: a power of the present shares (1: as they are, 0: equal), or shares by value; values not listed keep their present share.
TARGETS: Mapping[str, float | Mapping[str, float]] = {"source": 0.5, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.8}
#: Expected share of all tokens in the sample.
BUDGET = 0.5
#: Rounds of raking at most, and the largest relative error of a marginal at which it ends.
ROUNDS, ERROR = 40, 1e-6
#: Cells up to this number are broadcast to the documents, more are joined by a shuffle.
BROADCAST_CELLS = 50_000
#: Dimensions of up to this number of values have their factors sent as one array, those of more are joined by a shuffle.
FEW_VALUES = 1_000
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A coarse topic by form, for tables without a column of that name: licensed, table, record (digits) or prose; null and empty texts are prose."""
    return F.when(text.contains("License"), "licensed").when(text.contains(" | "), "table").when(F.translate(text, "0123456789", "") != text, "record").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def marginal(cells: DataFrame, dim: str, target: float | Mapping[str, float]) -> DataFrame:
    """(dim, _share) of every value that has tokens: its target share, summing to 1. Values that a listed target lacks keep their present share; the listed ones share the rest."""
    tokens = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("_tokens"))
    if not isinstance(target, Mapping):
        powers = tokens.select(dim, F.pow("_tokens", F.lit(float(target))).alias("_share"))
        return powers.withColumn("_share", F.col("_share") / F.lit(powers.agg(F.sum("_share")).first()[0] or 1.0))
    listed = F.create_map(*(F.lit(x) for kv in target.items() for x in kv))[F.col(dim)].cast("double")
    tokens = tokens.withColumn("_listed", listed)
    whole = tokens.agg(F.sum("_tokens").alias("all"), F.sum(F.when(F.col("_listed").isNull(), F.col("_tokens"))).alias("rest"), F.sum("_listed").alias("listed")).first()
    every = whole["all"] or 1.0
    left, given = 1 - (whole["rest"] or 0.0) / every, whole["listed"] or 0.0
    total = (left if given > 0 else 0.0) + 1 - left
    share = F.when(F.col("_listed").isNull(), F.col("_tokens") / every).otherwise(F.col("_listed") / given * left if given > 0 else F.lit(0.0))
    return tokens.select(dim, (share / (total or 1.0)).alias("_share"))


def raked(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, *, rounds: int = ROUNDS, error: float = ERROR) -> DataFrame:
    """`cells` (the dimensions and tokens) with weight: shares that sum to 1 and fit the targets.

    Values that a listed target lacks, "(none)" too, keep their present share, and the listed shares are scaled to the
    rest. Only values listed with 0, and cells without tokens, get weight 0. Where targets
    contradict each other the last round's weights stay, exact for the last dimension. A round sums the weights by each dimension's values, so cells
    are never brought into one task. The sums of a dimension of up to FEW_VALUES values go to the driver, and its factors come back as
    one array of logarithms (logarithms, as those of contradicting targets leave the doubles): a job without a join. Those of more values are joined by sorted shuffles.
    """
    dims = list(targets)
    now = cells.filter("tokens > 0").select(*dims, "tokens")
    shares = {d: written(marginal(now, d, targets[d]).filter("_share > 0"), "marginal") for d in dims}
    few: dict[str, dict[int, float]] = {}
    for d in dims:
        known = shares[d].withColumnRenamed("_share", f"_share_{d}")
        if known.count() <= FEW_VALUES:
            known = known.withColumn(f"_code_{d}", F.row_number().over(Window.orderBy(d)))
            few[d] = {r[0]: r[1] for r in known.select(f"_code_{d}", f"_share_{d}").collect()}
        now = now.join(known.hint("merge"), d)
    now = written(now.withColumn("weight", F.col("tokens").cast("double")), "rake")
    logs = {d: [0.0] * len(few[d]) for d in few}
    for _ in range(rounds):
        off = 0.0
        for d in dims:
            weighed = _weighed(now, logs)
            if d in few:
                sums = weighed.groupBy(f"_code_{d}").agg(F.sum("weight")).collect()
                for code, held in sums:
                    logs[d][code - 1] += math.log(few[d][code] / held)
                    off = max(off, abs(few[d][code] / held - 1))
            else:
                factor = weighed.groupBy(d).agg((F.first(f"_share_{d}") / F.sum("weight")).alias("_factor"))
                now = weighed.join(factor.hint("merge"), d).withColumn("weight", F.col("weight") * F.col("_factor"))
                now = written(now.withColumn("_off", F.abs(F.col("_factor") - 1)).drop("_factor"), "rake")
                off = max(off, now.agg(F.max("_off")).first()[0] or 0.0)
                now, logs = now.drop("_off"), {x: [0.0] * len(few[x]) for x in few}
        if not off > error:
            break
    now = written(_weighed(now, logs).select(*dims, "tokens", "weight"), "rake")
    total = now.agg(F.sum("weight")).first()[0] or 1.0
    return now.withColumn("weight", F.col("weight") / F.lit(total))


def _weighed(now: DataFrame, logs: Mapping[str, list[float]]) -> DataFrame:
    """The weights times the factors whose logarithms are listed by the values' codes. An array read from text is one literal, so all rounds run the same compiled code."""
    power = F.lit(0.0)
    for d, found in logs.items():
        if any(found):
            power += F.element_at(F.from_json(F.lit(json.dumps(found)), "array<double>"), F.col(f"_code_{d}"))
    return now.withColumn("weight", F.col("weight") * F.exp(power))


def with_probability(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Adds probability: min(1, factor * weight / tokens), with the factor at which the expected sample has budget times all tokens."""
    ratio = F.col("weight") / F.col("tokens")
    whole = cells.agg(F.sum("tokens").alias("tokens"), F.max(ratio).alias("hi"), F.min(ratio).alias("lo")).first()
    if not whole["tokens"]:
        return cells.withColumn("probability", F.lit(0.0))
    goal = budget * whole["tokens"]
    low, high = goal / whole["tokens"] / whole["hi"] * 0.5, 2.0 / whole["lo"]
    for _ in range(6):  # each step cuts the bracket to a sixteenth of its logarithm
        tried = [low * (high / low) ** (k / 16) for k in range(17)]
        each = cells.select("tokens", ratio.alias("_ratio"), F.posexplode(F.from_json(F.lit(json.dumps(tried)), "array<double>")).alias("_k", "_c"))
        got = dict(each.groupBy("_k").agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("_ratio") * F.col("_c")))).collect())
        above = next((k for k in range(1, 17) if got[k] >= goal), 16)
        low, high = tried[above - 1], tried[above]
    return cells.withColumn("probability", F.round(F.least(F.lit(1.0), ratio * high), 12))


def cells_of(documents: DataFrame, dims: list[str]) -> DataFrame:
    """Tokens by cell; nulls in a dimension are a value of their own."""
    return documents.groupBy(*dims).agg(F.sum("_tokens").alias("tokens"))


def _prepared(documents: DataFrame, dims: list[str]) -> DataFrame:
    cols = {d: F.coalesce(F.col(d).cast("string"), F.lit(NONE)) if d in documents.columns or d != "topic" else topic_of(F.coalesce("text", F.lit(""))) for d in dims}
    return documents.select("doc_id", "text", *(c.alias(d) for d, c in cols.items()))


def mixture(documents: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, *, budget: float = BUDGET, seed: int = 1) -> DataFrame:
    """doc_id, the dimensions, n_tokens, weight and probability of the document's cell, and kept for every row of `documents`.

    Dimensions are columns of `documents`; topic is computed from the text where it is none of them. Nulls in
    a dimension are a value of their own, "(none)". Null and empty texts have no token; in a cell without tokens,
    and where a target lists the value with 0, the probability is 0. Values that a listed target lacks keep their present share. Repeated rows of one id are kept or
    left together; a null id is hashed like any value. An empty table gives an empty result.
    """
    dims = list(targets)
    rows = _prepared(documents, dims).select(F.col("doc_id").cast("long").alias("doc_id"), *dims, tokens_of(F.col("text")).alias("_tokens"))
    rows = written(rows, "tokens")
    found = _placed(rows, cells_of(rows, dims), dims, targets, budget)
    return found.select("doc_id", *dims, F.col("_tokens").alias("n_tokens"), "weight", "probability", (_draw(seed) < F.col("probability")).alias("kept"))


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _placed(rows: DataFrame, cells: DataFrame, dims: list[str], targets: Mapping[str, float | Mapping[str, float]], budget: float) -> DataFrame:
    fitted = written(with_probability(raked(written(cells, "cells"), targets), budget).drop("tokens"), "fitted")
    few = fitted.count() <= BROADCAST_CELLS
    return rows.join(F.broadcast(fitted) if few else fitted, dims, "left").fillna(0.0, ["weight", "probability"])


def sampled(documents: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, *, budget: float = BUDGET, seed: int = 1) -> DataFrame:
    """The rows of `documents` that mixture() keeps, with their own columns; texts are not shuffled."""
    dims = list(targets)
    names = {d: fresh(documents, f"cell_{d}") for d in dims}
    chance = fresh(documents, "probability")
    prepared = _prepared(documents, dims)
    cells = cells_of(prepared.select(*dims, tokens_of(F.col("text")).alias("_tokens")), dims)
    fitted = written(with_probability(raked(written(cells, "cells"), targets), budget).select(*(F.col(d).alias(n) for d, n in names.items()), F.col("probability").alias(chance)), "fitted")
    few = fitted.count() <= BROADCAST_CELLS
    key = {names[d]: (F.coalesce(F.col(d).cast("string"), F.lit(NONE)) if d in documents.columns or d != "topic" else topic_of(F.coalesce("text", F.lit("")))) for d in dims}
    rows = documents.withColumns(key).join(F.broadcast(fitted) if few else fitted, list(names.values()))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return rows.filter(draw < F.col(chance)).select(*documents.columns)
