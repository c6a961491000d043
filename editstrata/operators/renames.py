"""Paths through deletions and renames of subtrees, in a logarithmic number of rounds.

A move takes what is at or below one path to another, or away. Moves in a row are one function of a path, said by rules: the rule of the longest prefix replaces it. Two
functions in a row are one again: the first one's targets go through the second, and the second's rules that lie below a target of the first are said from there. So the
moves of a scene, in order, are combined in pairs, then in pairs of pairs; a path that stands between two moves takes, at each level, the one block that begins where it stands, until
all later moves are behind it. 10,000 moves are 14 levels, whatever the number of paths. Each level is a few joins by scene, block and prefix; paths and moves are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, lineage
from ..sources.shared import written
from .running import with_running

SCENE = "scene_id"


def _tail(path: Column, prefix: Column) -> Column:
    return path.substr(F.length(prefix) + 1, F.length(path))


def _applied(rows: DataFrame, rules: DataFrame, key: list[str], path: str) -> DataFrame:
    """`rows` with _to and _when of the rule of the longest prefix of `path` (null without one): where it goes (null: nowhere) and when, and _hit."""
    spots = rows.select(*key, F.col(path).alias("_path")).filter(F.col("_path").isNotNull()).distinct()
    met = spots.withColumn("_from", F.explode(lineage(F.col("_path")))).join(rules.select(*key, F.col("source").alias("_from"), "target", "at"), [*key, "_from"])
    best = met.groupBy(*key, "_path").agg(F.max_by(F.struct("_from", "target", "at"), F.length("_from")).alias("_r"))
    found = best.select(*key, F.col("_path").alias(path), F.concat("_r.target", _tail(F.col("_path"), F.col("_r._from"))).alias("_to"), F.col("_r.at").alias("_when"), F.lit(True).alias("_hit"))
    return rows.join(found, [*key, path], "left")


def _combined(rules: DataFrame) -> DataFrame:
    """Rules (scene_id, block, source, target, at) of blocks two by two, as rules of blocks of half the number."""
    pair = [SCENE, "pair"]
    rules = rules.withColumn("pair", F.expr("block div 2"))
    first, second = rules.filter("block % 2 = 0").drop("block"), rules.filter("block % 2 = 1").drop("block")
    on = _applied(first, second, pair, "target")
    gone_on = on.select(*pair, "source", F.when(F.coalesce("_hit", F.lit(False)), F.col("_to")).otherwise(F.col("target")).alias("target"), F.coalesce("_when", "at").alias("at"))
    # the second's rules below a target of the first, said from that target's source; a longer source of the first goes before
    below = second.withColumn("_above", F.explode(ancestors(F.col("source"))))
    inner = below.join(first.select(*pair, F.col("target").alias("_above"), F.col("source").alias("_source")), [*pair, "_above"])
    inner = inner.select(*pair, F.concat("_source", _tail(F.col("source"), F.col("_above"))).alias("source"), "target", "at", "_source")
    native = second.select(*pair, "source", "target", "at", F.lit("").alias("_source"))
    said = inner.unionByName(native)
    longest = said.select(*pair, "source").distinct().withColumn("_own", F.explode(lineage(F.col("source")))).join(first.select(*pair, F.col("source").alias("_own")), [*pair, "_own"])
    longest = longest.groupBy(*pair, "source").agg(F.max_by("_own", F.length("_own")).alias("_own"))
    kept = said.join(longest, [*pair, "source"], "left").filter(F.coalesce("_own", F.lit("")) == F.col("_source"))
    return gone_on.unionByName(kept.select(*pair, "source", "target", "at")).withColumnRenamed("pair", "block")


def moved(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """`paths` (scene_id, seq, path and others) with path as the later moves leave it, and moved_at, the seq of the last that moved it (null: none); what is deleted has no row.

    `moves`: scene_id, seq, source and target (null: what is at or below source goes away). Moves with a greater seq than the row's apply, in order of seq, which must be
    unique among a scene's moves. A row of a scene without moves stays as it is.
    """
    columns = [c for c in paths.columns if c not in ("path", "moved_at")]
    rules = written(moves.select(SCENE, "seq", "source", "target"), "moves")
    stops = paths.select(SCENE, "seq").distinct().select(SCENE, (2 * F.col("seq") + 1).alias("_at"), F.lit(0).alias("_is"))  # after the move of the same seq
    both = with_running(rules.select(SCENE, (2 * F.col("seq")).alias("_at"), F.lit(1).alias("_is")).unionByName(stops), [SCENE], "_at", {"_n": F.col("_is")})
    ranks = written(both, "ranks")
    rules = written(rules.join(ranks.filter("_is = 1").select(SCENE, F.expr("_at div 2").alias("seq"), (F.col("_n") - 1).alias("block")), [SCENE, "seq"]).select(SCENE, "block", "source", "target", F.col("seq").alias("at")), "rules")
    stands = ranks.filter("_is = 0").select(SCENE, F.expr("(_at - 1) div 2").alias("seq"), F.col("_n").alias("block"))
    now = written(paths.join(stands, [SCENE, "seq"]).withColumn("moved_at", F.lit(None).cast("long")), "paths")

    def through(now: DataFrame, rules: DataFrame, some: Column) -> DataFrame:
        at = now.filter(some)
        hit = _applied(at, rules, [SCENE, "block"], "path").filter("_hit is null or _to is not null")
        done = hit.select(*columns, F.coalesce("_to", "path").alias("path"), F.coalesce("_when", "moved_at").alias("moved_at"), (F.col("block") + 1).alias("block"))
        return now.filter(~some).select(*columns, "path", "moved_at", "block").unionByName(done)

    last, level = rules.agg(F.max("block").alias("block")).first()["block"], 0
    while last:
        now, level = through(now, rules, F.col("block") % 2 == 1).withColumn("block", F.expr("block div 2")), level + 1
        if level % 2 == 0:
            now = written(now, "paths")
        rules, last = written(_combined(rules), "rules"), last // 2
    if last is not None:
        now = through(now, rules, F.col("block") == 0)
    return now.select(*columns, "path", "moved_at")


def subtree_moves(log: DataFrame) -> DataFrame:
    """The moves of a log: deletions, and renames of a prim's last name."""
    target = F.when(F.col("k") == "rename_prim", F.concat(F.regexp_replace("prim", "[^/]+$", ""), "new_name"))
    return log.filter(F.col("k").isin("delete_prim", "rename_prim")).select(SCENE, "seq", F.col("prim").alias("source"), target.alias("target"))


def placed(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """scene_id, path, type_name, real, made and arrived: where each creation of a log stands after all its moves, and when it came there; several may stand at one path.

    A rename also makes its target, as an Xform that is not real: it counts only where nothing else stands. `before`: what earlier edits left, from this function; the
    log then holds later edits only, and the result is that of one run over all.
    """
    none = F.lit(None).cast("long")
    moves = subtree_moves(log)
    made = log.filter("k = 'ensure_prim'").select(SCENE, "seq", F.col("prim").alias("path"), F.coalesce("type_name", F.lit("")).alias("type_name"), F.lit(1).alias("real"), F.col("seq").alias("made"), none.alias("arrived"))
    roots = moves.filter("target is not null").select(SCENE, "seq", F.col("target").alias("path"), F.lit("Xform").alias("type_name"), F.lit(0).alias("real"), F.col("seq").alias("made"), none.alias("arrived"))
    rows = made.unionByName(roots)
    if before is not None:
        rows = rows.unionByName(before.withColumn("seq", F.lit(-1).cast("long")).select(rows.columns))
    ended = moved(rows, moves).withColumn("arrived", F.coalesce("moved_at", "arrived", "made"))
    return ended.select(SCENE, "path", "type_name", "real", "made", "arrived")


def standing(places: DataFrame) -> DataFrame:
    """scene_id, prim, type_name and seq: of what stands at one path the last that came there counts, of what came there together the last that was made.

    So where a rename moves a prim onto a younger one and a later move takes both along, the younger one's type stays.
    """
    last = F.struct("real", "arrived", "made")
    return places.groupBy(SCENE, F.col("path").alias("prim")).agg(F.max_by("type_name", last).alias("type_name"), F.max_by("made", last).alias("seq"))


def namespace(log: DataFrame) -> DataFrame:
    """scene_id, prim, type_name and seq of the prims that the edits of a log leave, made, deleted and renamed with their subtrees."""
    return standing(placed(log))


def moved_dependencies(dependencies: DataFrame, moves: DataFrame) -> DataFrame:
    """Asset dependencies (scene_id, prim, seq and others, as asset_path and resolved) at the paths where later moves leave their prims; those of deleted prims go."""
    found = moved(dependencies.withColumnRenamed("prim", "path"), moves)
    return found.withColumnRenamed("path", "prim").select(*dependencies.columns)
