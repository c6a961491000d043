"""Reductions of the log: coalescing, compaction, child replay and latest-value merges.

Latest values are `max_by` aggregates, which are combined before the shuffle; windows are used
only where the order of rows matters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import at_or_below, lineage
from ..sources.shared import written
from .running import with_rank, with_running
from .scans import is_exact_deletion, is_sample_barrier, routing_layer, with_tier

#: Kinds whose values can be time samples, and kinds that state a layer's content exactly.
SAMPLED = ("set_gprim_attrs", "set_xform_trs", "set_connectable_input", "set_visibility", "set_point_instancer")
EXACT = ("set_sdf_spec_fields", "erase_time_samples", "replace_sdf_layer_content")
#: Kinds that are replayed for the children of a loaded prim, and the attributes of transform fields.
CHILD_KINDS = ("ensure_prim", "ensure_xform_ops", "set_xform_trs", "set_visibility", "set_material_binding", "set_connectable_input", "set_connectable_connection", "delete_prim", "rename_prim", "erase_time_samples", "set_sdf_spec_fields")
TRS_ATTRIBUTES = {"t": "xformOp:translate", "r": "xformOp:orient", "s": "xformOp:scale"}

KEY = ["scene_id", "layer_key", "prim", "k", "time", "spec_path", "material_purpose"]
#: Kinds whose payloads merge field by field; of others the last edit stays whole.
MERGED = ("ensure_prim", "set_xform_trs", "set_point_instancer", "set_gprim_attrs", "set_connectable_input", "set_connectable_connection", "set_variant_selections", "set_stage_metadata", "set_sdf_spec_fields")
#: Columns of merging kinds: maps merge by key, sets unite, and of these scalars the last that is given stays.
MAPS, SETS, GIVEN = ("vals", "selections", "input_types", "primvar_meta", "attr_interp", "connections"), ("fields", "api_schemas"), ("type_name", "info_id", "up_axis")

#: What a reduction carries (see reduced): of is row, prim or spec.
CARRY = "scene_id string, layer_key string, of string, prim string, spec_path string, seq long, epoch long, barriers long, exact long, cuts long, table_at long, write_at long"


def coalesced_transforms(log: DataFrame) -> DataFrame:
    """scene_id, segment, prim, time, seq, field, value: transforms merged inside runs of transforms.

    Any other kind is a barrier. A merged edit keeps its first position; of a field the last value stays.
    """
    cut = with_running(log.select("scene_id", "seq", "k", "prim", "time", "field", "value"), ["scene_id"], "seq", {"segment": F.col("k") != "set_xform_trs"})
    rows = cut.filter("k = 'set_xform_trs'")
    values = rows.groupBy("scene_id", "segment", "prim", "time", "field").agg(F.max_by("value", "seq").alias("value"), F.min("seq").alias("_first"))
    whole = Window.partitionBy("scene_id", "segment", "prim", "time")
    return values.withColumn("seq", F.min("_first").over(whole)).drop("_first")


def written_attributes(log: DataFrame) -> DataFrame:
    """Adds attr, one row for each attribute that a timed edit writes a sample of; other edits give no row."""
    names = F.when(F.col("k") == "set_xform_trs", F.transform(F.map_keys("vals"), lambda f: F.coalesce(*(F.when(f == a, b) for a, b in TRS_ATTRIBUTES.items())))).when(F.col("k") == "set_connectable_input", F.transform(F.map_keys("vals"), lambda f: F.concat(F.lit("inputs:"), f))).when(F.col("k") == "set_visibility", F.array(F.lit("visibility"))).when(F.col("k").isin("set_gprim_attrs", "set_point_instancer"), F.map_keys("vals"))
    return log.filter(F.col("time").isNotNull()).withColumn("attr", F.explode(names))


def killers(log: DataFrame) -> DataFrame:
    """What undoes or parts edits, one row each with the seq of its last edit: by what (subtree, content, spec, load, barrier, specs), scene, layer and path."""
    k, path = F.col("k"), F.col("prim")
    exact = is_exact_deletion(k, F.col("removed"))
    row = lambda test, what, at: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(what).alias("by"), at.alias("path")))
    found = F.array_compact(
        F.array(
            row(k.isin("delete_prim", "rename_prim"), "subtree", path),
            row(k == "replace_sdf_layer_content", "content", F.lit("")),
            row((k == "set_sdf_spec_fields") & F.col("removed"), "spec", F.col("spec_path")),
            row(k.isin("load_payload", "unload_payload"), "load", path),
            row(is_sample_barrier(k, F.col("fields"), F.col("removed")) | exact, "barrier", path),
            row(k == "set_sdf_spec_fields", "specs", F.lit("")),
        )
    )
    some = log.filter(k.isin("delete_prim", "rename_prim", "load_payload", "unload_payload", *EXACT))
    return some.select("scene_id", "layer_key", "seq", F.explode(found).alias("f")).groupBy("scene_id", "layer_key", "f.by", "f.path").agg(F.max("seq").alias("at"))


def alive(log: DataFrame, kills: DataFrame | None = None) -> DataFrame:
    """`log` with dead: whether a later edit of the same layer has undone the row.

    Killers are deletions and renames at or above the prim, replaced layer content (for exact kinds), removed
    specs (for their spec) and the opposite payload load state. They are found in one scan and reduced to the last by key before they
    are joined; those that do not occur cost nothing. All rows are joined once, by prim; only exact kinds meet the killers by layer and spec.
    """
    kills = written(killers(log), "killers") if kills is None else kills
    present = {r["by"] for r in kills.groupBy("by").count().collect()}
    lay = ["scene_id", "layer_key"]
    later = lambda c: F.coalesce(F.col(c) > F.col("seq"), F.lit(False))
    at = lambda by, name: kills.filter(F.col("by") == by).select(*lay, F.col("path").alias(name), F.col("at").alias(f"_{by}"))
    rows = log.withColumn("_gone", F.lit(False))
    if present & {"content", "spec"}:
        exact = log.filter(F.col("k").isin(*EXACT)).join(at("content", "_none").drop("_none"), lay, "left").join(at("spec", "spec_path"), [*lay, "spec_path"], "left")
        exact = exact.withColumn("_gone", later("_content") | (later("_spec") & (F.col("spec_path") != ""))).select(*log.columns, "_gone")
        rows = rows.filter(~F.col("k").isin(*EXACT)).unionByName(exact)
    dead = F.col("_gone")
    if present & {"subtree", "load"}:
        prims = log.select(*lay, "prim").distinct().withColumn("_above", F.explode(lineage(F.col("prim"))))
        subtree = prims.join(at("subtree", "_above"), [*lay, "_above"]).select(*lay, "prim", "_subtree", F.lit(None).cast("long").alias("_load"))
        loads = at("load", "prim").select(*lay, "prim", F.lit(None).cast("long").alias("_subtree"), "_load")
        by_prim = subtree.unionByName(loads).groupBy(*lay, "prim").agg(F.max("_subtree").alias("_subtree"), F.max("_load").alias("_load"))
        dead = dead | later("_subtree") | (later("_load") & F.col("k").isin("load_payload", "unload_payload"))
        rows = rows.join(by_prim, [*lay, "prim"], "left")
    return rows.withColumn("dead", dead).select(*log.columns, "dead")


def with_epochs(log: DataFrame, kills: DataFrame | None = None) -> DataFrame:
    """Adds epoch to the rows of alive(): rows of one key merge only inside an epoch.

    For sampled kinds it counts the barriers before the row, dead ones included. For spec rows it counts the exact
    deletions before, and the sample writes to the spec's attribute that come after a living sample table. Only prims with a barrier
    are counted along, in parts of their edits; all others have epoch 0.
    """
    return _epochs(log, written(killers(log), "killers") if kills is None else kills)[0]


def _epochs(log: DataFrame, kills: DataFrame, carry: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows with their epochs, and the counts after them (CARRY, without its `row` rows; None if there are none). `carry`: the counts before them."""
    spot, spec = ["scene_id", "layer_key", "prim"], ["scene_id", "layer_key", "spec_path"]
    parted = kills.filter("by = 'barrier'").select("scene_id", "layer_key", F.col("path").alias("prim"))
    parted = parted if carry is None else parted.unionByName(carry.filter("of = 'prim'").select(*spot)).distinct()
    if parted.isEmpty():
        return log.withColumn("epoch", F.lit(0).cast("long")), None
    log = written(log, "alive")  # read several times below: quantiles, totals, windows, specs and writes
    carry = log.sparkSession.createDataFrame([], CARRY) if carry is None else carry
    prims, specs_before = carry.filter("of = 'prim'").select(*spot, "barriers", "exact"), carry.filter("of = 'spec'")
    exact = is_exact_deletion(F.col("k"), F.col("removed"))
    plain = log.join(parted, spot, "left_anti").withColumns({"_barriers": F.lit(0).cast("long"), "_exact": F.lit(0).cast("long")})
    sums = {"_barriers": is_sample_barrier(F.col("k"), F.col("fields"), F.col("removed")), "_exact": F.coalesce(exact, F.lit(False))}
    some = log.join(parted, spot, "left_semi")
    counted = with_running(some, spot, "seq", sums, own=False).join(prims, spot, "left")
    counted = counted.withColumns({f"_{c}": F.col(f"_{c}") + F.coalesce(c, F.lit(0)) for c in ("barriers", "exact")}).drop("barriers", "exact")
    totals = some.select(*spot, *(sums[f"_{c}"].cast("long").alias(c) for c in ("barriers", "exact"))).unionByName(prims).groupBy(*spot).agg(F.sum("barriers").alias("barriers"), F.sum("exact").alias("exact"))
    log = plain.unionByName(counted)
    flags = lambda table, write, base: (table.alias("table"), write.alias("write"), base.cast("long").alias("_base"))
    no, yes = F.lit(False), F.lit(True)
    specs = log.filter((F.col("k") == "set_sdf_spec_fields") & ~exact).select(*spec, "prim", "seq", *flags(~F.col("dead") & F.coalesce(F.array_contains("fields", "timeSamples"), no), no, F.lit(None)))
    tables = specs.filter("table").select(*spec).unionByName(specs_before.filter("table_at is not null").select(*spec)).distinct()
    writes = written_attributes(log).select("scene_id", "layer_key", F.concat("prim", F.lit("."), "attr").alias("spec_path"), "prim", "seq", *flags(no, yes, F.lit(None)))
    writes = writes.join(tables, spec, "left_semi")
    before = specs_before.select(*spec, "prim", F.coalesce("table_at", F.lit(-1)).alias("seq"), *flags(F.col("table_at").isNotNull(), no, F.col("cuts")))
    before = before.unionByName(specs_before.filter("write_at is not null").select(*spec, "prim", F.col("write_at").alias("seq"), *flags(no, yes, F.lit(0))))
    line = Window.partitionBy(*spec).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    both = specs.unionByName(writes).unionByName(before)
    both = both.withColumn("_table", F.max(F.when(F.col("table"), F.col("seq"))).over(line)).withColumn("_write", F.max(F.when(F.col("write"), F.col("seq"))).over(line))
    both = both.withColumn("_cut", F.col("write") & F.col("_base").isNull() & F.coalesce(F.col("_table") > F.coalesce("_write", F.lit(-1)), no))
    step = F.coalesce("_base", F.col("_cut").cast("long"))
    cuts = both.withColumn("_cuts", F.coalesce(F.sum(step).over(line), F.lit(0))).filter("not write and _base is null").select(*spec, "seq", "_cuts")
    spec_rows = log.filter("k = 'set_sdf_spec_fields'").join(cuts, [*spec, "seq"], "left").select(*log.columns, "_cuts")
    out = log.filter("k <> 'set_sdf_spec_fields'").withColumn("_cuts", F.lit(None).cast("long")).unionByName(spec_rows)
    epoch = F.when(F.col("k").isin(*SAMPLED), F.col("_barriers")).when(F.col("k") == "set_sdf_spec_fields", F.col("_exact") + F.coalesce("_cuts", F.lit(0))).otherwise(0)
    at = lambda flag: F.max(F.when(F.col(flag), F.col("seq")))
    lines = both.groupBy(*spec).agg(F.coalesce(F.max_by("prim", F.when(F.col("table"), F.col("seq"))), F.max("prim")).alias("prim"), F.sum(step).alias("cuts"), at("table").alias("table_at"), at("write").alias("write_at"))
    after = _carried(totals, "prim").unionByName(_carried(lines.filter("table_at is not null or cuts > 0"), "spec"))
    return out.withColumn("epoch", epoch).drop("_barriers", "_exact", "_cuts"), after


def _carried(rows: DataFrame, of: str) -> DataFrame:
    """Rows of CARRY: what is not given is null."""
    fields = [c.split() for c in CARRY.split(", ")]
    return rows.withColumn("of", F.lit(of)).select(*((F.col(c) if c == "of" or c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields))


def _merged(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row a group, payloads merged by each kind's rule, in two aggregations: by name inside the group, then by group."""
    maps, sets, given = ([c for c in x if c in rows.columns] for x in (MAPS, SETS, GIVEN))
    whole = [c for c in rows.columns if c not in (*group, "seq")]
    merging = F.col("k").isin(*MERGED)
    types = {c: rows.schema[c].dataType.valueType for c in maps}

    def entry(column: str, name: Column, value: Column | None = None) -> Column:
        return F.struct(F.lit(column).alias("of"), name.cast("string").alias("name"), *((value if c == column and value is not None else F.lit(None).cast(t)).alias(f"_{c}") for c, t in types.items()))

    nothing = F.array().cast("array<string>")
    entries = [F.array(entry("", F.lit("")))]
    pair_of = lambda c: lambda e: entry(c, e["key"], e["value"])
    name_of = lambda c: lambda e: entry(c, e)
    entries += [F.transform(F.map_entries(F.when(merging, F.col(c))), pair_of(c)) for c in maps]
    entries += [F.transform(F.when(merging, F.coalesce(F.col(c), nothing)), name_of(c)) for c in sets]
    if "connections" in maps and "disconnections" in rows.columns:
        entries.append(F.transform(F.when(merging, F.col("disconnections")), name_of("connections")))
    spread = rows.withColumn("_e", F.explode(F.flatten(F.array_compact(F.array(*entries))))).select(*rows.columns, "_e.*")
    head = F.col("of") == ""
    first = spread.groupBy(*group, "of", "name").agg(
        F.min("seq").alias("_first"),
        F.max("seq").alias("_last"),
        F.min_by("client_id", "seq").alias("_first_client"),
        F.max_by(F.when(head, F.struct(*whole)), "seq").alias("_whole"),
        *(F.max_by(c, F.when(head & F.col(c).isNotNull(), F.col("seq"))).alias(f"_given_{c}") for c in given),
        *(F.max_by(f"_{c}", F.when(F.col(f"_{c}").isNotNull() if c == "connections" else F.col("of") == c, F.col("seq"))).alias(f"_{c}") for c in maps),
        *([F.max_by(F.col("_connections").isNull(), F.struct("seq", F.col("_connections").isNull())).alias("_gone")] if "connections" in maps else []),
    )
    one = lambda c: F.first(F.when(head, F.col(c)), True).alias(c)
    pairs = lambda c: F.map_from_entries(F.collect_list(F.when((F.col("of") == c) & (F.col(f"_{c}").isNotNull() if c == "connections" else F.lit(True)), F.struct("name", f"_{c}"))))
    names = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("name"))))
    out = first.groupBy(*group).agg(
        *(one(c) for c in ("_first", "_last", "_first_client", "_whole")),
        *(one(f"_given_{c}") for c in given),
        *(pairs(c).alias(f"_all_{c}") for c in maps),
        *(names(F.col("of") == c).alias(f"_all_{c}") for c in sets),
        *([names((F.col("of") == "connections") & F.col("_gone")).alias("_all_disconnections")] if "connections" in maps else []),
    )
    several = {*maps, *sets, *(("disconnections",) if "connections" in maps else ())}
    columns = {c: F.col(f"_whole.{c}") for c in whole}
    columns |= {c: F.coalesce(f"_given_{c}", columns[c]) for c in given}
    columns |= {c: F.when(merging & (F.size(f"_all_{c}") > 0), F.col(f"_all_{c}")).when(merging, columns[c]).otherwise(columns[c]) for c in several if c in columns}
    if "disconnections" in columns:
        columns["disconnections"] = F.when(merging & (F.size("_all_disconnections") == 0), F.lit(None)).otherwise(columns["disconnections"])
    early = F.col("k").isin("ensure_prim", "ensure_xform_ops")
    columns["client_id"] = F.when(F.col("k") == "ensure_xform_ops", F.col("_first_client")).otherwise(columns["client_id"])
    return out.select(*group, F.when(early, F.col("_first")).otherwise(F.col("_last")).alias("seq"), *(columns[c].alias(c) for c in whole))


def _keyed(log: DataFrame) -> DataFrame:
    """The log with the columns of the merge key as they count: kinds without a spec, a purpose or a layer of their own have none."""
    log = log.fillna("", ["spec_path", "material_purpose", "layer_key"])
    log = routing_layer(log.filter("k <> 'set_sublayers'"))
    log = log.withColumn("spec_path", F.when(F.col("k").isin("set_sdf_spec_fields", "erase_time_samples"), F.col("spec_path")).otherwise(""))
    return log.withColumn("material_purpose", F.when(F.col("k") == "set_material_binding", F.col("material_purpose")).otherwise(""))


def _merged_living(rows: DataFrame, kills: DataFrame, columns: list[str]) -> DataFrame:
    """One edit by key and epoch, of living rows that have their epoch."""
    rows = rows.withColumn("_alone", F.when(is_exact_deletion(F.col("k"), F.col("removed")), F.col("seq")))
    group = [*KEY, "epoch", "_alone"]
    if not kills.filter("by = 'specs'").isEmpty():  # a spec of another kind begins anew
        rows = written(rows, "living")
        line = Window.partitionBy(*group).orderBy("seq")
        kind_change = ~F.col("spec_kind").eqNullSafe(F.lag("spec_kind").over(line)) | F.lag("seq").over(line).isNull()
        specs = rows.filter("k = 'set_sdf_spec_fields'").withColumn("_from", F.when(kind_change, F.col("seq")))
        specs = specs.withColumn("_from", F.max("_from").over(Window.partitionBy(*group))).filter("seq >= _from").drop("_from")
        rows = rows.filter("k <> 'set_sdf_spec_fields'").unionByName(specs)
    return _merged(rows, group).drop("_alone").select(*columns, "epoch")


def compacted(log: DataFrame) -> DataFrame:
    """The fewest edits that replay to the same scene, in the columns of `log`, with epoch.

    `log` has the columns of EDIT_SCHEMA, or those of them that it uses: scene_id, seq, client_id, layer_key, k, prim, time, spec_path,
    spec_kind, material_purpose, fields, vals, type_name, api_schemas and removed at least. Later edits undo earlier ones (alive), the rest are merged by
    key and epoch: maps by name, sets united, connections with what was disconnected last, of all else the last edit. A merged edit has the latest
    seq and author, ensure_prim the first seq, ensure_xform_ops the first edit's. Exact deletions stay apart.
    """
    log = _keyed(log)
    kills = written(killers(log), "killers")
    rows = with_epochs(alive(log, kills), kills).filter("not dead").drop("dead")
    return _merged_living(rows, kills, log.columns)


@dataclass(frozen=True)
class Reduced:
    """A reduced log and what its reduction must remember to go on: merged edits no longer tell where barriers stood."""

    rows: DataFrame
    carry: DataFrame


def reduced(log: DataFrame, before: Reduced | None = None) -> Reduced:
    """compacted() in pieces: `log` on top of the reduction of all edits before it gives what one compaction of both gives.

    Every seq of `log` is greater than those before in its scene. The edits before are not needed again: the reduced rows meet the new killers alone, new rows count their epochs on from the
    carried numbers, and both are merged by key. What is carried is three kinds of rows: epochs other than 0 by edit that stayed, barriers by prim, and by spec the last
    living sample table, the last write after it and the epochs so far; those of prims and specs of which nothing lives are dropped. Epochs that stay may have other numbers than in one run.
    Both tables are written to the shared folder.
    """
    log = _keyed(log)
    kills = written(killers(log), "killers")
    carry = None
    if before is not None:
        spec = ["scene_id", "layer_key", "spec_path"]
        specs = before.carry.filter("of = 'spec'")
        tables = specs.filter("table_at is not null").select(*spec, "prim", F.col("table_at").alias("seq"), F.lit("set_sdf_spec_fields").alias("k"))
        living = alive(tables, kills).filter("not dead").select(*spec, F.lit(True).alias("_lives"))
        specs = specs.join(living, spec, "left").withColumn("table_at", F.when(F.col("_lives"), F.col("table_at"))).select(before.carry.columns)
        carry = written(before.carry.filter("of = 'prim'").unionByName(specs), "carried")
    rows, after = _epochs(alive(log, kills), kills, carry)
    if before is not None:
        marks = before.carry.filter("of = 'row'").select("scene_id", "seq", F.col("epoch").alias("_epoch"))
        old = alive(before.rows.select(log.columns), kills).join(marks, ["scene_id", "seq"], "left").withColumn("epoch", F.coalesce("_epoch", F.lit(0).cast("long")))
        rows = old.select(rows.columns).unionByName(rows)
    out = written(_merged_living(rows.filter("not dead").drop("dead"), kills, log.columns), "reduced")
    carried = _carried(out.filter("epoch <> 0"), "row")
    if after is not None:
        prims, specs = out.select("scene_id", "layer_key", "prim").distinct(), out.filter("k = 'set_sdf_spec_fields'").select("scene_id", "layer_key", "spec_path").distinct()
        carried = carried.unionByName(after.filter("of = 'prim'").join(prims, prims.columns, "left_semi").select(carried.columns))
        carried = carried.unionByName(after.filter("of = 'spec'").join(specs, specs.columns, "left_semi").select(carried.columns))
    return Reduced(out.drop("epoch"), written(carried, "carry"))


def renumbered(log: DataFrame) -> DataFrame:
    """seq counted from 1 without gaps in each scene; keeps the old one as old_seq. One huge scene is many tasks."""
    return with_running(log.withColumnRenamed("seq", "old_seq"), ["scene_id"], "old_seq", {"seq": F.lit(1)})


def child_replay(log: DataFrame, prim: str) -> DataFrame:
    """The reduced edits below a prim, with segment and nth: their order of replay.

    Deletions and renames of the prim and above count as killers. Lifecycle edits and sample barriers stand alone;
    between them creates come first, then by prim.
    """
    below: Column = at_or_below(F.col("prim"), F.lit(prim)) & (F.col("prim") != prim)
    above = F.col("k").isin("delete_prim", "rename_prim") & at_or_below(F.lit(prim), F.col("prim"))
    kept = with_tier(compacted(log.filter((below & F.col("k").isin(*CHILD_KINDS)) | above)))
    barrier = F.col("k").isin("delete_prim", "rename_prim") | is_sample_barrier(F.col("k"), F.coalesce("fields", F.map_keys("vals")), F.col("removed"))
    kept = written(kept.withColumn("_barrier", barrier), "replayed")
    marked = with_running(kept, ["scene_id"], "seq", {"_upto": F.col("_barrier")}).withColumn("segment", 2 * F.col("_upto") - F.col("_barrier").cast("int"))
    return with_rank(marked.filter(below).drop("_barrier", "_upto"), ["scene_id"], ["segment", "tier", "prim", "seq"], "nth")


def united_schemas(log: DataFrame) -> DataFrame:
    """Per prim and layer of ensure_prim edits: the latest type, all schemas sorted, the first seq."""
    return log.filter("k = 'ensure_prim'").groupBy("scene_id", "layer_key", "prim").agg(F.max_by("type_name", "seq").alias("type_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("api_schemas")))).alias("api_schemas"), F.min("seq").alias("seq"))


def merged_connections(rows: DataFrame) -> DataFrame:
    """Per (scene, layer, prim, local_attr) the last connection's source and whether the last edit disconnected it.

    `rows`: scene_id, layer_key, prim, local_attr, source (null: a disconnection), seq. A disconnected attribute keeps its source.
    """
    key = ["scene_id", "layer_key", "prim", "local_attr"]
    return rows.groupBy(*key).agg(F.max_by("source", F.when(F.col("source").isNotNull(), F.col("seq"))).alias("source"), F.max_by(F.col("source").isNull(), "seq").alias("disconnected"))


def latest_metadata(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per scene the latest value of each stage field that an edit gives."""
    return log.groupBy("scene_id").agg(*(F.max_by(k, F.when(F.col(k).isNotNull(), F.col("seq"))).alias(k) for k in keys))


def redundant(log: DataFrame) -> DataFrame:
    """Value edits that repeat the value their layer holds for the field at that time."""
    along = Window.partitionBy("scene_id", "layer_key", "prim", "field", "time").orderBy("seq")
    return log.filter("field != ''").withColumn("_before", F.lag("value").over(along)).filter("value = _before").drop("_before")
