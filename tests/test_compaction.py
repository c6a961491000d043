"""Compaction against a sequential fold, on random logs with all its kinds."""

import random

import pytest

from editstrata.operators.reduce import Reduced, compacted, reduced
from editstrata.sources.edit_log import EDIT_SCHEMA
from editstrata.sources.log_store import LogStore, StaleToken

SAMPLED = {"set_gprim_attrs", "set_xform_trs", "set_connectable_input", "set_visibility", "set_point_instancer"}
ATTR = {"t": "xformOp:translate", "r": "xformOp:orient", "s": "xformOp:scale"}


SESSION = {"load_payload", "unload_payload", "set_stage_metadata"}
NAMES = {"set_xform_trs": ["t", "s"], "set_gprim_attrs": ["x", "y"], "set_sdf_spec_fields": ["timeSamples", "default", "custom"], "set_connectable_input": ["a", "b"], "set_stage_metadata": ["fps", "unit"], "set_point_instancer": ["positions", "ids"]}
KINDS = ["ensure_prim", "ensure_xform_ops", "set_xform_trs", "set_xform_trs", "set_gprim_attrs", "set_gprim_attrs", "set_visibility", "delete_prim", "rename_prim", "load_payload", "unload_payload", "set_material_binding", "erase_time_samples", "set_sdf_spec_fields", "set_sdf_spec_fields", "replace_sdf_layer_content", "set_sublayers", "set_reference", "set_variant_selections", "set_connectable_input", "set_connectable_connection", "set_connectable_connection", "set_stage_metadata", "deactivate_prim", "set_point_instancer"]


def some(rnd, names, value):
    return {n: value() for n in rnd.sample(names, rnd.randint(1, len(names)))}


def random_log(rnd, scene, kinds):
    rows = []
    for seq in range(1, rnd.randint(6, 26)):
        k = rnd.choice(kinds)
        e = {"scene_id": scene, "seq": seq, "client_id": f"c{rnd.randint(0, 2)}", "layer_key": rnd.choice(["L1", "L2"]), "k": k, "spec_path": "", "material_purpose": "", "removed": False, "session_id": f"x{seq}"}
        e["prim"] = "/" if k == "replace_sdf_layer_content" else rnd.choice(["/A", "/A/B", "/AB", "/A/B/C"])
        e["time"] = rnd.choice([None, 1.0, 2.0]) if k in SAMPLED else None
        e["removed"] = k == "set_sdf_spec_fields" and rnd.random() < 0.2
        if k in ("set_sdf_spec_fields", "erase_time_samples"):
            e["spec_path"] = f"{e['prim']}.{rnd.choice(['x', 'xformOp:translate', 'visibility'])}"
        if k == "set_sdf_spec_fields":
            e["spec_kind"] = rnd.choice(["attribute", "prim"])
        if k in NAMES and not e["removed"]:
            e["vals"] = some(rnd, NAMES[k], lambda: float(rnd.randint(0, 9)))
            e["fields"] = list(e["vals"])
        if k == "erase_time_samples":
            e["times"] = [float(rnd.randint(0, 3))]
        elif k == "set_material_binding":
            e |= {"material_purpose": rnd.choice(["", "full"]), "material_path": f"/M{rnd.randint(0, 3)}"}
        elif k in ("set_visibility", "deactivate_prim"):
            e["flag"] = rnd.random() < 0.5
        elif k == "rename_prim":
            e["new_name"] = f"N{rnd.randint(0, 9)}"
        elif k == "set_reference":
            e["arcs"] = [(f"a{rnd.randint(0, 9)}.usd", None, "explicit", 0.0, 1.0)] * rnd.randint(0, 2)
        elif k == "set_variant_selections":
            e["selections"] = some(rnd, ["look", "size"], lambda: f"v{rnd.randint(0, 3)}")
        elif k == "set_gprim_attrs" and rnd.random() < 0.5:
            e |= {"primvar_meta": some(rnd, ["x", "y"], lambda: ("float", f"i{rnd.randint(0, 2)}")), "attr_interp": some(rnd, ["x", "y"], lambda: f"p{rnd.randint(0, 2)}")}
        elif k == "set_connectable_input":
            e |= {"info_id": rnd.choice([None, "A", "B"]), "input_types": some(rnd, ["a", "b"], lambda: f"t{rnd.randint(0, 2)}")}
        elif k == "set_connectable_connection":
            e |= {"connections": {n: (f"/S{rnd.randint(0, 9)}", "out") for n in rnd.sample("pqr", rnd.randint(0, 2))}, "disconnections": rnd.sample("pqr", rnd.randint(0, 2))}
        elif k == "set_stage_metadata":
            e["up_axis"] = rnd.choice([None, "Y", "Z"])
        elif k == "ensure_prim":
            e |= {"type_name": rnd.choice([None, "Mesh", "Cube"]), "api_schemas": rnd.sample(["S1", "S2"], rnd.randint(0, 2))}
        rows.append(e)
    return rows


def joined(old, new):
    """The payload of an edit on top of its predecessor's."""
    k, out = new["k"], dict(new)
    if k == "set_connectable_connection":
        links, cut = dict((old or {}).get("connections") or {}), set((old or {}).get("disconnections") or ())
        for n, source in (new.get("connections") or {}).items():
            links[n] = source
            cut.discard(n)
        return out | {"connections": links, "disconnections": cut | set(new.get("disconnections") or ())}
    if old is None:
        return out
    if k == "set_sdf_spec_fields" and old.get("spec_kind") != new.get("spec_kind"):
        return out
    if k in NAMES or k in ("ensure_prim", "set_variant_selections"):
        for c in ("vals", "selections", "input_types", "primvar_meta", "attr_interp"):
            if old.get(c) or new.get(c):
                out[c] = (old.get(c) or {}) | (new.get(c) or {})
        for c in ("fields", "api_schemas"):
            out[c] = sorted(set(old.get(c) or ()) | set(new.get(c) or ()))
        for c in ("type_name", "info_id", "up_axis"):
            out[c] = new.get(c) or old.get(c)
    if k == "ensure_prim":
        out["seq"] = old["seq"]
    return out


def folded(rows):
    """What a reader of the log keeps in mind, edit by edit."""
    open_, frozen = {}, []
    for e in rows:
        k, prim, spec = e["k"], e["prim"], e["spec_path"]
        if k == "set_sublayers":
            continue
        layer = "" if k in SESSION else e["layer_key"]
        e = e | {"layer_key": layer}
        key = (e["scene_id"], layer, prim, k, e["time"], spec, e["material_purpose"])
        exact = k == "erase_time_samples" or e["removed"]
        vals = e.get("vals") or {}
        if e["time"] is not None:
            names = {"set_gprim_attrs": list(vals), "set_xform_trs": [ATTR.get(n) for n in vals], "set_visibility": ["visibility"], "set_connectable_input": [f"inputs:{n}" for n in vals]}.get(k, [])
            for n in names:
                held = next((o for o in open_ if o[:4] == (e["scene_id"], layer, prim, "set_sdf_spec_fields") and o[5] == f"{prim}.{n}"), None)
                if held and "timeSamples" in open_[held].get("fields", ()):
                    frozen.append((held, open_.pop(held)))
        if exact or (k == "set_sdf_spec_fields" and "timeSamples" in vals):
            kinds = SAMPLED | ({"set_sdf_spec_fields"} if exact else set())
            for o in [o for o in open_ if o[1] == layer and o[2] == prim and o[3] in kinds]:
                frozen.append((o, open_.pop(o)))

        def drop(test):
            for o in [o for o in open_ if test(o)]:
                del open_[o]
            frozen[:] = [x for x in frozen if not test(x[0])]

        if exact:
            if k == "set_sdf_spec_fields":
                drop(lambda o: o[1] == layer and o[5] == spec)
            frozen.append((key, e))
            continue
        if k in ("delete_prim", "rename_prim"):
            drop(lambda o: o[1] == layer and (o[2] == prim or o[2].startswith(prim + "/")))
        elif k == "replace_sdf_layer_content":
            drop(lambda o: o[1] == layer and o[3] in ("set_sdf_spec_fields", "erase_time_samples", "replace_sdf_layer_content"))
        elif k in ("load_payload", "unload_payload"):
            other = "unload_payload" if k == "load_payload" else "load_payload"
            open_.pop((e["scene_id"], layer, prim, other, None, "", ""), None)
        old = open_.get(key)
        if old and k == "ensure_xform_ops":
            continue
        open_[key] = joined(old, e)
    return sorted(map(told, [e for _, e in frozen] + list(open_.values())))


COLUMNS = ["scene_id", "layer_key", "prim", "k", "time", "spec_path", "material_purpose", "seq", "client_id", "type_name", "spec_kind", "new_name", "flag", "info_id", "up_axis", "material_path", "removed", "arcs", "times", "fields", "api_schemas", "disconnections", "vals", "selections", "input_types", "primvar_meta", "attr_interp", "connections"]


def told(e):
    """All columns of an edit as text; nothing and empty are alike, sets and maps sorted."""

    def one(c, x):
        if not x and x is not False and x != 0:
            return ""
        if isinstance(x, dict):
            return str(sorted((n, tuple(v) if isinstance(v, tuple) else v) for n, v in x.items()))
        if isinstance(x, (list, set, tuple)):
            x = [tuple(v) if isinstance(v, tuple) else v for v in x]
            return str(sorted(x) if c in ("fields", "api_schemas", "disconnections") else x)
        return str(x)

    return tuple(one(c, e.get(c)) for c in COLUMNS)


@pytest.mark.parametrize("seed", range(3))
def test_fold(spark, seed):
    """Random logs: all kinds; values and exact kinds alone; kinds that need no counting along."""
    rnd = random.Random(seed)
    kinds = [KINDS, [k for k in KINDS if k in SAMPLED or "sdf" in k or "erase" in k], [k for k in KINDS if "sdf" not in k and "erase" not in k]][seed]
    logs = [random_log(rnd, f"s{k}", kinds) for k in range(300)]
    names = spark.createDataFrame([], EDIT_SCHEMA).columns
    rows = [tuple(e.get(c) for c in names) for log in logs for e in log]
    got = sorted(told(r.asDict()) for r in compacted(spark.createDataFrame(rows, EDIT_SCHEMA.replace("variant", "double"))).collect())
    want = sorted(x for log in logs for x in folded(log))
    missing, extra = [x for x in want if x not in set(got)], [x for x in got if x not in set(want)]
    assert (missing[:3], extra[:3]) == ([], [])
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_reduced_in_pieces(spark, seed):
    """Random logs cut in two or three anywhere: each piece reduced on top of the reduction before is one compaction of all."""
    rnd = random.Random(40 + seed)
    kinds = [KINDS, [k for k in KINDS if k in SAMPLED or "sdf" in k or "erase" in k or k == "delete_prim"]][seed]
    logs = [random_log(rnd, f"s{k}", kinds) for k in range(400)]
    cuts = [sorted(rnd.randint(0, len(log)) for _ in range(2)) for log in logs]
    names = spark.createDataFrame([], EDIT_SCHEMA).columns
    held = None
    for piece in range(3):
        rows = [tuple(e.get(c) for c in names) for log, (low, high) in zip(logs, cuts, strict=True) for i, e in enumerate(log) if (i >= low) + (i >= high) == piece]
        held = reduced(spark.createDataFrame(rows, EDIT_SCHEMA.replace("variant", "double")), held)
    got = sorted(told(r.asDict()) for r in held.rows.collect())
    want = sorted(x for log in logs for x in folded(log))
    missing, extra = [x for x in want if x not in set(got)], [x for x in got if x not in set(want)]
    assert (missing[:3], extra[:3]) == ([], [])
    assert got == want


def test_store_compacts_on_top(spark, tmp_path):
    """Batches that come during each compaction go on beside it and are reduced by the next; the store ends as one compaction of all."""
    rnd = random.Random(77)
    logs = [random_log(rnd, f"s{k}", KINDS) for k in range(60)]
    names = spark.createDataFrame([], EDIT_SCHEMA).columns
    schema = EDIT_SCHEMA.replace("variant", "double")
    batch = lambda low, high: spark.createDataFrame([tuple(e.get(c) for c in names) for log in logs for e in log if low < e["seq"] <= high], schema)
    store = LogStore(spark, f"file://{tmp_path}/log")
    progress = lambda n: spark.createDataFrame([("c", "s", n)], "client_id string, session_id string, committed_through long")
    store.append(1, batch(0, 6), progress=progress(6))
    late = [(2, 6, 12), (3, 12, 18)]

    def step(new, before):
        if late:
            n, low, high = late.pop(0)
            assert store.append(n, batch(low, high), progress=progress(high))
        held = reduced(new, before and Reduced(*before))
        return held.rows, held.carry

    first = store.compact_onto(step)
    assert (first.version, first.epoch, store.progress().first().committed_through) == (1, 2, 12)
    assert not store.append(2, batch(6, 12)) and store.read(7, 12).count() == batch(6, 12).count()
    assert store.compact_onto(step).version == 2
    store.append(4, batch(18, 99))
    assert store.compact_onto(step, least_new=10_000).version == 2
    assert store.compact_onto(step).version == 3 == store.compact_onto(step).version
    assert store.progress().first().committed_through == 18 and store.token().head == max(e["seq"] for log in logs for e in log)
    got = sorted(told(r.asDict()) for r in store.read().collect())
    assert got == sorted(x for log in logs for x in folded(log))
    with pytest.raises(StaleToken):
        store.append(5, batch(0, 1))
        store.compact_onto(lambda new, before: (store.purge(), step(new, before))[1])
