"""Small value functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def connectable_part(name: Column) -> Column:
    """inputs or outputs of a qualified attribute name, else null."""
    return F.nullif(F.regexp_extract(name, r"^(inputs|outputs):(.+)$", 1), F.lit(""))


def connectable_base(name: Column) -> Column:
    """The attribute name without inputs: or outputs:, else null."""
    return F.nullif(F.regexp_extract(name, r"^(inputs|outputs):(.+)$", 2), F.lit(""))


#: Output types of node definitions.
NODE_TYPES = ("boolean", "color3", "color4", "filename", "float", "integer", "string", "surfaceshader", "vector2", "vector3", "vector4")
_NODE = rf"^ND_(.+)_({'|'.join(NODE_TYPES)})$"


def node_category(info_id: Column) -> Column:
    """ND_mix_color3 is of category mix; null for what is not a node definition."""
    return F.nullif(F.regexp_extract(info_id, _NODE, 1), F.lit(""))


def node_type(info_id: Column) -> Column:
    """ND_mix_color3 makes a color3."""
    return F.nullif(F.regexp_extract(info_id, _NODE, 2), F.lit(""))


def frame_file(frame: Column) -> Column:
    """The file of a stack frame `function (file.py:12)`, without the line; null for other frames."""
    place = F.nullif(F.regexp_extract(frame, r"^.+?\s+\(([^)]+)\)$", 1), F.lit(""))
    return F.regexp_replace(place, r":[^:]*$", "")


def abbreviated(text: Column, most: int = 120) -> Column:
    """At most so many characters, the last three of a longer text made one ellipsis; null is empty."""
    return F.when(F.length(text) > most, F.concat(text.substr(1, most - 3), F.lit("…"))).otherwise(F.coalesce(text, F.lit("")))


def human_bytes(n: Column) -> Column:
    """12 B, 1.5 KB, 2.0 MB."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / 1024**2, 1), F.lit(" MB")))


def uptime(seconds: Column) -> Column:
    """1h 2m, 2m 3s or 3s."""
    s = F.floor(seconds)
    h, m = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(s >= 60, F.concat(m, F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def scene_identity(label: Column, source: Column) -> Column:
    """A label and the first twelve digits of the source's SHA-1."""
    return F.concat_ws("-", label, F.sha1(source).substr(1, 12))


def fingerprint(*values: Column) -> Column:
    return F.xxhash64(*values)


def same(a: Column, b: Column) -> Column:
    """Equality of values and arrays, nulls equal."""
    return a.eqNullSafe(b)


def near(a: Column, b: Column, eps: float) -> Column:
    """Arrays of one length whose elements differ by eps at most; nulls are near nulls only."""
    close = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= eps)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_vector(v: Column, size: int) -> Column:
    """An array of so many finite numbers; a quaternion also must not be all zeros."""
    ok = (F.size(v) == size) & F.forall(v, finite)
    return F.coalesce(ok & F.exists(v, lambda x: x != 0) if size == 4 else ok, F.lit(False))


def clamped_fields(fields: Column) -> Column:
    return F.filter(fields, lambda f: f.isin("t", "r", "s"))


def slashes(path: Column) -> Column:
    """Asset path with forward slashes."""
    return F.translate(path, "\\", "/")


def asset_matches(requested: Column, candidate: Column) -> Column:
    """Same asset, whatever the slashes; a null request matches all."""
    return requested.isNull() | (slashes(requested) == slashes(candidate))


def seconds_since(ts: Column, now: Column) -> Column:
    return F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(ts.cast("timestamp")) / 1e6


#: Rejection codes with their names, and what a session does on those that do not end it.
REJECTIONS = {1: "invalid_identity", 2: "unexpected_id", 3: "stale_layer_graph", 4: "invalid_transaction"}
DISPOSITIONS = {3: "recoverable_conflict", 4: "invalid_operation"}


def rejection_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in REJECTIONS.items() for x in kv))
    return F.coalesce(names[code], F.concat(F.lit("unknown_"), code.cast("string")))


def rejection_disposition(code: Column) -> Column:
    """What a session does; unknown codes end it."""
    found = F.create_map(*(F.lit(x) for kv in DISPOSITIONS.items() for x in kv))
    return F.coalesce(found[code], F.lit("session_fatal"))
