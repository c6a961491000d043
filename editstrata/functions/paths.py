"""Scene paths such as /World/Group/Prim, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def depth(path: Column) -> Column:
    """Number of names in a path; 0 for the root."""
    return F.length(path) - F.length(F.translate(path, "/", "")) - F.when(path == "/", 1).otherwise(0)


def leaf_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The path above; / above a path of one name, null above /."""
    above = path.substr(F.lit(1), F.length(path) - F.length(leaf_name(path)) - 1)
    return F.when(path == "/", F.lit(None).cast("string")).when(above == "", "/").otherwise(above)


def lineage(path: Column) -> Column:
    """The path's ancestors from the top, and the path itself."""
    names = F.split(F.ltrim(path, F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(names, 1, n), "/")))


def ancestors(path: Column) -> Column:
    """The path's proper ancestors below the root, from the top."""
    return F.filter(lineage(path), lambda p: p != path)


def at_or_below(path: Column, root: Column) -> Column:
    """/A/B is at or below /A, /AB is not."""
    top = F.rtrim(root, F.lit("/"))
    return (path == root) | path.startswith(F.concat(top, F.lit("/")))


def renamed(path: Column, old_root: Column, new_name: Column) -> Column:
    """The path after old_root got a new last name; paths elsewhere stay."""
    top = parent(old_root)
    new_root = F.concat(F.when(top == "/", "").otherwise(top), F.lit("/"), new_name)
    return F.when(at_or_below(path, old_root), F.concat(new_root, path.substr(F.length(old_root) + 1, F.length(path)))).otherwise(path)


def prim_of(property_path: Column) -> Column:
    """The prim of a property path /A/B.attr; null for what is not absolute."""
    return F.when(property_path.startswith("/"), F.substring_index(property_path, ".", 1))


def is_prim_path(path: Column) -> Column:
    """Absolute, not the root, of identifiers, without a variant selection or property."""
    return F.coalesce(path.rlike(r"^(/[\p{L}_][\p{L}\p{N}_]*)+$"), F.lit(False))
