"""Typed values: numbers, truth values, texts, arrays and objects in one column, as VARIANT.

A value is equal to another if both mean the same: 1 and 1.0 are one number, also inside arrays, and an object's keys have no order. Texts, truth
values and numbers are never equal to each other. `canonical` is the text that says this; equality, fingerprints and keys go by it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, VariantType

_NUMBER = r"(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\))"


def is_typed(kind: DataType) -> bool:
    """Whether a column of this type, or a map's value, is a VARIANT."""
    return isinstance(kind, VariantType) or isinstance(kind, MapType) and isinstance(kind.valueType, VariantType)


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def kind_of(v: Column) -> Column:
    """null, bool, number, text, numbers (an array of numbers), rows (an array of these), array, object or other; null for no value."""
    of = F.schema_of_variant(v)
    return (
        F.when(of == "VOID", "null")
        .when(of == "BOOLEAN", "bool")
        .when(of == "STRING", "text")
        .when(of.rlike(f"^{_NUMBER}$"), "number")
        .when(of.rlike(f"^ARRAY<(?:{_NUMBER}|VOID)>$") & ~F.exists(_get(v, "array<double>"), F.isnull), "numbers")
        .when(of.rlike(f"^ARRAY<ARRAY<(?:{_NUMBER}|VOID)>>$") & ~F.exists(_get(v, "array<array<double>>"), lambda a: a.isNull() | F.exists(a, F.isnull)), "rows")
        .when(of.startswith("ARRAY"), "array")
        .when(of.startswith("OBJECT"), "object")
        .when(of.isNotNull(), "other")
    )


def number(v: Column) -> Column:
    """The number, or null for what is none."""
    return F.when(kind_of(v) == "number", _get(v, "double"))


def numbers(v: Column) -> Column:
    """The numbers of an array, or of an array of arrays one after another, as array<double>; null for what is neither."""
    kind = kind_of(v)
    return F.when(kind == "numbers", _get(v, "array<double>")).when(kind == "rows", F.flatten(_get(v, "array<array<double>>")))


def canonical(v: Column) -> Column:
    """A text that two values share exactly if they are equal. Whole numbers over 2**53 keep all digits."""
    kind, whole = kind_of(v), _get(v, "bigint")
    large = (F.schema_of_variant(v) == "BIGINT") & (F.abs(whole) > 1 << 53)
    return (
        F.when(kind == "number", F.when(large, whole.cast("string")).otherwise(_get(v, "double").cast("string")))
        .when(kind == "numbers", F.to_json(_get(v, "array<double>")))
        .when(kind == "rows", F.to_json(_get(v, "array<array<double>>")))
        .otherwise(F.to_json(v))
    )


def same(a: Column, b: Column) -> Column:
    """Equality by content; a missing value equals a missing one only."""
    return canonical(a).eqNullSafe(canonical(b))


def near(a: Column, b: Column, eps: float) -> Column:
    """Numbers and arrays of numbers that differ by eps at most, element by element; other values if they are equal."""
    x, y = (F.coalesce(numbers(v), F.when(kind_of(v) == "number", F.array(_get(v, "double")))) for v in (a, b))
    close = (F.size(x) == F.size(y)) & (kind_of(a) == kind_of(b)) & F.forall(F.zip_with(x, y, lambda p, q: F.abs(p - q)), lambda d: d <= eps)
    return F.when(x.isNotNull() & y.isNotNull(), close).otherwise(same(a, b))


def fingerprint(v: Column) -> Column:
    """A 64-bit hash of the value, equal for equal values; null for a missing one."""
    return F.when(v.isNotNull(), F.xxhash64(canonical(v)))


def finite(v: Column) -> Column:
    """Whether the value holds no number that is NaN or infinite; false for a missing value."""
    fine = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    kind = kind_of(v)
    return F.coalesce(F.when(kind == "number", fine(_get(v, "double"))).when(kind.isin("numbers", "rows"), F.forall(numbers(v), fine)).otherwise(v.isNotNull()), F.lit(False))


def has_width(v: Column, width: int) -> Column:
    """Whether an array of numbers, or of rows of numbers, is made of rows of so many."""
    kind = kind_of(v)
    of_rows = F.forall(_get(v, "array<array<double>>"), lambda a: F.size(a) == width)
    return F.coalesce(F.when(kind == "numbers", F.size(_get(v, "array<double>")) % width == 0).when(kind == "rows", of_rows), F.lit(False))


def is_vector(v: Column, size: int) -> Column:
    """An array of so many finite numbers; a quaternion also must not be all zeros."""
    items = F.when(kind_of(v) == "numbers", _get(v, "array<double>"))
    ok = (F.size(items) == size) & finite(v)
    return F.coalesce(ok & F.exists(items, lambda x: x != 0) if size == 4 else ok, F.lit(False))
