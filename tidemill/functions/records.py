"""Open records: JSON objects whose fields nobody listed, as maps from field names to VARIANT values.

A map keeps its record's fields in their order, and a VARIANT each value's type: numbers stay numbers, nested objects and
arrays stay what they are. Numbers are kept by value (1.50 comes out as 1.5), the fields of nested objects in order of
their names. An object with a field named twice is no record.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD = "map<string,variant>"


def record(text: Column) -> Column:
    """The record of a JSON text; null if it isn't an object, or names a field twice."""
    parsed = F.from_json(text, RECORD)
    return F.when(F.size(F.array_distinct(F.map_keys(parsed))) == F.size(parsed), parsed)


def text(value: Column) -> Column:
    """A record, or any value of one, as JSON."""
    return F.to_json(value)


def field(of: Column, path: str, kind: str) -> Column:
    """A record's field, or one further in by path a.b, as a type; null if it is missing or can't be one."""
    first, _, rest = path.partition(".")
    return F.try_variant_get(of[first], f"$.{rest}" if rest else "$", kind)


def keep(of: Column, columns: Column) -> Column:
    """The fields whose names are among the comma-separated columns (not trimmed)."""
    names = F.split(columns, ",")
    return F.map_filter(of, lambda k, _: F.array_contains(names, k))


def put(of: Column, **values: Column) -> Column:
    """A record with fields set: those that it has make way, the new ones come last."""
    new = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(v.cast("variant") for v in values.values())))
    return F.map_concat(F.map_filter(of, lambda k, _: ~k.isin(*values)), new)


def put_in(of: Column, name: str, inner: str, value: Column) -> Column:
    """A record with field inner of its object name replaced, in its place; as it is where there is none."""

    def changed(v: Column) -> Column:
        inside = F.try_variant_get(v, "$", "map<string,variant>")
        new = F.transform_values(inside, lambda k, x: F.when(k == inner, value.cast("variant")).otherwise(x))
        return F.when(inside.isNotNull(), F.to_variant_object(new)).otherwise(v)

    return F.transform_values(of, lambda k, v: F.when(k == name, changed(v)).otherwise(v))
