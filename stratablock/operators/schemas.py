"""Comparing, searching and extending lists of fields."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

from ..functions.names import unique_names
from ..sources.fields import BINARY, NARROW, WIDE, Field, check_record

INTEGERS = {"Byte", "Int16", "Int32", "Int64"}
FLOATS = {"Float", "Double"}
TEXTS = NARROW | WIDE
DATES = {"Date", "DateTime"}

PREDICATES = {
    "any": lambda t: True,
    "bool": lambda t: t == "Bool",
    "bool_or_integer": lambda t: t == "Bool" or t in INTEGERS,
    "integer": lambda t: t in INTEGERS,
    "float": lambda t: t in FLOATS,
    "numeric": lambda t: t in INTEGERS | FLOATS or t == "FixedDecimal",
    "string": lambda t: t in TEXTS,
    "string_or_date": lambda t: t in TEXTS | DATES | {"Time"},
    "date_or_time": lambda t: t in DATES | {"Time"},
    "time": lambda t: t == "Time",
    "date": lambda t: t in DATES,
    "binary": lambda t: t in BINARY,
    "blob": lambda t: t == "Blob",
    "spatial": lambda t: t == "SpatialObj",
    "not_binary": lambda t: t not in BINARY,
    "not_blob": lambda t: t != "Blob",
    "not_spatial": lambda t: t != "SpatialObj",
    "narrow_string": lambda t: t in NARROW,
    "wide_string": lambda t: t in WIDE,
    "variable_string": lambda t: t in ("V_String", "V_WString"),
}


def is_a(field: Field, kind: str) -> bool:
    return PREDICATES[kind](field.type)


def same_schema(a: list[Field], b: list[Field]) -> bool:
    """Type, name without regard to case, size and scale, in order."""
    key = lambda f: (f.type, f.name.casefold(), f.size, f.scale)
    return list(map(key, a)) == list(map(key, b))


def same_types(a: list[Field], b: list[Field], allow_more: bool = False) -> bool:
    """Types, sizes and scales in order; with allow_more, b may go on."""
    key = lambda f: (f.type, f.size, f.scale)
    x, y = list(map(key, a)), list(map(key, b))
    return x == (y[: len(x)] if allow_more else y)


def field_number(fields: list[Field], name: str, required: bool = True) -> int:
    for k, f in enumerate(fields):
        if f.name.casefold() == name.casefold():
            return k
    if required:
        raise KeyError(f"no field {name!r}")
    return -1


def fields_of(fields: list[Field], kind: str, begin: int = 0) -> list[int]:
    """Numbers of the fields of a kind (a predicate or a type name) from ``begin`` on."""
    return [k for k, f in enumerate(fields) if k >= begin and (PREDICATES[kind](f.type) if kind in PREDICATES else f.type == kind)]


def add_field(fields: list[Field], new: Field) -> list[Field]:
    names = unique_names([*(f.name for f in fields), new.name])
    out = [*fields, renamed(new, names[-1])]
    check_record(out)
    return out


def renamed(field: Field, name: str) -> Field:
    return Field(name, field.type, field.size, field.scale, field.source, field.description)


def rename_fields(fields: list[Field], names: dict[str, str]) -> list[Field]:
    """All at once, so that names can be swapped; names that collide are made unique."""
    lower = {k.casefold(): v for k, v in names.items()}
    wanted = [lower.get(f.name.casefold(), f.name) for f in fields]
    return [renamed(f, n) for f, n in zip(fields, unique_names(wanted))]


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """As rename_fields, for a table's columns: all at once, without regard to case, and made unique."""
    lower = {k.casefold(): v for k, v in names.items()}
    return df.toDF(*unique_names([lower.get(c.casefold(), c) for c in df.columns]))


def source_of(field: Field) -> tuple[str, str]:
    """(scope, value) of a field's source."""
    scope, _, value = field.source.partition(":")
    return scope, value


def schema_hash(fields: list[Field]) -> int:
    return zlib.crc32(";".join(f"{f.type},{f.size},{f.scale}" for f in fields).encode())
