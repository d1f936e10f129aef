"""Field types of row-block files, their Spark types and the schema text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr, unescape

from pyspark.sql import types as T

# Fixed values of the format: type names, widths in bytes (with the byte that marks a null), limits.
FIXED_WIDTH = {"Bool": 1, "Byte": 2, "Int16": 3, "Int32": 5, "Int64": 9, "Float": 5, "Double": 9, "Date": 11, "Time": 9, "DateTime": 20}
NUMBERS = {"Byte": "u1", "Int16": "<i2", "Int32": "<i4", "Int64": "<i8", "Float": "<f4", "Double": "<f8"}
CHARS = {"Date": 10, "Time": 8, "DateTime": 19}
NARROW, WIDE, VARIABLE = {"String", "V_String"}, {"WString", "V_WString"}, {"V_String", "V_WString", "Blob", "SpatialObj"}
BINARY = {"Blob", "SpatialObj"}
TYPE_NAMES = (*FIXED_WIDTH, "FixedDecimal", "String", "WString", "V_String", "V_WString", "Blob", "SpatialObj")
MAX_SIZE = {"V_String": 2147483647, "V_WString": 1073741823}
SNAP = {"V_String": 250_000_000, "V_WString": 125_000_000}
MAX_FIELDS, MAX_NAME, MAX_LENGTH, MAX_PRECISION = 32_000, 255, 2**31 - 1, 258
DEFAULT_TEXT_SIZE = 262_144


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    size: int = 0
    scale: int = 0
    source: str = ""
    description: str = ""

    def __post_init__(self) -> None:
        if self.type not in TYPE_NAMES:
            raise ValueError(f"Unknown field type {self.type!r} of {self.name!r}")
        if self.type in NARROW | WIDE and self.size <= 0:
            raise ValueError(f"{self.name!r}: a text field needs a size")
        if self.type in SNAP and self.size > SNAP[self.type]:
            object.__setattr__(self, "size", MAX_SIZE[self.type])
        if self.type == "FixedDecimal":
            if self.size <= 0 or self.scale < 0 or (self.scale and self.scale > self.size - 2):
                raise ValueError(f"{self.name!r}: FixedDecimal({self.size},{self.scale}) isn't possible")
            if self.size > MAX_PRECISION:
                raise ValueError(f"{self.name!r}: FixedDecimal takes {MAX_PRECISION} characters at most")

    @property
    def width(self) -> int:
        """Bytes in the fixed part of a record."""
        if self.type in VARIABLE:
            return 4
        if self.type in ("FixedDecimal", "String"):
            return self.size + 1
        return 2 * self.size + 1 if self.type == "WString" else FIXED_WIDTH[self.type]

    def spark(self, exact_decimals: bool = False) -> T.StructField:
        kind: T.DataType = {
            "Bool": T.BooleanType(), "Byte": T.ShortType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(),
            "Float": T.FloatType(), "Double": T.DoubleType(), "FixedDecimal": T.DoubleType(), "Date": T.DateType(), "DateTime": T.TimestampNTZType(),
        }.get(self.type, T.BinaryType() if self.type in BINARY else T.StringType())
        if self.type == "FixedDecimal" and exact_decimals:
            digits = self.size - (1 if self.scale else 0)
            kind = T.DecimalType(digits, self.scale) if digits <= 38 else T.StringType()
        return T.StructField(self.name, kind, True, {"type": self.type, "size": self.size, "scale": self.scale, "source": self.source, "description": self.description})


def check_record(fields: list[Field]) -> None:
    if len(fields) > MAX_FIELDS:
        raise ValueError(f"{len(fields)} fields; a file takes {MAX_FIELDS} at most")
    if sum(f.width for f in fields) > MAX_LENGTH:
        raise ValueError("the record is too long")


def from_spark(schema: T.StructType) -> list[Field]:
    """The fields for a Spark schema; metadata (type, size, scale, source, description) of a column wins where it fits its type."""
    plain = {
        T.BooleanType: "Bool", T.ByteType: "Int16", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float", T.DoubleType: "Double",
        T.DateType: "Date", T.TimestampType: "DateTime", T.TimestampNTZType: "DateTime", T.BinaryType: "Blob", T.StringType: "V_WString",
    }
    allowed = {
        "Byte": (T.ShortType, T.ByteType), "FixedDecimal": (T.DoubleType, T.FloatType, T.DecimalType, T.StringType), "Time": (T.StringType,), "Date": (T.StringType, T.DateType), "DateTime": (T.StringType, T.TimestampNTZType, T.TimestampType),
        **dict.fromkeys(("String", "WString", "V_String", "V_WString"), (T.StringType,)), "Blob": (T.BinaryType,), "SpatialObj": (T.BinaryType,),
    }
    out = []
    for f in schema.fields:
        kind, meta = type(f.dataType), f.metadata or {}
        told = {"source": meta.get("source", ""), "description": meta.get("description", "")}
        wanted = meta.get("type")
        if wanted in TYPE_NAMES and (kind in allowed.get(wanted, ()) or plain.get(kind) == wanted):
            out.append(Field(f.name, wanted, int(meta.get("size", 0)) or (DEFAULT_TEXT_SIZE if wanted in NARROW | WIDE else 0), int(meta.get("scale", 0)), **told))
        elif kind is T.DecimalType:
            out.append(Field(f.name, "FixedDecimal", f.dataType.precision + 1 + (1 if f.dataType.scale else 0), f.dataType.scale, **told))
        elif kind in plain:
            out.append(Field(f.name, plain[kind], DEFAULT_TEXT_SIZE if plain[kind] == "V_WString" else 0, 0, **told))
        else:
            raise TypeError(f"column {f.name!r}: {f.dataType.simpleString()} has no field type; encode it first, as with to_json")
    check_record(out)
    return out


def to_xml(fields: list[Field]) -> str:
    lines = []
    for f in fields:
        parts = {"name": f.name, "type": f.type}
        if f.type not in FIXED_WIDTH:
            parts["size"] = str(f.size or MAX_LENGTH)
        if f.type == "FixedDecimal":
            parts["scale"] = str(f.scale)
        parts |= {k: v for k, v in (("source", f.source), ("description", f.description)) if v}
        lines.append("<Field " + " ".join(f"{k}={quoteattr(v, {chr(10): '&#xA;', chr(13): '&#xD;'})}" for k, v in sorted(parts.items())) + "/>")
    return "<RecordInfo>" + "".join(lines) + "</RecordInfo>"


def _lenient(text: str) -> ElementTree.Element:
    """The same elements out of text that some writers leave unescaped: a quote that a name and =, or the tag's end, follows ends a value."""
    attribute = re.compile(r"""([\w:.-]+)\s*=\s*(?:"(.*?)"|'(.*?)')(?=\s+[\w:.-]+\s*=|\s*/?\s*\Z)""", re.S)

    def element(name: str, inner: str) -> ElementTree.Element:
        return ElementTree.Element(name, {k: unescape(a or b, {"&quot;": '"', "&apos;": "'", "&#xA;": "\n", "&#xD;": "\r"}) for k, a, b in attribute.findall(inner)})

    root = element("RecordInfo", re.match(r"<RecordInfo\b([^>]*?)/?>", text)[1])
    # a field's tag ends at the first > after which another tag, or the element's end, follows
    for m in re.finditer(r"<Field\b(.*?)/?>(?=\s*(?:</Field\s*>\s*)?(?:<Field\b|</RecordInfo))", text, re.S):
        root.append(element("Field", m[1]))
    return root


def from_xml(text: str) -> list[Field]:
    """The fields of the first RecordInfo element in text; none without one."""
    m = re.search(r"<RecordInfo\b[^>]*?(?:/>|>.*?</RecordInfo>)", text, re.S)
    if m is None:
        return []
    try:
        root = ElementTree.fromstring(m[0])
    except ElementTree.ParseError:
        root = _lenient(m[0])
    if root.get("LockIn", "").lower() == "true":
        raise ValueError("the file belongs to an In-Database workflow, which isn't compatible")
    out = []
    for e in root.iter("Field"):
        if e.get("name") is None or e.get("type") is None:
            raise ValueError("a field needs a name and a type")
        kind = next((t for t in TYPE_NAMES if t.lower() == e.get("type", "").lower()), e.get("type", ""))
        size, scale = e.get("size", "0"), e.get("scale")
        if kind == "FixedDecimal":
            if "." in size:
                size, _, scale = size.partition(".")
            elif scale is None:
                raise ValueError(f"{e.get('name')!r}: FixedDecimal needs a scale")
        sized = kind not in FIXED_WIDTH and not (kind in BINARY and size == str(MAX_LENGTH))
        out.append(Field(e.get("name", ""), kind, int(size or 0) if sized else 0, int(scale or 0) if kind == "FixedDecimal" else 0, e.get("source", ""), e.get("description", "")))
    return out
