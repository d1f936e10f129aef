"""Lenient conversions between field types as column expressions.

A value that can't be converted becomes null; nothing aborts.  Two conversions that
the JVM formats differently from C (shortest and fixed-point decimals of doubles) are
vectorised Python functions; all others are built-in expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.fields import Field

# Ranges of the integer field types.
RANGES = {"Byte": (0, 255), "Int16": (-32768, 32767), "Int32": (-(2**31), 2**31 - 1), "Int64": (-(2**63), 2**63 - 1)}
SPARK_INT = {"Byte": "smallint", "Int16": "smallint", "Int32": "int", "Int64": "bigint"}
BLANK = r"[\s\x{A0}]*"


class ConversionError(ValueError):
    """A conversion that isn't defined between two field types."""


def _within(c: Column, kind: str) -> Column:
    low, high = RANGES[kind]
    return (c >= F.lit(low)) & (c <= F.lit(high))


def int_to_int(c: Column, kind: str) -> Column:
    """Out of range: null."""
    return F.when(_within(c, kind), c).try_cast(SPARK_INT[kind])


def double_to_int(c: Column, kind: str) -> Column:
    """The range is checked before rounding; halves go away from zero."""
    low, high = RANGES[kind]
    # 2^63 - 1 has no double: the nearest below is the greatest that fits
    inside = (c >= F.lit(float(low))) & ((c < F.lit(2.0**63)) if kind == "Int64" else (c <= F.lit(float(high))))
    moved = c + F.when(c < 0, F.lit(-0.5)).otherwise(F.lit(0.5))
    return F.when(inside & ~F.isnan(c), moved).try_cast("bigint").try_cast(SPARK_INT[kind])


def string_to_int(c: Column, kind: str = "Int32") -> Column:
    """The longest run of digits after blanks and a sign; without digits, or out of range: null."""
    digits = F.nullif(F.regexp_extract(c, rf"^{BLANK}([+-]?\d+)", 1), F.lit(""))
    wide = digits.try_cast("bigint")
    return F.when(_within(wide, kind), wide).try_cast(SPARK_INT[kind])


def text_field_to_int(c: Column, kind: str = "Int32") -> Column:
    """As string_to_int, and hexadecimal after 0x."""
    hexadecimal = F.nullif(F.regexp_extract(c, "^0[xX]([0-9a-fA-F]{1,15})(?![0-9a-fA-F])", 1), F.lit(""))
    wide = F.conv(hexadecimal, 16, 10).try_cast("bigint")
    return F.when(c.rlike("^0[xX]"), F.when(_within(wide, kind), wide).try_cast(SPARK_INT[kind])).otherwise(string_to_int(c, kind))


def string_to_double(c: Column, separator: str = ".") -> Column:
    """The longest prefix that is a number; exponents by e or d, none if it has no digits; no words for infinity."""
    if separator == ",":
        c = F.translate(c, ".,", ",.")
    found = F.regexp_extract(c, rf"^{BLANK}([+-]?(?:\d+\.?\d*|\.\d+)(?:[eEdD][+-]?\d+)?)", 1)
    return F.nullif(F.translate(found, "dD", "ee"), F.lit("")).try_cast("double")


@F.pandas_udf(T.StringType())
def double_to_string(values: pd.Series) -> pd.Series:
    """15 significant digits, without trailing zeros; exponents from 1e15 on and below 1e-4."""

    def text(x: float) -> str:
        out = f"{x:.15g}"
        if "e" in out:
            digits, _, exponent = out.partition("e")
            out = f"{digits}e{int(exponent):+03d}"
        return out

    return values.map(text, na_action="ignore").astype(object).where(values.notna(), None)


def double_to_fixed(size: int, scale: int):
    """As by C's printf: the exact binary value decides, not its shortest decimal form."""

    @F.pandas_udf(T.StringType())
    def fixed(values: pd.Series) -> pd.Series:
        texts = values.map(lambda x: f"{x:.{scale}f}", na_action="ignore").astype(object)
        return texts.where(values.notna() & (texts.map(lambda t: len(t) if isinstance(t, str) else 0) <= size), None)

    return fixed


def fixed_to_text(c: Column, size: int, scale: int) -> Column:
    """A decimal column keeps all of its digits; any other number goes by its double."""
    return F.when(F.typeof(c).startswith("decimal"), string_to_fixed(c.cast("string"), size, scale)).otherwise(double_to_fixed(size, scale)(c.cast("double")))


def string_to_fixed(c: Column, size: int, scale: int) -> Column:
    """A plain decimal of any length; further digits round half up on the first of them; what is too long becomes null.

    All of it is done on digits, so nothing is lost beyond those that a decimal holds.
    """
    led = F.regexp_replace(c, r"^([+-]?)\.", "$10.")
    part = F.regexp_extract(led, r"\.(\d+)\z", 1)
    kept = F.regexp_extract(led, r"^[+-]?(\d+)", 1)
    if scale:
        kept = F.concat(kept, F.rpad(F.substring(part, 1, scale), scale, "0"))
    head = F.rtrim(kept, F.lit("9"))
    zeros = F.repeat(F.lit("0"), F.length(kept) - F.length(head))
    raised = F.when(head == "", F.concat(F.lit("1"), zeros)).otherwise(F.concat(F.left(head, F.length(head) - 1), (F.right(head, F.lit(1)).try_cast("int") + 1).cast("string"), zeros))
    digits = F.when(F.substring(part, scale + 1, 1) >= "5", raised).otherwise(kept)
    whole = F.regexp_replace(F.left(digits, F.length(digits) - scale), r"^0+(?=\d)", "")
    sign = F.when(led.startswith("-") & digits.rlike("[1-9]"), "-").otherwise("")
    text = F.concat(sign, whole, F.lit("."), F.right(digits, F.lit(scale))) if scale else F.concat(sign, whole)
    return F.when(led.rlike(r"^[+-]?\d+(\.\d+)?\z") & (F.length(text) <= size), text)


def number_to_bool(c: Column) -> Column:
    return c != 0


def string_to_bool(c: Column) -> Column:
    """True if the first character is a digit other than 0, or t; false for all other texts."""
    return c.rlike("^[1-9Tt]")


def bool_to_string(c: Column) -> Column:
    return F.when(c, "True").when(~c, "False")


def fixed_to_bool(c: Column) -> Column:
    return c.rlike("[1-9]")


def is_date(c: Column) -> Column:
    """yyyy-mm-dd from 1400 on, and nothing after it, no line end either."""
    return F.when(c.isNotNull(), c.rlike(r"^\d{4}-\d{2}-\d{2}\z") & (F.substring(c, 1, 4) >= "1400") & c.try_cast("date").isNotNull())


def is_time(c: Column) -> Column:
    return c.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d\z")


def is_datetime(c: Column) -> Column:
    """A date, or a date and a time with a space between them."""
    return is_date(c) | (is_date(F.substring(c, 1, 10)) & (F.substring(c, 11, 1) == " ") & is_time(F.substring(c, 12, F.length(c))))


def string_to_date(c: Column) -> Column:
    """The first ten characters, if they are a date from 1400 on."""
    head = F.substring(c, 1, 10)
    return F.when(is_date(head), head.try_cast("date"))


def string_to_time(c: Column) -> Column:
    """hh:mm:ss out of a date and time, or the first eight characters."""
    dated = (F.length(c) == 19) & string_to_date(c).isNotNull()
    text = F.when(dated, F.substring(c, 12, 8)).otherwise(F.substring(c, 1, 8))
    return F.when(is_time(text), text)


def string_to_datetime(c: Column) -> Column:
    """yyyy-mm-dd hh:mm:ss, or a date alone, which means midnight; no T between them."""
    full = F.when(F.length(c) == 10, F.concat(c, F.lit(" 00:00:00"))).otherwise(c)
    return F.when(is_datetime(c), full.try_cast("timestamp_ntz"))


def datetime_to_string(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def blob_to_string(c: Column, spatial: bool = False) -> Column:
    return F.when(c.isNotNull(), F.lit("SpatialObject")) if spatial else F.concat(F.octet_length(c).cast("string"), F.lit(" Bytes"))


def text_to_blob(c: Column, field: Field) -> Column:
    """The bytes that a file holds for the text: all of a fixed field's, zeros after the text, or just those of a variable one."""
    wide = field.type in ("WString", "V_WString")
    raw = F.encode(c, "UTF-16LE" if wide else "UTF-8")
    if field.type in ("V_String", "V_WString"):
        return raw
    return F.rpad(raw, field.size * (2 if wide else 1), F.lit(b"\0"))


def wide_to_narrow(c: Column) -> Column:
    """Latin-1; what it lacks becomes a question mark."""
    return F.decode(F.encode(F.regexp_replace(c, r"[^\x{00}-\x{FF}]", "?"), "ISO-8859-1"), "ISO-8859-1")


def cut_text(c: Column, size: int) -> Column:
    return F.substring(c, 1, size)


_TEXT = {"String", "WString", "V_String", "V_WString"}
_DATED = {"Date", "Time", "DateTime"}

#: As by text, which has years from 1400 to 9999 only.
_DIRECT = {
    ("Date", "DateTime"): lambda c: c.cast("timestamp_ntz"),
    ("DateTime", "Date"): lambda c: c.cast("date"),
    ("DateTime", "Time"): lambda c: F.date_format(c, "HH:mm:ss"),
}


def convert(c: Column, source: Field, target: Field, separator: str = ".") -> Column:
    """A column of the source's type as the target's."""
    s, t = source.type, target.type
    if (s == "SpatialObj" or s == "Blob") != (t == "SpatialObj" or t == "Blob") and t not in _TEXT:
        raise ConversionError(f"{s} doesn't convert to {t}")
    if s in ("Blob", "SpatialObj"):
        out = blob_to_string(c, s == "SpatialObj") if t in _TEXT else c
    elif t in _TEXT:
        if s == "Bool":
            out = bool_to_string(c)
        elif s in ("Float", "Double"):
            out = double_to_string(c.cast("double"))
        elif s == "FixedDecimal":
            out = fixed_to_text(c, source.size, source.scale)
        elif s == "DateTime":
            out = datetime_to_string(c)
        else:
            out = c.cast("string")
        if separator == "," and s in ("Float", "Double", "FixedDecimal"):
            out = F.translate(out, ".,", ",.")
        if t in ("String", "V_String") and s in ("WString", "V_WString"):
            out = wide_to_narrow(out)
        return cut_text(out, target.size)
    elif t in _DATED:
        if s not in _TEXT | _DATED:
            raise ConversionError(f"{s} doesn't convert to {t}")
        text = datetime_to_string(c) if s == "DateTime" else c.cast("string")
        out = {"Date": string_to_date, "Time": string_to_time, "DateTime": string_to_datetime}[t](text)
        if (s, t) in _DIRECT:
            # columns of that type need no text between; a field's type may also be told of text
            out = F.when(F.typeof(c).isin("date" if s == "Date" else "timestamp_ntz", "timestamp"), F.when(F.year(c).between(1400, 9999), _DIRECT[s, t](c))).otherwise(out)
    elif t == "Bool":
        out = c if s == "Bool" else string_to_bool(c) if s in _TEXT | _DATED else number_to_bool(c)
    elif t in RANGES:
        if s == "Bool":
            out = c.cast(SPARK_INT[t])
        elif s in RANGES:
            out = int_to_int(c, t)
        elif s in _TEXT:
            out = text_field_to_int(c, t)
        elif s in _DATED:
            raise ConversionError(f"{s} doesn't convert to {t}")
        else:
            out = double_to_int(c.cast("double"), t)
    else:
        if s in _DATED:
            raise ConversionError(f"{s} doesn't convert to {t}")
        if t == "FixedDecimal":
            if s in _TEXT:
                out = string_to_fixed(F.translate(c, ".,", ",.") if separator == "," else c, target.size, target.scale).try_cast("double")
            elif s in ("Float", "Double", "FixedDecimal"):
                out = double_to_fixed(target.size, target.scale)(c.cast("double")).try_cast("double")
            else:
                out = string_to_fixed(c.cast("int").cast("string") if s == "Bool" else c.cast("string"), target.size, target.scale).try_cast("double")
        else:
            out = (string_to_double(c, separator) if s in _TEXT else c.cast("double")).cast("float" if t == "Float" else "double")
    return out


def convert_table(df: DataFrame, source: list[Field], target: list[Field], pairs: dict[str, str] | None = None, separator: str = ".") -> DataFrame:
    """df as the target's fields in one projection.  pairs: target name to source name; targets without a source are null."""
    by_name = {f.name: f for f in source}
    pairs = {f.name: f.name for f in target} if pairs is None else pairs
    out = []
    for t in target:
        s = by_name.get(pairs.get(t.name, ""))
        made = F.lit(None) if s is None else convert(F.col(f"`{s.name}`"), s, t, separator)
        shape = t.spark()
        out.append(made.cast(shape.dataType).alias(t.name, metadata=shape.metadata))
    return df.select(*out)


def lost_values(df: DataFrame, source: list[Field], target: list[Field], separator: str = ".") -> DataFrame:
    """One row: for each field of both, how many values become null on conversion."""
    by_name = {f.name: f for f in target}
    both = [(f, by_name[f.name]) for f in source if f.name in by_name]
    return df.agg(*[F.count_if(F.col(f"`{s.name}`").isNotNull() & convert(F.col(f"`{s.name}`"), s, t, separator).isNull()).alias(s.name) for s, t in both])


def inexact_values(df: DataFrame, source: list[Field], target: list[Field]) -> DataFrame:
    """One row: for each integer field that becomes a Float or Double, how many values are too large for all of their digits to be kept for sure."""
    by_name = {f.name: f for f in target}
    limits = {"Float": 2.0**23, "Double": 2.0**52}
    both = [(f, by_name[f.name]) for f in source if f.type in RANGES and f.name in by_name and by_name[f.name].type in limits]
    return df.agg(*[F.count_if(F.abs(F.col(f"`{s.name}`").cast("decimal(20,0)")) > F.lit(int(limits[t.type]))).alias(s.name) for s, t in both] or [F.lit(0).alias("none")])


def conversion_messages(df: DataFrame, source: list[Field], target: list[Field], limit: int = 10, separator: str = ".", quiet: tuple[str, ...] = ()) -> DataFrame:
    """(field, value, message): for each field of both but those in ``quiet``, ``limit`` values that become null, the least first, and one row more if there are others."""
    by_name = {f.name: f for f in target}
    parts = []
    for s in source:
        if s.name in by_name and s.name not in quiet:
            t, c = by_name[s.name], F.col(f"`{s.name}`")
            lost = df.filter(c.isNotNull() & convert(c, s, t, separator).isNull()).select(c.cast("string").alias("value"))
            shown = lost.orderBy("value").limit(limit + 1).withColumn("k", F.row_number().over(Window.orderBy("value")))
            message = F.when(F.col("k") > limit, F.lit("there are more")).otherwise(F.lit(f"doesn't convert from {s.type} to {t.type}"))
            parts.append(shown.select(F.lit(s.name).alias("field"), F.when(F.col("k") <= limit, F.col("value")).alias("value"), message.alias("message")))
    made = parts[0] if parts else df.sparkSession.createDataFrame([], "field string, value string, message string")
    for p in parts[1:]:
        made = made.unionByName(p)
    return made
