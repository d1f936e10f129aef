"""Text helpers as column expressions: hashes, comparisons, numbers in any base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def hash128(c: Column) -> Column:
    """32 hexadecimal digits; equal values have equal ones, and nothing else is promised."""
    return F.md5(c.cast("binary"))


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts are equal without regard to case."""
    return F.lower(F.upper(a)) == F.lower(F.upper(b))


def begins_with(a: Column, b: Column) -> Column:
    return F.startswith(F.lower(F.upper(a)), F.lower(F.upper(b)))


def compacted(c: Column) -> Column:
    """Without white space but for what stands between quotes: texts that differ in nothing else compare as equal."""
    outside = F.transform(F.split(c, '"', -1), lambda part, k: F.when(k % 2 == 0, F.regexp_replace(part, r"\s+", "")).otherwise(part))
    return F.array_join(outside, '"')


def int_to_text(c: Column, base: int = 10) -> Column:
    """A 64-bit integer in a base from 2 to 36, with a sign and small letters."""
    _check(base)
    digits = F.lower(F.conv(F.abs(c.cast("decimal(20,0)")).cast("string"), 10, base))
    return F.concat(F.when(c < 0, "-").otherwise(""), digits)


def text_to_int(c: Column, base: int = 10) -> Column:
    """The longest run of the base's digits after blanks and a sign (and 0x, for base 16); none, or beyond 64 bits: null."""
    _check(base)
    some = DIGITS[:base]
    found = r"^[\s\x{A0}]*([+-]?)" + ("(?:0[xX])?" if base == 16 else "") + f"([{some}{some.upper()}]+)"
    digits = F.ltrim(F.lower(F.regexp_extract(c, found, 2)), F.lit("0"))
    most, left = "", 2**63
    while left:
        left, k = divmod(left, base)
        most = DIGITS[k] + most
    # texts of equal length compare as their numbers do
    fits = (F.length(digits) < len(most)) | ((F.length(digits) == len(most)) & (digits <= most))
    value = F.when(digits == "", F.lit("0")).when(fits, F.conv(digits, base, 10)).try_cast("decimal(20,0)")
    signed = F.when(F.regexp_extract(c, found, 1) == "-", -value).otherwise(value)
    return F.when(F.regexp_extract(c, found, 2) != "", signed).try_cast("bigint")


def _check(base: int) -> None:
    if not 2 <= base <= 36:
        raise ValueError(f"base {base} isn't between 2 and 36")
