import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from stratablock.functions import convert as C
from stratablock.functions import texts as X
from stratablock.sources.fields import Field

TEXT = Field("v", "V_WString", 50)


def run(spark, values, kind, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col('v'))).collect()]


@pytest.mark.parametrize(
    "values,kind,expr,want",
    [
        ([0, 255, 256, -1, None], "bigint", lambda v: C.int_to_int(v, "Byte"), [0, 255, None, None, None]),
        ([2**31 - 1, 2**31], "bigint", lambda v: C.int_to_int(v, "Int32"), [2**31 - 1, None]),
        ([2.5, -2.5, 0.5, -0.5, 0.4, 1e300, float("nan"), None], "double", lambda v: C.double_to_int(v, "Int32"), [3, -3, 1, -1, 0, None, None, None]),
        ([255.4, 255.0, 254.6], "double", lambda v: C.double_to_int(v, "Byte"), [None, 255, 255]),
        ([9.3e18, -9.2e18], "double", lambda v: C.double_to_int(v, "Int64"), [None, -9200000000000000000]),
        (["12abc", "  5", "-7", "+3", "x", "", "-", " x", None, "99999999999"], "string", lambda v: C.string_to_int(v), [12, 5, -7, 3, None, None, None, None, None, None]),
        (["300", "44"], "string", lambda v: C.string_to_int(v, "Byte"), [None, 44]),
        (["0x1F", "0XffzZ", "0x", "12", "0x80000000", None], "string", lambda v: C.text_field_to_int(v), [31, 255, None, 12, None, None]),
        (["1e5", "2d2", "7e", " 1.5x", ".5", "-.5e1", "5.", "abc", "inf", "", None], "string", lambda v: C.string_to_double(v), [1e5, 200.0, 7.0, 1.5, 0.5, -5.0, 5.0, None, None, None, None]),
        (["1,5", "1.5"], "string", lambda v: C.string_to_double(v, ","), [1.5, 1.0]),
        ([0.1, 1e15, 123456789.125, 1e-5, 0.0001, 100.0, 1e300, None], "double", lambda v: C.double_to_string(v), ["0.1", "1e+15", "123456789.125", "1e-05", "0.0001", "100", "1e+300", None]),
        ([0.125, 2.675, 1e9, None], "double", lambda v: C.double_to_fixed(6, 2)(v), ["0.12", "2.67", None, None]),
        (["9.99", "-9.95", ".5", "-.5", "+1", "1.", "abc", "", "12345678", None], "string", lambda v: C.string_to_fixed(v, 6, 1), ["10.0", "-10.0", "0.5", "-0.5", "1.0", None, None, None, None, None]),
        (["True", "t", "9", "0", "no", "", None], "string", lambda v: C.string_to_bool(v), [True, True, True, False, False, False, None]),
        ([True, False, None], "boolean", lambda v: C.bool_to_string(v), ["True", "False", None]),
        (["0.00", "0.10", None], "string", lambda v: C.fixed_to_bool(v), [False, True, None]),
        (["1" * 50 + ".45", "9" * 48 + ".95", "-0.04", "-0.05", "007.25", "1.5\n"], "string", lambda v: C.string_to_fixed(v, 60, 1), ["1" * 50 + ".5", "1" + "0" * 48 + ".0", "0.0", "-0.1", "7.3", None]),
        (["0.5", "99.4", "-2.5", "9.5"], "string", lambda v: C.string_to_fixed(v, 3, 0), ["1", "99", "-3", "10"]),
        (["2024-02-29", "2024-02-29\n", "1399-01-01", "2024-02-30", "x", None], "string", C.is_date, [True, False, False, False, False, None]),
        (["23:59:59", "23:59:59\n", None], "string", C.is_time, [True, False, None]),
        (["2024-01-15 10:00:00", "2024-01-15 10:00:00\n", "2024-01-15\n"], "string", lambda v: C.string_to_datetime(v), [dt.datetime(2024, 1, 15, 10), None, None]),
        (["a b", 'a "b  c" d', None], "string", X.compacted, ["ab", 'a"b  c"d', None]),
        (["zz", "-10", "", "12345678901234567890123"], "string", lambda v: X.text_to_int(v, 36), [1295, -36, None, None]),
        ([255, -255, 0, -(2**63), None], "bigint", lambda v: X.int_to_text(v, 16), ["ff", "-ff", "0", "-8000000000000000", None]),
        (["2024-02-29", "2023-02-29", "1399-12-31", "1400-01-01", "1900-02-29", "2024-01-15 10:00:00", "2024-1-5"], "string", lambda v: C.string_to_date(v), [dt.date(2024, 2, 29), None, None, dt.date(1400, 1, 1), None, dt.date(2024, 1, 15), None]),
        (["23:59:59", "24:00:00", "2024-01-15 10:11:12", "1:00:00"], "string", lambda v: C.string_to_time(v), ["23:59:59", None, "10:11:12", None]),
        (["2024-01-15", "2024-01-15 10:11:12", "2024-01-15T10:11:12", "2024-01-15 24:00:00"], "string", lambda v: C.string_to_datetime(v), [dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 15, 10, 11, 12), None, None]),
        ([bytearray(b"abc"), bytearray(b""), None], "binary", lambda v: C.blob_to_string(v), ["3 Bytes", "0 Bytes", None]),
        (["aé日😀"], "string", lambda v: C.wide_to_narrow(v), ["aé??"]),
    ],
)
def test_values(spark, values, kind, expr, want):
    got = run(spark, values, kind, expr)
    assert got == want


def test_wide_to_narrow_counts_units(spark):
    assert run(spark, ["é"], "string", C.wide_to_narrow) == ["é"]


def test_undefined_conversions():
    for s, t in (("Int32", "Date"), ("Blob", "Int32"), ("Date", "Double"), ("Double", "Blob"), ("Bool", "Time")):
        with pytest.raises(C.ConversionError):
            C.convert(None, Field("v", s, 9), Field("v", t, 9))


def test_table(spark):
    source = [Field("n", "Double"), Field("s", "V_WString", 20), Field("b", "Bool")]
    target = [Field("s", "Int32"), Field("n", "V_String", 3), Field("b", "Int16"), Field("new", "Double")]
    df = spark.createDataFrame([(1.25, "7x", True), (1234.5, "x", None)], "n double, s string, b boolean")
    out = C.convert_table(df, source, target)
    assert [tuple(r) for r in out.collect()] == [(7, "1.2", 1, None), (None, "123", None, None)]
    assert out.schema["n"].metadata["type"] == "V_String"
    assert tuple(C.lost_values(df, source, target).first()) == (0, 1, 0)
    swapped = C.convert_table(df, source, [Field("x", "Double")], {"x": "s"}, separator=",")
    assert [r.x for r in swapped.collect()] == [7.0, None]


def test_messages_and_inexact_values(spark):
    source = [Field("s", "V_WString", 20), Field("n", "Int64"), Field("quiet", "V_WString", 20)]
    target = [Field("s", "Int32"), Field("n", "Float"), Field("quiet", "Int32")]
    df = spark.createDataFrame([("x", 1, "q"), ("7", 2**24, "q"), ("b", -(2**23), "q"), ("a", None, "q"), (None, 2**23 + 1, None)], "s string, n long, quiet string")
    assert C.inexact_values(df, source, target).first().n == 2
    got = [tuple(r) for r in C.conversion_messages(df, source, target, limit=2, quiet=("quiet",)).collect()]
    assert got == [("s", "a", "doesn't convert from V_WString to Int32"), ("s", "b", "doesn't convert from V_WString to Int32"), ("s", None, "there are more")]
    assert C.conversion_messages(df, source, target, limit=9).count() == 7


def test_exact_decimal_round_trip():
    from stratablock.sources.records import decimal_text

    assert decimal_text(Decimal("2.675"), 10, 2) == "2.68" and decimal_text(2.675, 10, 2) == "2.67" and decimal_text("abc", 10, 2) is None


def test_exact_decimals_keep_their_digits_as_text(spark):
    df = spark.sql("SELECT CAST(v AS decimal(20,2)) AS v FROM VALUES ('123456789012345678.91'), ('-0.10'), ('0.00'), (NULL) t(v)")
    got = df.select(C.convert(F.col("v"), Field("v", "FixedDecimal", 22, 2), TEXT, ",").alias("s"))
    assert [r.s for r in got.collect()] == ["123456789012345678,91", "-0,10", "0,00", None]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind,source,target", [("date", "Date", "DateTime"), ("timestamp_ntz", "DateTime", "Date"), ("timestamp_ntz", "DateTime", "Time"), ("timestamp", "DateTime", "Date"), ("timestamp", "DateTime", "Time")])
def test_dates_convert_without_text_between(spark, kind, source, target):
    """The same values as by their text, years out of range too; no pattern is matched row by row."""
    texts = ["2024-02-29 23:59:59.999999", "1400-01-01 00:00:00", "1399-12-31 23:59:59", "9999-12-31 12:00:00", "0001-01-01 01:02:03", "1969-12-31 23:59:59.5", "1582-10-04 06:00:00", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").select("i", F.col("s").cast("timestamp_ntz").cast(kind).alias("v"))
    df = df.unionByName(spark.range(1).select(F.lit(99).alias("i"), F.expr(f"CAST(TIMESTAMP_NTZ'9999-12-31 23:00:00' + INTERVAL 2 HOURS AS {kind})").alias("v"))).orderBy("i")
    c, f, t = F.col("v"), Field("v", source), Field("v", target)
    by_text = {"Date": C.string_to_date, "Time": C.string_to_time, "DateTime": C.string_to_datetime}[target](C.datetime_to_string(c) if source == "DateTime" else c.cast("string"))
    got = df.select(C.convert(c, f, t).alias("out"))
    assert got.collect() == df.select(by_text.alias("out")).collect()
    assert "RLIKE" not in got._jdf.queryExecution().optimizedPlan().toString()
    told = spark.createDataFrame([("2024-02-29",), ("2024-02-30",), ("x",)], "v string").select(C.convert(c, Field("v", "Date"), Field("v", "DateTime")).alias("d"))
    assert [r.d for r in told.collect()] == [dt.datetime(2024, 2, 29), None, None]
