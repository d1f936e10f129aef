import pytest
from stratablock.functions.names import unique_names
from stratablock.operators import schemas as S
from stratablock.sources.fields import TYPE_NAMES, Field


@pytest.mark.parametrize(
    "given,made",
    [
        (["a", "A"], ["a", "A2"]),
        (["X"] * 4, ["X", "X2", "X3", "X4"]),
        (["X"] * 11, ["X", *(f"X{i}" for i in range(2, 10)), "X9_2", "X9_3"]),
        (["F2", "F2"], ["F2", "F3"]),
        (["F10", "F10", "F10"], ["F10", "F10_2", "F10_3"]),
        (["", "b", ""], ["Field_1", "b", "Field_3"]),
        (["n" * 300], ["n" * 255]),
        (["X", "X", "X2"], ["X", "X3", "X2"]),
        (["ok", "fine"], ["ok", "fine"]),
    ],
)
def test_names(given, made):
    assert unique_names(given) == made


def test_strict_names():
    assert unique_names(["1a", "b c", "é"], strict=True) == ["_1a", "b_c", "_"]


def test_predicates():
    counts = {k: sum(S.is_a(Field("f", t, 10, 0), k) for t in TYPE_NAMES) for k in S.PREDICATES}
    assert counts["any"] == 17 and counts["numeric"] == 7 and counts["string"] == 4 and counts["date"] == 2 and counts["time"] == 1
    assert counts["not_blob"] == 16 and counts["variable_string"] == 2 and counts["bool_or_integer"] == 5 and len(S.PREDICATES) == 20


def test_compare_find_rename():
    a = [Field("A", "Int32"), Field("b", "V_String", 10)]
    b = [Field("a", "Int32"), Field("B", "V_String", 10)]
    assert S.same_schema(a, b) and not S.same_schema(a, b[::-1])
    assert S.same_types(a, [*b, Field("c", "Bool")], allow_more=True) and not S.same_types(a, [*b, Field("c", "Bool")])
    assert S.field_number(a, "B") == 1 and S.field_number(a, "z", required=False) == -1
    with pytest.raises(KeyError):
        S.field_number(a, "z")
    assert S.fields_of(a, "numeric") == [0] and S.fields_of(a, "V_String") == [1] and S.fields_of(a, "any", 1) == [1]
    assert [f.name for f in S.rename_fields(a, {"A": "b", "b": "A"})] == ["b", "A"]
    assert [f.name for f in S.add_field(a, Field("a", "Bool"))] == ["A", "b", "a2"]
    assert S.schema_hash(a) == S.schema_hash(b) != S.schema_hash(a[:1])
    assert S.source_of(Field("x", "Bool", source="File: y")) == ("File", " y")
