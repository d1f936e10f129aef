"""Codec and file layer, without Spark."""

import datetime as dt
import random
import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from stratablock.sources import files, lzf
from stratablock.sources.fields import DEFAULT_TEXT_SIZE, MAX_SIZE, TYPE_NAMES, Field, from_xml, to_xml
from stratablock.sources.records import decode_block, encode_block

KINDS = {
    "Bool": pa.bool_(), "Byte": pa.int16(), "Int16": pa.int16(), "Int32": pa.int32(), "Int64": pa.int64(), "Float": pa.float32(), "Double": pa.float64(), "FixedDecimal": pa.float64(),
    "String": pa.string(), "WString": pa.string(), "V_String": pa.string(), "V_WString": pa.string(), "Date": pa.date32(), "Time": pa.string(), "DateTime": pa.timestamp("us"), "Blob": pa.binary(), "SpatialObj": pa.binary(),
}
VALUES = {
    "Bool": [True, False, None], "Byte": [0, 255, None], "Int16": [-32768, 32767, None], "Int32": [-(2**31), 2**31 - 1, None], "Int64": [-(2**63), 2**63 - 1, None], "Float": [1.5, -0.25, None],
    "Double": [3.14, -1e300, None], "FixedDecimal": [123.45, -0.5, None], "String": ["abc", "", None], "WString": ["héé", "", None], "V_String": ["x" * 200, "", None], "V_WString": ["日本😀", "", None],
    "Date": [dt.date(1934, 12, 12), dt.date(1400, 1, 1), None], "Time": ["12:34:56", "00:00:00", None], "DateTime": [dt.datetime(2024, 1, 15, 13, 45, 30), dt.datetime(9999, 12, 31, 23, 59, 59), None],
    "Blob": [b"\x00\x01\xff", b"", None], "SpatialObj": [b"1234", b"", None],
}


def field(kind, size=20, scale=2):
    return Field(f"f_{kind}", kind, min(size, 30) if kind == "FixedDecimal" else size, scale if kind == "FixedDecimal" else 0)


def back(fields, columns, wanted=None, **at):
    """Encodes the columns and decodes the wanted ones."""
    table = pa.table({f.name: pa.array(c, KINDS[f.type]) for f, c in zip(fields, columns)})
    wanted = list(range(len(fields))) if wanted is None else wanted
    schema = pa.schema([(fields[k].name, KINDS[fields[k].type]) for k in wanted])
    return decode_block(encode_block(table, fields), fields, table.num_rows, wanted, schema, **at)


def test_all_types_with_null_and_empty():
    fields = [field(k, 300) for k in TYPE_NAMES]
    got = back(fields, [VALUES[k] for k in TYPE_NAMES]).to_pydict()
    assert got == {f"f_{k}": VALUES[k] for k in TYPE_NAMES}


@pytest.mark.parametrize("kind", TYPE_NAMES)
def test_each_type_alone(kind):
    assert back([field(kind, 300)], [VALUES[kind]]).column(0).to_pylist() == VALUES[kind]
    assert back([field(kind, 300)], [[]]).num_rows == 0


@pytest.mark.parametrize("kind", ["V_String", "V_WString", "Blob"])
def test_lengths_of_variable_fields(kind):
    sizes = [0, 1, 2, 3, 4, 126, 127, 128, 255, 256, 65536, 300_000]
    values = [("a" * n if kind != "Blob" else b"\x07" * n) for n in sizes]
    fields = [Field("n", "Int32"), Field("v", kind, 400_000), Field("w", kind, 400_000)]
    got = back(fields, [sizes, values, values[::-1]])
    assert got.column(1).to_pylist() == values and got.column(2).to_pylist() == values[::-1]


def test_text_is_cut_to_its_size_at_a_character():
    assert back([Field("s", "V_String", 3)], [["aéé"]]).column(0).to_pylist() == ["aé"]
    assert back([Field("s", "V_WString", 3)], [["ab😀c"]]).column(0).to_pylist() == ["ab"]
    assert back([Field("s", "WString", 4)], [["abcd"]]).column(0).to_pylist() == ["abcd"]
    assert back([Field("s", "V_WString", 9)], [["a\0b"]]).column(0).to_pylist() == ["a\0b"]


def test_odd_bytes_read_as_text():
    fields = [Field("s", "String", 4)]
    raw = b"caf\xe9\x00" + "é\0\0".encode().ljust(4, b"\0")[:4] + b"\x00"
    got = decode_block(raw, fields, 2, [0], pa.schema([("s", pa.string())]))
    assert got.column(0).to_pylist() == ["café", "é"]


def test_out_of_range_and_invalid_become_null():
    assert back([Field("b", "Byte")], [[-1, 256, 7]]).column(0).to_pylist() == [None, None, 7]
    assert back([Field("d", "Date")], [[dt.date(1399, 12, 31), dt.date(2000, 2, 29)]]).column(0).to_pylist() == [None, dt.date(2000, 2, 29)]
    assert back([Field("t", "Time")], [["24:00:00", "1:00:00", "23:59:59"]]).column(0).to_pylist() == [None, None, "23:59:59"]
    raw = b"2023-02-29\x00" + b"2024-1-005\x00" + b"2024-02-29\x00"
    assert decode_block(raw, [Field("d", "Date")], 3, [0], pa.schema([("d", pa.date32())])).column(0).to_pylist() == [None, None, dt.date(2024, 2, 29)]
    raw = b"2024-01-15T10:00:00\x00" + b"2024-01-15 10:00:00\x00"
    assert decode_block(raw, [Field("d", "DateTime")], 2, [0], pa.schema([("d", pa.timestamp("us"))])).column(0).to_pylist() == [None, dt.datetime(2024, 1, 15, 10)]


def test_decimals():
    fields = [Field("d", "FixedDecimal", 10, 2)]
    table = pa.table({"d": pa.array([Decimal("123.45"), Decimal("-0.50"), Decimal("99999999.99"), None], pa.decimal128(12, 2))})
    raw = encode_block(table, fields)
    assert raw[:11] == b"123.45".ljust(10, b"\0") + b"\0"
    got = decode_block(raw, fields, 4, [0], pa.schema([("d", pa.decimal128(9, 2))]))
    assert got.column(0).to_pylist() == [Decimal("123.45"), Decimal("-0.50"), None, None]


def test_part_of_a_block_and_order_of_columns():
    fields = [Field("a", "Int32"), Field("s", "V_WString", 50), Field("b", "Double")]
    n = 500
    columns = [list(range(n)), [str(i) * (i % 40) for i in range(n)], [i / 2 for i in range(n)]]
    got = back(fields, columns, [2, 0], skip=100, take=7)
    assert got.schema.names == ["b", "a"] and got.column(1).to_pylist() == list(range(100, 107))


def test_lzf():
    rng = random.Random(5)
    cases = [b"", b"a", b"ab" * 5, bytes(1000), b"abc" * 3000, bytes(rng.randrange(256) for _ in range(5000)), bytes(rng.choice(b"ab") for _ in range(20_000)), b"x" * 263 + b"y", b"0123456789" * 900 + b"z" * 9000 + b"0123456789" * 5]
    for data in cases:
        packed = lzf.lzf_compress(data)
        assert packed is None or (len(packed) < len(data) and lzf.lzf_decompress(packed) == data)
    assert lzf.lzf_decompress(b"\x02abc\x20\x02\xe0\x05\x05") == b"abc" + b"abc" + b"abcabcabcabcab"[: 2 + 7 + 5]
    assert lzf.lzf_decompress(b"\x00a\xe0\xff\x00") == b"a" * 265
    with pytest.raises(ValueError):
        lzf.lzf_decompress(b"\x00a\x20\x09")
    big = cases[5] * 200
    for compress in (True, False):
        import io

        source, out = io.BytesIO(lzf.pack(big, compress)), b""
        while part := lzf.unpack_chunk(source.read):
            out += part
        assert out == big


def test_schema_text():
    fields = [Field('a&<"\'>\n', "Int32", source="file: x", description="d"), Field("b", "V_String", 256), Field("c", "FixedDecimal", 10, 0)]
    assert from_xml(to_xml(fields)) == fields
    assert from_xml("<x><RecordInfo><Field name='d' type='fixeddecimal' size='10.2'/></RecordInfo></x>") == [Field("d", "FixedDecimal", 10, 2)]
    assert from_xml("<nothing/>") == []
    for bad in ("<Field name='a' type='Int33'/>", "<Field name='a' type='FixedDecimal' size='9'/>", "<Field name='a' type='String'/>", "<Field type='Bool'/>"):
        with pytest.raises(ValueError):
            from_xml(f"<RecordInfo>{bad}</RecordInfo>")
    with pytest.raises(ValueError, match="In-Database"):
        from_xml("<RecordInfo LockIn='True'></RecordInfo>")
    assert Field("v", "V_String", 300_000_000).size == MAX_SIZE["V_String"]
    for size, scale in ((0, 0), (5, 4)):
        with pytest.raises(ValueError):
            Field("d", "FixedDecimal", size, scale)


def write(path, fields, table, **options):
    return files.write_file(str(path), fields, table.to_batches(max_chunksize=10_000), **options)


def read(path, wanted=None, **at):
    info = files.read_info(str(path))
    wanted = list(range(len(info.fields))) if wanted is None else wanted
    schema = pa.schema([(info.fields[k].name, KINDS[info.fields[k].type]) for k in wanted])
    parts = [b for p in files.plan([info], **at) for b in files.read_piece(p, wanted, schema)]
    return pa.Table.from_batches(parts, schema)


@pytest.mark.parametrize("n", [0, 1, 65535, 65536, 65537, 131073])
@pytest.mark.parametrize("variable", [False, True])
def test_block_edges(tmp_path, n, variable):
    fields = [Field("id", "Int32")] + ([Field("s", "V_WString", 90)] if variable else [])
    table = pa.table({"id": pa.array(np.arange(n), pa.int32())} | ({"s": pa.array([str(i % 97) * (i % 5) for i in range(n)], pa.string())} if variable else {}))
    assert write(tmp_path / "a.rb", fields, table, compress=not variable) == n
    info = files.read_info(str(tmp_path / "a.rb"))
    assert info.records == n and len(info.blocks) == -(-n // 65536)
    assert read(tmp_path / "a.rb").equals(table)
    for k in (0, 1, 65534, 65535, 65536, 65537, 131072):
        assert read(tmp_path / "a.rb", [0], offset=k, limit=3).column(0).to_pylist() == list(range(min(k, n), min(k + 3, n)))


@pytest.mark.parametrize("compress", [True, False])
def test_runs_of_records(tmp_path, monkeypatch, compress):
    """However few bytes or rows are decoded at a time, and however long a record is, the rows are the same."""
    rng = random.Random(7)
    fields = [Field("id", "Int32"), Field("s", "V_WString", 500_000), Field("b", "Blob")]
    texts = ["x" * rng.choice([0, 1, 3, 50, 400]) for _ in range(3000)]
    texts[1500] = "é" * 300_000
    table = pa.table({"id": pa.array(range(3000), pa.int32()), "s": pa.array(texts), "b": pa.array([None if i % 7 == 0 else bytes([i % 251]) * (i % 90) for i in range(3000)], pa.binary())})
    write(tmp_path / "a.rb", fields, table, compress=compress)
    for size, batch in ((8 << 20, 16_384), (1000, 16_384), (8 << 20, 37), (1, 1000)):
        monkeypatch.setattr(files, "SLICE_BYTES", size)
        info = files.read_info(str(tmp_path / "a.rb"))
        (piece,) = files.plan([info], 5, 2990)
        got = list(files.read_piece(piece, [0, 1, 2], table.schema, batch=batch))
        assert pa.Table.from_batches(got).equals(table.slice(5, 2990))
        assert max(b.num_rows for b in got) <= batch


def test_wide_rows_take_linear_time_and_bounded_memory(tmp_path):
    import time
    import tracemalloc

    def spent(chars):
        fields = [Field("s", "V_String", 5000)]
        table = pa.table({"s": pa.array([f"{i} " + "x" * chars for i in range(20_000)])})
        write(tmp_path / "w.rb", fields, table, compress=False)
        began = time.perf_counter()
        assert read(tmp_path / "w.rb").equals(table)
        return time.perf_counter() - began

    spent(10)
    assert spent(2000) < 30 * max(spent(100), 0.05)
    info = files.read_info(str(tmp_path / "w.rb"))
    tracemalloc.start()
    spent(2000)
    tracemalloc.clear_traces()
    for p in files.plan([files.read_info(str(tmp_path / "w.rb"))]):
        for _ in files.read_piece(p, [0], pa.schema([("s", pa.string())])):
            pass
    assert tracemalloc.get_traced_memory()[1] < 5 * files.SLICE_BYTES and info.records == 20_000
    tracemalloc.stop()


def test_blocks_of_long_texts_are_written_in_bounded_memory(tmp_path, monkeypatch):
    import tracemalloc

    fields = [Field("id", "Int32"), Field("s", "V_WString", 50_000), Field("b", "Blob")]

    def batches():
        for k in range(0, 3000, 500):
            texts = [f"{i} " + "xé" * 5000 for i in range(k, k + 500)]
            yield pa.record_batch({"id": pa.array(range(k, k + 500), pa.int32()), "s": pa.array(texts), "b": pa.array([t[:2000].encode() for t in texts])})

    files.write_file(str(tmp_path / "a.rb"), fields, iter([]), compress=False)
    held = list(batches())
    tracemalloc.start()
    files.write_file(str(tmp_path / "a.rb"), fields, iter(held), compress=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20  # of 75 MB of records, one block
    assert read(tmp_path / "a.rb").equals(pa.Table.from_batches(held))
    monkeypatch.setattr(files.time, "time", lambda: 1)
    for name, size in (("b.rb", 1 << 30), ("c.rb", 1000)):
        monkeypatch.setattr(files, "ENCODE_BYTES", size)
        files.write_file(str(tmp_path / name), fields, iter(held[:2]), compress=False)
    assert (tmp_path / "b.rb").read_bytes() == (tmp_path / "c.rb").read_bytes()


def test_blocks_of_long_blobs_are_written_in_bounded_memory(tmp_path):
    """Blobs beside a key, rows of very unequal length: what is encoded at once follows their bytes, not their number."""
    import tracemalloc

    held = [pa.record_batch({"id": pa.array(range(k, k + 500)), "v": pa.array([b"v" * (40_000 if i % 2 else 10) for i in range(500)], pa.binary())}) for k in range(0, 3000, 500)]
    tracemalloc.start()
    files.write_file(str(tmp_path / "a.rb"), [Field("id", "Int64"), Field("v", "Blob")], iter(held), compress=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # of 60 MB
    assert read(tmp_path / "a.rb").equals(pa.Table.from_batches(held))


def test_headers_of_many_files(tmp_path):
    for k in range(70):
        write(tmp_path / f"{k:03d}.rb", [Field("id", "Int32")], pa.table({"id": pa.array(range(k), pa.int32())}))
    infos = files.read_infos(files.list_files(str(tmp_path)))
    assert [i.records for i in infos] == list(range(70))
    import pickle

    blocks = tuple(range(600, 600 + 5000 * 8, 8))
    many = files.FileInfo("f", infos[0].fields, 5000 * 65_536, True, 600, blocks, True)
    pieces = files.plan([many])
    assert len(pieces) == 5000 and max(len(pickle.dumps(p)) for p in pieces) < 500


def test_unescaped_schema_text():
    text = '<RecordInfo><Field name="a & b" type="Int32"/><Field name="x < "y" > z" size="10" type="V_String" source="File: C:\\a&b"/><Field name="plain" type="Double"></Field></RecordInfo>'
    assert [(f.name, f.type, f.size) for f in from_xml(text)] == [("a & b", "Int32", 0), ('x < "y" > z', "V_String", 10), ("plain", "Double", 0)]
    assert from_xml('<RecordInfo><Field name="R&D &amp; x" type="Bool" /></RecordInfo>')[0].name == "R&D & x"


def test_without_index_and_uncompressed_records(tmp_path):
    fields = [Field("id", "Int32"), Field("s", "V_String", 90)]
    n = 70_000
    table = pa.table({"id": pa.array(np.arange(n), pa.int32()), "s": pa.array([f"v{i}" for i in range(n)])})
    write(tmp_path / "a.rb", fields, table)
    raw = bytearray((tmp_path / "a.rb").read_bytes())
    struct.pack_into("<q", raw, 96, 0)
    (tmp_path / "b.rb").write_bytes(raw)
    assert not files.read_info(str(tmp_path / "b.rb")).indexed
    assert read(tmp_path / "b.rb").equals(table)
    assert read(tmp_path / "b.rb", [0], offset=66_000, limit=2).column(0).to_pylist() == [66_000, 66_001]
    info = files.read_info(str(tmp_path / "a.rb"))
    body = encode_block(table, fields)
    plain = bytes(raw[: info.first_block]) + body
    plain = bytearray(plain)
    struct.pack_into("<i", plain, 112, 0)
    (tmp_path / "c.rb").write_bytes(plain)
    assert read(tmp_path / "c.rb").equals(table)


def test_tokens_by_doubling_are_those_of_a_plain_walk():
    """Arrow decodes the same references: of rows, of long and overlapping repeats, of noise; wrong ones are told."""
    rng = random.Random(3)
    rows = b"".join(struct.pack("<qqd", i // 4, rng.randrange(50), rng.randrange(10**6) / 100) for i in range(9000))
    for data in (rows, b"a" * 200_000, b"abc" * 50_000 + rows[:5000], bytes(rng.randrange(256) for _ in range(5000)) * 3, b"xy" * 5000 + b"z" * 70_000):
        packed = lzf.lzf_compress(data)
        assert lzf.lzf_decompress(packed) == lzf._by_token(packed) == data
        made, n = lzf._as_snappy(packed)
        assert n == len(data) and pa.Codec("snappy").decompress(made, n).to_pybytes() == data
    literals = b"".join(b"\x1f" + bytes(32) for _ in range(100))
    with pytest.raises(ValueError):
        lzf.lzf_decompress(b"\x00a\x20\x09" + literals)
    assert lzf.lzf_decompress(literals[:-5]) == lzf._by_token(literals[:-5])


def test_a_block_of_rows_takes_little_time():
    """Against the plain walk over the same tokens, so that the machine doesn't count."""
    import time

    rng = random.Random(3)
    data = b"".join(struct.pack("<qqidd", i // 4, rng.randrange(20_000), i % 7, rng.randrange(50), rng.randrange(10**6) / 100) for i in range(7000))
    packed = lzf.lzf_compress(data)
    spent = {}
    for f in (lzf.lzf_decompress, lzf._by_token) * 5:
        began = time.perf_counter()
        f(packed)
        spent[f] = min(spent.get(f, 9), time.perf_counter() - began)
    assert spent[lzf.lzf_decompress] < 0.9 * spent[lzf._by_token]


def test_texts_at_once_are_those_one_by_one(monkeypatch):
    from stratablock.sources import records

    values = ["", None, "abc", "é", "日本😀", "x" * 300, "", "a\0b", None, "😀" * 40, ""]
    array = pa.array([*values, "cut off"])
    for kind, size in (("V_WString", 300), ("WString", 300), ("V_String", 300), ("String", 300), ("V_WString", 50), ("V_String", 50)):
        for part in (array, array.slice(1, 9), array.slice(3, 0), array.slice(0, 5), pa.array([None, None], pa.string())):
            got = records._text_bytes(part, Field("v", kind, size))
            with monkeypatch.context() as m:
                m.setattr(records, "_all_at_once", lambda *_: None)
                want = records._text_bytes(part, Field("v", kind, size))
            assert got[0] == want[0] and got[1].tolist() == want[1].tolist()
    blobs = pa.array([b"", None, b"ab", b"\0"])
    assert records._all_at_once(blobs.slice(1), Field("v", "Blob"))[0] == b"ab\0"


def test_numbers_over_many_files(tmp_path):
    """Each piece knows how many records the files before its own have, also with an offset and a limit."""
    for k, n in enumerate((3, 0, 70_000, 5)):
        write(tmp_path / f"{k}.rb", [Field("id", "Int32")], pa.table({"id": pa.array(range(n), pa.int32())}))
    infos = files.read_infos(files.list_files(str(tmp_path)))
    assert [p.before + p.first_record for p in files.plan(infos)] == [0, 3, 3 + 65_536, 70_003]
    assert [(p.before + p.first_record, p.take) for p in files.plan(infos, 65_538, 4467)] == [(65_538, 1), (65_539, 4464), (70_003, 2)]
    schema = pa.schema([("id", pa.int32()), ("k", pa.int64())])
    got = [b for p in files.plan(infos, 70_000, 5) for b in files.read_piece(p, [0], schema, True, before=p.before)]
    assert pa.Table.from_batches(got).column("k").to_pylist() == list(range(70_000, 70_005))


def test_headers(tmp_path):
    write(tmp_path / "a.rb", [Field("id", "Int32")], pa.table({"id": pa.array([1], pa.int32())}))
    good = (tmp_path / "a.rb").read_bytes()
    for version, fine in ((1, False), (2, True), (3, True), (5, True), (6, False)):
        raw = bytearray(good)
        raw[64] = version
        (tmp_path / "b.rb").write_bytes(raw)
        if fine:
            assert files.read_info(str(tmp_path / "b.rb")).records == 1
        else:
            with pytest.raises(ValueError):
                files.read_info(str(tmp_path / "b.rb"))
    (tmp_path / "b.rb").write_bytes(good[:100])
    with pytest.raises(ValueError):
        files.read_info(str(tmp_path / "b.rb"))
    raw = bytearray(good)
    struct.pack_into("<q", raw, 104, 0)  # never closed
    (tmp_path / "b.rb").write_bytes(raw)
    assert read(tmp_path / "b.rb").num_rows == 0
    cut = bytearray(good[:-20])
    struct.pack_into("<q", cut, 104, 5)
    (tmp_path / "b.rb").write_bytes(cut)
    with pytest.raises(ValueError):
        read(tmp_path / "b.rb")


def test_default_size():
    assert DEFAULT_TEXT_SIZE == 262144
