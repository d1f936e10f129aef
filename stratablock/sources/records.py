"""Blocks of records to Arrow columns and back, a column at a time in numpy.

A record is a fixed part, a field after the other, and, if there are fields of
variable length, the length of what follows (32 bits) and their data.  Such a field's
fixed part is a 32-bit pointer: 0 empty, 1 null, up to three bytes within itself
(their number in bits 28-29), else the distance from the pointer to the data, which
start with their length: one odd byte (up to 127), or four even ones.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

import numpy as np
import pyarrow as pa

from .fields import BINARY, CHARS, NARROW, NUMBERS, VARIABLE, WIDE, Field
from .lzf import spread

FIRST_YEAR = 1400
#: Arrow's offsets have 32 bits.
MAX_SLICE = 2**31 - 1


def offsets_of(fields: list[Field]) -> list[int]:
    return [0, *np.cumsum([f.width for f in fields]).tolist()]


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of all values in a row: by places for short ones, else value by value, so that no index outgrows the values."""
    if int(lengths.sum()) <= 16 * len(lengths):
        return data[spread(starts, lengths)].tobytes()
    view = memoryview(data)
    return b"".join([view[a:b] for a, b in zip(starts.tolist(), (starts + lengths).tolist())])


def _copied(out: np.ndarray, to: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Puts values out of data into out: by places for short ones, else value by value, as in _gathered."""
    if int(lengths.sum()) <= 16 * len(lengths):
        out[spread(to, lengths)] = data[spread(starts, lengths)]
        return
    target, source = memoryview(out), memoryview(data)
    for a, b, n in zip(to.tolist(), starts.tolist(), lengths.tolist()):
        target[a : a + n] = source[b : b + n]


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


# Reading


def record_starts(data: np.ndarray, fixed: int, variable: bool, n: int) -> np.ndarray:
    if not variable:
        return np.arange(n, dtype=np.int64) * fixed
    raw, at, out = data.tobytes(), 0, np.empty(n, np.int64)
    for i in range(n):
        out[i] = at
        at += fixed + 4 + int.from_bytes(raw[at + fixed : at + fixed + 4], "little")
    return out


def _validity(null: np.ndarray) -> pa.Buffer | None:
    return pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None


def _binary(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, null: np.ndarray, kind: pa.DataType) -> pa.Array:
    lengths = np.where(null, 0, lengths)
    ends = _ends(lengths)
    if ends[-1] > MAX_SLICE:
        raise ValueError("a column's values take more than 2 GiB in one batch: read smaller batches")
    return pa.Array.from_buffers(kind, len(null), [_validity(null), pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(_gathered(data, starts, lengths))])


def _narrow(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, null: np.ndarray) -> pa.Array:
    """UTF-8 where it is that, else Latin-1, value by value."""
    out = _binary(data, starts, lengths, null, pa.string())
    try:
        out.validate(full=True)
        return out
    except pa.ArrowInvalid:
        raw = _binary(data, starts, lengths, null, pa.binary())

        def text(b: bytes | None) -> str | None:
            if b is None:
                return None
            try:
                return b.decode("utf-8")
            except UnicodeDecodeError:
                return b.decode("latin-1")

        return pa.array(map(text, raw.to_pylist()), pa.string())


def _wide(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, null: np.ndarray) -> pa.Array:
    lengths = np.where(null, 0, lengths // 2 * 2)
    raw = _gathered(data, starts, lengths)
    units = np.frombuffer(raw, "<u2")
    ends = _ends(lengths) // 2
    if ((units & 0xF800) == 0xD800).any():  # surrogates: pairs count within a value only
        values = [None if x else raw[2 * a : 2 * b].decode("utf-16-le", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace") for a, b, x in zip(ends[:-1], ends[1:], null)]
        return pa.array(values, pa.string())
    size = np.zeros(len(units) + 1, np.int32)  # a run's text is far below 2 GiB
    np.cumsum((units >= 0x80).view(np.uint8) + (units >= 0x800) + np.uint8(1), dtype=np.int32, out=size[1:])
    return pa.Array.from_buffers(pa.string(), len(null), [_validity(null), pa.py_buffer(size[ends].astype("<i4").tobytes()), pa.py_buffer(raw.decode("utf-16-le").encode("utf-8"))])


def _digits(chars: np.ndarray, *at: int) -> np.ndarray:
    out = np.zeros(len(chars), np.int64)
    for i in at:
        out = out * 10 + (chars[:, i].astype(np.int64) - 48)
    return out


def _are_digits(chars: np.ndarray, at: list[int]) -> np.ndarray:
    part = chars[:, at]
    return ((part >= 48) & (part <= 57)).all(1)


def parse_dates(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(days, valid) of yyyy-mm-dd; years before 1400 aren't valid."""
    ok = _are_digits(chars, [0, 1, 2, 3, 5, 6, 8, 9]) & (chars[:, 4] == 45) & (chars[:, 7] == 45)
    year, month, day = _digits(chars, 0, 1, 2, 3), _digits(chars, 5, 6), _digits(chars, 8, 9)
    ok &= (year >= FIRST_YEAR) & (month >= 1) & (month <= 12) & (day >= 1)
    months = np.where(ok, (year - 1970) * 12 + month - 1, 0).astype("M8[M]")
    days = months.astype("M8[D]") + np.where(ok, day - 1, 0)
    ok &= days.astype("M8[M]") == months
    return days, ok


def parse_times(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seconds, valid) of hh:mm:ss."""
    ok = _are_digits(chars, [0, 1, 3, 4, 6, 7]) & (chars[:, 2] == 58) & (chars[:, 5] == 58)
    h, m, s = _digits(chars, 0, 1), _digits(chars, 3, 4), _digits(chars, 6, 7)
    return np.where(ok, h * 3600 + m * 60 + s, 0), ok & (h < 24) & (m < 60) & (s < 60)


def _decimals(texts: list[str | None], kind: pa.DataType) -> pa.Array:
    def value(t: str | None):
        if t is None:
            return None
        try:
            return float(t) if pa.types.is_floating(kind) else Decimal(t)
        except (ValueError, InvalidOperation):
            return None

    if pa.types.is_string(kind):
        return pa.array(texts, kind)
    return pa.array(map(value, texts), kind)


def _column(f: Field, part: np.ndarray, data: np.ndarray, places: np.ndarray, kind: pa.DataType) -> pa.Array:
    """part: the field's bytes of all records; places: where they are in data."""
    if f.type == "Bool":
        return pa.array(part[:, 0] & 1 == 1, mask=part[:, 0] & 2 == 2)
    if f.type in NUMBERS:
        values = np.ascontiguousarray(part[:, :-1]).view(NUMBERS[f.type])[:, 0]
        return pa.array(values.astype(np.int16) if f.type == "Byte" else values, mask=part[:, -1] != 0)
    if f.type in VARIABLE:
        p = np.ascontiguousarray(part).view("<u4")[:, 0].astype(np.int64)
        null = p == 1
        inside = (p & 0x80000000 == 0) & (p & 0x30000000 != 0)
        away = ~null & ~inside & (p != 0)
        at = np.where(away, places + (p & 0x7FFFFFFF), 0)
        first = data[at].astype(np.int64)
        quad = np.minimum(at[:, None] + np.arange(4), len(data) - 1)
        far = data[quad].astype(np.int64) @ np.array([1, 1 << 8, 1 << 16, 1 << 24])
        odd = first & 1 == 1
        lengths = np.where(away, np.where(odd, first >> 1, far >> 1), np.where(inside, p >> 28, 0))
        starts = np.where(away, at + np.where(odd, 1, 4), places)
        if f.type in BINARY:
            return _binary(data, starts, lengths, null, pa.binary())
        return (_wide if f.type in WIDE else _narrow)(data, starts, lengths, null)
    null = part[:, -1] != 0
    chars = part[:, :-1]
    if f.type == "Time":
        seconds, ok = parse_times(chars)
        return _narrow(data, places, np.full(len(part), 8), null | ~ok)
    if f.type == "Date":
        days, ok = parse_dates(chars)
        return pa.array(days.astype("M8[D]"), mask=null | ~ok)
    if f.type == "DateTime":
        days, ok = parse_dates(chars)
        seconds, good = parse_times(chars[:, 11:])
        stamps = days.astype("M8[us]") + (seconds * 1_000_000).astype("m8[us]")
        return pa.array(stamps, mask=null | ~(ok & good & (chars[:, 10] == 32)))
    if f.type == "WString":
        units = np.ascontiguousarray(chars).view("<u2")
        ended = units == 0
        lengths = np.where(ended.any(1), ended.argmax(1), f.size) * 2
        return _wide(data, places, lengths, null)
    ended = chars == 0
    lengths = np.where(ended.any(1), ended.argmax(1), f.size)
    out = _narrow(data, places, lengths, null)
    return _decimals(out.to_pylist(), kind) if f.type == "FixedDecimal" else out


def decode_block(raw: bytes, fields: list[Field], n: int, wanted: list[int], schema: pa.Schema, skip: int = 0, take: int | None = None) -> pa.RecordBatch:
    """Records skip .. skip + take of a block of n as a batch of the wanted fields (by number), in that order."""
    width = sum(f.width for f in fields)
    starts = record_starts(np.frombuffer(raw, np.uint8), width, any(f.type in VARIABLE for f in fields), n)
    return decode_rows(raw, fields, starts[skip : None if take is None else skip + take], wanted, schema)


def decode_rows(raw: bytes | bytearray, fields: list[Field], starts: np.ndarray, wanted: list[int], schema: pa.Schema) -> pa.RecordBatch:
    """The records that start at these places as a batch of the wanted fields (by number), in that order."""
    data, places = np.frombuffer(raw, np.uint8), offsets_of(fields)
    whole = data if len(data) else np.zeros(4, np.uint8)
    columns = []
    for k, out in zip(wanted, schema):
        at = starts + places[k]
        part = data[at[:, None] + np.arange(fields[k].width)] if len(at) else np.zeros((0, fields[k].width), np.uint8)
        columns.append(_column(fields[k], part, whole, at, out.type).cast(out.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema) if columns else pa.RecordBatch.from_struct_array(pa.array([{}] * len(starts), pa.struct([])))


# Writing


def _text_bytes(array: pa.Array, f: Field) -> tuple[bytes, np.ndarray]:
    """The stored bytes of all values in a row, and their lengths; cut to the field's size at characters."""
    if (quick := _all_at_once(array, f)) is not None:
        return quick
    values = array.to_pylist()
    if f.type in BINARY:
        parts = [b if b is not None else b"" for b in values]
    elif f.type in WIDE:
        parts = [b"" if v is None else v.encode("utf-16-le", "surrogatepass") for v in values]
        parts = [p if len(p) <= 2 * f.size else p[: 2 * f.size].decode("utf-16-le", "ignore").encode("utf-16-le") for p in parts]
        if f.type == "WString":
            parts = [p if "\0" not in (v or "") else v.split("\0")[0].encode("utf-16-le", "surrogatepass") for p, v in zip(parts, values)]
    else:
        parts = [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in values]
        parts = [p if len(p) <= f.size else p[: f.size].decode("utf-8", "ignore").encode("utf-8") for p in parts]
        if f.type == "String":
            parts = [p.split(b"\0")[0] for p in parts]
    return b"".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def _all_at_once(array: pa.Array, f: Field) -> tuple[bytes, np.ndarray] | None:
    """As _text_bytes, where no value has to be cut."""
    kind = pa.binary() if f.type in BINARY else pa.string()
    array = array.cast(kind).fill_null(b"" if f.type in BINARY else "")
    n = len(array)
    if not n:
        return b"", np.zeros(0, np.int64)
    _, ends, data = array.buffers()
    ends = np.frombuffer(ends, "<i4", n + 1, 4 * array.offset).astype(np.int64)
    raw = memoryview(data)[ends[0] : ends[-1]].tobytes() if data is not None else b""
    lengths = np.diff(ends)
    if f.type in BINARY:
        return raw, lengths
    if f.type in ("String", "WString") and b"\0" in raw:
        return None
    if f.type in WIDE:
        if raw.isascii():
            lengths = 2 * lengths
        else:
            chars = np.frombuffer(raw, np.uint8)
            units = np.zeros(len(raw) + 1, np.uint8)
            units[:-1] = (chars & 0xC0) != 0x80
            units[:-1] += chars >= 0xF0
            lengths = np.where(lengths, 2 * np.add.reduceat(units, ends[:-1] - ends[0], dtype=np.int64), 0)
        if lengths.max() > 2 * f.size:
            return None
        try:
            return raw.decode("utf-8").encode("utf-16-le"), lengths
        except UnicodeDecodeError:
            return None
    return (raw, lengths) if lengths.max() <= f.size else None


def decimal_text(value: object, size: int, scale: int) -> str | None:
    """value as a FixedDecimal's text, halves away from zero; None if it doesn't fit or isn't a number."""
    try:
        text = str(Decimal(str(value)).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)) if not isinstance(value, float) else f"{value:.{scale}f}"
    except InvalidOperation:
        return None
    return text if len(text) <= size and text.lstrip("-").replace(".", "").isdigit() else None


def _char_rows(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join((t or "").encode("ascii", "replace")[:width].ljust(width, b"\0") for t in texts)
    return np.frombuffer(raw, np.uint8).reshape(len(texts), width), np.array([t is None for t in texts], bool)


def _fixed_column(f: Field, array: pa.Array) -> np.ndarray:
    n = len(array)
    out = np.zeros((n, f.width), np.uint8)
    null = np.asarray(array.is_null())
    if f.type == "Bool":
        out[:, 0] = np.where(null, 2, np.asarray(array.fill_null(False)).astype(np.uint8))
        return out
    if f.type in NUMBERS:
        values = np.asarray(array.fill_null(0))
        if f.type == "Byte":
            null = null | (values < 0) | (values > 255)
        out[:, :-1] = np.where(null, 0, values).astype(NUMBERS[f.type]).view(np.uint8).reshape(n, f.width - 1)
    elif f.type in CHARS:
        if pa.types.is_date(array.type) or pa.types.is_timestamp(array.type):
            unit = "D" if f.type == "Date" else "s"
            stamps = np.asarray(array.cast(pa.timestamp("us")).fill_null(0)).astype("M8[us]").astype(f"M8[{unit}]")
            years = stamps.astype("M8[Y]").astype(np.int64) + 1970
            null = null | (years < FIRST_YEAR) | (years > 9999)
            text = np.datetime_as_string(np.where(null, np.datetime64(0, unit), stamps), unit=unit).astype(f"S{CHARS[f.type]}")
            chars = text.view(np.uint8).reshape(n, -1).copy() if n else np.zeros((0, CHARS[f.type]), np.uint8)
            if f.type == "DateTime" and n:
                chars[:, 10] = 32
        else:
            chars, _ = _char_rows(array.to_pylist(), CHARS[f.type])
            ok = np.ones(n, bool)
            if f.type != "Time":
                ok &= parse_dates(chars)[1]
            if f.type != "Date":
                ok &= parse_times(chars[:, 11:] if f.type == "DateTime" else chars)[1]
            null = null | ~ok
        out[:, :-1] = np.where(null[:, None], 0, chars)
    elif f.type == "FixedDecimal":
        chars, null = _char_rows([None if v is None else decimal_text(v, f.size, f.scale) for v in array.to_pylist()], f.size)
        out[:, :-1] = chars
    else:
        raw, lengths = _text_bytes(array, f)
        flat = out.reshape(-1)
        flat[spread(np.arange(n) * f.width, lengths)] = np.frombuffer(raw, np.uint8)
    out[:, -1] = null
    return out


def encode_block(batch: pa.RecordBatch | pa.Table, fields: list[Field]) -> bytes:
    n, places = batch.num_rows, offsets_of(fields)
    arrays = [batch.column(i) for i in range(len(fields))]
    arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    variable = [k for k, f in enumerate(fields) if f.type in VARIABLE]
    fixed = np.zeros((n, places[-1]), np.uint8)
    for k, f in enumerate(fields):
        if k not in variable:
            fixed[:, places[k] : places[k + 1]] = _fixed_column(f, arrays[k])
    if not variable:
        return fixed.tobytes()
    used = np.zeros(n, np.int64)  # bytes of variable data so far, record by record
    later = []
    for k in variable:
        raw, lengths = _text_bytes(arrays[k], fields[k])
        flat, null = np.frombuffer(raw, np.uint8), np.asarray(arrays[k].is_null())
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else np.zeros(0, np.int64)
        away = lengths > 3
        short = lengths <= 127
        q = places[-1] + 4 - places[k] + used
        pointer = np.where(null, 1, 0)
        for size in (1, 2, 3):
            at = np.flatnonzero(lengths == size)
            pointer[at] = sum(flat[begins[at] + j].astype(np.int64) << 8 * j for j in range(size)) | size << 28
        pointer = np.where(away, np.where(q > 0x0FFFFFFF, q | 0x80000000, q), pointer)
        fixed[:, places[k] : places[k + 1]] = pointer.astype("<u4").view(np.uint8).reshape(n, 4)
        head = np.where(short, 1, 4)
        later.append((flat, lengths, begins, away, short, head, used.copy()))
        used += np.where(away, head + lengths, 0)
    starts = _ends(places[-1] + 4 + used)
    out = np.zeros(int(starts[-1]), np.uint8)
    rows = starts[:-1]
    out[rows[:, None] + np.arange(places[-1])] = fixed
    out[(rows + places[-1])[:, None] + np.arange(4)] = used.astype("<u4").view(np.uint8).reshape(n, 4)
    for flat, lengths, begins, away, short, head, before in later:
        at = rows + places[-1] + 4 + before
        one, four = np.flatnonzero(away & short), np.flatnonzero(away & ~short)
        out[at[one]] = lengths[one] << 1 | 1
        out[at[four][:, None] + np.arange(4)] = (lengths[four] << 1).astype("<u4").view(np.uint8).reshape(-1, 4)
        _copied(out, at + head, flat, begins, np.where(away, lengths, 0))
    return out.tobytes()
