"""LZF chunks: a stream of length-prefixed chunks of at most CHUNK bytes.

A chunk's 32-bit length has its top bit set where the payload is stored as it is.
Otherwise the payload is LZF: a control byte below 32 is followed by that many
literals plus one; any other holds a length in its upper three bits (7: one more
length byte follows) and, with the next byte, a distance of up to 8192 bytes back.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa

# Fixed values of the format.
CHUNK = 0x40000
STORED = 0x80000000
MAX_DISTANCE = 1 << 13
MAX_LITERALS = 32
MAX_MATCH = 264
#: Shorter repeats aren't looked for: they break longer ones up, and each costs time on reading.
MIN_MATCH = 8
#: Less than this is decoded token by token.
SHORT = 2048


def _steps(follow: np.ndarray) -> np.ndarray:
    """0, follow[0], follow[follow[0]] and so on below the last index, which is the end and follows itself; by doubling."""
    end = len(follow) - 1
    out = np.zeros(min(end, 1), np.int64)
    while len(out):
        new = follow.take(out)
        out = np.concatenate([out, new[new < end]])
        if new[-1] >= end:
            break
        follow = follow.take(follow)
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + lengths[i] - 1 of all i in a row."""
    total = int(lengths.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(total)


def _as_snappy(data: bytes) -> tuple[bytes, int] | None:
    """The same literals and references as a Snappy block, which Arrow decodes, and their length; None if the tokens don't end with the data."""
    n = len(data)
    d = np.frombuffer(data, np.uint8)
    follow = np.arange(n + 1)
    follow[:n] += np.where(d < 32, d + np.uint8(2), np.where(d >= 224, np.uint8(3), np.uint8(2)))
    at = _steps(np.minimum(follow, n))
    if follow[at[-1]] != n:
        return None
    c = d[at].astype(np.int64)
    plain = c < 32
    runs, matches = at[plain], at[~plain]
    count, control = c[plain] + 1, c[~plain]
    long = control >= 224
    length = (control >> 5) + np.where(long, d[np.minimum(matches + 1, n - 1)], 0) + 2
    distance = ((control & 31) << 8 | d[matches + 1 + long]) + 1
    pieces = (length + 63) >> 6
    size = np.empty(len(at), np.int64)
    size[plain], size[~plain] = count + 1, 3 * pieces
    begin = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    out[spread(begin[plain], count + 1)] = d[spread(runs, count + 1)]
    out[begin[plain]] = (count - 1) << 2
    place, left, back = begin[~plain], length, distance
    while len(place):
        out[place] = (np.minimum(left, 64) - 1) << 2 | 2
        out[place + 1], out[place + 2] = back & 255, back >> 8
        more = left > 64
        place, left, back = place[more] + 3, left[more] - 64, back[more]
    total = int(count.sum() + length.sum())
    head, x = bytearray(), total
    while x > 127:
        head.append(x & 127 | 128)
        x >>= 7
    head.append(x)
    return bytes(head) + out.tobytes(), total


def lzf_decompress(data: bytes) -> bytes:
    if len(data) >= SHORT and pa.Codec.is_available("snappy") and (made := _as_snappy(data)):
        try:
            return pa.Codec("snappy").decompress(made[0], made[1]).to_pybytes()
        except OSError:
            pass  # a wrong reference, which is told below
    return _by_token(data)


def _by_token(data: bytes) -> bytes:
    out = bytearray()
    i, n = 0, len(data)
    while i < n:
        control = data[i]
        i += 1
        if control < 32:
            out += data[i : i + control + 1]
            i += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[i]
            i += 1
        length += 2
        distance = ((control & 31) << 8 | data[i]) + 1
        i += 1
        start = len(out) - distance
        if start < 0:
            raise ValueError("LZF: a reference points before the chunk")
        if distance >= length:
            out += out[start : start + length]
        else:  # the copy overlaps its own output: a repeated pattern
            pattern = bytes(out[start:])
            out += (pattern * (length // distance + 1))[:length]
    return bytes(out)


def _matches(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where MIN_MATCH bytes recur within reach, how far back, and for how many bytes they go on to."""
    n = len(data) - MIN_MATCH + 1
    mask = np.uint64((1 << 8 * MIN_MATCH) - 1)
    key = np.ndarray((n,), "<u8", data + bytes(8), 0, (1,)) & mask
    slot = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    before = np.full(n, -1 - MAX_DISTANCE)
    before[order[1:][same]] = order[:-1][same]
    distance = np.arange(n) - before
    at = np.flatnonzero(distance <= MAX_DISTANCE)
    distance = distance[at]
    # neighbours at the same distance are one match
    apart = (np.diff(at) != 1) | (np.diff(distance) != 0)
    last = np.concatenate([at[:-1][apart], at[-1:]])
    length = last[np.concatenate([[0], np.cumsum(apart)])[: len(at)]] - at + MIN_MATCH
    return at, distance - 1, np.minimum(length, MAX_MATCH)


def _chosen(places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """From the first match on, each next one that starts where the one before has ended, or later."""
    n = len(places)
    if not n:
        return places
    here = np.zeros(int(places[-1]) + MAX_MATCH + 2, np.int32)
    here[places + 1] = 1
    follow = np.empty(n + 1, np.int64)
    follow[:n] = np.cumsum(here, dtype=np.int32).take(places + lengths)  # so many matches start before the end of each
    follow[n] = n
    return _steps(follow)


def lzf_compress(data: bytes) -> bytes | None:
    """data as LZF, or None where that doesn't save a byte.

    Matches are chosen one after the other; everything else, literals and references, is set at once.
    """
    n = len(data)
    if n < 2 * MIN_MATCH:
        return None
    places, back, lengths = _matches(data)
    taken = _chosen(places, lengths)
    at, distance, length = places[taken], back[taken], lengths[taken]
    begin = np.concatenate([[0], at + length])  # of the literals before each match, and of those at the end
    count = np.concatenate([at, [n]]) - begin
    controls = -(-count // MAX_LITERALS)
    long = length >= 9
    size = count + controls
    size[:-1] += np.where(long, 3, 2)
    if int(size.sum()) >= n:
        return None
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out[np.repeat(start, count) + inside + inside // MAX_LITERALS + 1] = np.frombuffer(data, np.uint8)[np.repeat(begin, count) + inside]
    part = np.arange(int(controls.sum())) - np.repeat(np.cumsum(controls) - controls, controls)
    out[np.repeat(start, controls) + part * (MAX_LITERALS + 1)] = np.minimum(np.repeat(count, controls) - part * MAX_LITERALS, MAX_LITERALS) - 1
    first = (start + count + controls)[:-1]
    out[first] = np.where(long, 7, length - 2) << 5 | distance >> 8
    out[first[long] + 1] = length[long] - 9
    out[first + np.where(long, 2, 1)] = distance & 255
    return out.tobytes()


def pack(data: bytes, compress: bool = True) -> bytes:
    """data as chunks."""
    out = []
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        small = lzf_compress(part) if compress else None
        out += [struct.pack("<I", len(part) | STORED), part] if small is None else [struct.pack("<I", len(small)), small]
    return b"".join(out)


def unpack_chunk(read: Callable[[int], bytes]) -> bytes:
    """The next chunk, taken by read(n); empty at the end."""
    head = read(4)
    if len(head) < 4:
        return b""
    (length,) = struct.unpack("<I", head)
    data = read(length & ~STORED)
    if len(data) < length & ~STORED:
        raise ValueError("the file ends within a chunk")
    return data if length & STORED else lzf_decompress(data)
