"""Unigram encoding and decoding with a public SentencePiece vocabulary.

Pieces with their scores stand in a double-array trie over UTF-8 bytes.  A Viterbi
pass finds the segmentation of greatest total score; of equal ones, that whose last
piece (and so on before it) is longest.  A character that no piece covers costs the
least score less ten and is written as byte pieces.

A space is written as the marker U+2581, with one more before the text, and decoding
turns markers back and drops that one.  A marker in the text itself is written as
byte pieces, so that every text comes back as it was.

No piece has a marker after another character (this is checked), so a text falls
into units of markers and what follows them, whose best segmentations don't depend
on each other.  Unknown units of a batch go through the trie together, a byte at a
time in numpy; known ones come from a bounded cache; very long ones run alone.

A null text counts as empty and has no ids.  Rows that repeat an id are encoded one
by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of
from .pretoken import groups

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_UNITS, CACHE_BYTES = 500_000, 64
#: Units of more bytes than this don't take part in the batches.
BATCH_BYTES = 192
_UNITS = re.compile(r" +[^ ]*")
_ODD = re.compile(r"  | \Z|\A | \A\Z")


class DoubleArray:
    """base and check of a trie over bytes; value is the piece's number at its last node, else -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        ends = {}
        for key, number in keys:
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            ends[node] = number
        size = 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[:257] = b"\1" * 257  # so that place less byte is never below 1
        free = hint = 257  # the first free place; where places for several children are looked for
        todo = [(0, 0)]  # node, its place
        for node, place in todo:
            value[place] = ends.get(node, -1)
            if not children[node]:
                base[place] = 0
                continue
            codes = sorted(children[node])
            at = (free if len(codes) == 1 else max(free, hint)) - codes[0]
            tried = 0
            while True:
                if at + 256 >= size:
                    more = size
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                    used += bytes(more)
                    size += more
                if not any(used[at + c] for c in codes):
                    break
                at += 1
                tried += 1
            if tried > 64:  # it's crowded before
                hint = at + codes[0]
            base[place] = at
            for c in codes:
                used[at + c] = 1
                check[at + c] = place
                todo.append((children[node][c], at + c))
            while used[free]:
                free += 1
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))


class Pieces:
    """A vocabulary: pieces, scores, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float64)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        normal = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        if any(MARK in names[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece has a marker inside: units would not be independent")
        self.unknown = float(self.score[normal].min()) - UNKNOWN_PENALTY
        self.longest = max(len(names[i].encode()) for i in normal)
        self.trie = DoubleArray([(names[i].encode(), i) for i in normal])
        back = {i: b"" for i in range(n) if special[i]} | {i: bytes([b]) for b, i in self.byte.items()}
        self.text = [back[i] if i in back else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.width = 2 if n <= 1 << 16 else 4


class UnigramCodec:
    def __init__(self, pieces: Pieces, cache_units: int = CACHE_UNITS):
        self.p = pieces
        self.kind = np.dtype(f"<u{pieces.width}")
        self.cache_units = cache_units
        self.cache: dict[str, bytes] = {}
        self.missed = 0
        self.mark = b"".join(self._id(pieces.byte[b]) for b in MARK.encode())

    def _id(self, i: int) -> bytes:
        return i.to_bytes(self.p.width, "little")

    def _written(self, unit: bytes, ends: list[int], ids: list[int]) -> bytes:
        """ids from the end of the unit to its start; -1 stands for a character in byte pieces."""
        out, start = [], 0
        for end, i in zip(reversed(ends), reversed(ids)):
            out.append(self._id(i) if i >= 0 else b"".join(self._id(self.p.byte[b]) for b in unit[start:end]))
            start = end
        return b"".join(out)

    def segment_alone(self, unit: bytes) -> bytes:
        """Viterbi over one unit, byte by byte."""
        trie, score = self.p.trie, self.p.score
        base, check, value = trie.base, trie.check, trie.value
        n = len(unit)
        best: list[float] = [-np.inf] * (n + 1)
        best[0] = 0.0
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 0
        while at < n:
            here = best[at]
            if here > -np.inf:
                state, k = 0, at
                while k < n:
                    nxt = int(base[state]) + unit[k]
                    if base[state] == 0 or nxt >= len(check) or check[nxt] != state:
                        break
                    state, k = nxt, k + 1
                    if (v := int(value[state])) >= 0 and here + score[v] > best[k]:
                        best[k], came[k] = here + score[v], (at, v)
                k = at + 1
                while k < n and unit[k] & 0xC0 == 0x80:
                    k += 1
                if here + self.p.unknown > best[k]:
                    best[k], came[k] = here + self.p.unknown, (at, -1)
            at += 1
        ends, ids, k = [], [], n
        while k:
            ends.append(k)
            k, i = came[k]
            ids.append(i)
        return self._written(unit, ends, ids)

    def segment_batch(self, units: list[bytes]) -> list[bytes]:
        """Viterbi over many units at once: a place at a time, all that are still within a piece take a step together."""
        trie, score = self.p.trie, self.p.score
        base, check, value = trie.base, trie.check, trie.value
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        most = int(lengths.max())
        codes = np.zeros((len(units), most + 1), np.int64)
        flat = np.frombuffer(b"".join(units), np.uint8)
        row_of = np.repeat(np.arange(len(units)), lengths)
        codes[row_of, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        best = np.full((len(units), most + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(units), most + 1), np.int64)
        piece = np.full((len(units), most + 1), -1, np.int64)
        tail = (codes & 0xC0) == 0x80
        for at in range(most):
            rows = np.flatnonzero((best[:, at] > -np.inf) & (lengths > at))
            if not len(rows):
                continue
            here = best[rows, at]
            end = np.full(len(rows), at + 1)
            live = np.flatnonzero(tail[rows, at + 1] & (lengths[rows] > at + 1))
            while len(live):
                end[live] += 1
                live = live[(lengths[rows[live]] > end[live]) & tail[rows[live], np.minimum(end[live], most)]]
            unknown = rows, end, here + self.p.unknown
            state = np.zeros(len(rows), np.int64)
            for k in range(at, min(most, at + self.p.longest)):
                b = base[state]
                nxt = b + codes[rows, k]
                ok = (b > 0) & (lengths[rows] > k)
                ok &= check[np.minimum(nxt, len(check) - 1)] == state
                rows, here, state = rows[ok], here[ok], nxt[ok]
                if not len(rows):
                    break
                v = value[state]
                total = np.where(v >= 0, here + score[v], -np.inf)
                better = total > best[rows, k + 1]
                r = rows[better]
                best[r, k + 1], back[r, k + 1], piece[r, k + 1] = total[better], at, v[better]
            r, e, total = unknown
            better = total > best[r, e]
            r, e = r[better], e[better]
            best[r, e], back[r, e], piece[r, e] = total[better], at, -1
        # walk back together
        at, all_rows = lengths.copy(), np.arange(len(units))
        steps = []
        while (at > 0).any():
            i = np.where(at > 0, piece[all_rows, at], -2)
            steps.append((i, at.copy()))
            at = np.where(at > 0, back[all_rows, at], 0)
        ids = np.stack([i for i, _ in steps[::-1]], 1) if steps else np.zeros((len(units), 0), np.int64)
        raw = ids.astype(self.kind).tobytes()
        skipped = (ids == -2).sum(1)
        odd = (ids == -1).any(1)
        step, size = self.p.width, ids.shape[1] * self.p.width
        out = [raw[i * size + s * step : (i + 1) * size] for i, s in enumerate(skipped.tolist())]
        for i in np.flatnonzero(odd).tolist():
            mine = [(int(a[i]), int(e[i])) for a, e in steps if a[i] != -2]
            out[i] = self._written(units[i], [e for _, e in mine], [a for a, _ in mine])
        return out

    def _fill(self, keys: set[str]) -> list[str]:
        """Segments the keys that the cache lacks; returns those to take out again."""
        need = [k for k in keys if k not in self.cache]
        coded = [(k if k[:1] == " " else " " + k if k[:1] != "\0" else k[1:]).replace(" ", MARK).encode("utf-8", "surrogatepass") for k in need]
        order = sorted(range(len(need)), key=lambda i: len(coded[i]))
        short = [i for i in order if len(coded[i]) <= BATCH_BYTES]
        for s in range(0, len(short), 4096):
            part = short[s : s + 4096]
            self.cache.update(zip([need[i] for i in part], self.segment_batch([coded[i] for i in part])))
        for i in order[len(short) :]:
            self.cache[need[i]] = self.segment_alone(coded[i])
        if len(self.cache) <= self.cache_units:
            return [need[i] for i in order if len(coded[i]) > CACHE_BYTES]
        self.missed += len(need)
        if self.missed > 8 * self.cache_units:  # what is kept fits these texts no more
            self.missed = 0
            return list(self.cache)
        return need

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text, packed."""
        plans: list[list[list[str]]] = []
        keys: set[str] = set()
        for text in texts:
            plan = []
            # a key is a word after one space, or starts with its spaces, or with NUL where no space precedes it
            for i, part in enumerate(text.split(MARK)) if MARK in text else ((0, text),):
                if not part:
                    units = [" "] if not i and text else []
                elif i:
                    head, space, rest = part.partition(" ")
                    units = (["\0" + head] if head else []) + (_UNITS.findall(space + rest) if space else [])
                elif _ODD.search(part):
                    units = _UNITS.findall(" " + part)
                else:
                    units = part.split(" ")
                units = [u[1:] if u[:1] == " " and u[1:2] not in ("", " ", "\0") else u for u in units]
                if any(u[:1] == "\0" for u in units) and not i:
                    units = [" " + u if u[:1] == "\0" else u for u in units]
                keys.update(units)
                plan.append(units)
            plans.append(plan)
        drop = self._fill(keys)
        get = self.cache.__getitem__
        out = [self.mark.join([b"".join(map(get, u)) for u in plan]) for plan in plans]
        for k in drop:
            self.cache.pop(k, None)
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.p.text.__getitem__, np.frombuffer(ids, self.kind).tolist()))
        return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


_codecs: dict[str, UnigramCodec] = {}


def codec(path: str) -> UnigramCodec:
    """One per Python worker and vocabulary."""
    if path not in _codecs:
        import gc

        _codecs[path] = UnigramCodec(Pieces(path))
        gc.freeze()
        gc.set_threshold(200_000, 50, 50)
    return _codecs[path]


CODED = "n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean"


def unigram_codes(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per row: <id>, n_tokens, n_byte_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip
    (whether decoding the ids gives the text), and the ids themselves if asked for."""
    schema = f"`{id_col}` long, {CODED}" + ", ids array<int>" * ids
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        is_byte = np.zeros(len(c.p.text), bool)
        is_byte[list(c.p.byte.values())] = True
        for part in groups(batches, 1):
            texts = part.column(1).to_pylist()
            rows = []
            for text, packed in zip(texts, c.encode(texts)):
                a = np.frombuffer(packed, c.kind)
                rows.append((len(a), int(is_byte[a].sum()), zlib.crc32(a.astype("<u4").tobytes()), c.decode(packed) == text) + ((a.astype(np.int32),) if ids else ()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names)

    return docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).mapInArrow(code, schema)


def op4_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return unigram_codes(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op4_unigram": op4_unigram}
