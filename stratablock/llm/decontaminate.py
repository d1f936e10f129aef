"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are lower-cased, white space reduced to single spaces;
characters are the UTF-8 bytes of the result.  An item of m characters may occur
with up to e = min(EDIT_SHARE x m, m / Q - 1) edits.  An occurrence then shares at
least m + 1 - Q (e + 1) q-grams with the item, on diagonals that differ by e at
most.  So shared q-grams are counted in diagonal bands of twice e + 1, each
overlapping the next by half; bands that reach the bound are verified by an
alignment over their diagonals alone.  Nothing within the edit budget is missed.

The benchmark goes to the executors in slices of SLICE_BYTES at most (or one item, if
it is longer); a larger one means more passes over the documents, each written to the
shared folder before the next, so that one slice at a time is in memory.  Documents
aren't shuffled.

Null texts and items count as empty; empty items fit nothing; items shorter than Q
characters must occur as they are.  Repeated rows and items are judged one by one.
Very long texts are handled in pieces that overlap by more than the longest item.
Columns of the documents are kept, whatever their names; one that is named as the
column of matches is replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table
from .pretoken import groups

Q = 8
EDIT_SHARE = 0.1
SLICE_BYTES = 8 << 20
PIECE = 1 << 18
_TABLE_BITS = 22
#: Of a key, for the band; the item's number has the others: a slice has less than 2 ** 23 items, a piece less than 2 ** 40 diagonals.
_BAND_BITS = 40
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

Match = tuple[int | None, int, int]  # item id, start in the normalised text, edits


def normalised(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def grams(text: bytes) -> np.ndarray:
    """The Q bytes from each place as one integer."""
    n = len(text) - Q + 1
    return np.ndarray((n,), "<u8", text, 0, (1,)) if n > 0 else np.zeros(0, "<u8")


def banded_distance(item: bytes, text: bytes, low: int, high: int, most: int | None = None) -> tuple[int, int]:
    """The fewest edits that turn item into a piece of text, and where that piece starts to be looked for,
    over alignments whose diagonals (place in text less place in item) stay within low..high.
    Given ``most``, it stops once more edits than that are certain."""
    d = np.arange(low, high + 1)
    far = len(item) + len(text) + 1
    p = np.frombuffer(item, np.uint8)
    padded = np.full(len(text) + 2 * (len(item) + len(d)) + abs(low) + abs(high), -1, np.int16)
    shift = len(item) + len(d) + abs(low)
    padded[shift : shift + len(text)] = np.frombuffer(text, np.uint8)
    row = np.where((d >= 0) & (d <= len(text)), 0, far)
    place = np.arange(len(d))
    for i in range(len(item)):
        at = i + d  # the text's character opposite to item[i]
        window = padded[shift + i + low : shift + i + low + len(d)]
        step = row + (window != p[i]) + np.where((at < 0) | (at >= len(text)), far, 0)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - place) + place
        if most is not None and i % 8 == 7 and row.min() > most:
            return far, 0
    best = int(row.argmin())
    return int(min(row[best], far)), max(0, low + best)


class BenchmarkIndex:
    def __init__(self, items: list[tuple[int | None, bytes]]):
        kept = [(i, t) for i, t in items if t]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        m = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.maximum(0, np.minimum((EDIT_SHARE * m).astype(np.int64), m // Q - 1))
        self.bound = m + 1 - Q * (self.edits + 1)
        self.short = [k for k, t in enumerate(self.texts) if len(t) < Q]
        self.longest = int((m + self.edits).max()) if len(m) else 0
        parts = [grams(t) for t in self.texts]
        codes = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, self.first, self.many = np.unique(codes[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * _MULTIPLIER) >> np.uint64(64 - _TABLE_BITS)

    def _bands(self, text: bytes) -> list[tuple[int, int]]:
        """(item, lowest diagonal) of bands with enough shared q-grams, those with most of them first."""
        codes = grams(text)
        hits = np.flatnonzero(self.table[self._slot(codes)])
        if not len(hits) or not len(self.codes):
            return []
        slot = np.minimum(np.searchsorted(self.codes, codes[hits]), len(self.codes) - 1)
        real = self.codes[slot] == codes[hits]
        hits, slot = hits[real], slot[real]
        many = self.many[slot]
        run = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)
        item, diagonal = self.owner[run], np.repeat(hits, many) - self.place[run]
        width = self.edits[item] + 1
        band = (diagonal + self.longest) // width
        # a q-gram of the item counts once in a band, however often the text repeats it; two keys, as one may not hold both
        key, place = (item << _BAND_BITS) + band, self.place[run]
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        key, count = np.unique(key[new], return_counts=True)
        # the band that starts at each key covers it and the next one
        follows = np.zeros(len(key), np.int64)
        follows[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        starts = [(key, count + follows)]
        lone = np.ones(len(key), bool)  # bands that start just before a key with nothing of their own
        lone[1:] = key[1:] != key[:-1] + 1
        starts.append((key[lone] - 1, count[lone]))
        out = []
        for k, c in starts:
            enough = c >= self.bound[(k + 1) >> _BAND_BITS] if len(k) else np.zeros(0, bool)
            for x, shared in zip(k[enough].tolist(), c[enough].tolist()):
                i = (x + 1) >> _BAND_BITS
                out.append((-shared, i, (x - (i << _BAND_BITS)) * int(self.edits[i] + 1) - self.longest))
        return [(i, low) for _, i, low in sorted(out)]

    def _piece(self, text: bytes) -> dict[int, tuple[int, int]]:
        found: dict[int, tuple[int, int]] = {}
        for i, low in self._bands(text):
            item, e = self.texts[i], int(self.edits[i])
            if i in found:
                continue
            begin = max(0, low - e)
            window = text[begin : low + 2 * (e + 1) + len(item) + e]
            if (at := window.find(item)) >= 0:
                found[i] = (begin + at, 0)
                continue
            distance, at = banded_distance(item, window, low - e - begin, low + 2 * (e + 1) + e - begin, e)
            if distance <= e:
                found[i] = (max(0, begin + at), distance)
        for i in self.short:
            if (at := text.find(self.texts[i])) >= 0:
                found[i] = (at, 0)
        return found

    def matches(self, text: bytes) -> list[Match]:
        """The items that occur in text, each with one occurrence: in each piece, that in the band of most shared q-grams."""
        best: dict[int, tuple[int, int]] = {}
        for begin in range(0, max(1, len(text)), PIECE):
            for i, (at, distance) in self._piece(text[begin : begin + PIECE + 2 * self.longest]).items():
                if i not in best or distance < best[i][1]:
                    best[i] = (begin + at, distance)
        return [(self.ids[i], at, distance) for i, (at, distance) in sorted(best.items())]


MATCHES = "array<struct<item_id:long,start:long,edits:long>>"


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, bytes]]]:
    held: list[tuple[int | None, bytes]] = []
    size = 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        text = normalised(r.t)
        if held and size + len(text) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append((r.i, text))
        size += len(text)
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", matches_col: str = "matches", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs and, after their own columns, the matches: (item_id, start, edits) of each item that occurs."""
    spark = docs.sparkSession
    docs = docs.drop(matches_col)
    place = docs.columns.index(text_col)
    names = [*(f"c{i}" for i in range(len(docs.columns))), "_matches"]
    out = docs.toDF(*names[:-1]).withColumn("_matches", F.array().cast(MATCHES))
    schema = out.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("edits", pa.int64())]))
    for number, items in enumerate( _slices(benchmark, item_col, item_text_col)):
        if number:
            out = cut(out, "decontaminated")
        sent = spark.sparkContext.broadcast(items)

        def search(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = BenchmarkIndex(sent.value)
            for part in groups(batches, place):
                old = part.column(len(names) - 1).to_pylist()
                new = [a + [dict(zip(("item_id", "start", "edits"), x)) for x in index.matches(normalised(t))] for a, t in zip(old, part.column(place).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(new, kind)], names)

        out = out.mapInArrow(search, schema)
    return out.toDF(*docs.columns, matches_col)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("matches", lambda m: m["item_id"]))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), items.alias("item_ids"), F.array_max(F.transform("matches", lambda m: m["edits"])).alias("most_edits"))


QUERIES = {"op6_decontaminate": op6_decontaminate}
