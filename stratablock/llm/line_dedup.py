"""Line dedup by winnowing.

Lines are compared without the white space around them; blank lines don't count.
A run is a number of consecutive lines of one document; it is long enough if it has
MIN_WORDS words.  From each line on, and up to each line, the shortest run that is
long enough is a window.

1. Each window selects its line of least hash (the first of equal ones).  Only selected
   lines become positions: a line's 128-bit hash, its place, and the hashes of the lines
   around it, as far as the windows that selected it reach.  Any two equal runs that are
   long enough hold an equal window, hence a selected line, at the same place of the run.
2. Positions are joined on the line's hash.  Those whose lines around are the same too
   are one class; all but its first member, in order of (document, line), are repeats.
3. The first members of the classes of a line are compared with one another: each match
   is extended line by line in both directions.  If it is long enough, the lines of the
   later one that it spans are a repeat.
4. Lines of repeats are deleted, with blank lines after them.

What extension reaches, over all selected lines, is just what any run that occurs
earlier covers.  A line with more than HOT_CLASSES classes isn't compared in one task:
its positions are split by the content of the windows around them; of equal windows,
all but the first are repeats.  So no task holds more than that many rows of a line, and
no pair of occurrences is ever sent.

Document order is that of (id, hash of the text); null ids come first, and rows that
repeat both are one document.  A null text stays null.  Documents of fewer words than
MIN_WORDS are never changed.  A text of which nothing is left becomes empty.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table
from .pretoken import groups

MIN_WORDS = 30
#: Classes of one line that a task compares with one another.
HOT_CLASSES = 256
#: A line around a position: hash and number of words.
_LINE = np.dtype([("hash", "<u8"), ("words", "<u4")])
_POSITIONS = "key binary, class binary, _id long, _text_hash long, line int, before int, around binary"
_SPANS = "_id long, _text_hash long, first int, last int"


def real_lines(text: str) -> tuple[list[str], list[int]]:
    """Lines that aren't blank, without white space around them, and their places."""
    kept = [(s, i) for i, line in enumerate(text.split("\n")) if (s := line.strip())]
    return [s for s, _ in kept], [i for _, i in kept]


def windows(words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs of at least min_words words from each line on and up to each line."""
    total = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    if total[-1] < min_words:
        return []
    ends = np.searchsorted(total, total[:-1] + min_words)  # the least end so that first..end-1 has enough
    begins = np.searchsorted(total, total[1:] - min_words, "right") - 1
    spans = {(i, e - 1) for i, e in enumerate(ends.tolist()) if e <= len(words)}
    spans |= {(b, j) for j, b in enumerate(begins.tolist()) if b >= 0}
    return sorted(spans)


def selected(hashes: list[int], spans: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The line of least hash of each window, and how far the windows that select it reach."""
    out: dict[int, tuple[int, int]] = {}
    for i, j in spans:
        p = i if i == j else min(range(i, j + 1), key=hashes.__getitem__)
        a, b = out.get(p, (i, j))
        out[p] = min(a, i), max(b, j)
    return out


def positions(lines: list[str], min_words: int) -> list[tuple[bytes, bytes, int, int, bytes]]:
    """(hash of the selected line, hash of it and the lines around, its number, lines before it, lines around) of each selected line."""
    import xxhash

    words = np.array([len(s.split()) for s in lines], np.int64)
    spans = windows(words, min_words)
    if not spans:
        return []
    digests = [xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")) for s in lines]
    packed = np.empty(len(lines), _LINE)
    packed["hash"] = [int.from_bytes(d[8:], "little") for d in digests]
    packed["words"] = np.minimum(words, 0xFFFFFFFF)
    out = []
    for p, (a, b) in selected([int.from_bytes(d[:8], "little") for d in digests], spans).items():
        whole = xxhash.xxh3_128_digest(b"".join(digests[a : b + 1]) + (p - a).to_bytes(4, "little"))
        out.append((digests[p], whole, p, p - a, packed[a : b + 1].tobytes()))
    return out


def _side(around: list[np.ndarray], before: list[int], step: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, longest side): hashes, and words up to there, of the lines on one side of each position, nearest first."""
    sides = [x[:k][::-1] if step < 0 else x[k + 1 :] for x, k in zip(around, before)]
    longest = max(map(len, sides))
    hashes = np.zeros((len(sides), longest), np.uint64)
    words = np.zeros((len(sides), longest + 1), np.int64)
    for i, s in enumerate(sides):
        hashes[i, : len(s)] = s["hash"]
        words[i, 1 : len(s) + 1] = np.cumsum(s["words"])
        words[i, len(s) + 1 :] = -1  # no such line
    return hashes, words


def extensions(around: list[np.ndarray], before: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(row, lines before, lines after): how far row's position goes on like some earlier row's, where that is long enough.

    Rows hold the same line each.  All matches of a row have that line in common, so what they cover is one span.
    """
    left, left_words = _side(around, before, -1)
    right, right_words = _side(around, before, 1)
    own = int(around[0]["words"][before[0]])

    def agree(side: np.ndarray, words: np.ndarray, row: int) -> np.ndarray:
        same = (side[:row] == side[row]) & (words[:row, 1:] >= 0) & (words[row, 1:] >= 0)
        return np.logical_and.accumulate(same, axis=1).sum(1)

    out = []
    for row in range(1, len(around)):
        low, high = agree(left, left_words, row), agree(right, right_words, row)
        enough = own + left_words[row, low] + right_words[row, high] >= min_words
        if enough.any():
            out.append((row, int(low[enough].max()), int(high[enough].max())))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """text without the real lines of the spans, and how many those are."""
    _, places = real_lines(text)
    gone = {k for i, j in spans for k in range(i, j + 1)}
    dropped = {places[k] for k in gone}
    out, after = [], False
    for i, line in enumerate(text.split("\n")):
        if i in dropped:
            after = True
        elif line.strip() or not after:
            out.append(line)
            after = False
    return "\n".join(out), len(gone)


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["_id", "_text_hash", "first", "last"])


def repeats(found: DataFrame, min_words: int, hot_classes: int) -> DataFrame:
    """(_id, _text_hash, first, last) of runs that occur earlier, from the positions of all documents."""
    place = F.struct("_id", "_text_hash", "line")
    # merge joins at every size: the same plan for a test table and a large one, and one that splits hot keys
    shared = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared-lines")
    met = cut(found.join(shared.hint("merge"), "key", "left_semi"), "positions")
    alike = met.groupBy("class").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("key", "before", "around")])
    classes = cut(alike, "classes")
    later = met.select("class", "_id", "_text_hash", "line", "before", (F.length("around") / _LINE.itemsize).cast("int").alias("lines"))
    later = later.join(classes.filter("n > 1").select("class", "earliest").hint("merge"), "class").filter(~place.eqNullSafe(F.col("earliest")))
    begin = F.col("line") - F.col("before")
    copies = later.select("_id", "_text_hash", begin.alias("first"), (begin + F.col("lines") - 1).alias("last"))

    several = cut(classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1"), "lines-of-several-classes")
    rivals = classes.join(several.hint("merge"), "key").select("key", "earliest.*", "before", "around", "classes")

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def matches() -> list[tuple]:
            if len(held) < 2:
                return []
            around = [np.frombuffer(r[5], _LINE) for r in held]
            return [(held[k][1], held[k][2], held[k][3] - a, held[k][3] + b) for k, a, b in extensions(around, [r[4] for r in held], min_words)]

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += matches()
                    held = []
                held.append(row)
            if out:
                yield _span_batch(out)
        if out := matches():
            yield _span_batch(out)

    bounded = rivals.filter(F.col("classes") <= hot_classes).drop("classes")
    joined = bounded.repartition("key").sortWithinPartitions("key", "_id", "_text_hash", "line").mapInArrow(extend, _SPANS)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for key, i, h, line, before, around in zip(*(c.to_pylist() for c in batch.columns)):
                lines = np.frombuffer(around, _LINE)
                for a, b in windows(lines["words"].astype(np.int64), min_words):
                    if a <= before <= b:
                        content = key + (before - a).to_bytes(4, "little") + lines[a : b + 1].tobytes()
                        out.append((xxhash.xxh3_128_digest(content), i, h, line - before + a, line - before + b))
            if out:
                spans = _span_batch([r[1:] for r in out])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), *spans.columns], ["content", *spans.schema.names])

    crowded = cut(rivals.filter(F.col("classes") > hot_classes).drop("classes").mapInArrow(split, f"content binary, {_SPANS}"), "hot-lines")
    span = F.struct("_id", "_text_hash", "first", "last")
    firsts = cut(crowded.groupBy("content").agg(F.min(span).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("content", "earliest"), "hot-firsts")
    again = crowded.join(firsts.hint("merge"), "content").filter(~span.eqNullSafe(F.col("earliest"))).select("_id", "_text_hash", "first", "last")
    return copies.unionByName(joined).unionByName(again)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, count_col: str | None = None, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """docs with later repeats deleted from the text; count_col: name of an added column with the number of deleted lines."""
    keyed = F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_text_hash")

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, 2):
            rows = []
            for i, h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                rows += [(key, kind, i, h, p, before, around) for key, kind, p, before, around in positions(real_lines(t)[0], min_words)]
            if rows:
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _POSITIONS.split(", ")])

    texts = docs.select(*keyed, F.col(text_col).alias("_text")).filter("_text is not null")
    found = cut(texts.mapInArrow(cut_up, _POSITIONS), "line-positions")
    spans = repeats(found, min_words, hot_classes).groupBy("_id", "_text_hash").agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
    rep = cut(spans, "repeats").select(F.col("_id").alias("_rep_id"), F.col("_text_hash").alias("_rep_hash"), "_spans").hint("merge")

    names = docs.columns
    at = names.index(text_col)
    inner = [f"c{i}" for i in range(len(names))]
    plain = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(names, inner)], *keyed)
    both = plain.join(rep, F.col("_id").eqNullSafe(F.col("_rep_id")) & (F.col("_text_hash") == F.col("_rep_hash")), "left").select(*inner, "_spans")
    kinds = ", ".join(f"{x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(names, inner))

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, at):
            texts, counts = part.column(at).to_pylist(), [0] * part.num_rows
            for i, spans in enumerate(part.column(len(inner)).to_pylist()):
                if spans:
                    texts[i], counts[i] = without(texts[i], [(s["first"], s["last"]) for s in spans])
            columns = list(part.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*inner, "_deleted"])

    out = both.mapInArrow(apply, f"{kinds}, _deleted int")
    back = [F.col(x).alias(c) for c, x in zip(names, inner)]
    return out.select(*back, F.col("_deleted").alias(count_col)) if count_col else out.select(*back)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs, count_col="n_deleted")
    return out.select("doc_id", "n_deleted", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
