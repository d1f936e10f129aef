"""SimHash near-dedup by bit-sliced comparison.

A fingerprint bit is 1 where over half of a text's shingle hashes have it set.
Distinct fingerprints meet in buckets of equal key bits; within a bucket, 64
fingerprints a word stand as vertical bit planes, and the distances of one of them
to all others are counted at once in carry-save counters, bit plane by bit plane.
Blocks in which all distances exceed the radius are abandoned.

Two ways to choose keys:

* ``pigeonhole``: radius + 2 bit blocks, a table for each two of them.  Fingerprints
  that differ in at most ``radius`` bits share one such key for sure.
* ``bands``: SEARCH_BANDS keys a text, each of SEARCH_ROWS minima of rehashed shingles,
  for radii at which no key of bits prunes.  Their number is fixed, whatever the number
  of texts.

Equal fingerprints are grouped before (with map-side combining), so copies cost one
row.  A key with more than TILE_ROWS distinct fingerprints is split into tiles that
each hold two parts of it: every two fingerprints still meet, in tasks of bounded
size.  A task reports a spanning forest of what it links, not the pairs.

Null texts count as empty; a text without words has fingerprint zero and is linked
like any other.  Rows that repeat an id each get a row; null ids never become a
component's id unless it has no other.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, cut, read_table, text_of
from .components import connected_components
from .pretoken import groups

SEED = 42
TILE_ROWS = 8192
BATCH_ROWS = 1 << 16
#: Shingle sets compared with each other in one task: of a group's part, and in a tile of two parts of a group that its parts don't connect.
PART_ROWS, SET_TILE_ROWS = 64, 1024
#: As many shingles at most in a part on average, and sets of a group that are in all its parts.
PART_SHINGLES, SHARED_ROWS = 2_000_000, 16
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_HASH_CHUNK = 1 << 15
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``words`` words, in order, repeats included."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """64 x lanes bits, little-endian; lanes after the first take a remix of each hash."""
    n = len(hashes)
    if not n:
        return bytes(8 * lanes)
    out = []
    for lane in range(lanes):
        votes = np.zeros(64, np.int64)
        for i in range(0, n, _HASH_CHUNK):
            h = hashes[i : i + _HASH_CHUNK]
            if lane:
                h = (h ^ (h >> np.uint64(29 + lane))) * _MIX[(lane - 1) % 3]
                h = (h ^ (h >> np.uint64(32))) * _MIX[lane % 3]
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(2 * votes > n, bitorder="little").tobytes())
    return b"".join(out)


def set_fingerprint(hashes: np.ndarray, lanes: int) -> bytes:
    """The fingerprint of the set of shingles, each counted once, and 16 bytes that only equal sets share."""
    import xxhash

    distinct = np.unique(hashes)
    return fingerprint(distinct, lanes) + xxhash.xxh3_128_digest(distinct.tobytes(), SEED)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band: two sets of similarity s have it in common with the probability s ** rows."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 31, (bands * rows, 1), np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, (bands * rows, 1), np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), _HASH_CHUNK // 8):
        least = np.minimum(least, (short[i : i + _HASH_CHUNK // 8] * factors + shifts).min(1))
    keys = np.arange(bands, dtype=np.uint64) * _MIX[0]
    for column in least.reshape(bands, rows).T.astype(np.uint64):
        keys = (keys ^ column) * _MIX[1]
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def fingerprints(docs: DataFrame, words: int, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", bands: tuple[int, int] | None = None) -> DataFrame:
    """(_id, _text_hash, fp) per row; fp is binary, 8 x lanes bytes.  With ``bands`` (their number, and rows of each) it is that of set_fingerprint, and their keys follow."""
    names = ["_id", "_text_hash", "fp", "bands"][: 3 if bands is None else 4]

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, 2):
            hashes = [shingle_hashes(t, words) for t in part.column(2).to_pylist()]
            fps = [(fingerprint if bands is None else set_fingerprint)(h, lanes) for h in hashes]
            columns = [part.column(0), part.column(1), pa.array(fps, pa.binary())]
            if bands is not None:
                columns.append(pa.array([band_keys(h, *bands) for h in hashes], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names)

    text = text_of(text_col)
    kinds = "_id long, _text_hash long, fp binary" + ("" if bands is None else ", bands array<long>")
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_text_hash"), text.alias("_text")).mapInArrow(make, kinds)


# Keys


def pigeonhole(radius: int, bits: int = 64) -> list[list[int]]:
    """The bit positions of each table."""
    edges = [round(i * bits / (radius + 2)) for i in range(radius + 3)]
    blocks = [list(range(a, b)) for a, b in itertools.pairwise(edges)]
    return [a + b for a, b in itertools.combinations(blocks, 2)]


def keyed(fps: DataFrame, tables: list[list[int]]) -> DataFrame:
    """(key, fp): a row for each table."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                fp = batch.column(0).slice(i, 2048)
                raw = np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(len(fp), -1)
                ones = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
                for t, at in enumerate(tables):
                    key = (ones[:, at] << np.arange(len(at))).sum(1) + (t << len(at))
                    yield pa.RecordBatch.from_arrays([pa.array(key), fp.cast(pa.binary())], ["key", "fp"])

    return fps.select("fp").mapInArrow(make, "key long, fp binary")


# Comparison within sorted buckets


def planes_of(raw: np.ndarray) -> np.ndarray:
    """(bits, blocks) words out of (rows, bytes) fingerprints: bit l of word b is that bit of row 64 b + l."""
    rows, width = raw.shape
    blocks = -(-rows // 64)
    padded = np.zeros((blocks * 64, width), np.uint8)
    padded[:rows] = raw
    out = np.empty((width * 8, blocks), np.uint64)
    for i in range(0, blocks, 256):
        ones = np.unpackbits(padded[i * 64 : (i + 256) * 64], axis=1, bitorder="little").reshape(-1, 64, width * 8)
        packed = np.packbits(ones.transpose(2, 0, 1), axis=2, bitorder="little")
        out[:, i : i + 256] = np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]
    return out


def _words(mask: np.ndarray) -> np.ndarray:
    """(n, 64) booleans as n words."""
    return np.ascontiguousarray(np.packbits(mask, axis=1, bitorder="little")).view(np.uint64)[:, 0]


def bit_sliced(planes: np.ndarray, left: np.ndarray, lane: np.ndarray, right: np.ndarray, alive: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distances of row (left, lane) to the 64 rows of block right, where alive has a bit.

    Yields (position in the arrays, lane of right) of those within radius.
    """
    n_bits = radius.bit_length()
    at = np.arange(len(left))
    counters = [np.zeros(len(left), np.uint64) for _ in range(n_bits)]
    alive = alive.copy()
    one, zero = np.uint64(1), np.uint64(0)
    lane64 = lane.astype(np.uint64)

    def exceeds() -> np.ndarray:
        over, equal = np.zeros_like(alive), np.full_like(alive, ~zero)
        for j in reversed(range(n_bits)):
            if radius >> j & 1:
                equal &= counters[j]
            else:
                over |= equal & counters[j]
                equal &= ~counters[j]
        return over

    for i, plane in enumerate(planes):
        d = plane[right] ^ (zero - ((plane[left] >> lane64) & one))
        for j in range(n_bits):
            carry = counters[j] & d
            counters[j] ^= d
            d = carry
        alive &= ~d  # beyond what the counters hold
        if i % 8 == 7:
            alive &= ~exceeds()
            live = alive != 0
            if live.sum() < 0.7 * len(live):
                at, left, right, lane64, alive = at[live], left[live], right[live], lane64[live], alive[live]
                counters = [c[live] for c in counters]
                if not len(at):
                    return
    alive &= ~exceeds()
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pos, other = np.nonzero(bits)
    yield at[pos], other


def forest(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest row of each row's component."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while ((nxt := labels[labels]) != labels).any():
            labels = nxt
    return labels


def bucket_links(keys: np.ndarray, raw: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, other row) within runs of equal keys: a spanning forest of what differs in ``radius`` bits at most.
    So there are never more links than rows, whatever a group's size."""
    change = np.flatnonzero(np.diff(keys)) + 1
    sizes = np.diff(np.concatenate([[0], change, [len(keys)]]))
    keep = np.repeat(sizes > 1, sizes)
    rows = np.flatnonzero(keep)
    if not len(rows):
        return rows, rows
    group = np.repeat(np.arange(len(sizes)), sizes)[keep]
    m = len(rows)
    planes = planes_of(raw[rows])
    blocks = planes.shape[1]
    lanes = np.full(blocks * 64, -1, np.int64)
    lanes[:m] = group
    lanes = lanes.reshape(blocks, 64)
    first, last = lanes[:, 0], group[np.minimum(np.arange(blocks) * 64 + 63, m - 1)]
    end = np.searchsorted(first[: np.count_nonzero(first >= 0)], last, "right")  # blocks that start within block's last group
    pair_left = np.repeat(np.arange(blocks), np.maximum(end - np.arange(blocks), 1))
    begin = np.concatenate([[0], np.cumsum(np.maximum(end - np.arange(blocks), 1))[:-1]])
    pair_right = np.arange(len(pair_left)) - np.repeat(begin, np.maximum(end - np.arange(blocks), 1)) + pair_left
    labels = np.arange(m)
    later = np.triu(np.ones((64, 64), bool), 1)
    for i in range(0, len(pair_left), 2048):
        left, right = pair_left[i : i + 2048], pair_right[i : i + 2048]
        for k in range(64):
            mask = lanes[right] == lanes[left, k][:, None]
            mask &= (lanes[left, k] >= 0)[:, None]
            same = left == right
            mask[same] &= later[k]
            alive = _words(mask)
            some = np.flatnonzero(alive)
            if not len(some):
                continue
            for at, other in bit_sliced(planes, left[some], np.full(len(some), k), right[some], alive[some], radius):
                labels = forest(m, left[some][at] * 64 + k, right[some][at] * 64 + other, labels)
    linked = np.flatnonzero(labels != np.arange(m))
    return rows[linked], rows[labels[linked]]


def _compared(radius: int, width: int | None) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            keys = np.concatenate([k for k, _ in held])
            raw = np.concatenate([r for _, r in held])
            stop = len(keys) if final else int(np.searchsorted(keys == keys[-1], True))
            if not final and not stop:
                return
            a, b = bucket_links(keys[:stop], raw[:stop, :width], radius)
            held = [(keys[stop:], raw[stop:])] if stop < len(keys) else []
            count = len(keys) - stop
            if len(a):
                fps = lambda at: pa.array([raw[i].tobytes() for i in at], pa.binary())
                yield pa.RecordBatch.from_arrays([fps(a), fps(b)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                # key and tile as one: rows come sorted by both
                k = batch.column(0).to_numpy(zero_copy_only=False) * np.int64(1_000_003) + batch.column(1).to_numpy(zero_copy_only=False)
                held.append((k, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)))
                count += batch.num_rows
                if count >= BATCH_ROWS:
                    yield from flush(False)
        if count:
            yield from flush(True)

    return run


def links(keys: DataFrame, radius: int, tile_rows: int = TILE_ROWS, width: int | None = None) -> DataFrame:
    """(a, b) of distinct fingerprints in rows (key, fp); of fp ``width`` bytes are compared, or all."""
    large = keys.groupBy("key").count().filter(F.col("count") > tile_rows).select("key", F.ceil(F.col("count") * 2 / tile_rows).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("parts", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    tiled = keys.join(cut(large, "large-buckets"), "key", "left").withColumn("mine", mine).withColumn("other", other)
    placed = tiled.select("key", F.when(F.col("parts").isNull(), 0).otherwise(_tile("mine", "other")).cast("int").alias("tile"), "fp")
    return placed.repartition("key", "tile").sortWithinPartitions("key", "tile", "fp").mapInArrow(_compared(radius, width), "a binary, b binary").distinct()


def classes(docs_fp: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint: the smallest _id reachable over the pairs (a, b)."""
    own = cut(docs_fp.groupBy("fp").agg(F.min("_id").alias("own")), "fingerprints")
    roots = cut(connected_components(pairs), "roots")
    ids = cut(roots.join(own, roots.node == own.fp).groupBy("root").agg(F.min("own").alias("reach")), "reach")
    reach = roots.join(ids, "root").select(F.col("node").alias("fp"), "reach")
    return cut(own.join(reach, "fp", "left").select("fp", F.coalesce("reach", "own").alias("component_id")), "classes")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """<id>, fingerprint (16 hex digits), component_id per row: fingerprints link at ``radius`` or fewer differing bits, all of them."""
    marked = cut(fingerprints(docs, words, 1, id_col, text_col), "simhash")
    distinct = cut(marked.select("fp").distinct(), "distinct-fp")
    found = classes(marked, links(keyed(distinct, pigeonhole(radius)), radius, tile_rows))
    return marked.join(found, "fp").select(F.col("_id").alias(id_col), F.lower(F.hex(_reversed("fp"))).alias("fingerprint"), "component_id")


def _reversed(col: str):
    """The eight bytes in the other order: hex digits start with the highest bit."""
    return F.concat(*[F.substring(F.col(col), 8 - i, 1) for i in range(8)])


#: Bits of fingerprints for similarity search: of 256, 39 differ at 0.8 (standard deviation 6), 48 between sets of four and five.
SEARCH_LANES = 4
SEARCH_RADIUS = 64
#: At 0.8, a pair shares one of the bands with the probability 1 - (1 - 0.8 ** 4) ** 12 = 0.998.
SEARCH_BANDS, SEARCH_ROWS = 12, 4


def set_links(values: np.ndarray, sizes: np.ndarray, labels: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, other row): pairs of sets of that Jaccard similarity, as many as join all labels that such pairs join.

    ``values`` holds the sets one after the other, without repeats; ``labels`` tells rows known to be joined.  A row is
    compared with each later one that isn't joined to it.  Sets that similar share one of their rarest values (as many
    as may be missing, and one), so only rows that do are counted in full: nothing is missed by that.
    """
    n = len(sizes)
    labels = labels.copy()
    _, codes, counts = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    codes = rank[codes]
    codes = codes[np.lexsort((codes, np.repeat(np.arange(n), sizes)))]
    starts = np.cumsum(sizes) - sizes
    rarest = np.minimum(sizes, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1)
    mark = np.zeros(len(counts), np.int64)
    out_a, out_b = [], []

    def marked(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many of the first values of each row have a mark."""
        begin = np.cumsum(lengths) - lengths
        at = np.repeat(starts[rows] - begin, lengths) + np.arange(int(lengths.sum()))
        return np.add.reduceat(mark[codes[at]], begin)

    for i in range(n - 1):
        rest = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        rest = rest[(sizes[rest] >= similarity * sizes[i] - 1e-9) & (sizes[i] >= similarity * sizes[rest] - 1e-9)]
        if not len(rest) or not sizes[i]:
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own[: rarest[i]]] = 1
        rest = rest[marked(rest, rarest[rest]) > 0]
        if len(rest):
            mark[own] = 1
            common = marked(rest, sizes[rest])
            rest = rest[common >= similarity * (sizes[i] + sizes[rest] - common)]
        mark[own] = 0
        if len(rest):
            theirs, first = np.unique(labels[rest], return_index=True)
            out_a.append(np.full(len(first), i))
            out_b.append(rest[first])
            labels[np.isin(labels, theirs)] = labels[i]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _similar(similarity: float) -> Callable:
    """(root, tile, fp, label, shingles) in order of root and tile to what set_links finds in each tile."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            fps = [x for b in held for x in b.column(2).to_pylist()]
            if len(fps) < 2:
                return
            label: dict[bytes, int] = {}
            labels = np.array([label.setdefault(x, len(label)) for b in held for x in b.column(3).to_pylist()])
            if len(label) < 2:
                return
            sizes = np.concatenate([pc.list_value_length(b.column(4)).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
            values = np.concatenate([b.column(4).flatten().to_numpy(zero_copy_only=False) for b in held])
            a, b = set_links(values, sizes, labels, similarity)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array([fps[i] for i in at], pa.binary()) for at in (a, b)], ["a", "b"])

        for batch in batches:
            begin = 0
            for now, run_ in itertools.groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                n = sum(1 for _ in run_)
                if now != key:
                    yield from flush()
                    held, key = [], now
                held.append(batch.slice(begin, n))
                begin += n
        yield from flush()

    return run


def _tile(mine: str, other: str):
    return F.least(mine, other) * 32768 + F.greatest(mine, other)


def similar_pairs(sets: DataFrame, similarity: float, part_rows: int = PART_ROWS, tile_rows: int = SET_TILE_ROWS) -> DataFrame:
    """(a, b): links that connect just what pairs of that Jaccard similarity connect within each group.

    sets has root (the group), fp and shingles.  A group of up to part_rows sets is one task's.  A larger one is dealt
    into such parts, a few of its sets being in all of them, which mostly connects all of it.  Where it doesn't, every
    two sets of it meet in tiles, in which what is connected already needs no comparing.
    """
    compare = lambda df: df.select("root", "tile", "fp", "label", "shingles").repartition("root", "tile").sortWithinPartitions("root", "tile").mapInArrow(_similar(similarity), "a binary, b binary")

    def parts(rows: int, shingles: int):
        return F.ceil(F.greatest(F.col("n") / rows, F.col("shingles_n") / shingles)).cast("int")

    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles").cast("long")).alias("shingles_n"))
    large = cut(sizes.filter((F.col("n") > part_rows) | (F.col("shingles_n") > PART_SHINGLES)).withColumn("parts", parts(part_rows, PART_SHINGLES)), "large-groups")
    everywhere = F.pmod(F.xxhash64("fp", F.lit(13)), F.col("n")) < SHARED_ROWS
    mine = F.pmod(F.xxhash64("fp", F.lit(11)), F.col("parts")).cast("int")
    tiles = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(everywhere, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(mine))
    dealt = sets.join(large, "root", "left").withColumn("tile", F.explode(tiles)).withColumn("label", F.col("fp"))
    found = cut(compare(dealt), "similar")
    if large.isEmpty():
        return found
    known = cut(connected_components(found), "similar-roots").withColumnRenamed("root", "label")
    labelled = cut(sets.join(large.select("root"), "root", "left_semi").select("root", "fp").join(known, F.col("fp") == F.col("node"), "left").select("root", "fp", F.coalesce("label", "fp").alias("label")), "labels")
    apart = labelled.groupBy("root").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("root")
    left = cut(large.join(apart, "root").select("root", F.least(parts(tile_rows, 2 * PART_SHINGLES) * 2, F.lit(32767)).alias("parts")), "large-groups-left")
    if left.isEmpty():
        return found
    paired = sets.join(left, "root").join(labelled.select("fp", "label"), "fp").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return found.unionByName(cut(compare(paired.withColumn("tile", _tile("mine", "other"))), "similar-tiles"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text_hash, component_id): texts of that Jaccard similarity of their shingle sets, and what they reach, share a component.

    Candidates share one of a fixed number of bands, and their 256-bit fingerprints
    differ in SEARCH_RADIUS bits at most: a matter of chance, for which the README states
    the recall.  They only say which texts to compare: within what candidates connect, every two texts are decided by the exact similarity of
    their shingle sets, whatever the group's size (unless connected already).
    Fingerprints are those of the sets, and only texts of equal sets count as one.
    """
    marked = cut(fingerprints(docs, words, SEARCH_LANES, id_col, text_col, (SEARCH_BANDS, SEARCH_ROWS)), "simhash")
    distinct = cut(marked.groupBy("fp").agg(F.first("bands").alias("bands")), "distinct-fp")
    keys = distinct.select(F.explode("bands").alias("key"), "fp")
    candidates = cut(links(keys, SEARCH_RADIUS, width=8 * SEARCH_LANES), "simhash-links")
    grouped = cut(connected_components(candidates), "candidate-groups")

    def shingle_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, 2):
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], ["fp", "root", "shingles"])

    # aggregated before the join: copies of a text collapse map-side
    chosen = marked.groupBy("fp").agg(F.min(F.struct("_id", "_text_hash")).alias("r")).join(grouped, F.col("fp") == F.col("node")).select("fp", "root", "r.*")
    text = text_of(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_text_hash"), text.alias("_text"))
    rows = texts.join(chosen.hint("merge"), texts["_id"].eqNullSafe(chosen["_id"]) & (texts["_text_hash"] == chosen["_text_hash"])).select("fp", "root", "_text").dropDuplicates(["fp"])
    sets = cut(rows.mapInArrow(shingle_sets, "fp binary, root binary, shingles array<long>"), "shingle-sets")
    return marked.join(classes(marked, similar_pairs(sets, similarity)), "fp").select("_id", "_text_hash", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
