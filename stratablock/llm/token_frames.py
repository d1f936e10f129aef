"""Token ids in binary shards: one zstandard frame a document, a seek table at the end.

A shard is a valid zstandard stream in the public seekable format:

    frame 0 .. frame n-1     the ids of one document each, little-endian, unsigned
    skippable frame          magic 0x184D2A50: b"TOKF", id width, n, then per frame
                             the doc id (signed 64 bits) and whether it is null
    skippable frame          magic 0x184D2A5E, the seek table: per frame compressed
                             size, size and checksum (low 32 bits of XXH64 of the
                             ids), 32 bits each; then n, a descriptor and 0x8F92EAB1

A reader takes the tail of the file, then only the frames it wants.

Documents are range-partitioned by id (and the hash of the text, and their place in
the input, where an id repeats), so shard order is id order, and each task
streams its range into a file of its own name in the shared folder.  The manifest,
written by Spark, names the files of the attempts that succeeded; what a lost
attempt has left is never read.

A null text counts as empty, and an empty document holds the end id alone.  Null
ids come first.  Rows that repeat an id stand in the order of their texts' hashes.
An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, shared_path, text_of
from .pretoken import encoder, groups

END_ID = 2
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1")])
_HEAD = struct.Struct("<4sBI")


class ShardWriter:
    """Writes frames one after another; only the tables are held."""

    def __init__(self, out: BinaryIO, width: int, level: int = 3):
        self.out, self.width = out, width
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        packed = self.zstd.compress(ids)
        self.out.write(packed)
        self.entries.append((len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append((0, 1) if doc_id is None else (doc_id, 0))

    def close(self) -> None:
        n = len(self.entries)
        index = _HEAD.pack(b"TOKF", self.width, n) + np.array(self.ids, _INDEX).tobytes()
        table = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<IBI", n, CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, source: BinaryIO, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUMS:
            raise ValueError("not a token shard: no seek table with checksums")
        at = size - 9 - n * _ENTRY.itemsize
        self.entries = np.frombuffer(self._at(at, n * _ENTRY.itemsize), _ENTRY)
        length = _HEAD.size + n * _INDEX.itemsize
        name, self.width, m = _HEAD.unpack((raw := self._at(at - 8 - length, length))[: _HEAD.size])
        if name != b"TOKF" or m != n:
            raise ValueError("not a token shard: the document index is damaged")
        self.index = np.frombuffer(raw, _INDEX, offset=_HEAD.size)
        self.places = np.concatenate([[0], np.cumsum(self.entries["packed"].astype("i8"))])
        self.zstd = zstandard.ZstdDecompressor()

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.entries)

    def doc_id(self, k: int) -> int | None:
        return None if self.index[k]["null"] else int(self.index[k]["doc_id"])

    def _ids(self, k: int, packed: bytes) -> np.ndarray:
        e = self.entries[k]
        ids = self.zstd.decompress(packed, max_output_size=int(e["size"]))
        if len(ids) != e["size"] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != e["check"]:
            raise ValueError(f"frame {k}: the checksum doesn't fit")
        return np.frombuffer(ids, f"<u{self.width}")

    def ids(self, k: int) -> np.ndarray:
        """The ids of document k alone; no other frame is read."""
        return self._ids(k, self._at(int(self.places[k]), int(self.entries[k]["packed"])))

    def all_ids(self, read_bytes: int = 4 << 20) -> Iterator[np.ndarray]:
        """All documents in order, read in runs of frames."""
        k = 0
        while k < len(self):
            end = max(k + 1, int(np.searchsorted(self.places, self.places[k] + read_bytes, "right")) - 1)
            run = self._at(base := int(self.places[k]), int(self.places[end]) - base)
            for i in range(k, end):
                yield self._ids(i, run[int(self.places[i]) - base : int(self.places[i + 1]) - base])
            k = end


MANIFEST = "shard int, path string, n_docs long, n_tokens long, bytes long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, path: str | None = None, special_as_text: bool = False) -> DataFrame:
    """Encodes every text and writes shards below path; returns the manifest (shard, path, n_docs, n_tokens, bytes).

    special_as_text: see UnitEncoder; without it, the ids are the library's with add_special_tokens=False.
    """
    spark = docs.sparkSession
    folder = path or shared_path(spark, "tokens")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        enc = encoder(vocabulary, special_as_text)
        end = end_id.to_bytes(enc.width, "little")
        shard, writer, n_tokens = TaskContext.get().partitionId(), None, 0
        name = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.tok.zst"
        for part in groups(batches, 1):
            if writer is None:
                fs, place = FileSystem.from_uri(name)
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(place, compression=None)
                writer = ShardWriter(out, enc.width)
            ids = part.column(0).to_pylist()
            for doc_id, coded in zip(ids, enc.encode(part.column(1).to_pylist())):
                writer.add(doc_id, coded + end)
                n_tokens += len(coded) // enc.width + 1
        if writer is not None:
            writer.close()
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [len(writer.entries)], "n_tokens": [n_tokens], "bytes": [size]})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    # ranges go on within an id, and within a repeated row: no id, null or other, is one task's
    order = "_id", "_text_hash", "_row"
    marked = rows.withColumns({"_text_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    return cut(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, out of the shards.

    The manifest has one row a shard, like a listing of files, and is gathered to
    number the shards' first tokens.
    """
    spark = manifest.sparkSession
    starts, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((r.path, r.bytes, starts))
        starts += r.n_tokens
    shards = spark.createDataFrame(rows, "path string, bytes long, start long").repartition(max(1, len(rows)))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for r in batch.to_pylist():
                fs, place = FileSystem.from_uri(r["path"])
                with fs.open_input_file(place) as source:
                    reader, start, out = ShardReader(source, r["bytes"]), r["start"], []
                    for k, ids in enumerate(reader.all_ids()):
                        out.append((reader.doc_id(k), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) == 10_000 or k == len(reader) - 1:
                            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                            out = []

    return shards.mapInArrow(read, TOKENS)


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op1_token_frames": op1_token_frames}
