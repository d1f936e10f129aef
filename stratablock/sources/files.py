"""Row-block files: header, schema, block index; planning of partitions; writing."""

from __future__ import annotations

import struct
import time
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa

from .fields import VARIABLE, Field, check_record, from_xml, to_xml
from .lzf import CHUNK, pack, unpack_chunk
from .records import decode_rows, encode_block

# Fixed values of the format.
HEADER = struct.Struct("<64sIIqI4xqqqI")
HEADER_SIZE = 512
FILE_ID, ID_MASK, ID_BASE, ID_VERSIONS = 0x00440204, 0xFF0000, 0x440000, range(2, 6)
BLOCK_RECORDS = 65_536
SUFFIX = ".rb"
DESCRIPTION = "Row block file"
#: A block index larger than this isn't believed.
MAX_BLOCKS = 1 << 28
#: Records are decoded in runs of about so many bytes, so that memory follows neither a block's rows nor their length.
SLICE_BYTES = 8 << 20
#: Rows are encoded as soon as they take about so many bytes of Arrow's; of a block, only what fills no chunk yet is held.
ENCODE_BYTES = 2 << 20
#: Headers read at the same time.
READERS = 32
#: A finished file is held in memory up to this size, on its way to a store without in-place updates.
SPOOL_BYTES = 64 << 20


def file_system(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" not in path and not path.startswith("file:"):
        import os

        return LocalFileSystem(), os.path.abspath(path)
    return FileSystem.from_uri(path)


def list_files(path: str) -> list[str]:
    """The file itself, or the row-block files of a folder or of a glob, by name."""
    import fnmatch

    from pyarrow.fs import FileSelector, FileType

    fs, place = file_system(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) and "://" in path else ""
    folder, _, name = place.rpartition("/")
    if any(c in name for c in "*?["):
        found = [i.path for i in fs.get_file_info(FileSelector(folder)) if i.type == FileType.File and fnmatch.fnmatchcase(i.base_name, name)]
    else:
        info = fs.get_file_info(place)
        if info.type == FileType.File:
            return [path]
        if info.type == FileType.NotFound:
            raise FileNotFoundError(path)
        found = [i.path for i in fs.get_file_info(FileSelector(place, recursive=True)) if i.type == FileType.File and i.path.endswith(SUFFIX) and "/_" not in i.path[len(place) :]]
    if not found:
        raise FileNotFoundError(f"no row-block file in {path}")
    return [prefix + p for p in sorted(found)]


@dataclass(frozen=True)
class FileInfo:
    path: str
    fields: tuple[Field, ...]
    records: int
    compressed: bool
    first_block: int
    blocks: tuple[int, ...]  # places of the blocks; one only if there is no index to rely on
    indexed: bool


def read_info(path: str) -> FileInfo:
    fs, place = file_system(path)
    size = fs.get_file_info(place).size
    with fs.open_input_file(place) as source:
        head = source.read(HEADER_SIZE)
        if len(head) < HEADER_SIZE:
            raise ValueError(f"{path}: too short for a header")
        _, file_id, _, _, units, _, index_at, records, compression = HEADER.unpack(head[: HEADER.size])
        if file_id & ID_MASK != ID_BASE or file_id & 0xFF not in ID_VERSIONS:
            raise ValueError(f"{path}: not a row-block file of a known version")
        raw = source.read(2 * units)
        if len(raw) < 2 * units:
            raise ValueError(f"{path}: the schema is cut off")
        fields = tuple(from_xml(raw.decode("utf-16-le", "replace").rstrip("\0")))
        first = HEADER_SIZE + 2 * units
        expected = -(-records // BLOCK_RECORDS)
        blocks, indexed = (first,) * (1 if records else 0), False
        if records and first <= index_at <= size - 4:
            source.seek(index_at)
            (count,) = struct.unpack("<I", source.read(4))
            if count == expected and count < MAX_BLOCKS and len(table := source.read(8 * count)) == 8 * count:
                places = struct.unpack(f"<{count}q", table)
                if places[0] == first and all(a < b for a, b in zip(places, places[1:])) and places[-1] < index_at:
                    blocks, indexed = places, True
    return FileInfo(path, fields, records, compression == 1, first, blocks, indexed)


def read_infos(paths: list[str]) -> list[FileInfo]:
    """Headers and indexes of all files, many at a time: reading them is waiting for the store."""
    if len(paths) < 2:
        return [read_info(p) for p in paths]
    with ThreadPoolExecutor(min(READERS, len(paths))) as pool:
        return list(pool.map(read_info, paths))


@dataclass(frozen=True)
class Piece:
    """Records of consecutive blocks of a file: of those from ``place`` on, the first of which is number ``at``, skip some, then take.  The files before it have ``before`` records."""

    path: str
    fields: tuple[Field, ...]
    compressed: bool
    place: int
    at: int
    skip: int
    take: int
    before: int = 0

    @property
    def first_record(self) -> int:
        return self.at + self.skip


def plan(infos: list[FileInfo], offset: int = 0, limit: int | None = None, blocks_each: int = 1) -> list[Piece]:
    """Pieces that hold records offset .. offset + limit of all files in a row; blocks outside aren't touched."""
    pieces = []
    left = sum(i.records for i in infos) if limit is None or limit < 0 else limit
    skip, before = max(0, offset), 0
    for info in infos:
        begin = min(skip, info.records)
        skip -= begin
        end = min(info.records, begin + left)
        left -= end - begin
        step = BLOCK_RECORDS * blocks_each
        while begin < end:
            block = begin // BLOCK_RECORDS if info.indexed else 0
            stop = min(end, (block // blocks_each + 1) * step) if info.indexed else end
            at = block * BLOCK_RECORDS
            pieces.append(Piece(info.path, info.fields, info.compressed, info.blocks[block], at, begin - at, stop - begin, before))
            begin = stop
        before += info.records
    return pieces


def read_piece(piece: Piece, wanted: list[int], schema: pa.Schema, row_index: bool = False, batch: int = 16_384, before: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of the piece; schema is that of the wanted fields, and of the row index after them, to which ``before`` is added."""
    inner = pa.schema(list(schema)[:-1]) if row_index else schema
    fs, place = file_system(piece.path)
    at, skip, take = piece.at, piece.skip, piece.take
    with fs.open_input_file(place) as source:
        source.seek(piece.place)
        for raw, starts in _records(piece, source, skip + take, batch):
            gone = min(skip, len(starts))
            skip -= gone
            kept = starts[gone:]
            if len(kept):
                columns = list(decode_rows(raw, list(piece.fields), kept, wanted, inner).columns) if wanted else []
                if row_index:
                    columns.append(pa.array(np.arange(before + at + gone, before + at + len(starts)), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema) if columns else pa.RecordBatch.from_struct_array(pa.array([{}] * len(kept), pa.struct([])))
            at += len(starts)


def _records(piece: Piece, source: BinaryIO, n: int, rows: int) -> Iterator[tuple[bytearray, np.ndarray]]:
    """The next n records in runs of ``rows`` at most, or of little more than SLICE_BYTES: bytes, and where each record starts.

    What follows a run in the last chunk is the next run's beginning, wherever blocks end; each byte is walked over once.
    """
    fixed = sum(f.width for f in piece.fields)
    variable = any(f.type in VARIABLE for f in piece.fields)
    more = struct.Struct("<I").unpack_from
    raw, starts, at = bytearray(), [], 0
    while n > 0:
        most = min(n, rows)
        if variable:
            while len(starts) < most and at < SLICE_BYTES and at + fixed + 4 <= len(raw):
                end = at + fixed + 4 + more(raw, at + fixed)[0]
                if end > len(raw):
                    break
                starts.append(at)
                at = end
        else:
            count = min(most, len(raw) // fixed)
            if count == most or len(raw) >= SLICE_BYTES:
                starts, at = range(0, count * fixed, fixed), count * fixed
        if len(starts) == most or at >= SLICE_BYTES:
            yield raw, np.array(starts, np.int64)
            n -= len(starts)
            raw, starts, at = raw[at:], [], 0
            continue
        part = unpack_chunk(source.read) if piece.compressed else source.read(1 << 20)
        if not part:
            raise ValueError(f"{piece.path}: the records are cut off")
        raw += part


class FileWriter:
    """Writes blocks to an output; the header comes last, so an unfinished file has no records."""

    def __init__(self, out: BinaryIO, fields: list[Field], compress: bool = True, description: str = DESCRIPTION):
        check_record(fields)
        self.out, self.fields, self.compress, self.description = out, fields, compress, description
        text = (to_xml(fields) + "\0").encode("utf-16-le")
        self.units = len(text) // 2
        self.records, self.places = 0, []
        self.at = HEADER_SIZE + len(text)
        out.write(bytes(HEADER_SIZE) + text)
        self.held: list[pa.RecordBatch] = []
        self.size = 0  # of what is held, in bytes
        self.count = 0  # records of the block, encoded or held
        self.rest = b""  # encoded, but less than a chunk

    def add(self, batch: pa.RecordBatch) -> None:
        while batch.num_rows:
            if not self.count:
                self.places.append(self.at)
            part = batch.slice(0, BLOCK_RECORDS - self.count)
            while part.num_rows > 1 and part.nbytes > ENCODE_BYTES:
                part = part.slice(0, part.num_rows // 2)
            if self.size + part.nbytes > ENCODE_BYTES:
                self._encode()
            self.held.append(part)
            self.size += part.nbytes
            self.count += part.num_rows
            batch = batch.slice(part.num_rows)
            if self.count == BLOCK_RECORDS:
                self._flush()

    def _encode(self) -> None:
        """Writes all whole chunks; chunks don't end with runs of rows, so that the file is the same whatever the runs."""
        if not self.held:
            return
        raw = self.rest + encode_block(pa.Table.from_batches(self.held), self.fields)
        self.held, self.size = [], 0
        whole = len(raw) // CHUNK * CHUNK
        self.rest = raw[whole:]
        for i in range(0, whole, CHUNK):
            self._put(raw[i : i + CHUNK])

    def _put(self, raw: bytes) -> None:
        packed = pack(raw, self.compress)
        self.out.write(packed)
        self.at += len(packed)

    def _flush(self) -> None:
        """Ends the block."""
        self._encode()
        self._put(self.rest)
        self.rest = b""
        self.records += self.count
        self.count = 0

    def finish(self) -> bytes:
        """Writes the rest and the index; returns the header, which goes to the file's start."""
        self._flush()
        index_at = self.at
        self.out.write(struct.pack(f"<I{len(self.places)}q", len(self.places), *self.places))
        head = HEADER.pack(self.description.encode("ascii", "replace")[:63], FILE_ID, int(time.time()), 0, self.units, 0, index_at, self.records, 1)
        return head.ljust(HEADER_SIZE, b"\0")


def write_file(path: str, fields: list[Field], batches: Iterable[pa.RecordBatch], compress: bool = True, description: str = DESCRIPTION) -> int:
    """Writes a file; returns its number of records.  An unfinished one has none, as its header comes last.

    In a mounted file system the file is written where it belongs.  Stores that take streams only get it in one
    stream out of memory, or, beyond SPOOL_BYTES, out of a temporary file of the task's.
    """
    import tempfile

    from pyarrow.fs import LocalFileSystem

    fs, place = file_system(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    with open(place, "w+b") if isinstance(fs, LocalFileSystem) else tempfile.SpooledTemporaryFile(SPOOL_BYTES) as out:
        writer = FileWriter(out, fields, compress, description)
        for b in batches:
            writer.add(b)
        head = writer.finish()
        out.seek(0)
        out.write(head)
        if not isinstance(fs, LocalFileSystem):
            out.seek(0)
            with fs.open_output_stream(place, compression=None) as target:
                while part := out.read(1 << 22):
                    target.write(part)
    return writer.records
