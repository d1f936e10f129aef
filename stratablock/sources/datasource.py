"""The Spark data source ``rowblock``.

Reading: one partition for each ``blocksPerPartition`` blocks.  Options:

* path: a file, a folder or a glob; files of a folder must agree in their field types
* columns: comma-separated names (or a JSON list): only these are decoded, in this order
* offset, limit: of the records of all files in a row; blocks outside aren't read
* rowIndex: name of an added column with the record's number in its file, or, with rowIndexOf
  ``table``, in all files in a row
* decimals: ``exact`` for decimal columns, else FixedDecimal becomes double
* batchSize, blocksPerPartition

Spark's Python sources are told neither which columns nor how many rows a query
needs, so those are options here; ``stratablock.scan`` sets them.

Writing: a file per task in a folder beside the target; names become valid and _SUCCESS
appears when all tasks have succeeded.  Overwriting swaps folders: until the new one is in
its place, the old one stays, under another name for the moment between.  Appending moves
the new files, whose fields must be those of the old ones, into the folder.  Options:
compression (``lzf`` or ``none``), singleFile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.names import unique_names
from .fields import Field, from_spark
from .files import SUFFIX, FileInfo, Piece, file_system, list_files, plan, read_info, read_infos, read_piece, write_file

NAME = "rowblock"
#: A table of twice as many blocks or more has several in each partition, about so many partitions in all: what a task costs
#: besides its rows doesn't grow with the table, nor does the driver's list of them.  blocksPerPartition overrides it.
PARTITIONS = 256


def wanted_columns(text: str | None) -> list[str] | None:
    if not text:
        return None
    return json.loads(text) if text.lstrip().startswith("[") else [c.strip() for c in text.split(",")]


def projected(fields: tuple[Field, ...], columns: list[str] | None) -> list[int]:
    if columns is None:
        return list(range(len(fields)))
    places = {f.name: k for k, f in enumerate(fields)}
    for c in columns:
        if c not in places:
            raise ValueError(f"Unknown column in projection: {c}")
    return [places[c] for c in columns]


def load_infos(path: str) -> list[FileInfo]:
    infos = read_infos(list_files(path))
    kinds = [[(f.type, f.name.lower(), f.size, f.scale) for f in i.fields] for i in infos]
    for info, kind in zip(infos, kinds):
        if kind != kinds[0]:
            raise ValueError(f"{info.path}: its schema differs from that of {infos[0].path}")
    return infos


class PiecePartition(InputPartition):
    def __init__(self, number: int, piece: Piece | None = None):
        super().__init__(number)
        self.piece = piece


@dataclass
class Written(WriterCommitMessage):
    staged: str | None
    records: int


class RowBlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _infos(self) -> list[FileInfo]:
        return load_infos(self.options["path"])

    def schema(self) -> StructType:
        info = read_info(list_files(self.options["path"])[0])
        exact = self.options.get("decimals", "").lower() == "exact"
        out = [info.fields[k].spark(exact) for k in projected(info.fields, wanted_columns(self.options.get("columns")))]
        if row_index := self.options.get("rowIndex"):
            out.append(StructField(row_index, LongType()))
        return StructType(out)

    def reader(self, schema: StructType) -> DataSourceReader:
        return RowBlockReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RowBlockWriter(schema, overwrite, self.options)


class RowBlockReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.options = schema, dict(options)

    def partitions(self) -> list[PiecePartition]:
        o = {k.lower(): v for k, v in self.options.items()}
        infos = load_infos(o["path"])
        blocks = sum(len(i.blocks) for i in infos)
        each = int(o.get("blocksperpartition", max(1, blocks // PARTITIONS)))
        pieces = plan(infos, int(o.get("offset", 0)), int(o["limit"]) if "limit" in o else None, each)
        return [PiecePartition(i, p) for i, p in enumerate(pieces)] or [PiecePartition(0)]

    def read(self, partition: PiecePartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.piece is None:
            return
        o = {k.lower(): v for k, v in self.options.items()}
        schema = to_arrow_schema(self.schema)
        before = partition.piece.before if o.get("rowindexof", "file").lower() == "table" else 0
        wanted = projected(partition.piece.fields, wanted_columns(o.get("columns")))
        yield from read_piece(partition.piece, wanted, schema, "rowindex" in o, int(o.get("batchsize", 16_384)), before)


class RowBlockWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, overwrite: bool, options):
        self.options = {k.lower(): v for k, v in dict(options).items()}
        self.path = self.options["path"]
        names = unique_names(schema.names)
        self.fields = [Field(n, f.type, f.size, f.scale, f.source, f.description) for n, f in zip(names, from_spark(schema))]
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex
        fs, place = file_system(self.path)
        kind = fs.get_file_info(place).type.name
        if not overwrite and kind != "NotFound":
            if self._single() or kind == "File":
                raise FileExistsError(f"{self.path} is there already and is one file; write with mode overwrite")
            self._check_fields()

    def _check_fields(self) -> None:
        """Appended files have the fields of those that are there."""
        try:
            there = list_files(self.path)
        except FileNotFoundError:
            return
        old = read_info(there[0]).fields
        kind = lambda fields: [(f.type, f.name.lower(), f.size, f.scale) for f in fields]
        if kind(old) != kind(self.fields):
            raise ValueError(f"{self.path}: the fields to append differ from those that are there")

    def _beside(self, what: str) -> str:
        """A name in the same folder that no scan of it lists."""
        parent, _, name = self.path.rstrip("/").rpartition("/")
        return f"{parent}/_{what}-{self.job}-{name}" if parent else f"_{what}-{self.job}-{name}"

    def _staging(self) -> str:
        return self._beside("staging")

    def _single(self) -> bool:
        return self.options.get("singlefile", "").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{self._staging()}/part-{task.partitionId():06d}-{uuid.uuid4().hex}{SUFFIX}"
        first = next((b for b in iterator if b.num_rows), None)
        if first is None and task.partitionId():
            return Written(None, 0)

        def rows() -> Iterator[pa.RecordBatch]:
            if first is not None:
                yield first
                yield from iterator

        return Written(name, write_file(name, self.fields, rows(), self.options.get("compression", "lzf").lower() != "none"))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector

        fs, place = file_system(self.path)
        staged = sorted((m for m in messages if m is not None and m.staged), key=lambda m: m.staged)
        if len(staged) > 1:
            staged = [m for m in staged if m.records] or staged[:1]
        if self._single():
            if len(staged) != 1:
                raise ValueError("singleFile takes one partition: coalesce(1) first")
            if fs.get_file_info(place).type.name == "Directory":
                fs.move(place, file_system(self._beside("old"))[1])
            fs.move(file_system(staged[0].staged)[1], place)
        else:
            kept = {m.staged.rpartition("/")[2] for m in staged}
            folder = file_system(self._staging())[1]
            fs.create_dir(folder, recursive=True)
            # files of attempts that failed, and empty ones, don't come along
            for i in fs.get_file_info(FileSelector(folder)):
                if i.base_name not in kept:
                    fs.delete_file(i.path)
            if not self.overwrite and fs.get_file_info(place).type.name == "Directory":
                for name in sorted(kept):
                    fs.move(f"{folder}/{name}", f"{place}/{name}")
            else:
                self._swap(fs, folder, place)
            with fs.open_output_stream(f"{place}/_SUCCESS"):
                pass
        self._clear()

    def _swap(self, fs, folder: str, place: str) -> None:
        """Nothing is deleted before the new files are in their place."""
        from pyarrow.fs import FileSelector

        old = file_system(self._beside("old"))[1]
        there = fs.get_file_info(place).type.name != "NotFound"
        try:
            if there:
                fs.move(place, old)
            fs.move(folder, place)
        except (OSError, NotImplementedError):  # a store that moves files only: the new ones come before the old ones go
            before = [i for i in fs.get_file_info(FileSelector(place, allow_not_found=True)) if i.type.name == "File"]
            for i in fs.get_file_info(FileSelector(folder)):
                fs.move(i.path, f"{place}/{i.base_name}")
            for i in before:
                fs.delete_file(i.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, place = file_system(self.path)
        old = file_system(self._beside("old"))[1]
        if fs.get_file_info(place).type.name == "NotFound" and fs.get_file_info(old).type.name != "NotFound":
            fs.move(old, place)
        self._clear()

    def _clear(self) -> None:
        for what in ("staging", "old"):
            fs, place = file_system(self._beside(what))
            kind = fs.get_file_info(place).type.name
            if kind != "NotFound":
                fs.delete_file(place) if kind == "File" else fs.delete_dir(place)
