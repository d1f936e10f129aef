"""Reading, writing and registering row-block tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .functions.names import unique_names
from .ship import ship
from .sources.datasource import NAME, RowBlockSource, load_infos, projected
from .sources.fields import Field
from .sources.files import plan, read_piece


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("rowblock")`` known; calling it again changes nothing."""
    ship(spark)
    spark.dataSource.register(RowBlockSource)


def file_schema(path: str) -> list[Field]:
    return list(load_infos(path)[0].fields)


def num_records(path: str) -> int:
    """From the headers alone."""
    return sum(i.records for i in load_infos(path))


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, offset: int = 0, limit: int | None = None, row_index: str | None = None, exact_decimals: bool = False, blocks_per_partition: int | None = None, row_index_of: str = "file") -> DataFrame:
    """A lazy table of which only the wanted columns are decoded and only the blocks within offset and limit are read.

    row_index: a column with the record's number in its file, or, with row_index_of ``table``, in all files in a row.
    """
    if row_index_of not in ("file", "table"):
        raise ValueError(f"row_index_of is file or table, not {row_index_of!r}")
    register(spark)
    reader = spark.read.format(NAME)
    if columns:
        reader = reader.option("columns", json.dumps(columns))
    if offset > 0:
        reader = reader.option("offset", offset)
    if limit is not None and limit >= 0:
        reader = reader.option("limit", limit)
    if row_index:
        reader = reader.option("rowIndex", row_index).option("rowIndexOf", row_index_of)
    if exact_decimals:
        reader = reader.option("decimals", "exact")
    if blocks_per_partition:
        reader = reader.option("blocksPerPartition", blocks_per_partition)
    return reader.load(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path)


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None, offset: int = 0, limit: int | None = None) -> pa.Table:
    """The table in the driver's memory."""
    return scan(spark, path, columns, offset, limit).toArrow()


def read_pandas(spark: SparkSession, path: str, columns: list[str] | None = None):
    """The table as a pandas frame in the driver's memory."""
    return scan(spark, path, columns).toPandas()


def read_records(spark: SparkSession, path: str, columns: list[str] | None = None, offset: int = 0, limit: int | None = None) -> list[dict]:
    """Rows as dictionaries in the driver's memory."""
    return [r.asDict() for r in scan(spark, path, columns, offset, limit).collect()]


def record(path: str, number: int) -> dict:
    """One record by its number; only its block is read, without Spark."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    infos = load_infos(path)
    if not 0 <= number < sum(i.records for i in infos):
        raise IndexError(f"{path} has no record {number}")
    (piece,) = plan(infos, number, 1)
    fields = piece.fields
    schema = to_arrow_schema(StructType([f.spark() for f in fields]))
    return next(read_piece(piece, list(range(len(fields))), schema)).to_pylist()[0]


def read_batches(spark: SparkSession, path: str, size: int = 65_536, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows (the last one of fewer), in the files' order, decoded here as they are asked for; no job runs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    infos = load_infos(path)
    wanted = projected(infos[0].fields, columns)
    schema = to_arrow_schema(StructType([infos[0].fields[k].spark() for k in wanted]))
    held: list[pa.RecordBatch] = []
    count = 0
    for piece in plan(infos):
        for batch in read_piece(piece, wanted, schema, batch=min(size, 16_384)):
            while count + batch.num_rows >= size:
                part = batch.slice(0, size - count)
                yield pa.Table.from_batches([*held, part], schema).combine_chunks().to_batches()[0]
                batch, held, count = batch.slice(part.num_rows), [], 0
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held, schema).combine_chunks().to_batches()[0]


def write(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "lzf", single_file: bool = False) -> None:
    """A folder with a file per partition, or one file.  Names that a file can't hold are replaced; the data stay.

    mode ``append`` adds files to a folder whose fields are the same.
    """
    register(df.sparkSession)
    names = unique_names(df.columns)
    out = df if names == df.columns else df.toDF(*names)
    writer = (out.coalesce(1) if single_file else out).write.format(NAME).mode(mode).option("compression", compression)
    writer.option("singleFile", str(single_file).lower()).save(path)


def write_columns(spark: SparkSession, columns: dict[str, list], path: str, schema: list[Field] | None = None, mode: str = "overwrite") -> None:
    """Python lists by name; with a schema, missing columns are null, and the first field's list gives the number of rows."""
    from pyspark.sql.types import StructType

    if schema is None:
        table = pa.table({n: pa.array(v) if any(x is not None for x in v) else pa.array(v, pa.string()) for n, v in columns.items()})
        write(spark.createDataFrame(table), path, mode, single_file=True)
        return
    kinds = StructType([f.spark(True) for f in schema])
    n = len(columns.get(schema[0].name, ()))
    rows = [tuple(columns.get(f.name, [None] * n)[i] for f in schema) for i in range(n)]
    write(spark.createDataFrame(rows, kinds), path, mode, single_file=True)


def write_records(spark: SparkSession, rows: list[dict], path: str, schema: list[Field], mode: str = "overwrite") -> None:
    """Dictionaries by name: what a row lacks is null, what the schema lacks is left out."""
    from pyspark.sql.types import StructType

    kinds = StructType([f.spark(True) for f in schema])
    write(spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], kinds), path, mode, single_file=True)


def write_arrow(spark: SparkSession, table: pa.Table, path: str, mode: str = "overwrite") -> None:
    write(spark.createDataFrame(table), path, mode)


def write_pandas(spark: SparkSession, frame, path: str, mode: str = "overwrite") -> None:
    """An index that says more than the rows' numbers becomes columns before the others."""
    import pandas as pd

    plain = isinstance(frame.index, pd.RangeIndex) and frame.index.start == 0 and frame.index.step == 1
    write_arrow(spark, pa.Table.from_pandas(frame if plain else frame.reset_index(), preserve_index=False), path, mode)


def write_sql(spark: SparkSession, query: str, path: str, **options) -> None:
    write(spark.sql(query), path, **options)


def register_view(spark: SparkSession, name: str, path: str, snapshot: bool = False, **scan_options) -> DataFrame:
    """A view for SQL; with snapshot, its rows are cached and later changes of the file don't show."""
    df = scan(spark, path, **scan_options)
    if snapshot:
        df = df.cache()
    df.createOrReplaceTempView(name)
    return df
