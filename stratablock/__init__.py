"""Row-block tables for Spark."""

from .api import (
    file_schema,
    num_records,
    read,
    read_arrow,
    read_batches,
    read_pandas,
    read_records,
    record,
    register,
    register_view,
    scan,
    write,
    write_arrow,
    write_columns,
    write_pandas,
    write_records,
    write_sql,
)
from .sources.fields import Field

__version__ = "0.1.0"
__all__ = [
    "Field",
    "file_schema",
    "num_records",
    "read",
    "read_arrow",
    "read_batches",
    "read_pandas",
    "read_records",
    "record",
    "register",
    "register_view",
    "scan",
    "write",
    "write_arrow",
    "write_columns",
    "write_pandas",
    "write_records",
    "write_sql",
]
