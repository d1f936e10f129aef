"""Streams into row-block files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import write


def write_stream(stream: DataFrame, path: str, checkpoint: str, compression: str = "lzf", **trigger) -> StreamingQuery:
    """Each micro-batch becomes a folder batch-<number> below path; a batch that is run again replaces its folder.

    scan() of path reads all finished batches.
    """

    def store(batch: DataFrame, number: int) -> None:
        write(batch, f"{path}/batch-{number:012d}", compression=compression)

    out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (out.trigger(**trigger) if trigger else out).start()
