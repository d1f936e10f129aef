"""What the operators share: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_dir: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is named (tests, local mode)."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="stratablock-")
    return _own_dir[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/stratablock/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made_so_far(spark: SparkSession) -> frozenset[str]:
    return frozenset(_made.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, keep: frozenset[str] = frozenset()) -> None:
    """Deletes what this application has cut, but for the paths to keep: for when the results that read it are written."""
    jvm, app = spark.sparkContext._jvm, spark.sparkContext.applicationId
    for path in [p for p in _made.get(app, []) if p not in keep]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        _made[app].remove(path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here.

    A lost executor then costs the tasks it ran, not the whole chain before.
    """
    spark = df.sparkSession
    ship(spark)
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, so that no locale or Unicode table takes part."""
    return F.translate(col, UPPER, UPPER.lower())


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
