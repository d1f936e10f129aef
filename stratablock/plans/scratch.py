"""Where queries put files for a round trip: the cluster's shared folder, or one of our own where none is set."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="rowblock-")
        named = _own[app]
    return f"{named.rstrip('/')}/rowblock/{label}-{uuid.uuid4().hex}"
