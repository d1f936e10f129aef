"""Times the headline queries; prints one line of JSON.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1).  BENCH_CPUS: cores (default 8).
Each time is the better of two runs, results forced by a count or a write to nowhere.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import stratablock as sb  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def spent(run: Callable[[], object], times: int = 2) -> float:
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - began)
    return round(best, 3)


def force(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="rowblock-bench-")
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").repartition(CPUS).cache()
    rows = lineitem.count()
    times: dict[str, float] = {}
    try:
        # workers start and import before anything is timed
        sb.write(lineitem.limit(1000), f"{folder}/warm")
        force(sb.scan(spark, f"{folder}/warm"))
        times["write_lzf"] = spent(lambda: sb.write(lineitem, f"{folder}/lzf"), 1)
        times["write_stored"] = spent(lambda: sb.write(lineitem, f"{folder}/stored", compression="none"), 1)
        sb.write(lineitem, f"{folder}/one", single_file=True, compression="none")
        one, many, wide = f"{folder}/one", f"{folder}/lzf", f"{folder}/wide"
        times["write_wide"] = spent(lambda: sb.write(spark.read.parquet(f"{SF_DIR}/documents.parquet"), wide), 1)
        last = rows - 1000
        times |= {
            "scan_full": spent(lambda: force(sb.scan(spark, one))),
            "scan_full_lzf": spent(lambda: force(sb.scan(spark, many))),
            "scan_lzf_one_column": spent(lambda: force(sb.scan(spark, many, ["l_quantity"]))),
            "scan_wide": spent(lambda: force(sb.scan(spark, wide))),
            "scan_wide_one_column": spent(lambda: force(sb.scan(spark, wide, ["n_chars"]))),
            "scan_one_column": spent(lambda: force(sb.scan(spark, one, ["l_quantity"]))),
            "head_1000": spent(lambda: sb.scan(spark, one, limit=1000).collect()),
            "offset_last_1000": spent(lambda: sb.scan(spark, one, offset=last, limit=1000).collect()),
            "header_count": spent(lambda: sb.num_records(one)),
            "read_aggregate": spent(lambda: sb.scan(spark, one, ["l_returnflag", "l_linestatus", "l_quantity"]).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)), F.sum("l_quantity")).collect()),
        }
        lineitem.unpersist()
        from stratablock.plans import catalogue

        for name in ("rt_orders_by_status", "join_inner", "agg_rollup", "window_rank", "join_asof", "conv_double_to_int", "topk"):
            times[name] = spent(lambda name=name: force(catalogue.queries()[name](spark, SF_DIR)), 1 if name.startswith(("rt_", "conv_")) else 2)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf[1]) if sf else None, "rows_per_sec_full_scan": round(rows / times["scan_full"])}))
    spark.stop()


if __name__ == "__main__":
    main()
