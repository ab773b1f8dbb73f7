"""Runs named queries one after another and goes on when one fails."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, rows long, seconds double, error string"


def retry_delay(message: str, attempt: int, base: float = 2.0, most: float = 120.0) -> float:
    """Seconds to wait before a service is called again: what its message asks for and two
    more, `most` at the longest, else twice as long at each attempt."""
    asked = re.search(r"retry in ([0-9.]+)\s*s", message, re.I)
    return min(float(asked[1]) + 2, most) if asked else base * 2**attempt


def run_all(spark: SparkSession, sf_dir: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]], out: str, names: list[str] | None = None) -> DataFrame:
    """Write the result of each query to `out`/name; name, rows, seconds and error of all."""
    done = []
    for name in names or list(queries):
        began, rows, error = time.time(), None, None
        try:
            queries[name](spark, sf_dir).write.mode("overwrite").parquet(f"{out}/{name}")
            rows = spark.read.parquet(f"{out}/{name}").count()
        except Exception as failure:  # the others run on
            error = f"{type(failure).__name__}: {failure}"[:2000]
        done.append((name, rows, round(time.time() - began, 3), error))
    return spark.createDataFrame(done, SCHEMA)
