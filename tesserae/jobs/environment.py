"""What runs here: versions, the model's size, and whether driver and executors share the scratch folder."""

from __future__ import annotations

import platform
from importlib import metadata

from pyspark.sql import SparkSession

from ..operators import model
from ..sources.scratch import scratch_path

NEEDED = ("pyspark", "numpy", "pandas", "pyarrow")


def environment(spark: SparkSession) -> tuple[list[str], bool]:
    """(lines of a report, whether everything is there)."""
    lines, good = [f"python {platform.python_version()}", f"spark {spark.version}, {spark.sparkContext.master}, {spark.sparkContext.defaultParallelism} tasks at once"], True
    for name in NEEDED:
        try:
            lines.append(f"{name} {metadata.version(name)}")
        except metadata.PackageNotFoundError:
            lines.append(f"{name} is missing")
            good = False
    lines.append(f"{model.parameter_count()} parameters")
    try:
        path = scratch_path(spark, "check")
        spark.range(8).write.parquet(path)
        shared = spark.read.parquet(path).count() == 8
    except Exception as e:  # whatever keeps tasks from writing or the driver from reading
        lines.append(f"scratch folder: {type(e).__name__}: {str(e)[:200]}")
        return lines, False
    lines.append(f"scratch folder: {'shared' if shared else 'files of executors are missing'}")
    return lines, good and shared
