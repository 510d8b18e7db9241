"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins from measured sizes: it broadcasts a side
#: only when the shuffled data proved to be below the threshold, and splits
#: skewed partitions of sort-merge joins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    conf = DEFAULTS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra
    return builder.config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that functions
    over Arrow batches find it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-package-"), "millrace.zip")  # Spark serves it from the driver
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(root):
            for n in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(base, n)
                z.write(full, os.path.join("millrace", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._millrace_shipped = True
