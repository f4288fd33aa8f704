"""Session settings shared by tests, the benchmark and the command line."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings every plan here assumes: ANSI, AQE, UTC."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lithic")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a source tree.

    On a cluster the package is installed or sent with ``--py-files``; the extra entry is
    then a path that does not exist and is ignored.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
