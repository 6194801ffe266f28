"""Sessions, and what executors need to have."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution; on a cluster, take the cluster's own."""
    build = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        build = build.config(key.replace("__", "."), value)
    return build.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    to = tempfile.mkdtemp()  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, to, ignore_errors=True)
    shutil.copytree(package, f"{to}/tree/gridloom", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{to}/gridloom", "zip", f"{to}/tree"))
    sc._gridloom_shipped = True
