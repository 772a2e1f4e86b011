"""What a job needs of its session: the package on the executors, and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's modules to every executor, once per application; kernels then run from any working directory.

    The archive is made in a folder of the driver's own, Spark serves it to the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_wavelake_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="wavelake-"), "wavelake_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(_PACKAGE.parent)))
    sc.addPyFile(path)
    sc._wavelake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``; one of its own only on a single machine without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_wavelake_dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        path = "file://" + tempfile.mkdtemp(prefix="wavelake-shared-")
        spark.sparkContext._wavelake_dir = path
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: what was computed is not computed again, and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
