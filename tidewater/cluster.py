"""What a cluster needs: a shared folder, and the package on Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names in spark.checkpoint.dir.

    Only where none is set and all runs on one machine (tests, a laptop) a temporary folder is
    made and set; a cluster without a shared folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def delete(spark: SparkSession, path: str) -> None:
    """A folder of the shared folder, with all that is in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once, so workers can import it wherever they run.

    Spark serves the archive from the driver; jobs submitted with --py-files don't need it.
    """
    context = spark.sparkContext
    if getattr(context, "_tidewater_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidewater-")) / "tidewater.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    context.addPyFile(str(archive))
    context._tidewater_shipped = True
