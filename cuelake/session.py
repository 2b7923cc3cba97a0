"""Makes the package importable in Python workers that weren't started with it on their path, and finds the shared folder."""

from __future__ import annotations

import os
import posixpath
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_cuelake_shipped", False):
        return spark
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="cuelake-src-"), "cuelake_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._cuelake_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a purely local session without that setting gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cuelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found else "file://" + posixpath.abspath(found)
