"""Intermediate tables that cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: "weakref.WeakSet" = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python code there can import it."""
    context = spark.sparkContext
    if context not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="logweave-code-")
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(context)


_stored: "weakref.WeakSet[DataFrame]" = weakref.WeakSet()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="logweave-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and return the scan of it.

    Unlike a cached frame it survives the loss of executors, and unlike an RDD checkpoint later
    readers keep column pruning, filter pushdown and true size statistics. A frame that is such a scan
    already is returned as it is.
    """
    if df in _stored:
        return df
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/logweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored.add(stored)
    return stored
