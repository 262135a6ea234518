"""Where jobs keep intermediate tables, and how this package reaches the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from siftgate.options import OptionError


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, may that be unset: a local
    temporary folder then stands in. Anywhere else each executor would keep its own part to itself.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise OptionError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siftgate-")
    return f"{root.rstrip('/')}/siftgate/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> bool:
    """Delete a folder that :func:`scratch` named, on whichever file system it lies."""
    if "/siftgate/" not in path:
        raise OptionError(f"{path!r} is no scratch folder")
    return delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def empty_file(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True).close()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once per Spark application)."""
    context = spark.sparkContext
    if getattr(context, "_siftgate_shipped", False):
        return
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    base = os.path.join(tempfile.mkdtemp(prefix="siftgate-"), "siftgate")
    context.addPyFile(shutil.make_archive(base, "zip", home, "siftgate"))
    context._siftgate_shipped = True
