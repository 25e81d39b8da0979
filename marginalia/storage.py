"""Folders that the driver and all executors share, by Spark's file systems on the driver and by Arrow's in Python tasks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables between jobs, below spark.checkpoint.dir; where none is set, one of our own in local mode and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="marginalia-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def in_tasks(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, for Python code: local and mounted folders, HDFS and the object stores that Arrow knows."""
    local = re.sub("^file:/+", "/", uri)
    return (fs.LocalFileSystem(), os.path.abspath(local)) if "://" not in local else fs.FileSystem.from_uri(local)


def on_driver(spark: SparkSession, path: str):
    """Hadoop's file system and path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = on_driver(spark, path)
    return bool(files.exists(where))
