"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", name: str = "cohortlab") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the submitter's settings are used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, whatever kind of storage it is on: a mounted folder is shared, too.

    Without that setting, the warehouse, which executors write tables to; in local mode a temporary folder.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if re.match(r"local($|\[)", sc.master):
            folder = tempfile.mkdtemp(prefix="cohortlab-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory()


def file_states(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a file or of the files of a folder; changes when they are written again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return tuple(
        sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in _files(spark, path).listStatus(where))
    )


_ROOTS: set[str] = set()
_MADE: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder of this application; all of them are removed when the program ends."""
    root = os.path.join(shared_folder(spark), "cohortlab", spark.sparkContext.applicationId)
    if root not in _ROOTS:
        _ROOTS.add(root)
        files, path = _files(spark, root), spark._jvm.org.apache.hadoop.fs.Path(root)
        atexit.register(_removed, files, path)
    folder = os.path.join(root, f"{label}-{uuid.uuid4().hex}")
    _MADE.append(folder)
    return folder


def _removed(files, path) -> None:
    try:
        files.delete(path, True)
    except (Py4JError, OSError):  # the JVM has ended before
        pass


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several later passes read, and return the written copy.

    The copy lives in the shared folder, so it outlives lost executors, and being Parquet each
    pass still reads only its own columns.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """Like ``stage`` for a job that ends in its ``with`` block: the copy is removed afterwards."""
    spark = df.sparkSession
    with scratch(spark, label) as path:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A new folder that is removed when the block ends."""
    path = new_folder(spark, label)
    try:
        yield path
    finally:
        remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    if path in _MADE:
        _MADE.remove(path)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query that starts in the ``with`` block shuffles is removed when the query ends, not when the driver
    happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def passing_folders(spark: SparkSession) -> Iterator[None]:
    """For a job that ends in its ``with`` block: the folders that are made in it are removed afterwards."""
    before = set(_MADE)
    try:
        yield
    finally:
        for path in [p for p in _MADE if p not in before]:
            remove_folder(spark, path)
