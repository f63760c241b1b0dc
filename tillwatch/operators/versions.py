"""Tables that are replaced as a whole: a reader sees the old rows or the new ones, never a part of either."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "current"


def _paths(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, folder: str) -> str | None:
    """The version that readers see; null before the first."""
    jvm, path, fs = _paths(spark, folder)
    pointer = jvm.org.apache.hadoop.fs.Path(path, POINTER)
    return spark.read.text(pointer.toString()).first()[0] if fs.exists(pointer) else None


def replace(rows: DataFrame, folder: str) -> None:
    """Write a new version beside the current one, then move the pointer to it in one rename. The version before stays for
    readers that have begun; older ones go. A writer that fails leaves the current version as it is."""
    spark = rows.sparkSession
    jvm, path, fs = _paths(spark, folder)
    before, new = version(spark, folder), f"version-{uuid.uuid4()}"
    rows.write.parquet(f"{folder}/{new}")
    draft = jvm.org.apache.hadoop.fs.Path(path, f".{new}")
    out = fs.create(draft, True)
    out.write(bytearray(new.encode()))
    out.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(path, POINTER), over)
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in (before, new):
            fs.delete(status.getPath(), True)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The current version's rows; filters reach its files."""
    found = version(spark, folder)
    if found is None:
        raise ValueError(f"there is no table in {folder} yet")
    return spark.read.parquet(f"{folder}/{found}")
