"""Sessions: settings that the engine relies on, and its own code on the executors."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def create(app: str = "tillwatch", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by their Spark names."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in `spark.checkpoint.dir`, which all machines reach. Only a local master may go without that setting: it gets a temporary folder, as all its threads are on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tillwatch-"))
    return context.getCheckpointDir()


def fingerprint(spark: SparkSession, path: str) -> str:
    """What tells the files of a table from those of another time: their names, lengths and times. One listing, no job."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = store.listStatus(at) if store.exists(at) else ()
    return "|".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


#: Bytes of stored tables whose rows make up a task's share: some 300,000 narrow rows, a few hundred MB in the maps of an aggregation.
TASK_BYTES = 4 << 20


def tasks_for(*frames: DataFrame) -> int:
    """How many tasks rows of these frames are dealt to: as many as the bytes of the files that they are read from ask for, so that
    a task's memory stays as the tables grow. Compressed shuffles tell less: adaptive execution takes 64 MB of them for a small task,
    and repetitive rows fill fifty times that in memory."""
    spark = frames[0].sparkSession
    names: dict[str, set[str]] = {}
    for f in (f for frame in frames for f in frame.inputFiles()):
        folder, name = f.rsplit("/", 1)
        names.setdefault(folder, set()).add(name)
    jvm, conf, size = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for folder, wanted in names.items():
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        for f in at.getFileSystem(conf).listStatus(at):
            size += f.getLen() if f.getPath().toUri().getRawPath().rsplit("/", 1)[1] in wanted else 0
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def dealt(key: str, *frames: DataFrame) -> list[DataFrame]:
    """Frames that meet by a key, each dealt by it to the same number of tasks."""
    n = tasks_for(*frames)
    return [frame.repartition(n, key) for frame in frames]


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where PYTHONPATH doesn't already lead to it."""
    here = str(ROOT.parent)
    context = spark.sparkContext
    if here not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and not getattr(context, "_tillwatch_shipped", False):
        folder = tempfile.mkdtemp(prefix="tillwatch-")
        context.addPyFile(shutil.make_archive(f"{folder}/{ROOT.name}", "zip", here, ROOT.name))
        context._tillwatch_shipped = True
    return spark
