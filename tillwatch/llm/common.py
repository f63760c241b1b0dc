"""What the text operators share: Arrow text buffers, shared storage, small Spark helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.session import shared_folder, ship

#: Rows that Spark hands to a Python worker at once, and the bytes of text that a worker takes up at once.
BATCH_ROWS = 1000
CHUNK_BYTES = 2_000_000


def session(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder. Spark removes it with `spark.cleaner.referenceTracking.cleanCheckpoints`."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A Parquet table written in the same folder and read again: for what is too large for a checkpoint's plain rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleaned(spark: SparkSession) -> None:
    """Remove all checkpoints and tables of this application; results that still read them can't be used afterwards."""
    jvm, folder = spark.sparkContext._jvm, shared_folder(spark)
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n).cast("bigint"))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty), and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text_col: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most `limit` bytes of text each (or a single longer row), with their text buffers."""
    data, offsets = buffer_of(batch.column(text_col))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def decoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a text buffer: (bytes, char starts in them, code points, n + 1 char offsets of rows). Bytes that are no UTF-8 are replaced first."""
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace").encode("utf-8") for a, b in zip(offsets[:-1], offsets[1:])]
        raw = b"".join(rows)
        data, offsets = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        text = raw.decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return data, np.arange(len(data)), points, offsets
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    return data, starts, points, np.searchsorted(starts, offsets)


def partitions_of(df: DataFrame) -> int:
    """Number of the tasks that would scan a frame: grows with its bytes, found without a job."""
    return max(1, df.rdd.getNumPartitions())
