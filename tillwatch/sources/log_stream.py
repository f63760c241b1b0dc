"""A certificate log as a Spark data source: entries by index, in batch and as a stream whose offset is the next index.

A log is a folder of tiles: `tile=<n>` holds the entries from n * TILE on, one JSON object a line in the order of their index,
all full but the last. A plan needs the names of the tiles and the length of the last one; entries are read by tasks, a tile or
a part of one each. A batch of the stream takes at most `entries` of them.

The offset that a batch will end at is put into `cursor`, a file beside the stream's checkpoint, when the batch is planned. Spark
plans a batch after it has noted its offsets, so a reader that starts again goes on from where Spark does, whether the batch was
finished or is run again: each entry comes once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT, TILE = "tillwatch_log", 256
SCHEMA = "index bigint, leaf_input string"


def write_log(entries: DataFrame, path: str, index: str = "index", leaf: str = "leaf_input", tile: int = TILE, mode: str = "error") -> None:
    """Entries (indexes without a gap from 0) as a log's folder; each tile is one task's."""
    line = F.to_json(F.struct(F.col(leaf).alias("leaf_input"), F.lit("").alias("extra_data")))
    placed = entries.select(F.floor(F.col(index) / tile).alias("tile"), F.col(index).alias("_i"), line.alias("value"))
    placed.repartition("tile").sortWithinPartitions("tile", "_i").select("tile", "value").write.mode(mode).partitionBy("tile").text(path)


class Tiles:
    """The folder of a log, in any store that Arrow reaches."""

    def __init__(self, path: str, tile: int):
        self.path, self.tile = path, tile

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else self.path.replace("file:", "file://", 1))

    def files(self, n: int) -> list[str]:
        store, root = self.store()
        listed = store.get_file_info(fs.FileSelector(f"{root}/tile={n}", allow_not_found=True))
        return sorted(f.path for f in listed if f.is_file and not f.base_name.startswith((".", "_")))

    def lines(self, n: int) -> list[bytes]:
        store, _ = self.store()
        found: list[bytes] = []
        for path in self.files(n):
            with store.open_input_stream(path) as f:
                found += f.read().splitlines()
        return found

    def size(self) -> int:
        """Entries of the log: full tiles, and the lines of the last one."""
        store, root = self.store()
        tiles = [int(f.base_name[5:]) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("tile=")]
        return max(tiles) * self.tile + len(self.lines(max(tiles))) if tiles else 0

    def parts(self, start: int, end: int) -> list[Part]:
        cuts = [start, *range((start // self.tile + 1) * self.tile, end, self.tile), end]
        return [Part(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]

    def rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        n = part.start // self.tile
        found = self.lines(n)[part.start - n * self.tile : part.end - n * self.tile]
        if len(found) != part.end - part.start:
            raise ValueError(f"the log has no entries {part.start + len(found)} to {part.end - 1}")
        yield pa.RecordBatch.from_arrays([pa.array(range(part.start, part.end), pa.int64()), pa.array([json.loads(x).get("leaf_input", "") for x in found], pa.string())], names=["index", "leaf_input"])


class Part(InputPartition):
    """Entries from `start` to before `end`, of one tile."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class LogReader(DataSourceReader):
    def __init__(self, log: Tiles, start: int):
        self.log, self.start = log, start

    def partitions(self) -> list[Part]:
        return self.log.parts(self.start, self.log.size())

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from self.log.rows(partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, log: Tiles, start: int, entries: int, cursor: str | None):
        self.log, self.start, self.entries, self.cursor, self.at = log, start, entries, cursor, None

    def initialOffset(self) -> dict:
        return {"index": self.start}

    def latestOffset(self) -> dict:
        at = self.at if self.at is not None else self._noted()
        return {"index": max(at, min(self.log.size(), at + self.entries))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = max(end["index"], self.at or 0)
        if self.cursor:
            store, path = Tiles(self.cursor, 1).store()
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as f:
                f.write(str(self.at).encode())
        return self.log.parts(start["index"], end["index"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.log.rows(partition)

    def _noted(self) -> int:
        if not self.cursor:
            return self.start
        store, path = Tiles(self.cursor, 1).store()
        if not store.get_file_info(path).is_file:
            return self.start
        with store.open_input_stream(path) as f:
            return int(f.read() or self.start)


class LogSource(DataSource):
    """Options: path, tile (entries of a tile), start (first index), entries (most of a batch), cursor (a file)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _log(self) -> Tiles:
        return Tiles(self.options["path"], int(self.options.get("tile", TILE)))

    def reader(self, schema) -> LogReader:
        return LogReader(self._log(), int(self.options.get("start", 0)))

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self._log(), int(self.options.get("start", 0)), int(self.options.get("entries", 50_000)), self.options.get("cursor"))


def registered(spark: SparkSession) -> SparkSession:
    """The session, knowing the source."""
    spark.dataSource.register(LogSource)
    return spark


def log(spark: SparkSession, path: str, tile: int = TILE, start: int = 0) -> DataFrame:
    """All entries of a log: index, leaf_input."""
    return registered(spark).read.format(FORMAT).option("tile", tile).option("start", start).load(path)


def log_stream(spark: SparkSession, path: str, cursor: str, tile: int = TILE, start: int = 0, entries: int = 50_000) -> DataFrame:
    """The entries of a log as a stream of bounded batches: index, leaf_input."""
    return registered(spark).readStream.format(FORMAT).option("tile", tile).option("start", start).option("entries", entries).option("cursor", cursor).load(path)
