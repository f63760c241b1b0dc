"""Streaming forms: incremental aggregates with mergeable state, change detection, alert matching, micro-batched appends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import alerts, reports
from ..schemas import REACHED


def observations(spark: SparkSession, path: str, schema, files: int = 10) -> DataFrame:
    """Files of observations as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Append a stream to a table under its month, a batch each few seconds; `once` takes what there is and ends."""
    dated = stream.withColumn("month", F.date_format("ts", "yyyyMM"))
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("month").trigger(**trigger).start()


def market_share_states(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Distinct-host sketches per month and keys, one file set a batch; a rerun of a batch overwrites its own, so each counts once."""

    def put(batch: DataFrame, n: int) -> None:
        reports.monthly_state(batch, keys, "ts").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_share(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What the states of all batches say together."""
    return reports.merged_state(spark.read.parquet(path), ["month", *keys])


EVENTS = "host_id long, entity_id string, event_type string, scan_id long"
_EVENT = Row("host_id", "entity_id", "event_type", "scan_id")


class Sightings(StatefulProcessor):
    """Two-in-a-row change detection of one host: its state is the last scan that counted, and the entities it knows.

    Every call to the state is a message to the JVM and back, and a scan changes all entities that a host is known for. So a
    host's state is one row: a batch reads it once, folds all the host's scans and writes it once. A host that no scan reached
    for `idle_days` of event time loses its state by a timer; one that fires before that, as scans came after it was set, is
    set anew.
    """

    def __init__(self, idle_days: int):
        self.idle_ms = idle_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.host = handle.getValueState("host", "at long, scan_id long, entities array<string>, confirmations array<int>, misses array<int>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.host.get()
        last = before = tuple(stored[:2]) if stored is not None else None
        known = {name: (n, misses) for name, n, misses in zip(*stored[2:])} if stored is not None else {}
        for r in sorted(rows, key=lambda r: (r.at, r.scan_id)):
            if r.status == REACHED and (last is None or (r.at, r.scan_id) > last):
                last = r.at, r.scan_id
                yield from self._scan(key[0], r.scan_id, set(r.entities or ()), known)
        if last != before:
            self.host.update((*last, list(known), [n for n, _ in known.values()], [misses for _, misses in known.values()]))
            if before is None:
                self.handle.registerTimer(self._due(last[0]))

    def _scan(self, host: int, scan_id: int, seen: set[str], known: dict[str, tuple[int, int]]) -> Iterator[Row]:
        """Events of one scan; `known`, the confirmations and misses of each entity, becomes what holds after it."""
        missed = sorted(known.keys() - seen)
        for name in sorted(seen):
            n = known.get(name, (0, 0))[0] + 1
            known[name] = n, 0
            if n == 2:
                yield _EVENT(host, name, "added", scan_id)
        for name in missed:
            n, misses = known[name]
            if misses + 1 < 2:
                known[name] = n, misses + 1
            else:
                del known[name]
                yield _EVENT(host, name, "removed", scan_id)

    def _due(self, at: int) -> int:
        return at // 1000 + self.idle_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored = self.host.get()
        if stored is not None and (due := self._due(stored[0])) >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            self.host.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes(scans: DataFrame, idle_days: int = 3650, late: str = "0 seconds") -> DataFrame:
    """Two-in-a-row change events of a stream: host_id, entity_id, event_type, scan_id.

    scans: host_id, scan_id, ts (timestamp), status, entities array<string>. A scan that isn't later than the host's last one, by time
    and id, is none of news. State is kept in RocksDB, a row a host. A host that is idle for
    `idle_days` of event time is forgotten. Needs the protobuf package, as all of Spark's keyed state in Python does.
    """
    scans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    placed = scans.withWatermark("ts", late).select("host_id", "scan_id", "ts", F.unix_micros("ts").alias("at"), "status", "entities")
    return placed.groupBy("host_id").transformWithState(Sightings(idle_days), EVENTS, "append", "eventTime")


def alert_deliveries(events: DataFrame, rules: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Match a stream of events against alert rules; what earlier batches delivered isn't delivered again."""

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        earlier = spark.read.schema("rule_id long, event_id long, batch long").parquet(path).where(F.col("batch") < n) if n else None
        alerts.match(batch, rules, earlier).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_tolerant_counts(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by window and type; a watermark bounds what is kept, at the price of later rows. The batch forms drop none."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


Sink = Callable[[DataFrame, int], None]
