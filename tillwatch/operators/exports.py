"""Exports: rows, canaries, watermark order, files with metadata, and schedules."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson
from ..schemas import confidence_rank
from . import file_sink
from .ordered import checkpointed

# The fields of an export with their types; a basic profile leaves FULL_ONLY out.
FIELDS = {
    "snapshot": {
        "domain": "string", "as_of": "timestamp", "platform_id": "string", "platform_confidence": "string", "country": "string", "country_confidence": "string", "currency": "string", "vertical_id": "string",
        "checkout_status": "string", "coverage": "string", "acquirer_hidden": "boolean", "provider_ids": "array<string>", "providers": "array<string>", "providers_active_on_checkout": "array<string>",
        "method_ids": "array<string>", "methods": "array<string>", "checkout_psp_hosts": "array<string>", "traffic_rank": "bigint", "first_seen": "date", "last_seen": "date", "last_checkout_scan_at": "timestamp",
    },
    "increment": {"domain": "string", "event_type": "string", "entity": "string", "old_value": "string", "new_value": "string", "detected_at": "timestamp"},
    "aggregates": {"country": "string", "platform_id": "string", "provider_id": "string", "stores": "bigint", "share": "double", "ci_low": "double", "ci_high": "double"},
}
FULL_ONLY = {
    "snapshot": ("currency", "vertical_id", "acquirer_hidden", "providers_active_on_checkout", "checkout_psp_hosts", "traffic_rank", "last_checkout_scan_at"),
    "increment": ("old_value", "new_value"), "aggregates": (),
}
KEYS = {"snapshot": ("domain",), "increment": ("domain", "event_type", "entity", "detected_at"), "aggregates": ("country", "platform_id", "provider_id")}


def fields_for(kind: str, full: bool) -> list[str]:
    return [f for f in FIELDS[kind] if full or f not in FULL_ONLY[kind]]


def as_of(light: Column, checkout: Column, updated: Column) -> Column:
    """The later of the scans there were, or else the last update."""
    return F.coalesce(F.greatest(light, checkout), updated)


def _as_exported(rows: DataFrame, kind: str) -> DataFrame:
    """The fields of a kind, in order, with their types; null where `rows` has no such column."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS[kind].items()])


def snapshot_rows(stores: DataFrame, providers: DataFrame, methods: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """One row per store with its lists: children are gathered once by host, never per page.

    providers: host_id, provider_id, role, confidence, active, first_seen, last_seen; methods: host_id, method_id,
    method_type, confidence; hosts: host_id, hostname, third_party. A store's own columns have the names of the fields.
    """
    entry = F.struct("provider_id", "role", "confidence", "active", "first_seen", "last_seen")
    p = providers.groupBy("host_id").agg(F.sort_array(F.collect_list(entry)).alias("p"))
    m = methods.groupBy("host_id").agg(F.sort_array(F.collect_list(F.struct("method_id", "method_type", "confidence"))).alias("m"))
    out = stores.drop("first_seen", "last_seen").join(p, "host_id", "left").join(m, "host_id", "left")
    if hosts is not None:
        out = out.join(hosts.where("third_party").groupBy("host_id").agg(F.sort_array(F.collect_set("hostname")).alias("h")), "host_id", "left")
    of = lambda c, f: F.coalesce(F.transform(c, f), F.array().cast("array<string>"))
    joined = lambda *xs: F.concat_ws(":", *[x.cast("string") for x in xs])
    listed = {
        "provider_ids": of("p", lambda x: x["provider_id"].cast("string")), "providers": of("p", lambda x: joined(x["provider_id"], x["role"], x["confidence"])),
        "providers_active_on_checkout": of(F.filter("p", lambda x: x["active"]), lambda x: x["provider_id"].cast("string")), "method_ids": of("m", lambda x: x["method_id"].cast("string")),
        "methods": of("m", lambda x: joined(x["method_id"], F.coalesce(x["method_type"], F.lit("other")), x["confidence"])),
        "checkout_psp_hosts": F.coalesce("h", F.array().cast("array<string>")) if hosts is not None else F.array().cast("array<string>"),
        "first_seen": F.array_min(F.transform("p", lambda x: x["first_seen"])), "last_seen": F.array_max(F.transform("p", lambda x: x["last_seen"])),
    }
    return _as_exported(out.withColumns(listed), "snapshot")


def increment_rows(events: DataFrame, stores: DataFrame, since: str, until: str) -> DataFrame:
    """Events of visible stores in [since, until)."""
    at = lambda t: F.to_timestamp_ntz(F.lit(t))
    some = events.where((F.col("detected_at") >= at(since)) & (F.col("detected_at") < at(until))).withColumnRenamed("entity_id", "entity")
    return _as_exported(some.join(stores.select("host_id", "domain"), "host_id"), "increment")


def aggregate_rows(shares: DataFrame) -> DataFrame:
    """Shares (country, platform, provider_id, stores, total) with their intervals, as an export has them."""
    low, high = wilson(F.col("stores"), F.col("total"))
    return _as_exported(shares.select("country", F.col("platform").alias("platform_id"), "provider_id", "stores", (F.col("stores") / F.col("total")).alias("share"), low.alias("ci_low"), high.alias("ci_high")), "aggregates")


def row_key(kind: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEYS[kind]])


def order_key(watermark_hex: str, key: Column) -> Column:
    """The place of a row in the order that only this watermark produces."""
    return F.sha2(F.concat(F.unhex(F.lit(watermark_hex.replace("-", ""))), F.encode(key, "UTF-8")), 256)


def watermarked(rows: DataFrame, watermark_hex: str, key: Column) -> DataFrame:
    """Rows in watermark order: a range-partitioned sort that spills, nothing is gathered."""
    return rows.withColumn("_o", order_key(watermark_hex, key)).orderBy("_o").drop("_o")


def order_breaks(rows: DataFrame, watermark_hex: str, key: Column, place: str) -> DataFrame:
    """Rows of a delivered file (with their `place` in it) that are out of the watermark's order; none if the file is genuine.

    Each row is compared with the greatest key of the places before it: a running maximum within ranges of places, and the
    maximum of all earlier ranges.
    """
    size = 100_000
    keyed = rows.withColumn("_o", order_key(watermark_hex, key)).withColumn("_r", F.floor(F.col(place) / size))
    heads = keyed.groupBy("_r").agg(F.max("_o").alias("_m"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range of places
    heads = heads.select("_r", F.max("_m").over(before).alias("_m"))
    within = Window.partitionBy("_r").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    checked = keyed.withColumn("_w", F.max("_o").over(within)).join(heads, "_r")
    return checked.where(F.col("_o") < F.greatest(F.coalesce("_w", F.lit("")), F.coalesce("_m", F.lit("")))).drop("_o", "_r", "_w", "_m")


def canaries(rows: DataFrame, export_hex: str, zone: str, low: int = 3, high: int = 10) -> DataFrame:
    """Between `low` and `high` made-up stores, the same for the same export: columns of `rows` that a canary fills, else null."""
    spark = rows.sparkSession
    seed = lambda n: F.sha2(F.concat(F.unhex(F.lit(export_hex.replace("-", ""))), F.unhex(F.lpad(F.hex(n), 2, "0"))), 256)
    number = lambda h, k, n: (F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int") % n).cast("int")
    many = F.lit(low) + number(F.sha2(F.concat(F.encode(F.lit("count"), "UTF-8"), F.unhex(F.lit(export_hex.replace("-", "")))), 256), 0, high - low + 1)
    base = spark.range(high).where(F.col("id") < many).withColumn("h", seed(F.col("id")))
    pick = lambda k, *options: F.element_at(F.array(*[F.lit(o) for o in options]), number(F.col("h"), k, len(options)) + 1)
    made = {"domain": F.concat(F.lit("c-"), F.substring("h", 1, 12), F.lit(f".{zone}")), "platform": pick(10, "woocommerce", "shopify", "magento2", "shopware6", "prestashop"), "country": pick(9, "DE", "FR", "GB"), "provider_ids": F.array(pick(7, "stripe", "adyen", "paypal", "mollie")), "method_ids": F.array(pick(8, "visa", "mastercard", "ideal"))}
    return base.select(*[(made[f.name] if f.name in made else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])


def write_parquet(rows: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """Zstandard Parquet in row groups of 50 000 rows. Metadata are entries of each file's footer, and with the schema in a sidecar beside it."""
    file_sink.write(rows, path, "parquet", metadata)
    sidecar(rows, metadata).coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def sidecar(rows: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """One line of JSON: metadata and the fields with their types."""
    fields = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in rows.schema]
    return rows.sparkSession.createDataFrame([(json.dumps({"metadata": metadata, "fields": fields}, sort_keys=True),)], "value string")


def as_text(rows: DataFrame) -> DataFrame:
    """Every column as CSV has it: lists joined by bars, lower-case booleans, ISO dates, null as nothing."""
    out = []
    for f in rows.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        text = F.array_join(F.transform(c, lambda x: x.cast("string")), "|") if kind == "array" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else c.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(f.name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """CSV files that begin with a `# k=v` line, which readers skip as a comment, and a header."""
    file_sink.write(as_text(rows), path, "csv", metadata)


def read_csv(spark, path: str) -> DataFrame:
    """Rows of such files; the line of metadata is a comment, and the header comes after it."""
    return spark.read.option("header", True).option("comment", "#").csv(path, pathGlobFilter="*.csv")


def write_report(metrics: dict[str, DataFrame], path: str) -> None:
    """One ZIP, `report.zip` below the path, with one CSV a metric."""
    rows, headers = file_sink.report_rows({name: as_text(m) for name, m in metrics.items()})
    file_sink.write(rows, path, "zip", headers, name="report.zip")


def due_jobs(contracts: DataFrame, jobs: DataFrame, month: str) -> DataFrame:
    """Contracts with a monthly export that has no job in the month yet."""
    done = jobs.where((F.col("periodic") == "true") & (F.date_format("created_at", "yyyy-MM") == month)).select("org_id")
    return contracts.where("schedule = 'monthly'").join(done, "org_id", "left_anti")


def approval(estimate: int, limit: int, left: int) -> str:
    """What becomes of a request for so many rows: refused beyond the quota that is left, else for approval beyond the limit."""
    return "refused" if estimate > left else "approval" if estimate > limit else "queued"


def approved(estimate: Column, limit: Column, left: Column) -> Column:
    """`approval` for columns."""
    return F.when(estimate > left, "refused").when(estimate > limit, "approval").otherwise("queued")


def run_jobs(jobs: list[dict], build) -> list[dict]:
    """Run each job by itself; a failure is that job's own."""
    out = []
    for job in jobs:
        try:
            out.append(job | {"status": "done", "rows": build(job)})
        except Exception as e:  # noqa: BLE001 - any fault of a job ends that job
            out.append(job | {"status": "failed", "error": str(e)[:500]})
    return out


#: Months that observations, scans and stops of walks are kept.
RETENTION = {"observations": 36, "scans": 12, "stops": 24}


def retained(observations: DataFrame, today: str, months: int = 36, ts: str = "scan_date") -> DataFrame:
    """Observations within their retention; on a table partitioned by date only the partitions left are read."""
    return observations.where(F.col(ts) >= F.add_months(F.lit(today).cast("date"), -months))


def expire_months(spark, path: str, today: str, months: int, dry_run: bool = False, column: str = "month") -> list[str]:
    """Remove the months of a table partitioned by `column` (yyyyMM) that ended before the retention, and name them.

    Folders are listed and dropped by name: no file is opened. A month that the period still touches stays whole. What is read
    while a month goes fails and may be read again; a sweep that was cut short goes on with the next one. A dry run only names them.
    """
    year, month = int(today[:4]), int(today[5:7])
    keep = year * 12 + month - 1 - months
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in store.listStatus(root) if store.exists(root) else ():
        key, _, value = status.getPath().getName().partition("=")
        if key == column and value.isdigit() and len(value) == 6 and int(value[:4]) * 12 + int(value[4:]) - 1 < keep:
            gone.append(value)
            if not dry_run:
                store.delete(status.getPath(), True)
    return sorted(gone)


def sweep_captures(spark, path: str, before: Column, dry_run: bool = False, prefixes: tuple[str, ...] = ("light", "checkout")) -> DataFrame:
    """Remove raw captures that are older than a time: prefix, removed (or, in a dry run, what would be).

    Files are listed with their times, not opened, and removed by the tasks that were dealt them. A file that is gone already
    counts as removed, so a sweep that is run again ends the same.
    """
    files = spark.read.format("binaryFile").load([f"{path}/{p}" for p in prefixes], recursiveFileLookup=True).where(F.col("modificationTime") < before)
    old = files.select(F.regexp_extract("path", rf"/({'|'.join(prefixes)})/", 1).alias("prefix"), "path")

    def run(batches):
        for batch in batches:
            if not dry_run:
                for p in batch.column("path").to_pylist():
                    store, at = file_sink.store_of(p)
                    if store.get_file_info(at).is_file:
                        store.delete_file(at)
            yield batch.select(["prefix"])

    counted = checkpointed(old.mapInArrow(run, "prefix string").groupBy("prefix").agg(F.count("*").alias("removed")))
    names = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    return names.join(counted, "prefix", "left").select("prefix", F.coalesce("removed", F.lit(0)).alias("removed"))


def without_optouts(plans: DataFrame, hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """Scan plans without those of hosts whose domain opted out. plans: host_id; hosts: host_id, domain; domains: domain, optout."""
    out = hosts.join(domains.where("optout").select("domain"), "domain", "left_semi").select("host_id")
    return plans.join(out, "host_id", "left_anti")


def write_observations(rows: DataFrame, path: str, ts: str, order: list[str]) -> None:
    """Append observations under their month, sorted within files so that statistics skip."""
    rows.withColumn("month", F.date_format(ts, "yyyyMM")).sortWithinPartitions("month", *order).write.mode("append").partitionBy("month").parquet(path)


def sync_dictionary(stored: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """A dictionary after loading: new rows at version 1, changed ones a version higher, others and missing ones as they are."""
    columns = [c for c in loaded.columns if c != key]
    a = stored.select(key, F.col("version").alias("_v"), F.struct(*columns).alias("_a"))
    b = loaded.select(key, F.struct(*columns).alias("_b"))
    j = a.join(b, key, "full_outer")
    same = F.col("_a").eqNullSafe(F.col("_b")) | F.col("_b").isNull()
    version = F.when(F.col("_v").isNull(), 1).when(same, F.col("_v")).otherwise(F.col("_v") + 1)
    return j.select(key, version.alias("version"), F.coalesce("_b", "_a").alias("_c")).select(key, "version", "_c.*")


def upsert(state: DataFrame, rows: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """State after rows, one grouped pass over both: per column `min`, `max` (nulls never win), `first` (state wins) or `last` (rows win)."""
    both = state.withColumn("_n", F.lit(0)).unionByName(rows.withColumn("_n", F.lit(1)))
    how = {"min": F.min, "max": F.max, "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n")))}
    return both.groupBy(*keys).agg(*[how[r](c).alias(c) for c, r in rules.items()])


def insert_ignore(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key the state doesn't have, once each."""
    return rows.join(state.select(*keys), keys, "left_anti").dropDuplicates(keys)


def ensure_plans(plans: DataFrame, wanted: DataFrame, now: Column, manual: float = 1_000_000.0) -> DataFrame:
    """Plans after new priorities: one that is manual or leased keeps its own. plans: host_id, priority, locked_until; wanted: host_id, priority."""
    j = plans.join(wanted.select("host_id", F.col("priority").alias("_p")), "host_id", "full_outer")
    free = (F.col("priority") < manual) & (F.col("locked_until").isNull() | (F.col("locked_until") <= now))
    return j.select("host_id", F.when(F.col("priority").isNull(), F.col("_p")).when(free & F.col("_p").isNotNull(), F.col("_p")).otherwise(F.col("priority")).alias("priority"), "locked_until")


def best_confidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"))
