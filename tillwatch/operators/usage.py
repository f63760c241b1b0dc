"""Usage reports, anomaly detectors over usage logs, and canary hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Thresholds of the detectors."""

    window_hours: int = 24
    baseline_days: int = 14
    records_multiplier: float = 3.0
    records_min: int = 1000
    outside_share: float = 0.2
    outside_min: int = 20
    lookups_min: int = 300
    distinct_share: float = 0.9
    probes_min: int = 5
    network_min: int = 50
    critical_multiplier: float = 10.0
    critical_lookups: int = 3000


def network(ip: Column) -> Column:
    """The /16 of an IPv4 address, the /32 of an IPv6 one; null if it is neither."""
    v4 = F.when(ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), F.concat(F.substring_index(ip, ".", 2), F.lit(".0.0/16")))
    full = F.when(ip.rlike(r"(?i)^[0-9a-f]{1,4}:[0-9a-f]{1,4}:[0-9a-f:]*$"), F.concat(F.lower(F.substring_index(ip, ":", 2)), F.lit("::/32")))
    return F.coalesce(v4, full)


def summarise(usage: DataFrame, org_id, start: str, end: str) -> DataFrame:
    """Requests, records, addresses and errors by endpoint, by day and in total, in one pass of grouping sets: scope, key, ..."""
    at = lambda d: F.to_timestamp_ntz(F.lit(d))
    own = usage.where((F.col("org_id") == org_id) & (F.col("ts") >= at(start)) & (F.col("ts") < at(end))).select("endpoint", F.date_format("ts", "yyyy-MM-dd").alias("day"), "records", "ip", (F.get_json_object("params", "$.k") >= "40").alias("error"))
    sets = own.groupingSets([["endpoint"], ["day"], []], "endpoint", "day").agg(
        F.grouping("endpoint").alias("_e"), F.grouping("day").alias("_d"), F.count("*").alias("requests"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.countDistinct("ip").alias("addresses"), F.count_if("error").alias("errors"),
    )
    scope = F.when(F.col("_e") == 0, "endpoint").when(F.col("_d") == 0, "day").otherwise("total")
    return sets.select(scope.alias("scope"), F.coalesce("endpoint", "day", F.lit("")).alias("key"), "requests", "records", "addresses", "errors")


def detect(usage: DataFrame, now: Column, s: Limits = Limits(), lookup: str = "lookup") -> DataFrame:
    """Findings of all organisations: org_id, detector, severity, value, reference.

    usage: org_id, id, ts, endpoint, records, ip, denial, domain, request_id. One grouped pass gives the counts of all
    detectors but the one for networks, which is an anti join of recent against known networks.
    """
    hours, days = F.expr(f"INTERVAL {s.window_hours} HOURS"), F.expr(f"INTERVAL {s.baseline_days} DAYS")
    since = now - hours
    at = F.col("ts")
    fresh, base = (at >= since) & (at < now), (at >= since - days) & (at < since)
    looked = fresh & (F.col("endpoint") == lookup)
    one = usage.where((at >= since - days) & (at < now)).groupBy("org_id").agg(
        F.count_if(fresh).alias("requests"), F.count_if(fresh & (F.col("denial") == "outside_segment")).alias("outside"),
        F.sum(F.when(fresh, F.col("records")).otherwise(0)).alias("records"), F.sum(F.when(base, F.col("records")).otherwise(0)).alias("base"),
        F.count_if(looked).alias("lookups"), F.countDistinct(F.when(looked, F.coalesce("domain", "request_id", F.col("id").cast("string")))).alias("distinct"),
        F.count_if(fresh & (F.col("denial") == "field_profile_insufficient")).alias("probes"),
    )
    mean = F.greatest(F.col("base") / F.greatest(F.lit(1.0), F.lit(s.baseline_days * 24.0 / s.window_hours)), F.lit(1.0))
    entry = lambda name, severity, value, reference: F.struct(F.lit(name).alias("detector"), severity.alias("severity"), value.cast("double").alias("value"), reference.cast("double").alias("reference"))
    big = lambda on: F.when(on, "critical").otherwise("high")
    found = F.array_compact(F.array(
        F.when((F.col("requests") >= s.outside_min) & (F.col("outside") / F.col("requests") >= s.outside_share), entry("outside_segment", F.lit("medium"), F.col("outside"), F.col("requests"))),
        F.when((F.col("records") >= s.records_min) & (F.col("records") > s.records_multiplier * mean), entry("records_spike", big(F.col("records") / mean >= s.critical_multiplier), F.col("records"), mean)),
        F.when((F.col("lookups") >= s.lookups_min) & (F.col("distinct") / F.col("lookups") >= s.distinct_share), entry("enumeration", big(F.col("lookups") >= s.critical_lookups), F.col("lookups"), F.col("distinct"))),
        F.when(F.col("probes") >= s.probes_min, entry("field_probing", F.lit("medium"), F.col("probes"), F.lit(0))),
    ))
    counted = one.select("org_id", F.explode(found).alias("f")).select("org_id", "f.*")
    nets = usage.withColumn("net", network(F.col("ip"))).where("net is not null")
    known = nets.where((at >= now - F.expr("INTERVAL 30 DAYS")) & (at < since)).select("org_id", "net").distinct()
    loud = nets.where(fresh).join(known, ["org_id", "net"], "left_anti").join(known.select("org_id").distinct(), "org_id", "left_semi").groupBy("org_id", "net").agg(F.count("*").alias("n")).where(F.col("n") >= s.network_min)
    networks = loud.groupBy("org_id").agg(F.lit("new_network").alias("detector"), F.lit("low").alias("severity"), F.sum("n").cast("double").alias("value"), F.count("*").cast("double").alias("reference"))
    return counted.unionByName(networks)


_SEVERITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def merge_incidents(open_: DataFrame, found: DataFrame) -> DataFrame:
    """One open incident per organisation and detector; severity only rises, and `restricted` once it is critical."""
    rank = lambda c: F.element_at(F.create_map(*[x for k, v in _SEVERITY.items() for x in (F.lit(k), F.lit(v))]), c)
    both = open_.select("org_id", "detector", "severity", F.lit(0).alias("new")).unionByName(found.select("org_id", "detector", "severity", F.lit(1).alias("new")))
    out = both.groupBy("org_id", "detector").agg(F.max_by("severity", rank(F.col("severity"))).alias("severity"), F.sum("new").alias("hits"), F.min("new").alias("_new"))
    return out.select("org_id", "detector", "severity", "hits", (F.col("severity") == "critical").alias("restricted"), (F.col("_new") == 1).alias("opened"))


def canary_hits(lines: DataFrame, canaries: DataFrame, zone: str, line: str = "line") -> DataFrame:
    """Hits of canary names under `zone` in log lines `<time> <name> [source] [detail]`, joined to the exports that carry them."""
    parts = F.split(F.trim(line), r"\s+", 4)
    name = F.lower(F.rtrim(F.try_element_at(parts, F.lit(2)), F.lit(".")))
    label = F.regexp_extract(name, rf"([^.]+)\.{zone.replace('.', chr(92) + '.')}$", 1)
    at = F.try_to_timestamp(F.regexp_replace(F.try_element_at(parts, F.lit(1)), "Z$", "+00:00"))
    hits = lines.where(~F.trim(line).startswith("#")).select(at.alias("ts"), F.concat(label, F.lit("." + zone)).alias("domain"), F.try_element_at(parts, F.lit(3)).alias("source"), F.try_element_at(parts, F.lit(4)).alias("detail"), (label != "").alias("ok"))
    return hits.where("ok and ts is not null").drop("ok").join(canaries, "domain")


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """The keyed SHA-256 digest of a text, as lower-case hexadecimal digits, computed in the JVM; the secret's two pads are constants."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))), 256)


def screening_hits(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, verdicts) of screening responses (org_id, query, body as JSON).

    Hits: org_id, place, query, entity_id, caption, score, match, by score descending, then query, then id. Verdicts:
    match if a hit says so, potential_match with others, clear without any. A response whose status isn't 200 gives `failed`.
    """
    shape = "status int, results array<struct<id:string,caption:string,score:double,match:boolean>>"
    doc = responses.select("org_id", "query", F.from_json("body", shape).alias("d"))
    each = doc.select("org_id", "query", F.explode("d.results").alias("r")).select("org_id", "query", F.coalesce("r.id", F.lit("")).alias("entity_id"), F.coalesce("r.caption", F.lit("")).alias("caption"), F.bround(F.coalesce("r.score", F.lit(0.0)), 4).alias("score"), F.coalesce("r.match", F.lit(False)).alias("match"))
    order = Window.partitionBy("org_id").orderBy(F.desc("score"), "query", "entity_id")
    counted = doc.groupBy("org_id").agg(F.bool_or(F.coalesce("d.status", F.lit(200)) != 200).alias("bad"), F.bool_or(F.exists("d.results", lambda r: F.coalesce(r["match"], F.lit(False)))).alias("match"), F.sum(F.coalesce(F.size("d.results"), F.lit(0))).alias("n"))
    verdict = F.when(F.col("bad"), "failed").when(F.col("match"), "match").when(F.col("n") > 0, "potential_match").otherwise("clear")
    return each.withColumn("place", F.row_number().over(order)), counted.select("org_id", verdict.alias("verdict"))


def canary_incidents(hits: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canaries with hits and last hit, incidents) after hits: one of high severity per organisation, merged into what is open.

    hits: domain, org_id, ts, kind; open_: org_id, detector, severity. Counters have domain, hits, last_hit_at.
    """
    counted = hits.groupBy("domain").agg(F.count("*").alias("hits"), F.max("ts").alias("last_hit_at"))
    found = hits.select("org_id", F.lit("canary_hit").alias("detector"), F.lit("high").alias("severity"))
    return counted, merge_incidents(open_, found)


def chain_breaks(log: DataFrame, by: list[str], order: list[str], payload: Column) -> DataFrame:
    """Rows of a hash chain whose hash isn't that of the hash before and their payload. log: ..., row_hash."""
    before = F.coalesce(F.lag("row_hash").over(Window.partitionBy(*by).orderBy(*order)), F.lit(""))
    return log.withColumn("expected", F.sha2(F.concat(before, payload).cast("binary"), 256)).where(F.col("expected") != F.col("row_hash"))
