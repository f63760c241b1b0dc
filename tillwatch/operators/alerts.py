"""Alert rules matched to events, digests, retries and delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import confidence_rank


def match(events: DataFrame, rules: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """Deliveries due: rule_id, event_id.

    events: id, host_id, event_type, entity_id, detected_at, country, platform, domain, confidence. rules: rule_id,
    created_at, event_types, entities, countries, platforms, domains (arrays; empty: any), min_confidence, enabled.
    Rules join to events by their event type, exploded, so only pairs of one type meet. A missing confidence is high, as
    that of a removed row. Events older than the rule don't count; what was delivered isn't again.
    """
    each = rules.where("enabled").withColumn("event_type", F.explode("event_types"))
    allows = lambda list_, value: (F.size(list_) == 0) | F.coalesce(F.array_contains(list_, value), F.lit(False))
    on = (F.col("detected_at") >= F.col("created_at")) & allows("entities", F.col("entity_id")) & allows("countries", F.col("country")) & allows("platforms", F.col("platform")) & allows("domains", F.col("domain"))
    on &= F.col("min_confidence").isNull() | (confidence_rank(F.coalesce("confidence", F.lit("high"))) >= confidence_rank(F.col("min_confidence")))
    found = events.join(each, "event_type").where(on).select("rule_id", F.col("id").alias("event_id"))
    return found if delivered is None else found.join(delivered.select("rule_id", "event_id"), ["rule_id", "event_id"], "left_anti")


def digests(deliveries: DataFrame, rules: DataFrame, now: Column, hour: int = 7) -> DataFrame:
    """Payloads per rule for the digests that are due: daily ones at the hour, weekly ones on Monday at the hour."""
    due = (F.hour(now) == hour) & ((F.col("mode") == "daily") | ((F.col("mode") == "weekly") & (F.dayofweek(now) == 2)))
    return deliveries.join(rules.select("rule_id", "mode"), "rule_id").where(due).groupBy("rule_id").agg(F.sort_array(F.collect_list("event_id")).alias("events"), F.count("*").alias("n"))


def retry(deliveries: DataFrame, ladder: tuple[float, ...] = (1.0, 3.0, 7.0, 13.0)) -> DataFrame:
    """After a failure, deliveries (attempts so far) wait by the ladder; the fifth failure is final."""
    steps = F.array(*[F.lit(h) for h in ladder])
    attempts = F.col("attempts") + 1
    spent = attempts > len(ladder)
    return deliveries.withColumn("status", F.when(spent, "failed").otherwise("pending")).withColumn("wait_hours", F.when(~spent, F.element_at(steps, F.least(attempts, F.lit(len(ladder))).cast("int")))).withColumn("attempts", attempts)


def scan_to_alert(deliveries: DataFrame) -> DataFrame:
    """Seconds from the end of a scan (or its event) to delivery, never below zero: adds `seconds`."""
    began = F.unix_seconds(F.coalesce("finished_at", "detected_at").cast("timestamp"))
    return deliveries.withColumn("seconds", F.greatest(F.lit(0), F.unix_seconds(F.col("sent_at").cast("timestamp")) - began))
