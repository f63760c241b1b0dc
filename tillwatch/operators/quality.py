"""Evaluation against gold labels, dashboards, stop reviews and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import order_statistics


def ratio(a: Column, b: Column) -> Column:
    """a / b, null without b."""
    return F.when(b != 0, a / b)


def confusion(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 by columns of both inputs.

    gold: host_id, entity_type, entity_id, present; predicted: host_id, entity_type, entity_id. A prediction counts
    against only on hosts that gold has any label of its type for, negative ones included.
    """
    key = ["host_id", "entity_type", "entity_id"]
    labelled = gold.select("host_id", "entity_type").distinct()
    truth = gold.where("present").select(*key).distinct().withColumn("t", F.lit(1))
    said = predicted.join(labelled, ["host_id", "entity_type"], "left_semi").select(*key).distinct().withColumn("p", F.lit(1))
    both = truth.join(said, key, "full_outer")
    n = lambda c: F.count_if(c)
    counted = both.groupBy(*by).agg(n(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), n(F.col("t").isNull()).alias("fp"), n(F.col("p").isNull()).alias("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    counted = counted.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    return counted.withColumn("f1", F.when(p.isNotNull() & r.isNotNull() & (p + r > 0), 2 * p * r / (p + r)))


def per_rule(firings: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn of each rule (rule_id, host_id, entity_id): fn are positives of its target where it didn't fire."""
    fired = firings.select("rule_id", "host_id", "entity_id").distinct()
    truth = gold.where("present").select("host_id", "entity_id").distinct()
    labelled = gold.select("host_id").distinct()
    hits = fired.join(labelled, "host_id", "left_semi").join(truth.withColumn("t", F.lit(1)), ["host_id", "entity_id"], "left")
    counted = hits.groupBy("rule_id", "entity_id").agg(F.count("t").alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"))
    positives = truth.groupBy("entity_id").agg(F.count("*").alias("all"))
    return counted.join(positives, "entity_id", "left").select("rule_id", "entity_id", "tp", "fp", (F.coalesce("all", F.lit(0)) - F.col("tp")).alias("fn"))


def gate(counts: DataFrame, targets: dict[str, float], value: str = "precision") -> DataFrame:
    """Whether each entity type reaches its target; a missing value passes."""
    pairs = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))])
    target = F.try_element_at(pairs, F.col("entity_type"))
    return counts.withColumn("target", target).withColumn("passed", F.coalesce(F.col(value) >= target, F.lit(True)))


def walk_outcomes(walks: DataFrame, group: str = "platform") -> DataFrame:
    """Shares of walks by platform and overall (`all`), from one rollup; an empty platform is `(none)`.

    walks: platform, to_checkout, to_payment, blocked (booleans).
    """
    named = walks.withColumn(group, F.when(F.coalesce(group, F.lit("")) == "", "(none)").otherwise(F.col(group)))
    share = lambda c: (F.count_if(c) / F.count("*")).alias(c)
    rolled = named.rollup(group).agg(F.grouping(group).alias("_all"), F.count("*").alias("walks"), share("to_checkout"), share("to_payment"), share("blocked"))
    return rolled.withColumn(group, F.when(F.col("_all") == 1, "all").otherwise(F.col(group))).drop("_all")


def freshness(stores: DataFrame, now: Column, light_days: float, checkout_days: float) -> DataFrame:
    """Median age, stale share and never-scanned count of either scan, in one row. stores: light_at, checkout_at, watched."""
    out, medians = [], []
    for name, limit in (("light", light_days), ("checkout", checkout_days)):
        age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(f"{name}_at").cast("timestamp"))) / 86400
        medians.append(order_statistics(stores, age, {f"{name}_median": 0.5}, between=True))
        out += [ratio(F.count_if(age > limit), F.count(age)).alias(f"{name}_stale"), F.count_if(age.isNull()).alias(f"{name}_never")]
    one = stores.agg(*out)
    for m in medians:
        one = one.join(F.broadcast(m), how="left")  # one row each
    return one


def watchlist_stale(stores: DataFrame, now: Column, days: float) -> DataFrame:
    """Stale share of watched stores; 1 if there are some and none was ever scanned."""
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("checkout_at").cast("timestamp"))) / 86400
    some = stores.where("watched").agg(F.count("*").alias("n"), F.count(age).alias("scanned"), F.count_if(age > days).alias("late"))
    return some.select("n", F.when((F.col("n") > 0) & (F.col("scanned") == 0), 1.0).otherwise(ratio(F.col("late"), F.col("scanned"))).alias("stale"))


def daily_spikes(events: DataFrame, last_day: str, days: int, multiplier: float = 3.0, least: int = 5, lead: int = 8) -> DataFrame:
    """Events a day over a calendar without gaps, the mean of the seven days before, and whether the day is a spike.

    The calendar begins `lead` days early so that the first day has its week. Always seven days count, at least one event a day is taken as the mean.
    """
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last_day).cast("date"), days + lead - 1), F.lit(last_day).cast("date"))).alias("day"))
    counted = events.groupBy(F.to_date("detected_at").alias("day")).agg(F.count("*").alias("n"))
    filled = spine.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.unix_date("day").alias("k"))
    week = Window.orderBy("k").rangeBetween(-7, -1)  # a calendar of days + lead rows
    mean = F.coalesce(F.sum("n").over(week), F.lit(0)) / 7
    out = filled.withColumn("mean7", mean)
    out = out.withColumn("spike", (F.col("n") >= least) & (F.col("n") >= multiplier * F.greatest(F.col("mean7"), F.lit(1.0))))
    return out.where(F.col("day") > F.date_sub(F.lit(last_day).cast("date"), days)).drop("k")


def removed_spikes(events: DataFrame, now: Column, multiplier: float = 3.0, least: int = 5) -> DataFrame:
    """Providers whose removals of the last day exceed thrice the mean of the seven days before: one conditional pass."""
    day = F.expr("INTERVAL 24 HOURS")
    at = F.col("detected_at")
    removed = events.where((F.col("event_type") == "provider_removed") & (at < now) & (at >= now - F.expr("INTERVAL 8 DAYS")))
    out = removed.groupBy("entity_id").agg(F.count_if(at >= now - day).alias("today"), (F.count_if(at < now - day) / 7).alias("mean7"))
    return out.where((F.col("today") >= least) & (F.col("today") > multiplier * F.greatest(F.col("mean7"), F.lit(1.0))))


def with_share(df: DataFrame, count: str = "n", within: list[str] | None = None) -> DataFrame:
    """Adds each row's share of the sum within columns (of all, without)."""
    if within:
        return df.withColumn("share", F.col(count) / F.sum(count).over(Window.partitionBy(*within)))
    return df.join(F.broadcast(df.agg(F.sum(count).alias("_all")))).withColumn("share", F.col(count) / F.col("_all")).drop("_all")  # one row


def stop_distribution(stops: DataFrame) -> DataFrame:
    """Stops by platform, step, reason: n and share of all."""
    return with_share(stops.groupBy("platform", "step", "reason").agg(F.count("*").alias("n")))


def stop_marginals(stops: DataFrame) -> DataFrame:
    """Stops by reason, by step and by platform in one pass: dimension, value, n, share."""
    text = stops.select(F.col("reason").cast("string").alias("reason"), F.col("step").cast("string").alias("step"), F.col("platform").cast("string").alias("platform"))
    each = text.select(F.explode(F.create_map(*[x for c in ("reason", "step", "platform") for x in (F.lit(c), F.col(c))])).alias("dimension", "value"))
    return with_share(each.groupBy("dimension", "value").agg(F.count("*").alias("n")), within=["dimension"])


def week_start(day: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def weekly_trend(stops: DataFrame) -> DataFrame:
    """Stops by week (from Sunday) and reason, with the share within the week."""
    return with_share(stops.groupBy(week_start(F.to_date("scan_ts")).alias("week"), "reason").agg(F.count("*").alias("n")), within=["week"])


def release_comparison(stops: DataFrame, version: str) -> DataFrame:
    """Reason shares by version, in the order in which versions were first seen."""
    counted = stops.groupBy(F.col(version).alias("version"), "reason").agg(F.count("*").alias("n"), F.min("scan_ts").alias("first"))
    each = Window.partitionBy("version")
    seen = counted.withColumn("share", F.col("n") / F.sum("n").over(each)).withColumn("seen", F.min("first").over(each))
    order = seen.groupBy("version").agg(F.min("seen").alias("s"))
    placed = order.withColumn("place", F.row_number().over(Window.orderBy("s", "version")))  # one row a version
    return seen.join(placed.select("version", "place"), "version").select("version", "place", "reason", "n", "share")


def stop_growth(stops: DataFrame, now: Column, delta: float = 0.05, least: int = 20) -> DataFrame:
    """Reasons whose share of a platform's stops grew by `delta` since the week before; platforms of fewer than `least` stops in either week are left out."""
    week = F.expr("INTERVAL 7 DAYS")
    at = F.col("scan_ts")
    recent = stops.where((at < now) & (at >= now - F.expr("INTERVAL 14 DAYS"))).withColumn("this", at >= now - week)
    counted = recent.groupBy("platform", "reason").agg(F.count_if("this").alias("b"), F.count_if(~F.col("this")).alias("a"))
    each = Window.partitionBy("platform")
    shares = counted.withColumn("tb", F.sum("b").over(each)).withColumn("ta", F.sum("a").over(each)).where((F.col("tb") >= least) & (F.col("ta") >= least))
    out = shares.select("platform", "reason", (F.col("a") / F.col("ta")).alias("before"), (F.col("b") / F.col("tb")).alias("after"))
    return out.where(F.col("after") - F.col("before") >= delta)


def breaches(metrics: DataFrame, limits: list[tuple[str, str, float]]) -> DataFrame:
    """Metrics (kind, subject, value, n) beyond a limit (kind, '<' or '>', bound)."""
    on = F.lit(False)
    for kind, way, bound in limits:
        on |= (F.col("kind") == kind) & (F.col("value") < bound if way == "<" else F.col("value") > bound)
    return metrics.where(on)


def new_alerts(found: DataFrame, open_: DataFrame) -> DataFrame:
    """Findings that no open alert of the same kind and subject covers."""
    return found.join(open_.select("kind", "subject"), ["kind", "subject"], "left_anti")


def review_queue(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """The least certain findings of two sources, by score, hostname, id."""
    return first.unionByName(second).orderBy("score", "hostname", "id").limit(limit)


def liveness(workers: DataFrame, now: Column, interval: int) -> DataFrame:
    """live within two intervals since the last beat, stale within ten, stopped beyond, or when it said so."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("beat").cast("timestamp"))
    state = F.when(F.col("stopped") | (age > 10 * interval), "stopped").when(age > 2 * interval, "stale").otherwise("live")
    return workers.withColumn("state", state)
