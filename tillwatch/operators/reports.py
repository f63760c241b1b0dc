"""Report aggregates: shares whose small rows are summed, flows, monthly courses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PSP_ROLES
from ..session import dealt


def cell_label(country: Column | None = None, platform: Column | None = None) -> Column:
    """Country and platform with a bar between; `??` and `unknown` stand for null."""
    country = F.col("country") if country is None else country
    platform = F.col("platform") if platform is None else platform
    return F.concat(F.coalesce(country, F.lit("??")), F.lit("|"), F.coalesce(platform, F.lit("unknown")))


def suppressed(rows: DataFrame, stores: DataFrame, key: str, min_cell: int) -> DataFrame:
    """cell, key, n, total of membership `rows` (host_id, key, distinct): small cells go, small keys are summed into `other`."""
    labelled = stores.select("host_id", cell_label().alias("cell"))
    totals = labelled.groupBy("cell").agg(F.countDistinct("host_id").alias("total")).where(F.col("total") >= min_cell)
    counts = labelled.join(rows.select("host_id", F.col(key).cast("string").alias(key)).distinct(), "host_id").groupBy("cell", key).agg(F.count("*").alias("n"))
    merged = counts.groupBy("cell", F.when(F.col("n") < min_cell, F.lit("other")).otherwise(F.col(key)).alias(key)).agg(F.sum("n").alias("n"))
    return merged.join(totals, "cell")


def withheld_cells(stores: DataFrame, min_cell: int) -> DataFrame:
    """How many cells there are, and how many a report withholds."""
    return stores.groupBy(cell_label().alias("cell")).agg(F.countDistinct("host_id").alias("n")).agg(F.count("*").alias("cells"), F.count_if(F.col("n") < min_cell).alias("withheld"), F.sum("n").alias("stores"))


def psp_share(stores: DataFrame, providers: DataFrame, min_cell: int, roles: tuple[str, ...] = PSP_ROLES) -> DataFrame:
    return suppressed(providers.where(F.col("role").isin(*roles)), stores, "provider_id", min_cell)


def method_share(stores: DataFrame, methods: DataFrame, min_cell: int) -> DataFrame:
    return suppressed(methods, stores, "method_id", min_cell)


def bnpl_share(stores: DataFrame, providers: DataFrame, methods: DataFrame, min_cell: int, role: str = "bnpl", kind: str = "bnpl") -> DataFrame:
    """Stores with a pay-later method or provider, once each: cell, n, total."""
    some = methods.where(F.col("method_type") == kind).select("host_id").union(providers.where(F.col("role") == role).select("host_id")).distinct()
    labelled = stores.select("host_id", cell_label().alias("cell")).join(some.withColumn("has", F.lit(1)), "host_id", "left")
    return labelled.groupBy("cell").agg(F.count("has").alias("n"), F.count("*").alias("total")).where(F.col("total") >= min_cell)


def providers_per_store(stores: DataFrame, providers: DataFrame, min_cell: int) -> DataFrame:
    """Mean number of providers, stores without any included: cell, mean, total."""
    counted = stores.select("host_id", cell_label().alias("cell")).join(providers.groupBy("host_id").agg(F.countDistinct("provider_id").alias("n")), "host_id", "left")
    out = counted.groupBy("cell").agg((F.sum(F.coalesce("n", F.lit(0))) / F.count("*")).alias("mean"), F.count("*").alias("total"))
    return out.where(F.col("total") >= min_cell)


def flows(events: DataFrame, min_n: int) -> DataFrame:
    """Stores that dropped one provider and took up another in the period: removed, added, stores."""
    of = lambda kind, name: events.where(F.col("event_type") == kind).select("host_id", F.col("entity_id").alias(name)).distinct()
    pairs = of("provider_removed", "removed").join(of("provider_added", "added"), "host_id").where("removed <> added")
    return pairs.groupBy("removed", "added").agg(F.countDistinct("host_id").alias("stores")).where(F.col("stores") >= min_n)


def monthly_cumulative(stores: DataFrame, providers: DataFrame) -> DataFrame:
    """Stores first seen with a provider up to each month, carried over months without news: month, provider_id, stores."""
    own, held = dealt("host_id", stores.select("host_id"), providers.select("host_id", "provider_id", F.date_format("first_seen", "yyyy-MM").alias("month")))
    first = own.join(held, "host_id")
    news = first.groupBy("provider_id", "month").agg(F.countDistinct("host_id").alias("n"))
    order = Window.partitionBy("provider_id").orderBy("month")
    known = news.withColumn("upto", F.sum("n").over(order)).withColumn("next", F.lead("month").over(order))
    months = first.select(F.col("month").alias("m")).distinct()
    # each month of the calendar falls to the last news at or before it; the calendar is as long as the history has months
    calendar = F.broadcast(months.groupBy().agg(F.sort_array(F.collect_set("m")).alias("all")))
    spread = known.join(calendar).withColumn("m", F.explode(F.filter("all", lambda x: (x >= F.col("month")) & (F.col("next").isNull() | (x < F.col("next"))))))
    return spread.select(F.col("m").alias("month"), "provider_id", F.col("upto").alias("stores"))


def monthly_state(observations: DataFrame, keys: list[str], ts: str = "first_seen") -> DataFrame:
    """Mergeable distinct-host state per month and keys: month, keys, state (a sketch)."""
    return observations.groupBy(F.date_format(ts, "yyyyMM").alias("month"), *keys).agg(F.hll_sketch_agg("host_id").alias("state"))


def merged_state(state: DataFrame, keys: list[str]) -> DataFrame:
    """Approximate distinct hosts of merged states."""
    return state.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias("hosts"))


def monthly_exact(observations: DataFrame, keys: list[str], ts: str = "first_seen") -> DataFrame:
    """The exact twin of `monthly_state`."""
    return observations.groupBy(F.date_format(ts, "yyyyMM").alias("month"), *keys).agg(F.countDistinct("host_id").alias("hosts"))
