"""Who may see what: visibility, opt-out, segments, field profiles and quotas, as columns and joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import in_networks

#: Fields that only the full profile has.
FULL_ONLY = frozenset({"evidence", "psp_hosts", "recent_changes", "confidence_score", "rule_ids", "traffic_rank"})


def client_visible(stores: DataFrame, sources: DataFrame, optouts: DataFrame | None = None) -> DataFrame:
    """Stores that are not opted out and have some source that may be shown. Opt-outs: a flag, or a verified request."""
    shown = sources.where(F.col("source") != "czds").select("host_id")
    out = stores.where(~F.coalesce("optout", F.lit(False))).join(shown, "host_id", "left_semi")
    if optouts is not None:
        out = out.join(optouts.where("verified_at is not null").select("domain"), "domain", "left_anti")
    return out


def czds_only(sources: DataFrame) -> DataFrame:
    """Hosts all of whose sources are zone files."""
    return sources.groupBy("host_id").agg(F.bool_and(F.col("source") == "czds").alias("only")).where("only").select("host_id")


@dataclass(frozen=True)
class Segment:
    """What a contract covers; an empty set covers all."""

    countries: frozenset[str] = frozenset()
    platforms: frozenset[str] = frozenset()

    def clause(self, country: Column | None = None, platform: Column | None = None) -> Column:
        country = F.col("country") if country is None else country
        platform = F.col("platform") if platform is None else platform
        out = F.lit(True)
        if self.countries:
            out &= country.isin(sorted(self.countries))
        if self.platforms:
            out &= platform.isin(sorted(self.platforms))
        return out

    def narrowed(self, countries: tuple[str, ...] = (), platforms: tuple[str, ...] = ()) -> Segment:
        """The segment within a request; a request outside the contract is an error."""
        for asked, held in ((countries, self.countries), (platforms, self.platforms)):
            if held and (extra := set(asked) - held):
                raise PermissionError(f"outside the contracted segment: {', '.join(sorted(extra))}")
        return Segment(frozenset(countries) or self.countries, frozenset(platforms) or self.platforms)


def with_profile(df: DataFrame, full: bool) -> DataFrame:
    """Drop the fields that a basic profile doesn't have."""
    return df if full else df.select(*[c for c in df.columns if c not in FULL_ONLY])


def over_rate(usage: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Fixed windows in which an organisation made more than `limit` requests: org_id, window, n, over, retry_after."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return usage.groupBy("org_id", F.floor(at / window_seconds).alias("window")).agg(F.count("*").alias("n"), (F.lit(window_seconds) - F.max(at) % window_seconds).alias("retry_after")).where(F.col("n") > limit)


def quota_state(usage: DataFrame, now: str, daily: int, monthly: int) -> DataFrame:
    """Records used today and this month per organisation, and whether a quota is spent."""
    at = F.to_timestamp_ntz(F.lit(now))
    month = usage.where((F.col("ts") >= F.trunc(at, "month").cast("timestamp_ntz")) & (F.col("ts") < at))
    today = F.when(F.col("ts") >= F.to_date(at).cast("timestamp_ntz"), F.col("records")).otherwise(0)
    used = month.groupBy("org_id").agg(F.coalesce(F.sum(today), F.lit(0)).alias("today"), F.coalesce(F.sum("records"), F.lit(0)).alias("month"))
    return used.withColumn("spent", (F.col("today") >= daily) | (F.col("month") >= monthly))


def ip_allowed(requests: DataFrame, networks: DataFrame) -> DataFrame:
    """Requests (org_id, ip) with `allowed`: true without entries (org_id, cidr) of the organisation, false for a null or bad address.

    Entries are addresses or networks of either family; bad ones are skipped, but an organisation that has only such allows nobody.
    """
    hits = in_networks(requests, networks, by=("org_id",)).withColumn("_hit", F.lit(True))
    held = networks.select("org_id").distinct().withColumn("_held", F.lit(True))
    out = requests.join(hits, ["org_id", "ip"], "left").join(held, "org_id", "left")
    return out.withColumn("allowed", F.col("_held").isNull() | F.coalesce("_hit", F.lit(False))).drop("_hit", "_held")
