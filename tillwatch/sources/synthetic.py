"""Seeded test data of any size: every column is a function of the row's number and the seed, so tasks need no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(salt: str, seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of salt, seed and keys."""
    text = F.concat_ws(":", F.lit(salt), F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def zipf(n: int, exponent: float = 1.0) -> list[float]:
    """Cumulative shares of n places under Zipf's law."""
    weights = [1 / (k + 1) ** exponent for k in range(n)]
    total, out = sum(weights), []
    for w in weights:
        out.append((out[-1] if out else 0.0) + w / total)
    return out


def pick(u: Column, options: list[str], exponent: float = 1.0) -> Column:
    """One of some options, the first ones most often."""
    below = [F.when(u >= c, 1).otherwise(0) for c in zipf(len(options), exponent)[:-1]]
    at = F.lit(1)
    for b in below:
        at = at + b
    return F.element_at(F.array(*[F.lit(o) for o in options]), at)


def stores(spark: SparkSession, n: int, seed: int, countries: list[str], platforms: list[str], parts: int | None = None) -> DataFrame:
    """n stores: host_id, domain, country, platform, traffic_rank (for two in three)."""
    return twins(spark.range(0, n, 1, parts) if parts else spark.range(n), "id", seed, countries, platforms)


def twins(rows: DataFrame, key: str, seed: int, countries: list[str], platforms: list[str]) -> DataFrame:
    """A made-up store for each row of a table, by its key: as many as there are real ones, with nothing of theirs."""
    i = F.col(key)
    ranked = F.when(unit("ranked", seed, i) < 2 / 3, F.floor(unit("rank", seed, i) * 1_000_000).cast("bigint") + 1)
    return rows.select(i.alias("host_id"), F.concat(F.lit("shop-"), i.cast("string"), F.lit(".example")).alias("domain"), pick(unit("country", seed, i), countries).alias("country"), pick(unit("platform", seed, i), platforms).alias("platform"), ranked.alias("traffic_rank"))


def providers(of: DataFrame, seed: int, names: list[str], most: int = 3) -> DataFrame:
    """One to `most` distinct providers of each store: host_id, provider_id."""
    draws = F.floor(unit("many", seed, F.col("host_id")) * most).cast("int") + 1
    each = of.select("host_id", F.explode(F.sequence(F.lit(1), draws)).alias("k"))
    return each.select("host_id", pick(unit("provider", seed, F.col("host_id"), F.col("k")), names).alias("provider_id")).distinct()
