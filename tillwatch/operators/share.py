"""Market share by country and platform, with small cells withheld."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson
from ..session import dealt

CELL = ("country", "platform")


def same_cell(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = CELL, how: str = "inner") -> DataFrame:
    """Join on cell keys, nulls equal; the keys of `a` stay."""
    right = b.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in b.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = a
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return joined.join(right, condition, how).drop(*[f"_{k}" for k in keys])


def cell_totals(stores: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    return stores.groupBy(*keys).agg(F.countDistinct("host_id").alias("total"))


def _members(stores: DataFrame, providers: DataFrame, keys: tuple[str, ...], *more: Column) -> DataFrame:
    """Distinct rows of host, cell and provider, dealt out by host to tasks of a bounded size."""
    held = providers.select("host_id", F.col("provider_id").cast("string").alias("provider_id"), *more)
    own, held = dealt("host_id", stores.select("host_id", *keys), held)
    return own.join(held, "host_id").distinct()


def _counted(member: DataFrame, slice_: tuple[str, ...], min_cell: int) -> DataFrame:
    """slice_, provider_id, stores of distinct members. Providers of fewer than `min_cell` are told by the counts; only their
    members, fewer than `min_cell` each, are looked at again. An inner join keeps to the distinct members, where a semi join would
    be moved below them and have all computed anew."""
    pair = [*slice_, "provider_id"]
    counts = member.groupBy(*pair).agg(F.count("*").alias("stores"))
    small = counts.where(F.col("stores") < min_cell).select(*[F.col(c).alias(f"_{c}") for c in pair])
    same = F.lit(True)
    for c in pair:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    other = member.join(small, same).groupBy(*slice_).agg(F.countDistinct("host_id").alias("stores"))
    columns = [*pair, "stores"]
    return counts.where(F.col("stores") >= min_cell).select(*columns).unionByName(other.withColumn("provider_id", F.lit("other")).select(*columns))


def market_share(stores: DataFrame, providers: DataFrame, min_cell: int, role: str | None = None, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Cell keys, provider_id (as text), stores, total, share and its interval.

    Cells of fewer than `min_cell` stores are withheld. Providers of fewer are merged into `other`, which counts the
    distinct stores with any such provider. Membership is shuffled once; both aggregations read that exchange.
    """
    totals = cell_totals(stores, keys).where(F.col("total") >= min_cell)
    held = providers if role is None else providers.where(F.col("role") == role)
    rows = same_cell(_counted(_members(stores, held, keys), keys, min_cell), totals, keys)
    low, high = wilson(F.col("stores"), F.col("total"))
    return rows.select(*keys, "provider_id", "stores", "total", (F.col("stores") / F.col("total")).alias("share"), low.alias("lo"), high.alias("hi"))


def snapshot(stores: DataFrame, providers: DataFrame, min_cell: int, keys: tuple[str, ...] = CELL) -> DataFrame:
    """All cells of all roles and of any role (null), with `other` frozen at `min_cell`, and a totals row per cell (provider null).

    Role slices come from one explode and one aggregation, not a pass per role.
    """
    slice_ = (*keys, "role")
    member = _members(stores, providers, keys, F.explode(F.array(F.col("role"), F.lit(None).cast("string"))).alias("role"))
    totals = cell_totals(stores, keys).select(*keys, F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("provider_id"), F.col("total").alias("stores"))
    return _counted(member, slice_, min_cell).unionByName(totals.select(*slice_, "provider_id", "stores"))


def from_snapshot(cells: DataFrame, min_cell: int, role: str | None = None, condition: Column | None = None, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Market share read off a snapshot: the rows of `market_share`, without touching membership."""
    cells = cells if condition is None else cells.where(condition)
    totals = cells.where("provider_id is null").select(*keys, F.col("stores").alias("total")).where(F.col("total") >= min_cell)
    rows = same_cell(cells.where(F.col("provider_id").isNotNull() & F.col("role").eqNullSafe(F.lit(role))).select(*keys, "provider_id", "stores"), totals, keys)
    low, high = wilson(F.col("stores"), F.col("total"))
    return rows.select(*keys, "provider_id", "stores", "total", (F.col("stores") / F.col("total")).alias("share"), low.alias("lo"), high.alias("hi"))


def top_per_cell(shares: DataFrame, top: int = 5, keys: tuple[str, ...] = CELL) -> DataFrame:
    """The `top` named providers of each cell, and its `other` row last: adds `place`."""
    named = F.col("provider_id") == "other"
    order = Window.partitionBy(*keys).orderBy(named.asc(), F.desc("stores"), "provider_id")
    placed = shares.withColumn("place", F.row_number().over(order))
    return placed.where((F.col("place") <= top) | named)
