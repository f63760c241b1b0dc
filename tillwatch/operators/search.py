"""Filtered search over stores, keyset pages, and whole store documents."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import confidence_rank

#: Where stores without a rank sort.
NO_RANK = 2_147_483_647
SORTS = ("domain", "rank", "updated")


@dataclass(frozen=True)
class Filters:
    """What a search asks for. Lists that are empty don't restrict; `has_*` lists need every entry."""

    countries: tuple[str, ...] = ()
    platforms: tuple[str, ...] = ()
    has_providers: tuple = ()
    lacks_providers: tuple = ()
    roles: tuple[str, ...] = ()
    has_methods: tuple[str, ...] = ()
    min_providers: int | None = None
    max_providers: int | None = None
    min_confidence: str | None = None
    first_seen_from: str | None = None
    first_seen_to: str | None = None
    last_seen_from: str | None = None
    last_seen_to: str | None = None
    changed_from: str | None = None
    changed_to: str | None = None
    prefix: str | None = None
    contains: str | None = None


def _having(stores: DataFrame, rows: DataFrame, on: Column | None = None, how: str = "left_semi") -> DataFrame:
    return stores.join((rows if on is None else rows.where(on)).select("host_id"), "host_id", how)


def apply_filters(stores: DataFrame, f: Filters, providers: DataFrame, methods: DataFrame, events: DataFrame) -> DataFrame:
    """Stores that pass all filters. Existence tests are semi and anti joins; all seen-bounds hold on one provider row."""
    if f.countries:
        stores = stores.where(F.col("country").isin(*f.countries))
    if f.platforms:
        stores = stores.where(F.col("platform").isin(*f.platforms))
    if f.prefix is not None:
        stores = stores.where(F.lower("domain").like(f.prefix.replace("%", "").lower() + "%"))
    if f.contains is not None:
        stores = stores.where(F.col("domain").ilike(f"%{f.contains}%"))
    if f.has_providers:  # one grouped pass instead of a join per provider
        all_ = providers.where(F.col("provider_id").isin(*f.has_providers)).groupBy("host_id").agg(F.countDistinct("provider_id").alias("n"))
        stores = _having(stores, all_, F.col("n") == len(set(f.has_providers)))
    if f.lacks_providers:
        stores = _having(stores, providers, F.col("provider_id").isin(*f.lacks_providers), "left_anti")
    if f.roles:
        stores = _having(stores, providers, F.col("role").isin(*f.roles))
    if f.has_methods:
        all_ = methods.where(F.col("method_id").isin(*f.has_methods)).groupBy("host_id").agg(F.countDistinct("method_id").alias("n"))
        stores = _having(stores, all_, F.col("n") == len(set(f.has_methods)))
    if f.min_confidence is not None:
        rank = {"low": 0, "medium": 1, "high": 2}[f.min_confidence]
        stores = _having(stores, providers, confidence_rank(F.col("confidence")) >= rank)
    bounds = [(c, op, v) for c, op, v in (("first_seen", ">=", f.first_seen_from), ("first_seen", "<=", f.first_seen_to), ("last_seen", ">=", f.last_seen_from), ("last_seen", "<=", f.last_seen_to)) if v is not None]
    if bounds:
        on = F.lit(True)
        for c, op, v in bounds:
            at = F.to_timestamp_ntz(F.lit(v))
            on &= F.col(c) >= at if op == ">=" else F.col(c) <= at
        stores = _having(stores, providers, on)
    if f.changed_from is not None or f.changed_to is not None:
        on = F.lit(True)
        if f.changed_from is not None:
            on &= F.col("detected_at") >= F.to_timestamp_ntz(F.lit(f.changed_from))
        if f.changed_to is not None:
            on &= F.col("detected_at") < F.to_timestamp_ntz(F.lit(f.changed_to))
        stores = _having(stores, events, on)
    if f.min_providers is not None or f.max_providers is not None:
        counted = stores.join(providers.groupBy("host_id").agg(F.count("*").alias("_n")), "host_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
        if f.min_providers is not None:
            counted = counted.where(F.col("_n") >= f.min_providers)
        if f.max_providers is not None:
            counted = counted.where(F.col("_n") <= f.max_providers)
        stores = counted.drop("_n")
    return stores


def encode_cursor(sort: str, value, host_id: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"s": sort, "v": value, "h": host_id}, default=str).encode()).decode()


def decode_cursor(cursor: str, sort: str) -> tuple:
    """(value, host_id) of a cursor; one that was made for another order is an error."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        held, value, host = found["s"], found["v"], int(found["h"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("the cursor can't be read") from e
    if held != sort:
        raise ValueError("the cursor belongs to another order")
    return value, host


def page(stores: DataFrame, sort: str = "domain", cursor: str | None = None, limit: int = 100) -> DataFrame:
    """At most limit + 1 stores after the cursor: one more than a page tells whether there is another."""
    key, descending = {"domain": (F.col("domain"), False), "rank": (F.coalesce("traffic_rank", F.lit(NO_RANK)), False), "updated": (F.col("updated_at"), True)}[sort]
    if cursor is not None:
        value, host = decode_cursor(cursor, sort)
        at = F.lit(value).cast(stores.select(key.alias("k")).schema["k"].dataType)
        here, there = F.struct(key.alias("k"), F.col("host_id").alias("h")), F.struct(at.alias("k"), F.lit(host).cast(stores.schema["host_id"].dataType).alias("h"))
        stores = stores.where(here < there if descending else here > there)
    order = [key.desc(), F.col("host_id").desc()] if descending else [key.asc(), F.col("host_id").asc()]
    return stores.orderBy(*order).limit(limit + 1)


def feed(events: DataFrame, before_id: int | None = None, limit: int = 100) -> DataFrame:
    """The newest events by id, below an id."""
    return (events if before_id is None else events.where(F.col("id") < before_id)).orderBy(F.desc("id")).limit(limit + 1)


def recent_events(events: DataFrame, n: int = 10) -> DataFrame:
    """Each host's n latest events, by time then id."""
    order = Window.partitionBy("host_id").orderBy(F.desc("detected_at"), F.desc("id"))
    return events.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def latest_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def documents(stores: DataFrame, providers: DataFrame, methods: DataFrame, events: DataFrame, recent: int = 10) -> DataFrame:
    """Stores with their providers, methods and latest events as ordered arrays; each child is gathered once by host."""
    entry = F.struct("provider_id", "role", "confidence")
    p = providers.groupBy("host_id").agg(F.sort_array(F.collect_list(entry)).alias("providers"))
    m = methods.groupBy("host_id").agg(F.sort_array(F.collect_set("method_id")).alias("methods"))
    e = recent_events(events, recent).groupBy("host_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "id", "event_type", "entity_id"))), lambda x: x.dropFields("rn")).alias("recent_changes"))
    out = stores.join(p, "host_id", "left").join(m, "host_id", "left").join(e, "host_id", "left")
    empty = lambda df, c: F.array().cast(df.schema[c].dataType)
    return out.withColumns({"providers": F.coalesce("providers", empty(p, "providers")), "methods": F.coalesce("methods", empty(m, "methods")), "recent_changes": F.coalesce("recent_changes", empty(e, "recent_changes"))})


@dataclass(frozen=True)
class SearchRequest:
    """A whole request: filters, order, cursor, page size and field profile."""

    filters: Filters = field(default_factory=Filters)
    sort: str = "domain"
    cursor: str | None = None
    limit: int = 100
    full: bool = False


def search(views, request: SearchRequest, segment=None) -> DataFrame:
    """Visible stores of a segment that pass the filters, one page, as documents of the profile.

    Filters on a store's own columns come before its visibility, so sources are looked up for few. The page is fetched first, in one job: at most
    limit + 1 rows. Their ids then filter the children's scans.
    """
    from .visibility import Segment, with_profile

    held = (segment or Segment()).narrowed(request.filters.countries, request.filters.platforms)
    stores = apply_filters(views.visible.where(held.clause()), request.filters, views.providers, views.methods, views.events)
    found = page(stores, request.sort, request.cursor, request.limit)
    rows = found.collect()
    own = lambda df: df.where(F.col("host_id").isin([r["host_id"] for r in rows]))
    held = stores.sparkSession.createDataFrame(rows, found.schema)
    return with_profile(documents(held, own(views.providers), own(views.methods), own(views.events)), request.full)
