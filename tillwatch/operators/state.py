"""State that observations change: confirmations and misses, profiles, availability, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import REACHED
from .ordered import sliced

_RANK = {"low": 0, "medium": 1, "high": 2}


def diff(scans: DataFrame, sightings: DataFrame, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two-in-a-row change detection: (events, state).

    scans: host_id, scan_id, ts, status; sightings: scan_id, entity_id. Only scans that reached the payment step count, in
    the order of time and id. The second sighting of an entity adds it, sightings need not be consecutive; two misses in
    a row remove it, and a new sighting starts afresh. `start` (host_id, entity_id, confirmations, misses) is what was known.

    Scans of a host are numbered. An entity's sightings fall into episodes, which end where two numbers or more are left
    out: the second sighting of an episode adds, the second number after its last removes. What was known is a sighting as
    many numbers before the first scan as it has misses. Windows over sightings only, which spill; no array per host.
    """
    by_time = Window.partitionBy("host_id").orderBy("ts", "scan_id")
    walks = scans.where(F.col("status") == REACHED).select("host_id", "scan_id", F.row_number().over(by_time).cast("bigint").alias("k"))
    seen = sightings.select("scan_id", "entity_id").distinct().join(walks, "scan_id").select("host_id", "entity_id", "k", F.col("scan_id").cast("bigint").alias("scan_id"), F.lit(1).cast("bigint").alias("c"))
    if start is not None:
        known = start.where("confirmations > 0").select("host_id", "entity_id", (-F.col("misses")).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("scan_id"), F.col("confirmations").cast("bigint").alias("c"))
        seen = seen.unionByName(known)
    entity = ["host_id", "entity_id"]
    in_order = Window.partitionBy(*entity).orderBy("k")
    fresh = F.coalesce((F.col("k") - F.lag("k").over(in_order) >= 3).cast("int"), F.lit(0))
    marked = seen.withColumn("fresh", fresh).withColumn("episode", F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    episode = Window.partitionBy(*entity, "episode").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    added = marked.withColumn("n", F.sum("c").over(episode)).where("n = 2 and scan_id is not null").select(*entity, F.lit("added").alias("event_type"), "scan_id")
    spans = marked.groupBy(*entity, "episode").agg(F.max("k").alias("until"), F.sum("c").alias("n"))
    ends = walks.select(F.col("host_id"), (F.col("k") - 2).alias("until"), F.col("scan_id").cast("bigint").alias("scan_id"))
    removed = spans.join(ends, ["host_id", "until"]).select(*entity, F.lit("removed").alias("event_type"), "scan_id")
    last = walks.groupBy("host_id").agg(F.max("k").alias("last"))
    left = F.coalesce("last", F.lit(0)) - F.col("until")
    state = spans.join(last, "host_id", "left").where(left < 2).select(*entity, F.col("n").cast("int").alias("confirmations"), left.cast("int").alias("misses"))
    return added.unionByName(removed), state


def platform_changes(observed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Observed platforms of medium or high confidence that differ from the profile's: host_id, old_value, new_value."""
    sure = observed.where(F.col("confidence").isin("medium", "high") & F.col("platform").isNotNull())
    return sure.select("host_id", F.col("platform").alias("new_value")).join(profiles.select("host_id", F.col("platform").alias("old_value")), "host_id").where("old_value <> new_value")


def fold_profiles(updates: DataFrame) -> DataFrame:
    """Profiles after all updates of each host in order (ts, scan_type, then the rest): host_id, ... (ts as text).

    A platform is taken from a light scan always, from a checkout where its confidence isn't below the held one's; country
    and vertical where their confidence isn't below, or either is none. So what counts begins with the last update that is
    taken whatever is held; of the known confidences from there on, the last of the highest stays. Two grouped passes with
    partial aggregation, joined by host. updates: host_id, ts, scan_type, platform, platform_confidence, country,
    country_confidence, vertical, vertical_confidence, currency, traffic_rank.
    """
    rest = ["ts", "scan_type", "traffic_rank", "platform", "platform_confidence", "country", "country_confidence", "vertical", "vertical_confidence", "currency"]
    u = updates.withColumn("_o", F.struct(*rest))
    rank = lambda c: F.when(F.col(c) == "low", 0).when(F.col(c) == "medium", 1).when(F.col(c) == "high", 2)
    light = F.coalesce(F.col("scan_type") == "light", F.lit(False))
    blind = {"platform": light, "country": rank("country_confidence").isNull(), "vertical": rank("vertical_confidence").isNull()}
    marks = u.groupBy(F.col("host_id").alias("_h")).agg(*[F.max(F.when(F.col(c).isNotNull() & on, F.col("_o"))).alias(f"_{c}") for c, on in blind.items()])
    j = u.join(marks, F.col("host_id") == F.col("_h"))
    out = []
    for c in blind:
        counts = F.col(c).isNotNull() & (F.col(f"_{c}").isNull() | (F.col("_o") >= F.col(f"_{c}")))
        after = F.lit(True) if c == "platform" else F.col(f"_{c}").isNull() | (F.col("_o") > F.col(f"_{c}"))
        order = F.struct(after, F.coalesce(rank(f"{c}_confidence"), F.lit(-1)), F.col("_o"))
        out.append(F.max_by(F.struct(c, f"{c}_confidence"), F.when(counts, order)).alias(f"_{c}"))
    last = lambda c, on: F.max_by(c, F.when(on, F.col("_o"))).alias(c)
    done = j.groupBy("host_id").agg(*out, last("currency", F.col("currency") != ""), last("traffic_rank", F.col("traffic_rank").isNotNull()), F.max(F.when(light, F.col("ts"))).alias("last_light"), F.max(F.when(~light, F.col("ts"))).alias("last_checkout"))
    return done.select("host_id", *[F.col(f"_{c}.{f}").alias(f) for c in blind for f in (c, f"{c}_confidence")], "currency", "traffic_rank", "last_light", "last_checkout")


def upsert_providers(state: DataFrame, observed: DataFrame) -> DataFrame:
    """Providers after one scan: first_seen stays, last_seen moves, confidence only rises, score is the larger when it may move.

    Both: host_id, provider_id, role, confidence, score, active, first_seen, last_seen, confirmations, misses.
    """
    key = ["host_id", "provider_id"]
    old, new = (df.select(*key, F.struct(*[c for c in state.columns if c not in key]).alias(n)) for df, n in ((state, "a"), (observed, "b")))
    j = old.join(new, key, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    rank = lambda s: F.element_at(F.create_map(*[x for k, v in _RANK.items() for x in (F.lit(k), F.lit(v))]), F.col(f"{s}.confidence"))
    moves = both & (rank("b") >= rank("a"))
    return j.select(
        *key, F.coalesce("a.role", "b.role").alias("role"),
        F.when(moves, F.col("b.confidence")).otherwise(F.coalesce("a.confidence", "b.confidence")).alias("confidence"),
        F.when(moves, F.greatest("a.score", "b.score")).otherwise(F.coalesce("a.score", "b.score")).alias("score"),
        (F.coalesce("a.active", F.lit(False)) | F.coalesce("b.active", F.lit(False))).alias("active"),
        F.coalesce("a.first_seen", "b.first_seen").alias("first_seen"), F.coalesce("b.last_seen", "a.last_seen").alias("last_seen"),
        (F.coalesce("a.confirmations", F.lit(0)) + F.when(F.col("b").isNotNull(), 1).otherwise(0)).alias("confirmations"),
        F.when(F.col("b").isNotNull(), 0).otherwise(F.col("a.misses")).alias("misses"),
    )


def availability(failures: DataFrame, domains: DataFrame, budget: int = 4) -> DataFrame:
    """Stores that went offline: those of shops whose retry budget is spent; opted-out ones don't change."""
    spent = failures.where(F.col("fail_count") >= budget).select("host_id")
    return domains.where("status <> 'optout'").join(spent, "host_id", "left_semi").select("host_id", F.col("status").alias("old_value"), F.lit("unreachable").alias("new_value"), (F.col("status") == "ecommerce").alias("event"))


def apply_optouts(domains: DataFrame, requests: DataFrame) -> DataFrame:
    """Domains with verified requests become opted out; the earliest verification is kept."""
    verified = requests.where("verified_at is not null").groupBy("domain").agg(F.min("verified_at").alias("optout_at"))
    return domains.join(verified, "domain", "left").withColumn("optout", F.col("optout") | F.col("optout_at").isNotNull())


def fold_limits(complaints: DataFrame, least: float = 0.01) -> DataFrame:
    """Limits per network after complaints and lifts in order: asn, factor, complaints, lifted.

    A repeated complaint halves the smaller factor, not below `least`; one after a lift starts afresh. complaints: asn, ts,
    id, kind ('complaint' or 'lift'), factor.

    A repeated complaint is the map f -> max(least, min(f, r) / 2). Products of such maps are f -> max(least, min(f / 2^m, g)), where g
    is the least r / 2^(complaints from it on): the product is associative, and one aggregate a run of complaints without a lift
    between them. What it needs is how many complaints and lifts follow a row: counted within slices, and carried over from later slices as
    one row a slice and network. Networks without a complaint are left out; a null factor counts as none.
    """
    order = ["ts", "id"]
    rows = sliced(complaints.select("asn", *order, "factor", (F.col("kind") == "complaint").cast("int").alias("c"), (F.col("kind") == "lift").cast("int").alias("l")).where("c + l = 1"), "asn", *order)
    back = Window.partitionBy("_slice", "asn").orderBy(*[F.desc(c) for c in (*order, "_row")])
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumns({"after": F.coalesce(F.sum("c").over(later), F.lit(0)), "lifts": F.coalesce(F.sum("l").over(later), F.lit(0)), "before": F.lead("l").over(back)})
    sums = rows.groupBy("asn", "_slice").agg(F.sum("c").alias("c"), F.sum("l").alias("l"), F.max_by("l", F.struct(*order, "_row")).alias("last"))
    to_come = Window.partitionBy("asn").orderBy(F.desc("_slice"))
    earlier = to_come.rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("asn", "_slice", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c_later"), F.coalesce(F.sum("l").over(earlier), F.lit(0)).alias("l_later"), F.lead("last").over(to_come).alias("last_before"))
    placed = within.where("c = 1").join(carried, (within["asn"].eqNullSafe(carried["asn"])) & (within["_slice"] == carried["_slice"])).select(
        within["asn"], "factor", (F.col("after") + F.col("c_later")).alias("after"), (F.col("lifts") + F.col("l_later")).alias("lifts"), (F.coalesce("before", "last_before", F.lit(1)) == 1).alias("fresh"))
    halved = F.col("factor") * F.pow(F.lit(2.0), -(F.col("after") + F.when(F.col("fresh"), 0).otherwise(1)))
    runs = placed.groupBy("asn", "lifts").agg(F.count("*").alias("n"), F.min(halved).alias("g"), F.max_by("factor", "after").alias("first"))
    last = runs.groupBy("asn").agg(F.min_by(F.struct("n", "g", "first"), "lifts").alias("x"), F.sum("n").cast("int").alias("complaints"), (F.min("lifts") > 0).alias("lifted"))
    factor = F.when(F.col("x.n") == 1, F.col("x.first")).otherwise(F.greatest(F.lit(least), F.col("x.g")))
    return last.select("asn", factor.alias("factor"), "complaints", "lifted")


def review_decisions(findings: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with `suppressed`, gold labels) after reviewers' last decision on each: rejected ones are suppressed, all become labels."""
    key = ["host_id", "entity_type", "entity_id"]
    last = decisions.groupBy(*key).agg(F.max_by("decision", "decided_at").alias("decision"))
    out = findings.join(last, key, "left").withColumn("suppressed", F.coalesce(F.col("decision") == "reject", F.lit(False))).drop("decision")
    return out, last.where(F.col("decision").isin("confirm", "reject")).select(*key, (F.col("decision") == "confirm").alias("present"))


def script_pool(pool: DataFrame, requests: DataFrame, now: Column, ttl_days: int = 30, most_attempts: int = 3) -> DataFrame:
    """The fetch pool after new requests: unknown URLs are pending, stale ones pending again, spent ones stay failed."""
    new = requests.select("url").distinct().withColumn("_new", F.lit(True))
    j = pool.join(new, "url", "full_outer")
    stale = (F.col("status") == "ok") & (F.col("fetched_at") < now - F.make_dt_interval(F.lit(ttl_days)))
    again = (F.col("status") == "error") & (F.col("attempts") < most_attempts)
    status = F.when(F.col("status").isNull(), "pending").when(F.col("_new") & (stale | again), "pending").otherwise(F.col("status"))
    return j.select("url", status.alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "fetched_at")


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """Requests (key, at: seconds, and further columns) under a token bucket that may go into debt: adds `tokens` left and the `wait`.

    A bucket begins full with its first request, fills by `rate` a second up to `burst`, and each request takes a token: the step is
    tokens -> min(burst, tokens + gap * rate) - 1. Seen with refill and takings set aside, v = tokens + requests - rate * at, the step
    is v -> min(v, burst - rate * at + requests before): a clamp, whose product is the least of them. So a slice is a running
    minimum, and what it hands to the slices after it is one minimum and one count a key. Requests of one time and key are taken in any order.
    """
    rows = sliced(requests, "key", "at")
    in_order = Window.partitionBy("_slice", "key").orderBy("at", "_row")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"_k": F.row_number().over(in_order), "_from": F.first("at").over(upto)})
    clamp = F.lit(float(burst)) - (F.col("at") - F.col("_from")) * rate + F.col("_k") - 1
    placed = placed.withColumn("_c", clamp).withColumn("_least", F.min("_c").over(upto))
    sums = placed.groupBy("key", "_slice").agg(F.count("*").alias("n"), F.min("_c").alias("m"), F.min("at").alias("from"))
    before = Window.partitionBy("key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"ahead": F.coalesce(F.sum("n").over(before), F.lit(0)), "begin": F.min("from").over(Window.partitionBy("key"))})
    shift = F.col("ahead") - (F.col("from") - F.col("begin")) * rate  # from a slice's own v to the key's
    carried = sums.withColumn("shift", shift).withColumn("held", F.min(F.col("m") + F.col("shift")).over(before))
    carried = carried.select(F.col("key").alias("_key"), F.col("_slice").alias("_of"), (F.col("held") - F.col("shift")).alias("_held"))
    joined = placed.join(carried, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_of")))
    tokens = F.least("_least", "_held") - F.col("_k") + (F.col("at") - F.col("_from")) * rate
    return joined.withColumn("tokens", tokens).select(*requests.columns, "tokens", F.when(F.col("tokens") < 0, -F.col("tokens") / rate).otherwise(0.0).alias("wait"))


def latest_state(observations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last observation of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return observations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
