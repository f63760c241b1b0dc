"""Numeric columns: intervals, priorities, ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound of a share; (0, 0) without trials, successes beyond the trials count as all. No successes
    give a lower bound of exactly 0, and all an upper bound of exactly 1, so that rounding never leaves the share outside."""
    n = total.cast("double")
    s = F.greatest(F.lit(0.0), F.least(successes.cast("double"), n))
    p, z2 = s / n, z * z
    middle = p + z2 / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low = F.greatest(F.lit(0.0), (middle - spread) / (1 + z2 / n))
    high = F.least(F.lit(1.0), (middle + spread) / (1 + z2 / n))
    return F.when((n <= 0) | (s <= 0), 0.0).otherwise(low), F.when(n <= 0, 0.0).when(s >= n, 1.0).otherwise(high)


def wilson_sql(s: str, n: str) -> tuple[str, str]:
    """The same bounds in SQL, for doubles s and n."""
    z2 = Z95 * Z95
    p = f"(greatest(0.0, least({s}, {n})) / {n})"
    middle, spread = f"({p} + {z2!r} / (2 * {n}))", f"({Z95!r} * sqrt({p} * (1 - {p}) / {n} + {z2!r} / (4 * {n} * {n})))"
    low = f"CASE WHEN {n} <= 0 OR {s} <= 0 THEN 0.0 ELSE greatest(0.0, ({middle} - {spread}) / (1 + {z2!r} / {n})) END"
    return low, f"CASE WHEN {n} <= 0 THEN 0.0 WHEN {s} >= {n} THEN 1.0 ELSE least(1.0, ({middle} + {spread}) / (1 + {z2!r} / {n})) END"


def rank_score(rank: Column) -> Column:
    """1 for the first rank, 0 from the millionth on, for none, and for ranks below 1."""
    return F.when(rank >= 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.log10(rank.cast("double")) / 6))).otherwise(0.0)


def staleness(days: Column, interval: Column, cap: float = 3.0) -> Column:
    """Days since success in units of the interval, within [0, cap]; never is `cap`."""
    return F.when(days.isNull(), F.lit(cap)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(cap), days / F.greatest(interval, F.lit(1)))))


def priority(ecommerce: Column, rank: Column, checkout: Column, watched: Column, days: Column, interval: Column, weights: dict[str, float]) -> Column:
    """Product of weighted factors, rounded half-even to four places."""
    as_number = lambda flag: flag.cast("int").cast("double")
    factors = {"ecommerce": as_number(ecommerce), "rank": rank_score(rank), "checkout": as_number(checkout), "watchlist": as_number(watched), "staleness": staleness(days, interval)}
    out = F.lit(1.0)
    for name, factor in factors.items():
        out = out * (1 + weights[name] * factor)
    return F.bround(out, 4)


def retry_hours(failures: Column, ladder: tuple[float, ...] = (1, 6, 24, 72), budget: int = 4) -> Column:
    """Hours before the next try after so many failures in a row; null when the budget is spent."""
    steps = F.array(*[F.lit(float(h)) for h in ladder])
    return F.when(failures < budget, F.element_at(steps, F.least(failures, F.lit(len(ladder))).cast("int")))


def scan_interval(scan_type: Column, status: Column, watched: Column) -> Column:
    """Days between scans: light 7 for shops and 30 for candidates, checkout 7 when watched and else 30."""
    light = F.when(status == "ecommerce", 7).otherwise(30)
    return F.when(scan_type == "light", light).otherwise(F.when(watched, 7).otherwise(30))
