"""Addresses, folds over ordered rows and exact ranks, as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses
from ..operators import ordered, state, visibility
from .analog import Views, sql
from .registry import query

# --- addresses -------------------------------------------------------------------------------------------------------
#: Octets that meet the fixed networks on and beside their borders.
_A, _B, _C = (8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 255, 0, 9), (0, 15, 16, 18, 31, 32, 51, 63, 64, 127, 128, 168, 254), (0, 1, 2, 100, 113)
_OCTETS = f"""octet AS (SELECT event_id AS id, {list(_A)}[event_id % {len(_A)} + 1] AS a, {list(_B)}[event_id // {len(_A)} % {len(_B)} + 1] AS b, {list(_C)}[event_id // 7 % {len(_C)} + 1] AS c, event_id % 251 AS d, event_id % 11 AS kind FROM events)"""
_V4 = "(a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113))"


def _addresses(spark, sf_dir):
    """An address of every kind from each event: dotted, mapped, of the local, listed and open networks of IPv6, and rubbish."""
    k = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    e = Views(spark, sf_dir).t("events").select(k.alias("id"), pick(_A, k).alias("a"), pick(_B, F.floor(k / len(_A))).alias("b"), pick(_C, F.floor(k / 7)).alias("c"), (k % 251).alias("d"))
    say = lambda shape, *c: F.format_string(shape, *c)
    dotted = say("%d.%d.%d.%d", "a", "b", "c", "d")
    kinds = [dotted, F.concat(F.lit("::ffff:"), dotted), say("fe%02x:%x::%x", F.col("b"), F.col("c"), F.col("d")), say("FF%02x::%x", F.col("b"), F.col("d")), say("64:ff9b::%x:%x", F.col("b"), F.col("d")), say("2001:%x:%x::1", 3512 + F.col("b") % 2, F.col("d")),
             say("f%x%02x::%x", 12 + F.col("b") % 2, F.col("b"), F.col("d")), say("2606:4700::%x:%x", F.col("b"), F.col("d")), say("%d.%d.%d", "a", "b", "c"), say("1:%x:::%x", F.col("b"), F.col("d")), say("::%x", F.col("d") % 4)]
    ip = kinds[-1]
    for n, kind in enumerate(kinds[:-1]):
        ip = F.when(F.col("id") % len(kinds) == n, kind).otherwise(ip)
    return e.select("id", ip.alias("ip"))


@query("x26_forbidden_addresses", f"""WITH {_OCTETS} SELECT id, CASE kind WHEN 0 THEN {_V4} WHEN 1 THEN {_V4} WHEN 2 THEN b BETWEEN 128 AND 191 WHEN 3 THEN true WHEN 4 THEN true WHEN 5 THEN b % 2 = 0
  WHEN 6 THEN true WHEN 7 THEN false WHEN 8 THEN true WHEN 9 THEN true ELSE d % 4 < 2 END AS forbidden FROM octet""")  # fmt: skip
def x26_forbidden(spark, sf_dir):
    return _addresses(spark, sf_dir).select("id", addresses.forbidden(F.col("ip")).alias("forbidden"))


_ALLOWED = [(1, "fe80::/9"), (1, "10.0.0.0/8"), (1, "::2"), (2, "2606:4700::/33"), (2, "::ffff:0:0/96"), (2, "100.100.0.7/9"), (3, "ff00::/8 "), (3, "1.2.3.4/33"), (4, "rubbish"), (4, "::/129"), (5, "0.0.0.0/0")]


@query("j09_networks_of_both_families", f"""WITH {_OCTETS} SELECT id, CASE id % 7 WHEN 0 THEN true WHEN 6 THEN true WHEN 1 THEN (kind = 0 AND a = 10) OR (kind = 2 AND b >= 128) OR (kind = 10 AND d % 4 = 2)
  WHEN 2 THEN kind IN (1, 7) OR (kind = 0 AND a = 100 AND b < 128) WHEN 3 THEN kind = 3 WHEN 4 THEN false ELSE kind = 0 END AS allowed FROM octet""")  # fmt: skip
def j09_families(spark, sf_dir):
    """Organisations with addresses of either family, nested networks, host bits, bad entries among good ones, and only bad ones."""
    asked = _addresses(spark, sf_dir).withColumn("org_id", F.col("id") % 7)
    return visibility.ip_allowed(asked, spark.createDataFrame(_ALLOWED, "org_id long, cidr string")).select("id", "allowed")


@query("j08_addresses_as_of", """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey WHEN 4 THEN -3 WHEN 5 THEN -12
  WHEN 6 THEN CASE WHEN c_custkey % 3 = 0 THEN c_custkey END END AS asn FROM customer""")  # fmt: skip
def j08_as_of(spark, sf_dir):
    """Ranges of very different size (a /3, a /12, a /64 or a /24 a customer) and points inside, on both borders, and just behind them.

    No two customers share a block: keys beyond the blocks of IPv4 have theirs in IPv6.
    """
    k = F.col("c_custkey")
    c = Views(spark, sf_dir).t("customer")
    words = F.floor(k / 2**32), F.floor(k / 65536) % 65536, k % 65536
    head, behind = F.format_string("fd%02x:%x:%x:1", *words), F.format_string("fd%02x:%x:%x:2::", *words)
    low, high = F.concat(head, F.lit("::")), F.concat(head, F.lit(":ffff:ffff:ffff:ffff"))
    four = F.when(k < 245 * 65536, F.format_string("%d.%d.%d.", F.lit(11) + F.floor(k / 65536), F.floor(k / 256) % 256, k % 256))
    of_four = lambda last, else_: F.coalesce(F.concat(four, F.lit(last)), else_)
    own = c.select(k.alias("asn"), F.when(k % 8 == 6, of_four("0", low)).otherwise(low).alias("low_ip"), F.when(k % 8 == 6, of_four("255", high)).otherwise(high).alias("high_ip")).where("asn % 8 <> 6 or asn % 3 = 0")
    wide = spark.createDataFrame([(-3, "2000::", "3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), (-12, "4000::", "400f:ffff:ffff:ffff:ffff:ffff:ffff:ffff")], "asn long, low_ip string, high_ip string")
    tails = [low, high, F.concat(head, F.lit(":0:7::9")), behind, F.format_string("3fff:%x::1", k % 65536), F.format_string("400f:%x::1", k % 65536), of_four("255", high), F.format_string("4010::%x", k % 65536)]
    ip = tails[-1]
    for n, tail in enumerate(tails[:-1]):
        ip = F.when(k % 8 == n, tail).otherwise(ip)
    return ordered.address_ranges(c.select("c_custkey", ip.alias("ip")), own.unionByName(wide), "ip").select("c_custkey", "asn")


# --- folds -----------------------------------------------------------------------------------------------------------
@query("c11_politeness_waits", """WITH RECURSIVE r AS (SELECT user_id, CAST(floor(epoch(ts)) AS DOUBLE) AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
st AS (SELECT user_id, s, k, CAST(1.0 AS DOUBLE) AS tokens FROM r WHERE k = 1
  UNION ALL SELECT r.user_id, r.s, r.k, least(2.0, tokens + (r.s - st.s) / 32768) - 1 FROM st JOIN r ON r.user_id = st.user_id AND r.k = st.k + 1)
SELECT user_id, s AS second, tokens, CASE WHEN tokens < 0 THEN -tokens * 32768 ELSE 0.0 END AS wait FROM st""")  # fmt: skip
def c11_bucket(spark, sf_dir):
    """Waits of every user's requests under two requests at once and one in 32768 seconds."""
    asked = Views(spark, sf_dir).t("events").select(F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return state.token_bucket(asked, 1 / 32768, 2.0).select(F.col("key").alias("user_id"), F.col("at").alias("second"), "tokens", "wait")


# --- ranks -----------------------------------------------------------------------------------------------------------
@query("a31_latency_ranks", sql("SELECT endpoint, quantile_disc(records, 0.5) AS p50, quantile_disc(records, 0.95) AS p95, quantile_disc(records, 0.99) AS p99, min(records) AS least, median(records) AS middle FROM usage GROUP BY 1", "usage"))
def a31_latency(spark, sf_dir):
    """Nearest ranks and the median of whole numbers with many ties, by endpoint."""
    u = Views(spark, sf_dir).usage
    near = ordered.order_statistics(u, F.col("records"), {"p50": 0.5, "p95": 0.95, "p99": 0.99, "least": 0.0}, ("endpoint",))
    return near.join(ordered.order_statistics(u, F.col("records"), {"middle": 0.5}, ("endpoint",), between=True), "endpoint")
