"""Addresses of both families as columns: keys that sort as addresses do, networks as masked keys."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Networks that a crawler must not reach.
FORBIDDEN = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b::/96", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32",
)
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_MAPPED = "0" * 20 + "ffff"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null if it is none."""
    number = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("bigint"), lambda n, octet: n * 256 + octet.cast("bigint"))
    return F.when(ip.rlike(_V4), number)


def _hexed(n: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(n), digits, "0"))


def _v6_key(ip: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits; null if it is none. A scope behind `%` is dropped; the last two words may be a dotted address."""
    listed = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":"))

    def dotted(bare: Column) -> Column:
        tail = F.substring_index(bare, ":", -1)
        words = let(ip_number(tail), lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
        return F.when(~bare.contains("."), bare).otherwise(F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(tail)), F.lower(words)))

    def filled(sides: Column) -> Column:
        return let(F.struct(listed(sides[0]).alias("a"), F.coalesce(listed(F.try_element_at(sides, F.lit(2))), F.array().cast("array<string>")).alias("b"), (F.size(sides) == 2).alias("cut")), words)

    def words(x: Column) -> Column:
        gap = F.lit(8) - F.size(x["a"]) - F.size(x["b"])
        full = F.concat(x["a"], F.array_repeat(F.lit("0"), gap), x["b"])
        return F.when(F.when(x["cut"], gap >= 1).otherwise(gap == 0), full)

    full = let(F.split(let(F.lower(F.regexp_replace(ip, "%[^%]+$", "")), dotted), "::"), lambda sides: F.when(F.size(sides) <= 2, filled(sides)))
    key = let(full, lambda w: F.when(F.forall(w, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(w, lambda x: F.lpad(x, 4, "0")), "")))
    return F.when(ip.contains(":"), key)


def address(ip: Column) -> Column:
    """Family (4 or 6) and hexadecimal digits (8 or 32) of an address, as a struct; null if it is none. IPv4 in its IPv6 form stays IPv6."""
    of = lambda family: lambda digits: F.when(digits.isNotNull(), F.struct(F.lit(family).alias("family"), digits.alias("digits")))
    return F.when(ip.contains(":"), let(_v6_key(ip), of(6))).otherwise(let(_hexed(ip_number(ip), 8), of(4)))


def unmapped(found: Column) -> Column:
    """An address, IPv4 in its IPv6 form as IPv4."""

    def one(a: Column) -> Column:
        mapped = (a["family"] == 6) & a["digits"].startswith(_MAPPED)
        return F.when(mapped, F.struct(F.lit(4).alias("family"), F.substring(a["digits"], 25, 8).alias("digits"))).otherwise(a)

    return let(found, one)


def ip_key(ip: Column) -> Column:
    """An address as 32 hexadecimal digits, which sort as addresses do; IPv4 as in IPv6's mapped form. Null if it is neither."""
    return let(address(ip), lambda a: F.when(a["family"] == 4, F.concat(F.lit(_MAPPED), a["digits"])).otherwise(a["digits"]))


def masked(digits: Column, bits: Column) -> Column:
    """What the first `bits` bits of an address say: equal for all addresses of a network."""
    whole, rest = F.floor(bits / 4).cast("int"), bits % 4
    part = F.floor(F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int") / F.pow(F.lit(2), 4 - rest)).cast("int")
    return F.concat_ws("/", F.substring(digits, F.lit(1), whole), F.when(rest > 0, part.cast("string")).otherwise(""))


def network(cidr: Column) -> Column:
    """Family, prefix length and masked key of a network, as a struct; an address is a network of its own, host bits don't matter, null if it is none."""

    def one(x: Column) -> Column:
        most = F.when(x["a"]["family"] == 4, 32).otherwise(128)
        bits = F.when(x["said"].isNull(), most).when(x["said"].rlike(r"^\d{1,3}$"), x["said"].try_cast("int"))
        sound = x["a"].isNotNull() & (x["n"] <= 2) & (bits <= most)
        return F.when(sound, F.struct(x["a"]["family"].alias("family"), bits.alias("bits"), masked(x["a"]["digits"], bits).alias("head")))

    return let(F.split(F.trim(cidr), "/"), lambda parts: let(F.struct(address(parts[0]).alias("a"), F.try_element_at(parts, F.lit(2)).alias("said"), F.size(parts).alias("n")), one))


def _ends(cidr: str) -> tuple[int, str, str]:
    """Family, first and last address of a fixed network."""
    net = ipaddress.ip_network(cidr)
    return net.version, *(f"{int(a):0{net.max_prefixlen // 4}x}" for a in (net.network_address, net.broadcast_address))


def forbidden(ip: Column, networks: tuple[str, ...] = FORBIDDEN) -> Column:
    """Whether an address must not be reached: it lies in one of a short list of networks, or is no address (null too). IPv4 in its
    IPv6 form counts as IPv4. No join: the test is part of a scan.
    """

    def listed(found: Column) -> Column:
        hit = F.lit(False)
        for family, low, high in sorted(map(_ends, networks)):
            hit |= (found["family"] == family) & found["digits"].between(low, high)
        return found.isNull() | hit

    return let(unmapped(address(ip)), listed)


def in_networks(points: DataFrame, networks: DataFrame, ip: str = "ip", cidr: str = "cidr", by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (by, ip) of addresses that lie in one of the networks of the same `by`; entries that are no networks are skipped.

    A prefix tree as a table: networks are (family, length, masked key), an address meets them by an equi join with one key a
    length that occurs (of its `by`, where there is one). Networks may nest and overlap, and be of either family.
    """
    by = list(by)
    nets = networks.select(*by, network(F.col(cidr)).alias("_n")).where("_n is not null").select(*by, "_n.*").distinct()
    lengths = nets.select(*by, "family", "bits").distinct()
    asked = points.select(*by, ip).distinct().withColumn("_a", address(F.col(ip))).where("_a is not null").withColumn("family", F.col("_a.family"))
    keyed = asked.join(lengths, [*by, "family"]).withColumn("head", masked(F.col("_a.digits"), F.col("bits")))
    return keyed.join(nets, [*by, "family", "bits", "head"], "left_semi").select(*by, ip).distinct()
