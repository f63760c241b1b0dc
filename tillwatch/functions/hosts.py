"""Hostnames and URLs as columns; only names that aren't ASCII go through a vectorised Python function."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Public suffixes beyond the single-label ones, a subset; any top-level domain is a suffix by itself.
SECOND_LEVEL = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "org.uk", "plc.uk", "asn.au", "com.au", "edu.au", "id.au", "net.au", "org.au",
    "co.at", "or.at", "com.br", "net.br", "org.br", "com.cn", "net.cn", "org.cn", "co.id", "co.il", "co.in", "net.in", "org.in",
    "ac.jp", "co.jp", "ne.jp", "or.jp", "co.kr", "or.kr", "com.mx", "com.my", "co.nz", "net.nz", "org.nz", "com.pl", "net.pl", "org.pl",
    "com.pt", "com.sg", "co.th", "com.tr", "com.tw", "com.ua", "co.za", "github.io", "gitlab.io", "myshopify.com", "netlify.app",
    "pages.dev", "vercel.app", "web.app", "herokuapp.com", "wixsite.com", "blogspot.com", "azurewebsites.net",
)
_LABEL = r"^[a-z0-9]([a-z0-9_-]{0,61}[a-z0-9])?$"


@F.pandas_udf(T.StringType())
def idna(hosts: pd.Series) -> pd.Series:
    """Labels in their ASCII form; null where one has none."""

    def one(host: str | None) -> str | None:
        if host is None:
            return None
        try:
            return ".".join(x if x.isascii() else x.encode("idna").decode("ascii") for x in host.split("."))
        except UnicodeError:
            return None

    return hosts.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def displayed(hosts: pd.Series) -> pd.Series:
    """Punycode labels as Unicode; what can't be decoded stays."""

    def one(host: str) -> str:
        try:
            return host.encode("ascii").decode("idna")
        except UnicodeError:
            return host

    return hosts.map(one, na_action="ignore")


def bare_host(raw: Column) -> Column:
    """Lower case, without scheme, user, port, path, `*.`, `www.` and a trailing dot. IPv6 literals give null."""
    v = F.lower(F.trim(raw))
    v = F.regexp_replace(v, r"^[^/?#]*?://", "")
    v = F.regexp_replace(v, r"[/?#].*$", "")
    v = F.regexp_replace(v, r"^.*@", "")
    v6 = v.startswith("[") | (F.length(v) - F.length(F.replace(v, F.lit(":"), F.lit(""))) > 1)
    v = F.regexp_replace(v, r":.*$", "")
    v = F.regexp_replace(F.regexp_replace(v, r"^\*\.", ""), r"\.+$", "")
    return F.when(~v6, F.regexp_replace(v, r"^www\.", ""))


def valid_host(host: Column) -> Column:
    """An ASCII name of two or more sound labels, at most 253 characters, and no IPv4 address."""
    labels = F.split(host, r"\.")
    return (F.size(labels) >= 2) & (F.length(host) <= 253) & ~host.rlike(r"^\d+(\.\d+){3}$") & F.forall(labels, lambda x: x.rlike(_LABEL))


def with_host(df: DataFrame, raw: str, out: str = "hostname") -> DataFrame:
    """Adds the canonical host name of a column; null where it has none."""
    bare = df.withColumn(out, bare_host(F.col(raw)))
    ascii_ = F.when(F.col(out).rlike(r"^[\x00-\x7F]*$"), F.col(out)).otherwise(idna(F.when(~F.col(out).rlike(r"^[\x00-\x7F]*$"), F.col(out))))
    named = bare.withColumn(out, ascii_)
    return named.withColumn(out, F.when(valid_host(F.col(out)), F.col(out)))


def watched_domain(raw: Column) -> Column:
    """The name of a watchlist entry: without scheme, path, port and `www.`, in ASCII form; null if it is none."""
    v = F.regexp_replace(F.lower(F.trim(raw)), "^https?://", "")
    v = F.regexp_replace(F.regexp_replace(v, "[/:].*$", ""), r"^www\.", "")
    ascii_ = v.rlike(r"^[\x00-\x7F]*$")
    v = F.when(ascii_, v).otherwise(idna(F.when(~ascii_, v)))
    return F.when(v.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$") & (F.length(v) <= 253), v)


def public_suffix(host: Column, suffixes: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The longest listed suffix of a name, or else its last label."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def etld1(host: Column, suffixes: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The suffix and one label more; null for a bare suffix."""
    suffix = public_suffix(host, suffixes)
    n = F.size(F.split(suffix, r"\."))
    out = F.when(n == 1, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -3))
    return F.when(host != suffix, out)


def registrable(df: DataFrame, host: str, rules: DataFrame, out: str = "etld1") -> DataFrame:
    """Adds the suffix and one label more by a list of rules of any size (a column `rule`: `co.uk`, `*.ck`, `!www.ck`); null for a bare suffix.

    Names are exploded to their suffixes, which meet the rules by an equi join. The longest rule counts, an exception before
    all others; a name that no rule covers has its last label as suffix.
    """
    listed = rules.select(F.lower(F.trim("rule")).alias("r")).where("r <> '' and not startswith(r, '//')").select(F.regexp_replace("r", r"^(!|\*\.)", "").alias("_suffix"), F.when(F.col("r").startswith("!"), -1).when(F.col("r").startswith("*."), 1).otherwise(0).alias("_more")).distinct()
    labels = F.size(F.split("_suffix", r"\."))
    each = df.select(F.col(host).alias("_h")).where("_h is not null").distinct().select("_h", F.explode(suffixes_of(F.col("_h"))).alias("_suffix"))
    hits = each.join(listed, "_suffix").groupBy("_h").agg(F.max(F.when(F.col("_more") < 0, labels - 1)).alias("_e"), F.max(F.when(F.col("_more") >= 0, labels + F.col("_more"))).alias("_n"))
    parts = F.split(F.lower(F.rtrim(F.col(host), F.lit("."))), r"\.")
    n = F.coalesce("_e", "_n", F.lit(1)) + 1
    name = F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), "."))
    return df.join(hits, F.col(host) == F.col("_h"), "left").withColumn(out, name).drop("_h", "_e", "_n")


def url_host(url: Column) -> Column:
    """Host of a URL with or without scheme, lower case."""
    full = F.when(url.contains("://"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(F.concat(F.lit("https://"), url))
    return F.lower(F.try_parse_url(full, F.lit("HOST")))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def suffixes_of(host: Column) -> Column:
    """The name and all that follow its dots, longest first: what a suffix pattern may equal."""
    parts = F.split(F.lower(F.rtrim(host, F.lit("."))), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def suffix_match(hosts: DataFrame, patterns: DataFrame, host: str = "host") -> DataFrame:
    """Hosts with the first (by `place`) pattern they equal or lie below; `*.` is dropped. An equi join on exploded suffixes, no theta join.

    patterns: pattern, place, and further columns, which come along in the struct `found` (null without a match).
    """
    listed = patterns.select(F.lower(F.regexp_replace("pattern", r"^\*\.", "")).alias("_suffix"), F.struct(*patterns.columns).alias("_p"))
    each = hosts.select(host).distinct().select(host, F.explode(suffixes_of(F.col(host))).alias("_suffix"))
    best = each.join(listed, "_suffix").groupBy(host).agg(F.min_by("_p", F.col("_p.place")).alias("found"))
    return hosts.join(best, host, "left")


def host_category(df: DataFrame, rules: DataFrame, categories: DataFrame, host: str = "host") -> DataFrame:
    """Adds the category of a host: psp where an enabled provider rule (pattern, enabled) covers it, else that of the first listed suffix (place, pattern, category), else other."""
    paid = rules.where("enabled").select(F.lit(-1).alias("place"), "pattern", F.lit("psp").alias("category"))
    found = suffix_match(df, paid.unionByName(categories.select("place", "pattern", "category")), host)
    return found.withColumn("category", F.coalesce("found.category", F.lit("other"))).drop("found")


def hosted_checkout(urls: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """URLs with the known checkout of the same host whose path prefix is the longest: adds `provider_id`."""
    keyed = urls.withColumn("_host", url_host(F.col(url))).withColumn("_path", F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")))
    pairs = keyed.select(url, "_host", "_path").distinct().join(known.select(F.col("host").alias("_host"), "path_prefix", "provider_id"), "_host").where(F.expr("startswith(_path, path_prefix)"))
    best = pairs.groupBy(url).agg(F.max_by("provider_id", F.struct(F.length("path_prefix"), "provider_id")).alias("provider_id"))
    return keyed.drop("_host", "_path").join(best, url, "left")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int = 1 << 16) -> DataFrame:
    """Points with the range (disjoint, closed) that holds them, if any: an equi join on buckets of `width`.

    A range is listed in each bucket it touches, a point in its own, so the work grows with hits and not with points times ranges.
    """
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    keyed = points.withColumn("_bucket", F.floor(F.col(point) / width))
    on = (keyed["_bucket"] == spread["_bucket"]) & (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    return keyed.join(spread, on, "left").drop("_bucket")


