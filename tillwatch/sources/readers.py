"""Readers of domain lists, captures, rules, labels and ranges. Each gives a DataFrame of a fixed schema; bad lines are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import ip_key, ip_number
from ..functions.hosts import watched_domain, with_host
from ..schemas import RULE, SIGNAL_TYPES

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


def reader(kind: str) -> Callable[[Reader], Reader]:
    """Register a reader of a kind of domain list: it gives rank (null: none) and raw."""

    def put(f: Reader) -> Reader:
        _READERS[kind] = f
        return f

    return put


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A domain list as rank, raw, hostname; names that are none have a null hostname."""
    if kind not in _READERS:
        raise ValueError(f"no reader for {kind!r}; there are {', '.join(sorted(_READERS))}")
    return with_host(_READERS[kind](spark, path), "raw")


@reader("ranked")
def ranked(spark: SparkSession, path: str) -> DataFrame:
    """`rank,name` lines."""
    return spark.read.csv(path, schema="rank string, raw string").where("trim(rank) rlike '^[0-9]+$' and raw is not null").select(F.trim("rank").cast("bigint").alias("rank"), "raw")


@reader("manual")
def manual(spark: SparkSession, path: str) -> DataFrame:
    """First column; header words, comments and blanks are skipped."""
    first = F.trim(F.split("value", "[,;]")[0])
    return spark.read.text(path).select(F.lit(None).cast("bigint").alias("rank"), first.alias("raw")).where("raw <> '' and not startswith(raw, '#') and lower(raw) not in ('domain', 'host', 'hostname', 'url')")


@reader("webgraph")
def webgraph(spark: SparkSession, path: str) -> DataFrame:
    """`id, reversed host` vertices, plain or gzipped."""
    parts = F.split("value", "\t")
    flipped = F.array_join(F.reverse(F.split(F.try_element_at(parts, F.lit(2)), r"\.")), ".")
    return spark.read.text(path).where("not startswith(value, '#')").select(F.lit(None).cast("bigint").alias("rank"), flipped.alias("raw")).where("raw is not null")


@reader("certificates")
def certificates(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with data.leaf_cert.all_domains; lines that are no JSON are dropped."""
    doc = F.from_json("value", "data struct<leaf_cert:struct<all_domains:array<string>>>")
    return spark.read.text(path).select(F.explode(doc["data"]["leaf_cert"]["all_domains"]).alias("raw")).where("raw is not null").select(F.lit(None).cast("bigint").alias("rank"), "raw")


@reader("czds")
def zone(spark: SparkSession, path: str) -> DataFrame:
    """Owners of NS records of a zone file; the TTL may be left out."""
    parts = F.split(F.trim(F.regexp_replace("value", ";.*$", "")), r"\s+")
    kinds = F.transform(F.slice(parts, 2, 3), lambda p: F.upper(p))
    return spark.read.text(path).where(F.array_contains(kinds, "NS")).select(F.lit(None).cast("bigint").alias("rank"), F.lower(F.rtrim(parts[0], F.lit("."))).alias("raw")).dropDuplicates(["raw"])


def rules(spark: SparkSession, entries: list[dict], known: dict[str, set[str]] | None = None) -> DataFrame:
    """A validated rule set. A rule set is curated by hand, so it is checked on the driver; the first fault is an error.

    `known` has the ids that a target type may name; types that it leaves out may name any.
    """
    import re

    seen, rows = set(), []
    for e in entries:
        e = {"match": "host_suffix", "page_scope": "any", "enabled": True, "needs_verification": False, "version": 1} | e
        name = f"rule {e.get('rule_id')!r}"
        if e.get("signal_type") not in SIGNAL_TYPES:
            raise ValueError(f"{name}: unknown signal type")
        if known is not None and e.get("target_id") not in known.get(e.get("target_type"), {e.get("target_id")}):
            raise ValueError(f"{name}: unknown target {e.get('target_type')}:{e.get('target_id')}")
        if not 0 <= float(e["weight"]) <= 1:
            raise ValueError(f"{name}: a weight lies between 0 and 1")
        if e["enabled"] and e["needs_verification"]:
            raise ValueError(f"{name}: a rule that needs verification can't be enabled")
        if (e["rule_id"], e["version"]) in seen:
            raise ValueError(f"{name}: this version is there already")
        if e["match"] == "regex":
            re.compile(e["pattern"])
        seen.add((e["rule_id"], e["version"]))
        rows.append(tuple(float(e[f.name]) if f.name == "weight" else e[f.name] for f in RULE.fields))
    return spark.createDataFrame(rows, RULE)


# How a signal is matched where a rule doesn't say.
DEFAULT_MATCH = {
    "script_src": "url_contains", "network_host": "host_suffix", "iframe_src": "host_suffix", "js_global": "exact", "html_pattern": "regex", "form_action": "host_suffix",
    "checkout_label": "regex", "platform_plugin": "url_contains", "header": "header_name", "cookie": "cookie_name", "favicon": "sha256",
}


def _documents(spark: SparkSession, path: str, glob: str = "*.{yaml,yml,json}") -> list[tuple[str, dict]]:
    """YAML files below a folder (or JSON, which is YAML too), by name. They are curated by hand, so the driver reads them."""
    try:
        from yaml import safe_load
    except ImportError:
        from json import loads as safe_load
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.input_file_name().alias("f"), "value").orderBy("f").collect()
    found = [(r["f"].rsplit("/", 1)[-1], safe_load(r["value"])) for r in files]
    for name, doc in found:
        if not isinstance(doc, dict):
            raise ValueError(f"{name}: the top level must be a mapping")
    return found


def rule_files(spark: SparkSession, path: str, known: dict[str, set[str]] | None = None, glob: str = "*.{yaml,yml,json}") -> DataFrame:
    """The rules of all files below a folder, validated. A file names its target once; ids begin with it."""
    entries = []
    for name, doc in _documents(spark, path, glob):
        of = {"target_type": doc["target_type"], "target_id": doc["target_id"]}
        for r in doc["rules"]:
            if not str(r["id"]).startswith(f"{of['target_type']}.{of['target_id']}."):
                raise ValueError(f"{name}: rule id {r['id']!r} must begin with its target")
            entries.append(of | {"match": DEFAULT_MATCH.get(r["signal_type"], "regex")} | {k: v for k, v in r.items() if k in ("version", "signal_type", "match", "pattern", "weight", "page_scope", "enabled", "needs_verification")} | {"rule_id": r["id"]})
    return rules(spark, entries, known)


#: Dictionaries, and the columns of each that name ids: of itself (a parent) or of another.
DICTIONARIES = {"providers": {"parent_provider_id": "providers"}, "payment_methods": {"default_provider_id": "providers"}, "platforms": {"parent_id": "platforms"}, "verticals": {"parent_id": "verticals"}}


def dictionaries(spark: SparkSession, path: str, least: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The dictionaries below a folder as id, name, and the columns of DICTIONARIES; any fault is an error."""
    docs, out = {n.rsplit(".", 1)[0]: d for n, d in _documents(spark, path)}, {}
    for name, links in DICTIONARIES.items():
        rows = docs.get(name, {}).get(name, [])
        out[name] = spark.createDataFrame([(str(r["id"]), r.get("name"), r.get("status"), *[r.get(c) for c in links]) for r in rows], ", ".join(f"{c} string" for c in ("id", "name", "status", *links)))
    if faults := [tuple(r) for r in dictionary_faults(out, least or {}).collect()]:
        raise ValueError("; ".join(" ".join(map(str, f)) for f in sorted(faults, key=str)[:5]))
    return out


def dictionary_faults(tables: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """What is wrong with dictionaries: dictionary, id, fault. Repeated ids, links to no id, rows that are their own parent, and fewer rows (deprecated ones aside) than `least`."""
    found = []
    for name, df in tables.items():
        say = lambda rows, fault, name=name: rows.select(F.lit(name).alias("dictionary"), "id", F.lit(fault).alias("fault"))
        found.append(say(df.groupBy("id").count().where("count > 1"), "repeated"))
        for column, other in DICTIONARIES.get(name, {}).items():
            ids = tables[other].select(F.col("id").alias("_id"))
            found.append(say(df.where(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("_id"), "left_anti"), f"{column} is unknown"))
            if other == name:
                found.append(say(df.where(F.col(column) == F.col("id")), "its own parent"))
        if name in least:
            few = df.where("coalesce(status, '') <> 'deprecated'").agg(F.count("*").alias("n")).where(F.col("n") < least[name])
            found.append(few.select(F.lit(name).alias("dictionary"), F.col("n").cast("string").alias("id"), F.lit("too few").alias("fault")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def signature_rules(spark: SparkSession, path: str) -> DataFrame:
    """Third-party signatures (a JSON object per technology) as disabled rules: tags behind a backslash and semicolon go, a confidence tag is the weight."""
    kinds = {"scriptSrc": "script_src", "html": "html_pattern", "js": "js_global", "cookies": "cookie", "headers": "header"}
    shape = "map<string, struct<scriptSrc:string,html:string,js:map<string,string>,cookies:map<string,string>,headers:map<string,string>>>"
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)).alias("name", "t"))
    one = lambda v: F.when(v.isNotNull(), F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)))
    keyed = lambda m, joined: F.transform(F.map_entries(m), lambda e: F.when(joined & (e["value"] != ""), F.concat(e["key"], F.lit(":"), e["value"])).otherwise(e["key"]))
    parts = [("scriptSrc", one(F.col("t.scriptSrc"))), ("html", one(F.col("t.html"))), ("js", keyed(F.col("t.js"), F.lit(False))), ("cookies", keyed(F.col("t.cookies"), F.lit(False))), ("headers", keyed(F.col("t.headers"), F.lit(True)))]
    none = F.array().cast("array<string>")
    of_kind = lambda kind: lambda p: F.struct(F.lit(kind).alias("signal_type"), p.alias("p"))
    each = F.concat(*[F.transform(F.coalesce(v, none), of_kind(kinds[k])) for k, v in parts])
    rows = doc.select("name", F.posexplode(each).alias("k", "s")).select("name", "k", "s.*")
    weight = F.regexp_extract("p", r"\\;confidence:(\d+)", 1)
    slug = F.regexp_replace(F.lower("name"), "[^a-z0-9_]+", "_")
    return rows.select(F.concat_ws("_", slug, (F.col("k") + 1).cast("string")).alias("rule_id"), F.lit("platform").alias("target_type"), slug.alias("target_id"), "signal_type", F.regexp_replace("p", r"\\;.*$", "").alias("pattern"), F.when(weight != "", weight.cast("double") / 100).otherwise(0.5).alias("weight"), F.lit(False).alias("enabled"))


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels from CSV; of repeated ones the last counts; unknown types and unreadable flags are dropped."""
    raw = spark.read.csv(path, header=True, schema="domain string, entity_type string, entity_id string, present string, labeled_by string, labeled_at string, notes string")
    flag = F.lower(F.trim("present"))
    sound = raw.where(F.col("entity_type").isin("provider", "payment_method", "platform", "country") & flag.isin("true", "false", "1", "0", "yes", "no") & F.col("domain").isNotNull())
    return sound.groupBy(F.lower("domain").alias("domain"), "entity_type", "entity_id").agg(F.max_by(flag.isin("true", "1", "yes"), F.struct("labeled_at", "labeled_by")).alias("present"))


def findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings from CSV; a missing score is that of the confidence."""
    raw = spark.read.csv(path, header=True, schema="domain string, entity_type string, entity_id string, confidence string, confidence_score double, rule_id string, rule_version int, active_on_checkout boolean")
    default = F.create_map(F.lit("high"), F.lit(0.9), F.lit("medium"), F.lit(0.6), F.lit("low"), F.lit(0.3))
    return raw.where("confidence in ('high', 'medium', 'low')").withColumn("confidence_score", F.coalesce("confidence_score", F.element_at(default, F.col("confidence"))))


def ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Ranges of networks: low_ip and high_ip as given, low and high (numbers, null for IPv6), low_key and high_key (see `ip_key`), asn, country, name; unrouted ones (network 0) are dropped, NONE is null."""
    raw = spark.read.csv(path, sep="\t", schema="a string, b string, asn bigint, country string, name string")
    ends = [f(F.trim(c)).alias(n + s) for f, s in ((ip_number, ""), (ip_key, "_key")) for c, n in (("a", "low"), ("b", "high"))]
    return raw.select(F.trim("a").alias("low_ip"), F.trim("b").alias("high_ip"), *ends, "asn", F.when(~F.upper("country").isin("NONE", ""), F.col("country")).alias("country"), "name").where("asn <> 0 and low_key is not null and high_key is not null")


def log_lines(spark: SparkSession, path: str, columns: tuple[str, str, str, str]) -> DataFrame:
    """White-space separated lines of at most four fields, the first a time (Z and no zone: UTC); the rest of a line is the fourth."""
    parts = F.split(F.trim("value"), r"\s+", 4)
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(parts[0], "T", " "), "Z$", "+00:00"))
    rest = [F.try_element_at(parts, F.lit(k)).alias(c) for k, c in zip((2, 3, 4), columns[1:])]
    return spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(at.alias(columns[0]), *rest).where(F.col(columns[0]).isNotNull() & F.col(columns[1]).isNotNull())


def watchlist(text: DataFrame, column: str = "text") -> DataFrame:
    """Names of an uploaded list, one a line; a `domain` header in the first line is skipped."""
    lines = text.select(F.posexplode(F.split(column, r"\r?\n")).alias("k", "line")).select("k", F.trim(F.split("line", ",")[0]).alias("raw"))
    return lines.where("raw <> '' and not (k = 0 and lower(raw) = 'domain')").select(watched_domain(F.col("raw")).alias("hostname")).where("hostname is not null").distinct()


def ingest(state: DataFrame, records: DataFrame, source: str, batch: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hosts, domain sources, counters) after a list is taken in.

    state: hostname, rank, source, first_seen, last_seen, batch_id. The better rank stays (nulls never win), first_seen
    stays, last_seen moves; one counter row has what was seen, invalid, new and updated.
    """
    new = records.where("hostname is not null").groupBy("hostname").agg(F.min("rank").alias("rank")).select("hostname", "rank", F.lit(source).alias("source"), F.lit(now).alias("first_seen"), F.lit(now).alias("last_seen"), F.lit(batch).alias("batch_id"))
    both = state.unionByName(new)
    hosts = both.groupBy("hostname").agg(F.min("rank").alias("rank"))
    sources = both.groupBy("hostname", "source").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("batch_id", F.struct("last_seen", "batch_id")).alias("batch_id"))
    known = state.select("hostname").distinct().withColumn("_k", F.lit(True))
    counts = records.agg(F.count("*").alias("seen"), F.count_if(F.col("hostname").isNull()).alias("invalid"))
    fresh = new.join(known, "hostname", "left").agg(F.count_if(F.col("_k").isNull()).alias("new"), F.count("_k").alias("updated"))
    return hosts, sources, counts.join(F.broadcast(fresh))
