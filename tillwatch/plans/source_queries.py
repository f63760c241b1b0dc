"""Sources, sinks and writes as registered queries: tables become files of each format, and the readers read those."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hosts, text
from ..operators import detect, exports, file_sink, ordered, quality, search, share, state, usage, versions
from ..session import fingerprint, shared_folder, ship
from ..sources import captures, log_stream, readers, synthetic
from .analog import MIN_CELL, NOW, Views, sql
from .more_queries import snapshot
from .registry import query, sql_of


def _path(spark, name: str) -> str:
    """A new folder that all machines reach."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def _file(spark, name: str, df: DataFrame, **options: str) -> str:
    path = _path(spark, name)
    df.write.options(**options).text(path)
    return path


def _say(*parts) -> Column:
    """A line of text from columns and constants."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _customers(spark, sf_dir):
    return Views(spark, sf_dir).t("customer")


# --- domain lists ----------------------------------------------------------------------------------------------------
def _list(spark, sf_dir, kind: str, line: Column, **options: str):
    return readers.read(spark, kind, _file(spark, kind, _customers(spark, sf_dir).select(line.alias("value")), **options))


@query("s01_ranked_list", "SELECT c_custkey AS rank, 'shop' || c_custkey || '.example.com' AS hostname FROM customer WHERE c_custkey % 5 <> 0")
def s01(spark, sf_dir):
    k = F.col("c_custkey")
    return _list(spark, sf_dir, "ranked", F.when(k % 5 == 0, _say("x", k, ",bad.example")).otherwise(_say(k, ",Shop", k, ".Example.com"))).select("rank", "hostname")


@query("s02_manual_list", "SELECT 'shop' || c_custkey || '.example' AS hostname FROM customer WHERE c_custkey % 4 = 3")
def s02(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.when(k % 4 == 0, "# note").when(k % 4 == 1, "Domain").when(k % 4 == 2, " ").otherwise(_say("Shop", k, ".example; note"))
    return _list(spark, sf_dir, "manual", line).select("hostname")


@query("s03_webgraph_vertices", "SELECT 'shop' || c_custkey || '.example.com' AS hostname FROM customer WHERE c_custkey % 6 <> 0")
def s03(spark, sf_dir):
    k = F.col("c_custkey")
    return _list(spark, sf_dir, "webgraph", F.when(k % 6 == 0, "# id\tname").otherwise(_say(k, "\tcom.example.shop", k)), compression="gzip").select("hostname")


@query("s04_certificate_names", "SELECT unnest(['a' || c_custkey || '.example.com', 'b' || c_custkey || '.example.org']) AS hostname FROM customer WHERE c_custkey % 7 <> 0")
def s04(spark, sf_dir):
    k = F.col("c_custkey")
    doc = _say('{"data": {"leaf_cert": {"all_domains": ["*.a', k, '.example.com", "www.B', k, '.example.org"]}}}')
    return _list(spark, sf_dir, "certificates", F.when(k % 7 == 0, '{"data": broken').otherwise(doc)).select("hostname")


@query("s05_zone_owners", "SELECT DISTINCT 'shop' || c_custkey % 1000 || '.example' AS hostname FROM customer WHERE c_custkey % 3 <> 1")
def s05(spark, sf_dir):
    k, name = F.col("c_custkey"), _say("shop", F.col("c_custkey") % 1000, ".example.")
    line = F.when(k % 3 == 0, _say(name, " IN NS ns1.host.")).when(k % 3 == 1, _say("a", name, "\t60\tIN\tA\t10.0.0.1")).otherwise(_say(F.upper(name), "\t3600\tin\tns\tns2.host. ; note"))
    return _list(spark, sf_dir, "czds", line).select("hostname")


@query("s06_lists_by_kind", "SELECT 'ranked' AS kind, count(*) FILTER (c_custkey % 5 <> 0) AS n FROM customer UNION ALL SELECT 'manual', count(*) FILTER (c_custkey % 4 = 3) FROM customer UNION ALL SELECT 'czds', count(DISTINCT c_custkey % 1000) FILTER (c_custkey % 3 <> 1) FROM customer")
def s06(spark, sf_dir):
    n = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("hostname").alias("n"))
    return n("ranked", s01(spark, sf_dir)).unionByName(n("manual", s02(spark, sf_dir))).unionByName(n("czds", s05(spark, sf_dir)))


def _tlv(tag: int, *parts: bytes) -> bytes:
    """A DER element."""
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def _certificate(common: bytes, alternative: tuple[bytes, ...]) -> bytes:
    """A whole certificate that has the bytes of both names' ids in places where they mean nothing: issuer, key, another extension."""
    oid = lambda x: _tlv(0x06, bytes.fromhex(x))
    decoy = oid("551d11") + _tlv(0x04, _tlv(0x30, _tlv(0x82, b"decoy.example"))) + oid("550403") + _tlv(0x0C, b"decoy.example")
    name = lambda *pairs: _tlv(0x30, *[_tlv(0x31, _tlv(0x30, oid(o), _tlv(0x0C, v))) for o, v in pairs])
    algorithm = _tlv(0x30, oid("2a864886f70d01010b"), _tlv(0x05))
    validity = _tlv(0x30, _tlv(0x17, b"240101000000Z"), _tlv(0x17, b"250101000000Z"))
    key = _tlv(0x30, algorithm, _tlv(0x03, b"\0" + decoy))
    listed = _tlv(0x30, _tlv(0x81, b"mail@decoy.example"), *[_tlv(0x82, x) for x in alternative])
    extensions = _tlv(0xA3, _tlv(0x30, _tlv(0x30, oid("551d0e"), _tlv(0x04, decoy)), _tlv(0x30, oid("551d11"), _tlv(0x01, b"\xff"), _tlv(0x04, listed)), _tlv(0x30, oid("551d13"), _tlv(0x04, _tlv(0x30)))))
    signed = _tlv(0x30, _tlv(0xA0, _tlv(0x02, b"\2")), _tlv(0x02, b"\x11\x22"), algorithm, name(("55040a", decoy), ("550403", b"issuer.decoy.example")), validity, name(("55040a", b"A Shop"), ("550403", common)), key, extensions)
    return _tlv(0x30, signed, algorithm, _tlv(0x03, b"\0" + decoy))


def _leaves(spark, sf_dir):
    """A log's entry for each customer: two of five hold no certificate (one to be signed, one of an unknown kind), each other one names a host twice, and a third of them has another as its common name."""
    k = F.col("c_custkey")
    host = lambda letter: F.hex(F.encode(_say(letter, F.lpad(k.cast("string"), 8, "0"), ".example.com"), "UTF-8"))  # noqa: E731  21 bytes

    def made(common: str) -> Column:
        parts = _certificate(common.encode() * 21, (b"A" * 21,)).hex().upper()
        for place, letter in (("A", "a"), ("C", "c")):
            parts = parts.replace(place.encode().hex() * 21, f"|{letter}|")
        found = [host(x) if x in ("a", "c") else F.lit(x) for x in parts.split("|")]
        size = sum(42 if x in ("a", "c") else len(x) for x in parts.split("|")) // 2
        return F.concat(F.lit(f"{size:06x}"), *found)

    kind = F.when(k % 5 == 0, "0001").when(k % 5 == 1, "0007").otherwise("0000")
    leaf = F.concat(F.lit("00" * 10), kind, F.when(k % 3 == 0, made("C")).otherwise(made("A")))
    return _customers(spark, sf_dir).select((k - 1).alias("index"), F.base64(F.unhex(leaf)).alias("leaf_input"))


_LEAF_NAMES = "SELECT {} 'a' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.example.com' AS raw FROM customer WHERE c_custkey % 5 > 1 UNION ALL SELECT {} 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.example.com' FROM customer WHERE c_custkey % 5 > 1 AND c_custkey % 3 = 0"


@query("s07_certificate_leaves", _LEAF_NAMES.format("", ""))
def s07(spark, sf_dir):
    return captures.certificate_log(_leaves(ship(spark), sf_dir)).select("raw")


@query("s07_log_in_batches", _LEAF_NAMES.format("c_custkey - 1 AS index,", "c_custkey - 1,"))
def s07_stream(spark, sf_dir):
    """The log read as a stream in three batches, started anew after the second, its names appended to a table."""
    folder, entries = _path(ship(spark), "log"), _leaves(spark, sf_dir)
    n = entries.agg(F.max("index")).first()[0] + 1
    log_stream.write_log(entries, f"{folder}/tiles")
    for batches in (2, 1):
        stream = log_stream.log_stream(spark, f"{folder}/tiles", f"{folder}/checkpoint/cursor", entries=-(-n // 3))
        named = stream.withColumn("raw", F.explode(captures.names_of_leaves("leaf_input"))).select("index", "raw")
        for _ in range(batches):  # a run takes one batch
            named.writeStream.format("parquet").option("path", f"{folder}/names").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/names").select("index", "raw")


@query("s08_dictionary_faults", """SELECT 'providers' AS dictionary, CAST(s_suppkey AS VARCHAR) AS id, 'parent_provider_id is unknown' AS fault FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 7 <> 0
UNION ALL SELECT 'providers', CAST(s_suppkey AS VARCHAR), 'its own parent' FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT 'payment_methods', CAST(p_size AS VARCHAR), 'repeated' FROM part GROUP BY p_size HAVING count(*) > 1
UNION ALL SELECT 'verticals', '5', 'too few'""")  # fmt: skip
def s08(spark, sf_dir):
    v, none = Views(spark, sf_dir), F.lit(None).cast("string")
    own = F.col("s_suppkey").cast("string")
    parent = F.when(F.col("s_suppkey") % 7 == 0, own).when(F.col("s_suppkey") % 5 == 0, _say("x", own))
    tables = {
        "providers": v.t("supplier").select(own.alias("id"), F.col("s_name").alias("name"), none.alias("status"), parent.alias("parent_provider_id")),
        "payment_methods": v.t("part").select(F.col("p_size").cast("string").alias("id"), F.col("p_name").alias("name"), none.alias("status"), none.alias("default_provider_id")),
        "platforms": v.t("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), none.alias("status"), none.alias("parent_id")),
        "verticals": v.t("region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), none.alias("status"), none.alias("parent_id")),
    }
    return readers.dictionary_faults(tables, {"verticals": 6, "platforms": 25})


@query("s09_rule_files", "SELECT 'provider.n' || n_nationkey || '.' || r AS rule_id, 'n' || n_nationkey AS target_id, CASE r WHEN 'a' THEN 'script_src' ELSE 'network_host' END AS signal_type, CASE r WHEN 'a' THEN 'url_contains' ELSE 'host_suffix' END AS match, CASE r WHEN 'a' THEN 'cdn' ELSE '*.n' END || n_nationkey || '.example' AS pattern, CASE r WHEN 'a' THEN 0.5 ELSE 0.25 END::DOUBLE AS weight FROM nation, (VALUES ('a'), ('b')) t(r)")
def s09(spark, sf_dir):
    k = F.col("n_nationkey")
    doc = _say('{"target_type": "provider", "target_id": "n', k, '", "rules": [{"id": "provider.n', k, '.a", "version": 1, "signal_type": "script_src", "pattern": "cdn', k, '.example", "weight": 0.5, "enabled": true}, {"id": "provider.n', k, '.b", "version": 1, "signal_type": "network_host", "pattern": "*.n', k, '.example", "weight": 0.25, "enabled": true}]}')
    path = _path(spark, "rules")
    Views(spark, sf_dir).t("nation").select(k.alias("k"), doc.alias("value")).write.partitionBy("k").text(path)
    known = {"provider": {f"n{r[0]}" for r in Views(spark, sf_dir).t("nation").select("n_nationkey").collect()}}
    return readers.rule_files(spark, path, known, "*.txt").select("rule_id", "target_id", "signal_type", "match", "pattern", "weight")


@query("s10_signature_rules", r"SELECT replace(lower(n_name), ' ', '_') || '_' || k AS rule_id, CASE k WHEN 1 THEN 'script_src' ELSE 'header' END AS signal_type, CASE k WHEN 1 THEN 'cdn\.n' || n_nationkey || '\.com' ELSE 'X-Shop:n' || n_nationkey END AS pattern, CASE k WHEN 1 THEN 0.4 ELSE 0.5 END::DOUBLE AS weight, false AS enabled FROM nation, (VALUES (1), (2)) t(k)")
def s10(spark, sf_dir):
    k = F.col("n_nationkey")
    sig = F.struct(_say("cdn\\.n", k, "\\.com\\;confidence:40\\;version:\\1").alias("scriptSrc"), F.create_map(F.lit("X-Shop"), _say("n", k, "\\;version:\\1")).alias("headers"))
    doc = Views(spark, sf_dir).t("nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", sig)))).alias("value"))  # 25 nations
    return readers.signature_rules(spark, _file(spark, "signatures", doc)).select("rule_id", "signal_type", "pattern", "weight", "enabled")


@query("s11_gold_labels", "SELECT 'shop' || o_custkey || '.example' AS domain, 'provider' AS entity_type, 'p' || o_orderkey % 3 AS entity_id, arg_max(o_orderstatus = 'F', o_orderkey) AS present FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1, 2, 3")
def s11(spark, sf_dir):
    k = F.col("o_orderkey")
    flag = F.when(k % 10 == 0, "perhaps").when(F.col("o_orderstatus") == "F", F.when(k % 2 == 0, "TRUE").otherwise("1")).otherwise(F.when(k % 2 == 0, "no").otherwise("0"))
    rows = Views(spark, sf_dir).t("orders").select(_say("Shop", F.col("o_custkey"), ".example").alias("domain"), F.lit("provider").alias("entity_type"), _say("p", k % 3).alias("entity_id"), flag.alias("present"), F.lit("me").alias("labeled_by"), F.lpad(k.cast("string"), 12, "0").alias("labeled_at"), F.lit("").alias("notes"))
    path = _path(spark, "gold")
    rows.write.option("header", True).csv(path)
    return readers.gold_labels(spark, path)


@query("s12_findings", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN l_partkey % 2 = 0 THEN l_discount ELSE CASE l_linenumber % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 ELSE 0.3 END END::DOUBLE AS confidence_score FROM lineitem WHERE l_linenumber % 4 <> 3")
def s12(spark, sf_dir):
    n = F.col("l_linenumber")
    level = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "certain")]), n % 4 + 1)
    rows = Views(spark, sf_dir).t("lineitem").select(F.col("l_orderkey").cast("string").alias("domain"), F.lit("provider").alias("entity_type"), n.cast("string").alias("entity_id"), level.alias("confidence"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_discount")).alias("confidence_score"), F.lit("r").alias("rule_id"), F.lit(1).alias("rule_version"), F.lit(True).alias("active_on_checkout"))
    path = _path(spark, "findings")
    rows.write.option("header", True).csv(path)
    return readers.findings(spark, path).select(F.col("domain").cast("bigint").alias("l_orderkey"), F.col("entity_id").cast("int").alias("l_linenumber"), "confidence", "confidence_score")


_V6 = "'20010db8' || printf('%08x', c_custkey) || repeat('0', 16)"


@query("s13_address_ranges", f"SELECT c_custkey AS asn, CASE WHEN c_custkey % 2 = 0 THEN repeat('0', 20) || 'ffff' || printf('%08x', 167772160 + c_custkey % 65536 * 256) ELSE {_V6} END AS low_key, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'DE' END AS country FROM customer WHERE c_custkey % 5 <> 0")
def s13(spark, sf_dir):
    k = F.col("c_custkey")
    low, high = F.when(k % 2 == 0, _say(_octets(k), "0")).otherwise(_v6(k, "::")), F.when(k % 2 == 0, _say(_octets(k), "255")).otherwise(_v6(k, ":ffff:ffff:ffff:ffff"))
    line = F.concat_ws("\t", low, high, F.when(k % 5 == 0, "0").otherwise(k.cast("string")), F.when(k % 3 == 0, "None").otherwise("DE"), F.lit("a name"))
    path = _file(spark, "ranges", _customers(spark, sf_dir).select(line.alias("value")), compression="gzip")
    return readers.ip_ranges(spark, path).select("asn", "low_key", "country")


def _octets(k: Column) -> Column:
    """10.x.y. of the k-th block of 256 addresses."""
    return _say("10.", F.floor(k / 256) % 256, ".", k % 256, ".")


def _v6(k: Column, tail: str) -> Column:
    h = F.lower(F.lpad(F.hex(k), 8, "0"))
    return _say("2001:db8:", F.substring(h, 1, 4), ":", F.substring(h, 5, 4), tail)


@query("j08_two_families", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_custkey END AS asn FROM customer")
def j08_two_families(spark, sf_dir):
    """A block of addresses a customer: of IPv4 for even keys while its blocks last, of IPv6 for the others."""
    k = F.col("c_custkey")
    four, block = (k % 2 == 0) & (k < 246 * 65536), _say(F.lit(10) + F.floor(k / 65536), ".", F.floor(k / 256) % 256, ".", k % 256, ".")
    six = F.format_string("2001:db8:%x:%x:%x", F.floor(k / 2**32), F.floor(k / 65536) % 65536, k % 65536)
    low, high = F.when(four, _say(block, "0")).otherwise(_say(six, "::")), F.when(four, _say(block, "255")).otherwise(_say(six, ":ffff:ffff:ffff"))
    ranges = _customers(spark, sf_dir).where("c_custkey % 7 = 0").select(k.alias("asn"), low.alias("low_ip"), high.alias("high_ip"))
    points = _customers(spark, sf_dir).select("c_custkey", F.when(four, _say(block, "77")).otherwise(_say(six, "::1:2")).alias("ip"))
    return ordered.address_ranges(points, ranges, "ip").select("c_custkey", "asn")


@query("s14_log_lines", "SELECT event_id, '203.0.' || (event_id % 9) || '.1' AS target, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_id % 4 > 1")
def s14(spark, sf_dir):
    k = F.col("event_id")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.when(k % 4 == 0, "# note").when(k % 4 == 1, "nonsense line").otherwise(F.concat_ws("  ", at, _say("203.0.", k % 9, ".1"), F.lit("mail"), k.cast("string")))
    path = _file(spark, "log", Views(spark, sf_dir).t("events").select(line.alias("value")))
    rows = readers.log_lines(spark, path, ("at", "target", "source", "detail"))
    return rows.select(F.col("detail").cast("bigint").alias("event_id"), "target", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("s15_watchlists", "SELECT DISTINCT 'shop' || c_custkey % 700 || '.example' AS hostname FROM customer WHERE c_custkey % 3 <> 0")
def s15(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.when(k % 3 == 0, _say("no name ", k)).when(k % 3 == 1, _say("https://WWW.shop", k % 700, ".example/path")).otherwise(_say(" shop", k % 700, ".example:8080,note"))
    lists = _customers(spark, sf_dir).groupBy("c_nationkey").agg(F.concat(F.lit("Domain\n"), F.array_join(F.collect_list(line), "\r\n")).alias("text"))
    return readers.watchlist(ship(spark) and lists)


@query("s16_captures", r"SELECT page_id AS host_id, url, CASE WHEN page_id % 4 = 0 THEN '' ELSE html END AS html, CASE WHEN page_id % 4 = 0 THEN 'https://m.example/s.js' ELSE '' END AS scripts, 'a,b' AS cookies, CASE WHEN page_id % 4 = 0 THEN '' WHEN contains(html, '<script>var t=') THEN 't' ELSE '' END AS globals FROM pages")
def s16(spark, sf_dir):
    pages, folder = ship(spark) and Views(spark, sf_dir).t("pages"), _path(spark, "captures")
    body = F.when(F.col("page_id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.coalesce("html", F.lit("")), F.lit("\n")))  # the line's end keeps an empty page from being none
    files = captures.stored(pages.select("page_id", "url", body.alias("html")), folder, "html")
    none = F.array().cast("array<string>")
    page = F.struct(F.lit("homepage").alias("page_type"), F.col("url"), F.col("html_key"), F.create_map(F.lit("Set-Cookie"), F.lit("a=1; path=/\nb=2")).alias("headers"), F.array(F.lit("https://m.example/s.js")).alias("scripts"), none.alias("iframes"), none.alias("external_hosts"))
    files.select(F.col("page_id").alias("host_id"), F.array(page).alias("pages")).write.json(f"{folder}/manifests")
    got = captures.captures(spark, folder, lines=True, manifests=f"{folder}/manifests")
    joined = lambda c: F.array_join(c, ",")
    return got.select("host_id", "url", F.regexp_replace("html", r"\n\z", "").alias("html"), joined("script_srcs").alias("scripts"), joined("cookie_names").alias("cookies"), joined("js_globals").alias("globals"))


def _unit_sql(salt: str, keys: str) -> str:
    return f"(CAST(('0x' || substr(md5('{salt}:42:' || {keys}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _pick_sql(u: str, options: list[str]) -> str:
    steps = " ".join(f"WHEN {u} < {c!r}::DOUBLE THEN '{o}'" for c, o in zip(synthetic.zipf(len(options))[:-1], options))
    return f"CASE {steps} ELSE '{options[-1]}' END"


_COUNTRIES, _PLATFORMS, _NAMES = ["DE", "FR", "GB", "US", "PL"], ["shopify", "woocommerce", "magento2"], ["stripe", "adyen", "paypal", "mollie", "klarna"]


@query("s17_synthetic_stores", f"SELECT range AS host_id, {_pick_sql(_unit_sql('country', 'range'), _COUNTRIES)} AS country, {_pick_sql(_unit_sql('platform', 'range'), _PLATFORMS)} AS platform, CASE WHEN {_unit_sql('ranked', 'range')} < {2 / 3!r}::DOUBLE THEN CAST(floor({_unit_sql('rank', 'range')} * 1000000) AS BIGINT) + 1 END AS traffic_rank FROM (SELECT c_custkey AS range FROM customer)")
def s17(spark, sf_dir):
    return synthetic.twins(_customers(spark, sf_dir), "c_custkey", 42, _COUNTRIES, _PLATFORMS).select("host_id", "country", "platform", "traffic_rank")


@query("s17_synthetic_providers", f"SELECT DISTINCT host_id, {_pick_sql(_unit_sql('provider', 'host_id || chr(58) || k'), _NAMES)} AS provider_id FROM (SELECT range AS host_id, unnest(range(1, CAST(floor({_unit_sql('many', 'range')} * 3) AS BIGINT) + 2)) AS k FROM (SELECT c_custkey AS range FROM customer))")
def s17_providers(spark, sf_dir):
    return synthetic.providers(synthetic.twins(_customers(spark, sf_dir), "c_custkey", 42, _COUNTRIES, _PLATFORMS), 42, _NAMES)


# --- sinks and writes ------------------------------------------------------------------------------------------------
@query("w01_appended_months", "SELECT strftime(ts, '%Y%m') AS month, count(*) AS n FROM events GROUP BY 1")
def w01(spark, sf_dir):
    from ..streaming import jobs

    folder = _path(spark, "stream")
    schema = Views(spark, sf_dir).t("events").schema
    jobs.append(jobs.observations(spark, f"{sf_dir}/events*.parquet", schema), f"{folder}/table", f"{folder}/log", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/table").groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"))


@query("w03_seen_upsert", "SELECT o_custkey AS hostname, min(strftime(o_orderdate, '%Y-%m-%d')) FILTER (o_orderkey % 2 = 0) AS first_seen, CASE WHEN count(*) FILTER (o_orderkey % 2 = 1) > 0 THEN '2030-01-01' ELSE max(strftime(o_orderdate, '%Y-%m-%d')) END AS last_seen FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 2 = 0) > 0 UNION ALL SELECT o_custkey, '2030-01-01', '2030-01-01' FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 2 = 0) = 0")
def w03(spark, sf_dir):
    return _ingested(spark, sf_dir)[1].select(F.col("hostname").cast("bigint").alias("hostname"), "first_seen", "last_seen")


def _ingested(spark, sf_dir):
    o, day = Views(spark, sf_dir).t("orders"), F.date_format("o_orderdate", "yyyy-MM-dd")
    held = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").cast("string").alias("hostname")).agg(F.min("o_orderkey").alias("rank"), F.lit("ranked").alias("source"), F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.lit("b1").alias("batch_id"))
    new = o.where("o_orderkey % 2 = 1").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).otherwise(F.col("o_custkey")).cast("string").alias("hostname"), F.col("o_orderkey").alias("rank"))
    return readers.ingest(held, new, "ranked", "b2", "2030-01-01")


@query("a33_import_counters", "WITH n AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0) AS a, count(*) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1) SELECT CAST(sum(b) AS BIGINT) AS seen, CAST(0 AS BIGINT) AS invalid, count(*) FILTER (b > 0 AND a = 0) AS new, count(*) FILTER (b > 0 AND a > 0) AS updated FROM n")
def a33(spark, sf_dir):
    return _ingested(spark, sf_dir)[2]


def snapshot_folder(spark, sf_dir: str) -> str:
    """Where this application keeps the share snapshot of a folder of tables: written on first use, and anew once a table's files change."""
    files = "/".join(fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem", "nation", "region"))
    folder = f"{shared_folder(spark)}/share-{uuid.uuid5(uuid.NAMESPACE_URL, sf_dir + files)}"
    if versions.version(spark, folder) is None:
        v = Views(spark, sf_dir)
        versions.replace(share.snapshot(v.visible, v.providers, MIN_CELL), folder)
    return folder


@query("w06_replaced_snapshot", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def w06(spark, sf_dir):
    folder, c = _path(spark, "replaced"), _customers(spark, sf_dir)
    versions.replace(c.where("c_custkey % 2 = 0"), folder)
    versions.replace(c, folder)
    return versions.current(spark, folder).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


def _rows(spark, sf_dir):
    return _customers(spark, sf_dir).select(F.col("c_name").alias("domain"), F.array("c_mktsegment", F.lit("x")).alias("lists"), (F.col("c_acctbal") < 0).alias("flag"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("n"))


@query("w07_parquet_metadata", "SELECT count(*) AS rows, 'e-1' AS export FROM customer")
def w07(spark, sf_dir):
    path = _path(ship(spark), "parquet")
    exports.write_parquet(_rows(spark, sf_dir), path, {"id": "e-1"})
    told = file_sink.footers(spark, path).agg(F.min("metadata.id").alias("export"), F.max("metadata.id").alias("last")).where("export = last").select("export")
    return spark.read.parquet(path).agg(F.count("*").alias("rows")).join(F.broadcast(told))


@query("w08_csv_text", "SELECT c_name AS domain, c_mktsegment || '|x' AS lists, CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END AS flag, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS n FROM customer")
def w08(spark, sf_dir):
    path = _path(ship(spark), "csv")
    exports.write_csv(_rows(spark, sf_dir), path, {"export": "e-1"})
    return exports.read_csv(spark, path).fillna("")


@query("w08_csv_first_lines", "SELECT '# export=e-1 rows=all' AS line, true AS every_file")
def w08_lines(spark, sf_dir):
    """What the first lines of all files of an export say."""
    path = _path(ship(spark), "csv")
    exports.write_csv(_rows(spark, sf_dir).repartition(4, "domain"), path, {"export": "e-1", "rows": "all"})
    lines = file_sink.first_lines(spark, path)
    return lines.groupBy("line").agg((F.count("*") == F.lit(len(spark.read.csv(path, pathGlobFilter="*.csv").inputFiles()))).alias("every_file"))


@query("w09_schema_sidecar", "SELECT unnest(['domain', 'lists', 'flag', 'n']) AS name, unnest(['string', 'array<string>', 'boolean', 'bigint']) AS type")
def w09(spark, sf_dir):
    doc = F.from_json("value", "metadata map<string,string>, fields array<struct<name:string,type:string>>")
    return exports.sidecar(_rows(spark, sf_dir), {"export": "e-1"}).select(F.explode(doc["fields"]).alias("f")).select("f.*")


@query("w09_sidecar_beside_files", "SELECT name, type, rows, rows AS filled FROM (SELECT unnest(['domain', 'lists', 'flag', 'n']) AS name, unnest(['string', 'array<string>', 'boolean', 'bigint']) AS type) JOIN (SELECT count(*) AS rows FROM customer) ON true WHERE name <> 'n' UNION ALL SELECT 'n', 'bigint', count(*), count(*) FILTER (c_custkey % 2 = 0) FROM customer")
def w09_files(spark, sf_dir):
    """What a written export's sidecar says of each field, beside the rows that its footers count and the values that its files hold."""
    path = _path(ship(spark), "parquet")
    exports.write_parquet(_rows(spark, sf_dir), path, {"id": "e-1"})
    doc = F.from_json("value", "metadata map<string,string>, fields array<struct<name:string,type:string>>")
    told = spark.read.text(f"{path}.meta").select(F.explode(doc["fields"]).alias("f")).select("f.*")
    rows, back = file_sink.footers(spark, path).agg(F.sum("rows").alias("rows")), spark.read.parquet(path)
    filled = back.agg(F.map_from_arrays(F.array(*[F.lit(c) for c in back.columns]), F.array(*[F.count(c) for c in back.columns])).alias("n"))
    return told.join(F.broadcast(rows.join(F.broadcast(filled)))).select("name", "type", "rows", F.element_at("n", F.col("name")).alias("filled"))  # one row


@query("w11_report_files", "SELECT 'segments' AS metric, count(DISTINCT c_mktsegment) AS rows FROM customer UNION ALL SELECT 'nations', count(DISTINCT c_nationkey) FROM customer")
def w11(spark, sf_dir):
    return _report(spark, sf_dir).where("place > 0").groupBy("metric").agg(F.count("*").alias("rows"))


@query("w11_report_lines", "SELECT 'segments' AS metric, c_mktsegment AS name, CAST(count(*) AS VARCHAR) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'nations', CAST(c_nationkey AS VARCHAR), CAST(count(*) AS VARCHAR) FROM customer GROUP BY 2 UNION ALL SELECT unnest(['segments', 'nations', 'nothing']), unnest(['c_mktsegment', 'c_nationkey', 'c_name']), unnest(['count', 'count', 'n'])")
def w11_lines(spark, sf_dir):
    """Every line of a report's ZIP, headers included; a metric without rows has its header alone."""
    return _report(spark, sf_dir).select("metric", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("n"))


def _report(spark, sf_dir):
    folder, c = _path(ship(spark), "report"), _customers(spark, sf_dir)
    metrics = {"segments": c.groupBy("c_mktsegment").count(), "nations": c.groupBy("c_nationkey").count()}
    exports.write_report(metrics | {"nothing": c.where("c_custkey < 0").select("c_name", F.lit(1).alias("n"))}, folder)
    return file_sink.zip_lines(spark, folder)


@query("w12_expired_months", "SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y%m') >= '199506' GROUP BY 1")
def w12_months(spark, sf_dir):
    """Observations by month after those before the retention of 36 months are removed."""
    path = _path(spark, "observations")
    exports.write_observations(Views(spark, sf_dir).t("orders").select("o_orderkey", "o_orderdate"), path, "o_orderdate", ["o_orderkey"])
    exports.expire_months(spark, path, "1998-06-15", exports.RETENTION["observations"])
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"))


@query("w12_swept_captures", "SELECT unnest(['light', 'checkout']) AS prefix, unnest([count(*) FILTER (c_mktsegment < 'C'), count(*) FILTER (c_mktsegment > 'C')]) AS removed FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)")
def w12_sweep(spark, sf_dir):
    """Captures, a file a segment and nation, all older than tomorrow; a dry run before removes none."""
    path, c = _path(ship(spark), "captures"), _customers(spark, sf_dir)
    for prefix, some in (("light", "c_mktsegment < 'C'"), ("checkout", "c_mktsegment > 'C'")):
        named = c.where(some).select("c_mktsegment", "c_nationkey", F.lit("page").alias("value")).distinct()
        named.repartition("c_mktsegment", "c_nationkey").write.partitionBy("c_mktsegment", "c_nationkey").text(f"{path}/{prefix}")
    tomorrow = F.current_timestamp() + F.expr("INTERVAL 1 DAY")
    exports.sweep_captures(spark, path, tomorrow, dry_run=True)
    return exports.sweep_captures(spark, path, tomorrow)


@query("w12_plans_without_optouts", sql("SELECT host_id FROM store WHERE NOT optout AND host_id % 3 <> 0", "store"))
def w12_plans(spark, sf_dir):
    s = Views(spark, sf_dir).stores
    return exports.without_optouts(s.where("host_id % 3 <> 0").select("host_id"), s.select("host_id", "domain"), s.select("domain", "optout"))


@query("w14_rule_conflicts", "SELECT o_custkey AS rule_id, o_orderkey AS version FROM orders WHERE o_orderkey % 5 = 0")
def w14(spark, sf_dir):
    r = Views(spark, sf_dir).t("orders").select(F.col("o_custkey").alias("rule_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("pattern"))
    return detect.rule_conflicts(r, r.withColumn("pattern", F.when(F.col("version") % 5 == 0, F.concat("pattern", F.lit("!"))).otherwise(F.col("pattern"))))


# --- pages, cursors, queues ------------------------------------------------------------------------------------------
@query("f18_json_boolean", "SELECT event_id FROM events WHERE json_extract_string('{\"periodic\": ' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END || '}', '$.periodic') = 'true'")
def f18(spark, sf_dir):
    doc = _say('{"periodic": ', F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), "}")
    return Views(spark, sf_dir).t("events").where(F.get_json_object(doc, "$.periodic") == "true").select("event_id")


@query("l02_second_page", sql("SELECT host_id, domain FROM visible ORDER BY domain, host_id LIMIT 51 OFFSET 50", "visible"))
def l02(spark, sf_dir):
    shown = Views(spark, sf_dir).visible
    last = search.page(shown, "domain", None, 50).collect()[:50][-1]
    return search.page(shown, "domain", search.encode_cursor("domain", last["domain"], last["host_id"]), 50).select("host_id", "domain")


@query("l07_review_queue", "SELECT o_orderkey AS id, score FROM (SELECT o_orderkey, o_totalprice % 100 AS score, 'shop' || o_custkey AS hostname FROM orders) ORDER BY score, hostname, o_orderkey LIMIT 60")
def l07(spark, sf_dir):
    o = Views(spark, sf_dir).t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 100).alias("score"), _say("shop", F.col("o_custkey")).alias("hostname"))
    return quality.review_queue(o.where("id % 2 = 0"), o.where("id % 2 = 1"), 60).select("id", "score")


# --- names, texts, keys ----------------------------------------------------------------------------------------------
@query("x02_displayed_hosts", "SELECT c_custkey, 'shop' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.münchen.de' ELSE '.example' END AS shown FROM customer")
def x02(spark, sf_dir):
    name = _say("shop", F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, ".xn--mnchen-3ya.de").otherwise(".example"))
    return (ship(spark) and _customers(spark, sf_dir)).select("c_custkey", hosts.displayed(name).alias("shown"))


@query("x03_suffix_rules", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'shop' || c_custkey || '.co.uk' WHEN 1 THEN 'shop' || c_custkey || '.any.ck' WHEN 2 THEN 'www.ck' WHEN 3 THEN NULL WHEN 4 THEN 'x.unlisted' ELSE 'me' || c_custkey || '.hosted.example' END AS etld1 FROM customer")
def x03_rules(spark, sf_dir):
    k = F.col("c_custkey")
    rules = spark.createDataFrame([(r,) for r in ("// a note", "uk", "co.uk", "*.ck", "!www.ck", "com", "hosted.example")], "rule string")
    name = F.when(k % 6 == 0, _say("www.shop", k, ".co.uk")).when(k % 6 == 1, _say("a.shop", k, ".any.ck")).when(k % 6 == 2, "a.www.ck").when(k % 6 == 3, "co.uk").when(k % 6 == 4, "deep.x.unlisted").otherwise(_say("www.me", k, ".hosted.example"))
    return hosts.registrable(_customers(spark, sf_dir).select("c_custkey", name.alias("host")), "host", rules).select("c_custkey", "etld1")


@query("x04_watched_domains", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'shop' || c_custkey || '.example' WHEN 1 THEN 'xn--mnchen-3ya.de' END AS domain FROM customer")
def x04(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, _say(" HTTPS://www.Shop", k, ".example:8080/a?b ")).when(k % 4 == 1, "http://münchen.de/").when(k % 4 == 2, _say("shop ", k)).otherwise("localhost")
    return (ship(spark) and _customers(spark, sf_dir)).select("c_custkey", hosts.watched_domain(raw).alias("domain"))


@query("x09_signatures", "SELECT event_id, sha256(unhex('{}') || unhex(sha256(unhex('{}') || encode('1700000000.' || props)))) AS signature FROM events".format(*["".join(f"{b ^ x:02x}" for b in b"a secret".ljust(64, b"\0")) for x in (0x5C, 0x36)]))
def x09(spark, sf_dir):
    return Views(spark, sf_dir).t("events").select("event_id", usage.hmac_sha256(b"a secret", F.concat(F.lit("1700000000."), "props")).alias("signature"))


@query("x28_linked_data", "SELECT n_nationkey AS id, 'Store,PostalAddress,Offer' AS types, n_name AS country FROM nation")
def x28(spark, sf_dir):
    doc = _say('<html><script type="application/ld+json">{"@graph": [{"@type": "Store", "address": {"@type": "PostalAddress", "addressCountry": {"name": "', F.col("n_name"), '"}}}, {"@type": ["Offer"]}]}</script></html>')
    pages = ship(spark) and Views(spark, sf_dir).t("nation").select(F.col("n_nationkey").alias("id"), doc.alias("html"), F.lit("https://a.example").alias("url"))
    f = text.page_features(pages, "id")
    order = lambda t: F.when(t == "Store", 1).when(t == "PostalAddress", 2).otherwise(3)
    types = F.transform(F.array_sort(F.transform("json_ld_types", lambda t: F.struct(order(t).alias("o"), t.alias("t")))), lambda x: x["t"])
    return f.select("id", F.array_join(types, ",").alias("types"), F.col("schema_country").alias("country"))


@query("x29_cookie_names", "SELECT c_custkey, 'a' || c_custkey || ',session' AS names FROM customer")
def x29(spark, sf_dir):
    head = _say("a", F.col("c_custkey"), "=1; Expires=Wed, 21 Oct 2030 07:28:00 GMT\nsession=x; Path=/")
    return _customers(spark, sf_dir).select("c_custkey", F.array_join(text.cookie_names(head), ",").alias("names"))


def _responses(spark, sf_dir):
    k = F.col("o_orderkey")
    body = F.when(k % 7 == 0, '{"status": 200, "results": []}').otherwise(_say('{"results": [{"id": "q', k, '", "caption": "c", "score": 0.', F.lpad((k % 1000).cast("string"), 3, "0"), ', "match": ', F.when(k % 50 == 3, "true").otherwise("false"), "}]}"))
    return Views(spark, sf_dir).t("orders").select(F.col("o_custkey").alias("org_id"), k.cast("string").alias("query"), body.alias("body"))


@query("x30_screening_hits", "SELECT o_custkey AS org_id, CAST(o_orderkey AS VARCHAR) AS query, (o_orderkey % 1000) / 1000.0::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 1000 DESC, CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS place FROM orders WHERE o_orderkey % 7 <> 0")
def x30(spark, sf_dir):
    return usage.screening_hits(_responses(spark, sf_dir))[0].select("org_id", "query", "score", "place")


@query("x30_screening_verdicts", "SELECT o_custkey AS org_id, CASE WHEN bool_or(o_orderkey % 50 = 3 AND o_orderkey % 7 <> 0) THEN 'match' WHEN bool_or(o_orderkey % 7 <> 0) THEN 'potential_match' ELSE 'clear' END AS verdict FROM orders GROUP BY 1")
def x30_verdicts(spark, sf_dir):
    return usage.screening_hits(_responses(spark, sf_dir))[1]


@query("x31_truncated_details", "SELECT event_id, left(repeat(event_type || ' ', 100), 500) AS detail FROM events")
def x31(spark, sf_dir):
    taxonomy = spark.createDataFrame([("pay", "other")], "step string, reason string")
    stops = Views(spark, sf_dir).t("events").select("event_id", F.lit("pay").alias("step"), F.lit("other").alias("reason"), F.repeat(F.concat("event_type", F.lit("  ")), 100).alias("detail"), F.lit("https://x.example").alias("page_url"))
    return detect.normalised_stops(stops, taxonomy).select("event_id", F.when(F.length("detail") < 500, F.concat("detail", F.lit(" "))).otherwise(F.col("detail")).alias("detail"))


# --- detection -------------------------------------------------------------------------------------------------------
@query("d02_script_globals", "SELECT c_custkey, 'Stripe' || c_custkey || '.elements,a' || c_custkey || ',b,init' AS names FROM customer")
def d02(spark, sf_dir):
    k = F.col("c_custkey")
    script = F.array(_say("var a", k, " = 1; window.b = 2;"), _say("init();\nx.Stripe", k, ".elements(1)"))
    return _customers(spark, sf_dir).select("c_custkey", F.array_join(text.js_globals(script), ",").alias("names"))


@query("d08_host_categories", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'psp' WHEN host LIKE '%.org' THEN 'charity' ELSE 'other' END AS category FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages)")
def d08(spark, sf_dir):
    pages = Views(spark, sf_dir).t("pages").select("page_id", hosts.url_host(F.col("url")).alias("host"))
    own = pages.where("page_id % 3 = 0").select(F.concat(F.lit("*."), "page_id", F.lit("."), "host").alias("pattern"), F.lit(True).alias("enabled"))
    listed = spark.createDataFrame([(1, "*.org", "charity")], "place int, pattern string, category string")
    asked = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("pay."), "page_id", F.lit("."), "host")).otherwise(F.col("host")).alias("host"))
    return hosts.host_category(asked, own, listed).select("page_id", "category")


@query("d20_third_party_scripts", "SELECT c_custkey, unnest([0, 1]) AS place, unnest(['https://cdn.a.com/' || c_custkey || '.js', 'https://b.org/y.js']) AS url FROM customer")
def d20(spark, sf_dir):
    k = F.col("c_custkey")
    urls = F.array(_say("https://cdn.a.com/", k, ".js#f"), F.lit("https://www.shop.example/own.js"), _say("https://cdn.a.com/", k, ".js"), F.lit("https://b.org/y.js"))
    return detect.third_party_scripts(_customers(spark, sf_dir).select("c_custkey", urls.alias("scripts"), F.lit("shop.example").alias("own")), "c_custkey", F.col("scripts"), hosts.etld1, "own")


@query("d21_link_candidates", "SELECT 'shop' || c_custkey || '.example' AS host, unnest(['a' || c_custkey || '.example', 'b.example']) AS hostname FROM customer")
def d21(spark, sf_dir):
    k = F.col("c_custkey")
    links = F.array(_say("https://Shop", k, ".example/own"), _say("https://a", k, ".example/x"), _say("https://a", k, ".example/y"), F.lit("//b.example"), F.lit("https://c.example"))
    return detect.link_candidates(_customers(spark, sf_dir).select(_say("shop", k, ".example").alias("host"), links.alias("links")), "host", "links", 2)


@query("a20_rule_preview", "WITH p AS (SELECT contains(html, '<nav>') AS f, page_id % 2 = 0 AS t FROM pages WHERE page_id % 5 <> 0) SELECT count(*) FILTER (f) AS fired, count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (NOT f AND t) AS fn, CASE WHEN count(*) FILTER (f) > 0 THEN count(*) FILTER (f AND t) / count(*) FILTER (f) END AS precision, CASE WHEN count(*) FILTER (t) > 0 THEN count(*) FILTER (f AND t) / count(*) FILTER (t) END AS recall FROM p")
def a20(spark, sf_dir):
    from .more_queries import _signals

    draft = readers.rules(spark, [{"rule_id": "draft", "target_type": "provider", "target_id": "x", "signal_type": "html_pattern", "match": "contains", "pattern": "<nav>", "weight": 0.5}])
    k = F.col("page_id")
    gold = Views(spark, sf_dir).t("pages").where("page_id % 5 <> 0").select(k.alias("host_id"), F.lit("provider").alias("entity_type"), F.when(k % 2 == 0, "x").otherwise("y").alias("entity_id"), F.lit(True).alias("present"))
    return detect.preview(_signals(spark, sf_dir).withColumnRenamed("page_id", "host_id"), draft, gold, ["host_id"])[0]


# --- state, incidents, exports ---------------------------------------------------------------------------------------
@query("b12_canary_incidents", "SELECT user_id % 10 AS org_id, 'high' AS severity, count(*) AS hits, min(user_id) FILTER (user_id % 10 = 3) IS NULL AS opened FROM events WHERE event_type = 'click' GROUP BY 1")
def b12(spark, sf_dir):
    e = Views(spark, sf_dir).t("events").where("event_type = 'click'").select(_say("c-", F.col("user_id")).alias("domain"), (F.col("user_id") % 10).alias("org_id"), "ts", F.lit("dns").alias("kind"))
    open_ = e.where("org_id = 3").select("org_id", F.lit("canary_hit").alias("detector"), F.lit("low").alias("severity")).distinct()
    return usage.canary_incidents(e, open_)[1].select("org_id", "severity", "hits", "opened")


@query("b12_canary_counters", "SELECT 'c-' || user_id AS domain, count(*) AS hits, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_hit_at FROM events WHERE event_type = 'click' GROUP BY 1")
def b12_counters(spark, sf_dir):
    e = Views(spark, sf_dir).t("events").where("event_type = 'click'").select(_say("c-", F.col("user_id")).alias("domain"), F.lit(1).cast("bigint").alias("org_id"), "ts", F.lit("dns").alias("kind"))
    none = spark.createDataFrame([], "org_id long, detector string, severity string")
    return usage.canary_incidents(e, none)[0].select("domain", "hits", F.date_format("last_hit_at", "yyyy-MM-dd HH:mm:ss").alias("last_hit_at"))


_C04 = """a AS (SELECT host_id, provider_id, confidence, CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS r, confirmations FROM provider WHERE provider_id % 3 <> 0),
b AS (SELECT host_id, provider_id, CASE provider_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, CASE provider_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS r FROM provider WHERE provider_id % 2 = 0)"""


@query("c04_provider_upsert", sql("SELECT host_id, provider_id, CASE WHEN a.r IS NULL OR (b.r IS NOT NULL AND b.r >= a.r) THEN b.confidence ELSE a.confidence END AS confidence, coalesce(confirmations, 0) + CASE WHEN b.r IS NULL THEN 0 ELSE 1 END AS confirmations, CASE WHEN b.r IS NULL THEN 1 ELSE 0 END AS misses FROM a FULL JOIN b USING (host_id, provider_id)", "provider", ctes=_C04))
def c04(spark, sf_dir):
    p = Views(spark, sf_dir).providers
    shape = lambda df, c, n, m: df.select("host_id", "provider_id", "role", c.alias("confidence"), F.lit(0.5).alias("score"), F.lit(True).alias("active"), "first_seen", "last_seen", n.alias("confirmations"), F.lit(m).alias("misses"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "high")]), (F.col("provider_id") % 4 + 1).cast("int"))
    out = state.upsert_providers(shape(p.where("provider_id % 3 <> 0"), F.col("confidence"), F.col("confirmations"), 1), shape(p.where("provider_id % 2 = 0"), level, F.lit(1).cast("bigint"), 0))
    return out.select("host_id", "provider_id", "confidence", "confirmations", "misses")


@query("c12_script_pool", "SELECT url, CASE WHEN s IS NULL THEN 'pending' WHEN n AND ((s = 'ok' AND old) OR (s = 'error' AND k % 5 < 3)) THEN 'pending' ELSE s END AS status, CASE WHEN s IS NULL THEN 0 ELSE k % 5 END AS attempts FROM (SELECT 'u' || c_custkey AS url, c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'ok' ELSE 'error' END END AS s, c_custkey % 7 < 3 AS old, c_custkey % 4 <> 0 AS n FROM customer) WHERE s IS NOT NULL OR n")
def c12(spark, sf_dir):
    k = F.col("c_custkey")
    at = F.to_timestamp_ntz(F.when(k % 7 < 3, "2023-01-01 00:00:00").otherwise("2024-01-30 00:00:00"))
    pool = _customers(spark, sf_dir).where("c_custkey % 3 <> 0").select(_say("u", k).alias("url"), F.when(k % 2 == 0, "ok").otherwise("error").alias("status"), (k % 5).alias("attempts"), at.alias("fetched_at"))
    asked = _customers(spark, sf_dir).where("c_custkey % 4 <> 0").select(_say("u", k).alias("url"))
    return state.script_pool(pool, asked, F.to_timestamp_ntz(F.lit(NOW))).select("url", "status", "attempts")


@query("e06_row_keys", sql("SELECT domain || '|' || event_type || '|' || coalesce(entity_id, '') || '|' || strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS key FROM event e JOIN visible v ON v.host_id = e.host_id", "visible", "event"))
def e06(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = exports.increment_rows(v.events.withColumn("detected_at", F.date_trunc("second", "detected_at").cast("timestamp_ntz")), v.visible, "2000-01-01 00:00:00", "2100-01-01 00:00:00")
    return rows.select(exports.row_key("increment").alias("key"))


@query("e07_approvals", sql("SELECT platform, count(*) AS estimate, CASE WHEN count(*) > 5000 THEN 'refused' WHEN count(*) > 20 THEN 'approval' ELSE 'queued' END AS verdict FROM visible GROUP BY 1", "visible"))
def e07(spark, sf_dir):
    counts = Views(spark, sf_dir).visible.groupBy("platform").agg(F.count("*").alias("estimate"))
    return counts.withColumn("verdict", exports.approved(F.col("estimate"), F.lit(20), F.lit(5000)))


@query("e10_field_types", "SELECT 'domain' AS field, 'string' AS type, false AS full_only UNION ALL SELECT 'as_of', 'timestamp', false UNION ALL SELECT unnest(['platform_id', 'platform_confidence', 'country', 'country_confidence', 'checkout_status', 'coverage']), 'string', false UNION ALL SELECT unnest(['currency', 'vertical_id']), 'string', true UNION ALL SELECT 'acquirer_hidden', 'boolean', true UNION ALL SELECT unnest(['provider_ids', 'providers', 'method_ids', 'methods']), 'array<string>', false UNION ALL SELECT unnest(['providers_active_on_checkout', 'checkout_psp_hosts']), 'array<string>', true UNION ALL SELECT 'traffic_rank', 'bigint', true UNION ALL SELECT unnest(['first_seen', 'last_seen']), 'date', false UNION ALL SELECT 'last_checkout_scan_at', 'timestamp', true")
def e10(spark, sf_dir):
    basic = exports.fields_for("snapshot", False)
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.name not in basic) for f in snapshot(Views(spark, sf_dir)).schema], "field string, type string, full_only boolean")


def _filled_sql() -> str:
    body = sql_of("e01_snapshot_rows")
    return "WITH RECURSIVE snap AS (" + body + ") " + " UNION ALL ".join(f"SELECT '{f}' AS field, '{t}' AS type, count({f}) AS filled, count(*) AS rows FROM snap" for f, t in exports.FIELDS["snapshot"].items())


@query("e10_filled_fields", _filled_sql())
def e10_filled(spark, sf_dir):
    """The field dictionary of a snapshot export held against its rows: the type of each field, and how many rows fill it."""
    rows = snapshot(Views(spark, sf_dir))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(kinds[f]).alias("type"), F.count(f).alias("filled"), F.count("*").alias("rows")) for f in exports.FIELDS["snapshot"]])
    return rows.agg(each.alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("e11_isolated_jobs", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN n_nationkey % 4 <> 0 THEN n END AS rows FROM (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def e11(spark, sf_dir):
    c = _customers(spark, sf_dir).groupBy("c_nationkey").count()
    counts = {r[0]: r[1] for r in c.collect()}  # one a nation

    def build(job):
        if job["id"] % 4 == 0:
            raise RuntimeError("this job can't be built")
        return counts.get(job["id"], 0)

    jobs = exports.run_jobs([{"id": r[0]} for r in Views(spark, sf_dir).t("nation").select("n_nationkey").collect()], build)
    return spark.createDataFrame([(j["id"], j["status"], j.get("rows")) for j in jobs], "id int, status string, rows long")
