"""Addresses, as-of joins, folds over slices, exact ranks and logs, against brute force."""

import base64
import bisect
import ipaddress
import math
import random

import pytest
from pyspark.sql import functions as F

from tillwatch.functions import addresses
from tillwatch.operators import ordered, state, visibility
from tillwatch.plans import source_queries
from tillwatch.sources import captures, log_stream

R = random.Random(5)


@pytest.fixture(autouse=True)
def many_slices(spark):
    """Slices stay apart, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def some_addresses(n):
    """Sound and unsound addresses of both families in many spellings."""
    out = [None, "", ":", "::", ":::", "::1", "1::", "1:2", "1::2::3", "1:::2", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "fe80::1%eth0", "fe80::1%", "::ffff:1.2.3.4", "::1.2.3.4", "1.2.3.4::", "::1.2.3", "::1.2.3.400",
           "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "01.2.3.4", "1.2.3.4.5", "1.2.3", "256.1.1.1", "g::", "12345::", " 1.2.3.4", "1.2.3.4 ", "not-an-ip", "64:ff9b::a00:1", "::ffff:10.0.0.1", "ff02::1", "fd12::1", "8.8.8.8", "2606:4700::6810:84e5"]
    for _ in range(n):
        if R.random() < 0.4:
            out.append(str(ipaddress.IPv4Address(R.choice([R.getrandbits(32), R.choice([10, 100, 127, 169, 172, 192, 198, 203, 224]) << 24 | R.getrandbits(24)]))))
        else:
            a = ipaddress.IPv6Address(R.choice([R.getrandbits(128), R.getrandbits(16), 0xFFFF << 32 | R.getrandbits(32), R.choice([0xFE80, 0xFC00, 0x2001, 0x64]) << 112 | R.getrandbits(112)]))
            out.append(R.choice([a.compressed, a.exploded, a.compressed.upper()]))
    return out


def parsed(ip):
    try:
        return ipaddress.ip_address(ip) if ip is not None else None
    except ValueError:
        return None


def test_addresses_as_a_library_reads_them(spark):
    seen = some_addresses(400)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(seen)], "k int, ip string")
    got = {r.k: r for r in df.select("k", addresses.address(F.col("ip")).alias("a"), addresses.forbidden(F.col("ip")).alias("no")).collect()}
    nets = [ipaddress.ip_network(n) for n in addresses.FORBIDDEN]
    for k, x in enumerate(seen):
        a = parsed(x)
        assert (got[k].a and (got[k].a.family, int(got[k].a.digits, 16))) == (a and (a.version, int(a))), x
        b = a.ipv4_mapped or a if isinstance(a, ipaddress.IPv6Address) else a
        assert got[k].no == (b is None or b.is_multicast or b.is_unspecified or b.is_loopback or b.is_link_local or any(b in n for n in nets)), x


def test_allow_lists_of_both_families(spark):
    entries = [("a", "10.0.0.0/8"), ("a", "fe80::/10"), ("a", "2001:db8::1"), ("b", "0.0.0.0/0"), ("c", "::/0"), ("c", "bad"), ("d", "bad"), ("d", "1.2.3.4/"), ("d", "1.2.3.4/33"), ("d", "1.2.3.4/8/9"), ("d", None), ("e", "192.168.7.9/13"), ("e", "192.0.0.0/3"), ("e", "ffff::9/7"), (None, "10.0.0.0/8")]
    ips = some_addresses(150)
    df = spark.createDataFrame([(o, x) for o in ("a", "b", "c", "d", "e", "f") for x in ips], "org_id string, ip string")
    got = {(r.org_id, r.ip): r.allowed for r in visibility.ip_allowed(df, spark.createDataFrame(entries, "org_id string, cidr string")).collect()}

    def allowed(org, ip):
        mine, a = [c for o, c in entries if o == org], parsed(ip)
        nets = []
        for c in mine:
            try:
                nets.append(ipaddress.ip_network(c, strict=False))
            except (ValueError, TypeError):
                pass
        return not mine or (a is not None and any(a in n for n in nets))

    assert got == {(o, x): allowed(o, x) for o in ("a", "b", "c", "d", "e", "f") for x in ips}


@pytest.mark.parametrize("hot", [False, True])
def test_as_of(spark, monkeypatch, hot):
    points = [(k, None if k % 50 == 0 else 500 if hot and k % 2 else R.randint(0, 1000), "x") for k in range(600)]
    starts = sorted(R.sample(range(100, 900), 40))
    a = spark.createDataFrame(points, "id long, at long, low string").repartition(5)
    b = spark.createDataFrame([(s, -s) for s in starts] + [(None, 1)], "low long, name long").repartition(3)
    rows = ordered.as_of(a, F.col("at"), b, F.col("low"))
    got = {r.id: (r.at, r.low, r.found and (r.found.low, r.found.name)) for r in rows.collect()}
    for k, at, low in points:
        n = bisect.bisect_right(starts, at) if at is not None else 0
        assert got[k] == (at, low, (starts[n - 1], -starts[n - 1]) if n else None)
    assert len(got) == rows.count() == 600
    assert ordered.as_of(a.limit(0), F.col("at"), b, F.col("low")).count() == 0
    assert {r.found for r in ordered.as_of(a, F.col("at"), b.limit(0), F.col("low")).collect()} == {None}


def test_hot_points_are_spread(spark):
    a = spark.createDataFrame([(7,)] * 4000, "at long").repartition(6)
    tasks = ordered.sliced(a, "at").groupBy("_slice").count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 2500


def test_ranges_of_very_different_size(spark):
    nets = ["2000::/3", "fd00:0:0::/48", "fd00:0:1::/48", "fd00:0:3::/48", "4000::/12", "10.0.0.0/8", "11.0.0.0/24", "::ffff:0:0/96", "11.0.1.0/32"]
    ends = [(k, ipaddress.ip_network(n)) for k, n in enumerate(nets)]
    ranges = spark.createDataFrame([(k, str(n[0]), str(n[-1])) for k, n in ends] + [(97, "9.0.0.9", "9.0.0.1"), (98, "9.0.0.1", "::9"), (99, "rubbish", "9.0.0.1")], "asn long, low_ip string, high_ip string")
    ips = [str(x) for _, n in ends for x in (n[0], n[-1])] + [str(type(n[0])(min(max(int(x) + d, 0), 2 ** n.max_prefixlen - 1))) for _, n in ends for x, d in ((n[0], -1), (n[-1], 1))] + [None, "rubbish", "9.0.0.5", "::ffff:10.0.0.1"]
    found = ordered.address_ranges(spark.createDataFrame([(x,) for x in ips], "ip string"), ranges, "ip")
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {x: next((k for k, n in ends if parsed(x) is not None and parsed(x) in n), None) for x in ips}
    assert {r.ip: r.asn for r in found.collect()} == want


def test_token_bucket_of_a_hot_key(spark):
    at = sorted(R.uniform(0, 300) for _ in range(700)) + [300.0] * 200
    rows = [("hot", t, k) for k, t in enumerate(at)] + [(k, float(t), 0) for k in ("a", None) for t in (5, 5, 6, 90)]
    df = spark.createDataFrame(rows, "key string, at double, id long").repartition(4)
    assert ordered.sliced(df.where("key = 'hot'"), "key", "at").select("_slice").distinct().count() > 1
    found = state.token_bucket(df, 2.0, 5.0)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.key, []).append((r.at, r.wait))
    for key, mine in got.items():
        tokens, last, want = 5.0, None, []
        for t in sorted(t for k, t, _ in rows if k == key):
            tokens = min(5.0, tokens + (t - (t if last is None else last)) * 2.0) - 1
            last = t
            want.append((t, max(0.0, -tokens / 2.0)))
        assert [(t, pytest.approx(w, abs=1e-6)) for t, w in want] == sorted(mine)
    assert set(got) == {"hot", "a", None}


def test_limits_of_a_hot_network(spark):
    rows = [("hot", k // 3, k, R.choice(["complaint"] * 5 + ["lift"]), R.choice([0.9, 0.5, 0.3, 1.0])) for k in range(900)]
    rows += [("few", 1, 1, "complaint", 0.9), ("few", 2, 2, "complaint", 0.8), ("lifted", 1, 1, "complaint", 0.7), ("lifted", 1, 2, "lift", None), ("none", 1, 1, "lift", None), ("late", 1, 1, "lift", None), ("late", 2, 1, "complaint", 0.001), ("long", 0, 0, "complaint", 1.0)] + [("long", k, k, "complaint", 1.0) for k in range(1, 2000)]
    df = spark.createDataFrame(rows, "asn string, ts int, id long, kind string, factor double").repartition(4)
    want = {}
    for asn, _, _, kind, factor in sorted(rows, key=lambda r: r[:3]):
        f, n, lifted = want.get(asn, (None, 0, False))
        if kind == "lift":
            want[asn] = (f, n, n > 0)
        else:
            want[asn] = (factor if n == 0 or lifted else max(0.01, min(f, factor) / 2), n + 1, False)
    found = state.fold_limits(df)
    assert {r.asn: (r.factor, r.complaints, r.lifted) for r in found.collect()} == {k: v for k, v in want.items() if v[1]}
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sorted_rows, ranges", [(4, 256), (10_000, 1024)])
def test_order_statistics(spark, monkeypatch, sorted_rows, ranges):
    monkeypatch.setattr(ordered, "SORTED_ROWS", sorted_rows)
    monkeypatch.setattr(ordered, "RANGES", ranges)
    groups = {"ties": [1.0] * 40 + [2.0] * 3, "wide": [10.0 ** R.randint(-9, 9) * R.choice([1, -1]) for _ in range(60)], "one": [4.5], None: [3.0, 1.0], "none": [None, None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", float("nan")), ("wide", float("inf")), ("wide", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    near = {r.g: (r.least, r.p50, r.p95, r.most) for r in ordered.order_statistics(df, F.col("v"), {"least": 0.0, "p50": 0.5, "p95": 0.95, "most": 1.0}, ("g",)).collect()}
    mid = {r.g: r.middle for r in ordered.order_statistics(df, F.col("v"), {"middle": 0.5}, ("g",), between=True).collect()}
    for g, vs in groups.items():
        s = sorted(v for v in vs if v is not None)
        assert near[g] == (tuple(s[max(1, math.ceil(f * len(s) - 1e-12)) - 1] for f in (0.0, 0.5, 0.95, 1.0)) if s else (None,) * 4)
        assert mid[g] == ((s[(len(s) - 1) // 2] + (s[len(s) // 2] - s[(len(s) - 1) // 2]) * ((len(s) - 1) / 2 % 1)) if s else None)
    whole = spark.createDataFrame([(2**62 + k,) for k in range(50)], "v long")
    assert ordered.order_statistics(whole, F.col("v"), {"p": 0.3}).collect()[0].p == 2**62 + 14
    assert ordered.order_statistics(whole.limit(0), F.col("v"), {"p": 0.3}, ("v",)).count() == 0


def test_certificates_with_decoys():
    der = source_queries._certificate(b"common.example", (b"a.example", b"www.a.example"))
    names = ["a.example", "www.a.example", "common.example"]
    assert captures.certificate_names(der) == names
    leaf = lambda kind, body: b"\0" * 10 + kind + len(body).to_bytes(3, "big") + body
    assert captures.leaf_names(leaf(b"\0\0", der)) == names
    assert captures.leaf_names(leaf(b"\0\1", der)) is None
    assert captures.leaf_names(b"\0" * 4) == captures.leaf_names(leaf(b"\0\x09", der)) == captures.leaf_names(leaf(b"\0\0", b"garbage")) == captures.leaf_names(leaf(b"\0\0", b"")) == []
    for cut in range(len(der)):
        assert captures.leaf_names(leaf(b"\0\0", der[:cut])) == []
    assert captures.certificate_names(source_queries._certificate(b"No dot", (b"x.example",))) == ["x.example"]
    assert captures.certificate_names(source_queries._certificate(b"x.example", (b"x.example",))) == ["x.example"]


def entries(spark, n, start=0):
    return spark.createDataFrame([(k, base64.b64encode(f"leaf {k}".encode()).decode()) for k in range(start, n)], "index long, leaf_input string")


def test_log_restarts_where_it_ended(spark, tmp_path):
    tiles, out = f"{tmp_path}/tiles", f"{tmp_path}/out"
    log_stream.write_log(entries(spark, 25), tiles, tile=10)
    assert sorted(r["index"] for r in log_stream.log(spark, tiles, 10).collect()) == list(range(25))
    assert sorted(r["index"] for r in log_stream.log(spark, tiles, 10, start=17).collect()) == list(range(17, 25))
    sizes = []

    def put(batch, n):
        sizes.append(batch.count())
        if len(sizes) == 2:
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    def run():
        s = log_stream.log_stream(spark, tiles, f"{tmp_path}/cp/cursor", 10, entries=12)
        return s.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()

    run().awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    run().awaitTermination()  # takes the lost batch again
    run().awaitTermination()
    run().awaitTermination()
    assert sorted(r["index"] for r in spark.read.parquet(out).collect()) == list(range(25))
    assert max(sizes) == 12


def test_names_of_texts_that_are_no_base64(spark):
    df = spark.createDataFrame([("?",), (None,), ("AAAA",)], "leaf_input string")
    assert captures.certificate_log(df).count() == 0
