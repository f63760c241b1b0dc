"""Edge cases of sources, detection, state and versions that the registered queries don't meet."""

import gzip
import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tillwatch.functions import addresses, hosts, text
from tillwatch.operators import detect, state, usage, versions
from tillwatch.plans import source_queries
from tillwatch.sources import captures, readers


@pytest.mark.parametrize(
    "pattern, literal",
    [("powered by (\\w+)", "powered by "), ("a|b", ""), ("abc?d", "ab"), ("x[abc]yz+", "yz"), ("cdn\\.Shop\\.com", "cdn.shop.com"), ("(?:abc)def", "def"), ("ab{2}cde", "cde"), ("", ""), ("\\d+", ""), ("[]x]long", "long")],
)
def test_literals_of_patterns(pattern, literal):
    assert detect.literal_of(pattern, True) == literal


def test_literal_is_in_every_match():
    r = random.Random(2)
    parts = ["ab", "c?", "d+", "(e|f)", "[gh]", "x{2}", "\\.", "i*", "jk", "."]
    for _ in range(300):
        pattern = "".join(r.choice(parts) for _ in range(r.randrange(1, 7)))
        for _ in range(40):
            s = "".join(r.choice("abcdefghijkx.") for _ in range(12))
            if m := re.search(pattern, s):
                assert detect.literal_of(pattern, True) in m[0]


def test_literals_are_found_in_one_pass():
    literals = {"ab": [0], "b": [1], "": [2], "abc": [3], "x": [4]}
    built = detect._automaton(literals)
    for s in ("", "abc", "cab", "xb", "zzz"):
        assert detect._held(built, s) == {k for w, ks in literals.items() if w in s for k in ks}
    assert detect._held(detect._automaton({"": [7]}), "any") == {7}


@pytest.mark.parametrize("shard", [1, 2, 1000])
def test_rules_in_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(detect, "SHARD_RULES", shard)
    rules = spark.createDataFrame([(f"r{k}", 1, "html_pattern", "contains", p) for k, p in enumerate(["ab", "b", "abc", "x", "AB"])], "rule_id string, version int, signal_type string, match string, pattern string")
    signals = spark.createDataFrame([(1, "html_pattern", "zabc"), (2, "html_pattern", None), (3, "html_pattern", "X"), (4, "cookie", "ab")], "id long, signal_type string, value string")
    found = {(r.id, r.rule_id) for r in detect.candidates(signals, rules, ["id"]).collect()}
    assert found == {(1, "r0"), (1, "r1"), (1, "r2"), (1, "r4"), (3, "r3")}
    assert detect.candidates(signals, rules.limit(0), ["id"]).count() == 0


def test_links_keep_their_order(spark):
    df = spark.createDataFrame([("s.example", [f"https://{h}.example/" for h in ("z", "a", "s", "z", "m", "b")]), ("s.example", ["https://q.example"])], "host string, links array<string>")
    assert {r.hostname for r in detect.link_candidates(df, "host", "links", 3).collect()} == {"q.example", "z.example", "a.example"}


def test_readers_see_changed_tables(spark, tmp_path):
    from tillwatch.plans import analog

    spark.range(3).write.parquet(f"{tmp_path}/region.parquet")
    assert analog.table(spark, str(tmp_path), "region").columns == ["id"]
    spark.range(3).selectExpr("id", "id as more").write.mode("overwrite").parquet(f"{tmp_path}/region.parquet")
    assert analog.table(spark, str(tmp_path), "region").columns == ["id", "more"]


def test_preview_counts_labelled_hosts_only(spark):
    none = F.array().cast("array<string>")
    pages = spark.createDataFrame([(1, "a shopify b"), (2, "none"), (3, "Shopify"), (4, "shopify"), (5, None)], "host_id long, html string")
    signals = pages.select("host_id", F.lit("cart").alias("page_type"), F.lit("u").alias("url"), "html", F.create_map().cast("map<string,string>").alias("headers"), *[none.alias(c) for c in ("cookie_names", "script_srcs", "iframe_srcs", "form_actions", "network_hosts", "js_globals", "checkout_labels")], F.lit(None).cast("string").alias("favicon_sha256"))
    gold = spark.createDataFrame([(1, "platform", "s", True), (2, "platform", "s", True), (3, "platform", "t", True), (5, "platform", "s", False), (4, "provider", "s", True)], "host_id long, entity_type string, entity_id string, present boolean")
    draft = readers.rules(spark, [{"rule_id": "d", "target_type": "platform", "target_id": "s", "signal_type": "html_pattern", "match": "regex", "pattern": "shop[a-z]+y", "weight": 0.5}])
    counts, wrong = detect.preview(signals, draft, gold, ["host_id"])
    assert tuple(counts.first()) == (2, 1, 1, 1, 0.5, 0.5) and [r.host_id for r in wrong.collect()] == [3]


def _walk(scans, start):
    """Change detection, scan by scan, as words say it."""
    known, events = {k: list(v) for k, v in start.items()}, []
    for scan, seen in scans:
        for n in seen:
            c = known.setdefault(n, [0, 0])
            c[0], c[1] = c[0] + 1, 0
            if c[0] == 2:
                events.append((n, "added", scan))
        for n in set(known) - seen:
            known[n][1] += 1
            if known[n][1] >= 2:
                events.append((n, "removed", scan))
                del known[n]
    return sorted(events), sorted((n, *c) for n, c in known.items())


def test_changes_equal_a_walk_over_scans(spark):
    r = random.Random(4)
    scans, sights, start, want_e, want_s, n = [], [], [], [], [], 0
    for host in range(40):
        held = {e: (r.randrange(1, 4), r.randrange(2)) for e in "abc" if r.random() < 0.4}
        start += [(host, e, *c) for e, c in held.items()]
        walks = []
        for day in range(r.randrange(0, 9)):
            n += 1
            ok, seen = r.random() < 0.8, {e for e in "abcd" if r.random() < 0.5}
            scans.append((host, n, day, "reached_payment_step" if ok else "blocked"))
            sights += [(n, e) for e in seen] * 2
            if ok:
                walks.append((n, seen))
        events, left = _walk(walks, held)
        want_e += [(host, *e) for e in events]
        want_s += [(host, *s) for s in left]
    events, left = state.diff(spark.createDataFrame(scans, "host_id long, scan_id long, ts long, status string"), spark.createDataFrame(sights, "scan_id long, entity_id string"), spark.createDataFrame(start, "host_id long, entity_id string, confirmations int, misses int"))
    assert sorted(map(tuple, events.collect())) == sorted(want_e) and sorted(map(tuple, left.collect())) == sorted(want_s)


def test_profiles_equal_a_fold(spark):
    r = random.Random(6)
    level = {"low": 0, "medium": 1, "high": 2}
    cols = ["host_id", "ts", "scan_type", "platform", "platform_confidence", "country", "country_confidence", "vertical", "vertical_confidence", "currency", "traffic_rank"]
    rows = []
    for host in range(60):
        for day in range(r.randrange(1, 9)):
            one = lambda *o: r.choice([*o, None])
            rows.append((host, f"2024-01-{day + 1:02d}", r.choice(["light", "checkout"]), one("a", "b"), one("low", "medium", "high", "odd"), one("DE", "FR"), one("low", "medium", "high"), one("x", "y"), one("low", "high"), r.choice(["EUR", "USD", "", None]), one(1, 2)))
    got = {g.host_id: g.asDict() for g in state.fold_profiles(spark.createDataFrame(rows, "host_id long, " + ", ".join(f"{c} string" for c in cols[1:-1]) + ", traffic_rank long").repartition(5)).collect()}
    want = {}
    for row in sorted(rows, key=lambda x: x[:2]):
        u = dict(zip(cols, row))
        p = want.setdefault(u["host_id"], dict.fromkeys([*cols[3:], "last_light", "last_checkout"]))
        light = u["scan_type"] == "light"
        new, old = level.get(u["platform_confidence"]), level.get(p["platform_confidence"])
        if u["platform"] is not None and (light or p["platform"] is None or old is None or (new is not None and new >= old)):
            p["platform"], p["platform_confidence"] = u["platform"], u["platform_confidence"]
        for c in ("country", "vertical"):
            new, old = level.get(u[f"{c}_confidence"]), level.get(p[f"{c}_confidence"])
            if u[c] is not None and (p[c] is None or old is None or new is None or new >= old):
                p[c], p[f"{c}_confidence"] = u[c], u[f"{c}_confidence"]
        p["currency"] = u["currency"] or p["currency"]
        p["traffic_rank"] = u["traffic_rank"] or p["traffic_rank"]
        p["last_light" if light else "last_checkout"] = u["ts"]
    for host, p in want.items():
        for c, v in p.items():
            if c == "platform_confidence" and p["platform"] is None:
                continue
            assert got[host][c] == v, (host, c)


def test_versions_survive_a_writer_that_fails(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(ValueError):
        versions.current(spark, folder)
    versions.replace(spark.range(3), folder)
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        versions.replace(bad, folder)
    assert versions.current(spark, folder).count() == 3
    for n in (4, 5, 6):
        before = versions.current(spark, folder)
        versions.replace(spark.range(n), folder)
        assert before.count() == (3 if n == 4 else n - 1)  # a reader that has begun
    assert versions.current(spark, folder).count() == 6
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 2


def test_page_reads_the_snapshot_with_a_pushed_filter(spark):
    from tillwatch.plans import registry

    plan = registry.queries()["a08_snapshot_read"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "PushedFilters: [" in plan and "country" in plan.split("PushedFilters: [", 1)[1]


def test_attributes_as_browsers_read_them():
    seen = {"a?x=1&currency=EUR": "a?x=1&currency=EUR", "a&amp;b": "a&b", "&copy=1": "&copy=1", "&copy 1": "© 1", "&copyx": "&copyx", "&#65;&#x42": "AB", "&nosuch;": "&nosuch;", "&lt;&gt;": "<>", "?a=1&notit;b": "?a=1&notit;b", "&regid;x": "&regid;x", "&notin;": "∉", "&amp;lt;": "&lt;"}
    assert {k: text.attribute_text(k) for k in seen} == seen
    page = text._features('<a href="/p?a=1&currency=EUR&amp;b=2">x</a><a href=/q?&copy=1>y</a>', "https://s.example/")
    assert page["links"] == ["https://s.example/p?a=1&currency=EUR&b=2", "https://s.example/q?&copy=1"]


def test_addresses(spark):
    seen = {"10.0.0.1": "0" * 20 + "ffff0a000001", "::": "0" * 32, "2001:DB8::1": "20010db8" + "0" * 23 + "1", "1:2:3:4:5:6:7:8": "00010002000300040005000600070008", "1::2::3": None, "1:2": None, "300.1.1.1": None, "g::1": None, "": None, None: None}
    got = {r.ip: r.k for r in spark.createDataFrame([(i,) for i in seen], "ip string").select("ip", addresses.ip_key(F.col("ip")).alias("k")).collect()}
    assert got == seen


def test_suffix_rules_of_odd_names(spark):
    rules = spark.createDataFrame([("com",), ("*.ck",), ("!www.ck",), ("",), (None,)], "rule string")
    seen = {"a.b.com": "b.com", "com": None, "x.ck": None, "b.x.ck": "b.x.ck", "www.ck": "www.ck", "A.B.Com.": "b.com", "one": None, None: None}
    got = {r.h: r.etld1 for r in hosts.registrable(spark.createDataFrame([(h,) for h in seen], "h string"), "h", rules).collect()}
    assert got == seen


def test_dictionaries_and_rules_from_files(spark, tmp_path):
    docs = {"providers": {"providers": [{"id": "a", "name": "A", "parent_provider_id": "b"}, {"id": "b", "name": "B"}]}, "platforms": {"platforms": [{"id": "woo", "name": "Woo"}]}}
    for name, doc in docs.items():
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / f"{name}.yaml").write_text(json.dumps(doc))
    found = readers.dictionaries(spark, str(tmp_path / "d"), {"providers": 2})
    assert sorted(r.id for r in found["providers"].collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="too few"):
        readers.dictionaries(spark, str(tmp_path / "d"), {"providers": 3})
    (tmp_path / "d" / "platforms.yaml").write_text(json.dumps({"platforms": [{"id": "woo", "parent_id": "woo"}, {"id": "x", "parent_id": "gone"}]}))
    with pytest.raises(ValueError, match="its own parent"):
        readers.dictionaries(spark, str(tmp_path / "d"))
    rule = {"id": "provider.a.one", "signal_type": "script_src", "pattern": "a.js", "weight": 0.5, "enabled": True}
    for bad, why in (({}, None), ({"id": "provider.b.one"}, "begin with"), ({"weight": 2}, "weight"), ({"needs_verification": True}, "verification")):
        folder = tmp_path / f"r{why}"
        folder.mkdir()
        (folder / "a.yaml").write_text(json.dumps({"target_type": "provider", "target_id": "a", "rules": [rule | bad]}))
        if why is None:
            assert readers.rule_files(spark, str(folder), {"provider": {"a"}}).first().match == "url_contains"
            with pytest.raises(ValueError, match="unknown target"):
                readers.rule_files(spark, str(folder), {"provider": {"z"}})
        else:
            with pytest.raises(ValueError, match=why):
                readers.rule_files(spark, str(folder))


def test_captures_with_and_without_pages(spark, tmp_path):
    page = '<html><script src="https://js.pay.example/v3"></script><script>var a = 1;</script><form action="https://pay.example/go"></form></html>'
    (tmp_path / "h1").mkdir()
    (tmp_path / "h1" / "one.html.gz").write_bytes(gzip.compress(page.encode()))
    (tmp_path / "h1" / "bad.html.gz").write_bytes(b"not compressed")
    pages = [{"page_type": "cart", "url": "https://s.example/", "html_key": "h1/one.html.gz", "headers": {"Server": "x", "Set-Cookie": "b=1; Path=/"}}, {"url": "https://s.example/b", "html_key": "h1/bad.html.gz", "scripts": ["https://m.example/a.js"]}, {"url": "https://s.example/c", "external_hosts": ["z.example"]}]
    (tmp_path / "h1" / "manifest.json").write_text(json.dumps({"host_id": 1, "pages": pages}, indent=1))
    got = captures.captures(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.page_type for r in got] == ["cart", "homepage", "homepage"] and got[0].headers["server"] == "x" and got[0].cookie_names == ["b"]
    assert got[0].network_hosts == ["js.pay.example", "pay.example"] and got[0].js_globals == ["a"] and got[1].script_srcs == ["https://m.example/a.js"] and got[2].network_hosts == ["z.example"]


@pytest.mark.parametrize("store", ["file", "viewfs"])
def test_captures_are_found_by_their_whole_key(spark, tmp_path, store):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.captures.link./in", f"file://{tmp_path}")
    keys = {"light/a.example/pages/home.html.gz": gzip.compress(b"one"), "light/b.example/pages/home.html.gz": gzip.compress("zw\u00f6lf".encode()), "light/b.example/pages/cut.html.gz": gzip.compress(b"cut" * 99)[:-9], "light/b.example/pages/bad.html.gz": gzip.compress(b"")[:10] + b"\xff" * 20}
    for key, body in keys.items():
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(body)
    pages = [{"url": "https://s.example/", "html_key": key, "scripts": ["https://m.example/a.js"]} for key in (*keys, "light/none.html.gz", "light/a.example", "light/manifest.json/x", "light/../light/a.example/pages/home.html.gz", "")]
    (tmp_path / "light" / "manifest.json").write_text(json.dumps({"host_id": 1, "pages": pages}))
    path = str(tmp_path) if store == "file" else "viewfs://captures/in"
    for where in ({}, {"manifests": f"{path}/light"}):
        got = captures.captures(spark, path, **where).orderBy("place").collect()
        assert [r.html for r in got] == ["one", "zw\u00f6lf"] + [""] * 7
        assert [r.script_srcs for r in got] == [[], []] + [["https://m.example/a.js"]] * 7


def test_captures_cost_no_task_a_page(spark, tmp_path):
    html = {1: "a\n", 2: "", 3: "b\n\n", 5: "c\r\n", 6: "<script>var t=1</script>\u00e9", None: "no id"} | {k: f"<p>{k}</p>" for k in range(7, 300)}
    spark.createDataFrame([(k, f"https://s.example/{k}", h) for k, h in html.items()], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")

    def tasks():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(k).totalTasks() for k in range(executors.size()))

    before = tasks()
    got = {r.host_id: (r.url, r.html, r.scripts, r.cookies, r.globals) for r in source_queries.s16(spark, str(tmp_path)).collect()}
    assert tasks() - before < 100
    none = lambda k: k is not None and k % 4 == 0
    assert got == {k: (f"https://s.example/{k}", "" if none(k) else h, "https://m.example/s.js" if none(k) else "", "a,b", "t" if k == 6 else "") for k, h in html.items()}


def test_leaves_of_other_kinds_and_broken_ones():
    name = lambda v: bytes([0x82, len(v)]) + v
    names = name(b"a.example") + bytes([0x87, 4, 1, 2, 3, 4]) + name(b"b.example")
    tlv = source_queries._tlv
    san = tlv(0x30, bytes.fromhex("0603551d11"), b"\x01\x01\xff", tlv(0x04, tlv(0x30, names)))
    subject = lambda v: tlv(0x30, tlv(0x31, tlv(0x30, bytes.fromhex("0603550403"), tlv(0x0C, v))))
    signed = tlv(0x30, tlv(0x02, b"\1"), tlv(0x30), subject(b"issuer.ca"), tlv(0x30), subject(b"c.example"), tlv(0x30), tlv(0xA3, tlv(0x30, san)))
    der = tlv(0x30, signed, tlv(0x30), tlv(0x03, b"\0"))
    leaf = lambda kind, body: b"\0" * 10 + kind + len(body).to_bytes(3, "big") + body
    assert captures.leaf_names(leaf(b"\0\0", der)) == ["a.example", "b.example", "c.example"]
    assert captures.leaf_names(leaf(b"\0\1", der)) is None and captures.leaf_names(b"short") == []
    assert captures.leaf_names(leaf(b"\0\0", bytes.fromhex("0603551d1104"))) == []


@pytest.mark.parametrize("secret", [b"k", b"x" * 64, b"long " * 40])
def test_keyed_digest(spark, secret):
    rows = ["", "body", "ünï" * 50]
    got = spark.createDataFrame([(r,) for r in rows], "m string").select(usage.hmac_sha256(secret, F.col("m")).alias("h")).collect()
    assert [r.h for r in got] == [hmac.new(secret, m.encode(), hashlib.sha256).hexdigest() for m in rows]


def test_screening_of_failed_and_empty_responses(spark):
    rows = [(1, "q", '{"status": 500}'), (2, "q", '{"results": []}'), (3, "q", "broken"), (4, "q", None), (5, "b", '{"results": [{"id": "y", "score": 0.5}, {"id": "x", "score": 0.5, "match": true}]}')]
    hits, verdicts = usage.screening_hits(spark.createDataFrame(rows, "org_id long, query string, body string"))
    assert {r.org_id: r.verdict for r in verdicts.collect()} == {1: "failed", 2: "clear", 3: "clear", 4: "clear", 5: "match"}
    assert [(r.entity_id, r.place) for r in hits.orderBy("place").collect()] == [("x", 1), ("y", 2)]


def test_phone_votes(spark):
    table = {"1": "US", "49": "DE", "44": "GB"}
    seen = {"+49 30 1, +44 (0), +49-1": "DE", "+44 1 +49 1": "DE", "0049 1": "DE", "+1 5 +1 6 +49 7": "US", "+499": None, "": None, None: None}
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in seen], "t string").select("t", detect.phone_country(F.col("t"), table).alias("c")).collect()}
    assert got == seen
