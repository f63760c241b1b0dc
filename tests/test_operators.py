import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillwatch.functions import addresses, hosts, stats, text
from tillwatch.operators import alerts, detect, exports, quality, reports, search, state, usage, visibility
from tillwatch.sources import readers


def ts(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def at(t):
    return F.lit(t).cast("timestamp_ntz")


@pytest.mark.parametrize("s, n, low, high", [(0, 0, 0, 0), (30, 100, 0.21, 0.40), (100, 100, 0.96, 1.0)])
def test_wilson(spark, s, n, low, high):
    lo, hi = spark.range(1).select(*stats.wilson(F.lit(s), F.lit(n))).first()
    assert low <= lo <= hi <= high + 1e-9
    assert spark.range(1).select(*stats.wilson(F.lit(5), F.lit(3))).first() == spark.range(1).select(*stats.wilson(F.lit(3), F.lit(3))).first()


def test_differ(spark, rows):
    scans = spark.createDataFrame([(1, k, ts(k), "blocked" if k == 3 else "reached_payment_step") for k in range(1, 6)], "host_id long, scan_id long, ts timestamp_ntz, status string")
    seen = spark.createDataFrame([(1, "stripe"), (1, "paypal"), (2, "stripe"), (2, "paypal"), (3, "klarna"), (4, "stripe"), (4, "adyen"), (5, "stripe"), (5, "adyen")], "scan_id long, entity_id string")
    events, left = state.diff(scans, seen)
    assert rows(events, "entity_id", "event_type", "scan_id") == [("adyen", "added", 5), ("paypal", "added", 2), ("paypal", "removed", 5), ("stripe", "added", 2)]
    assert rows(left, "entity_id", "confirmations", "misses") == [("adyen", 2, 0), ("stripe", 4, 0)]


def test_differ_counts_sightings_across_a_miss_and_starts_afresh_after_removal(spark, rows):
    scans = spark.createDataFrame([(1, k, ts(k), "reached_payment_step") for k in range(1, 8)], "host_id long, scan_id long, ts timestamp_ntz, status string")
    seen = spark.createDataFrame([(1, "a"), (3, "a"), (6, "a"), (7, "a"), (7, "b")], "scan_id long, entity_id string")
    assert rows(state.diff(scans, seen)[0], "entity_id", "event_type", "scan_id") == [("a", "added", 3), ("a", "added", 7), ("a", "removed", 5)]
    two_light = spark.createDataFrame([(1, "b", 2, 0)], "host_id long, entity_id string, confirmations int, misses int")
    assert not rows(state.diff(scans.where("scan_id = 7"), seen, two_light)[0].where("entity_id = 'b'"))


def test_profiles_fold_by_precedence(spark):
    cols = "host_id long, ts string, scan_type string, platform string, platform_confidence string, country string, country_confidence string, vertical string, vertical_confidence string, currency string, traffic_rank long"
    u = [(1, "1", "light", "woo", "low", "DE", "high", None, None, "EUR", 5), (1, "2", "checkout", "shopify", None, "FR", "low", "toys", "low", "", None), (1, "3", "checkout", "magento", "high", None, None, "books", "medium", None, None), (1, "4", "light", "woo", "low", "FR", "high", None, None, "USD", None)]
    p = state.fold_profiles(spark.createDataFrame(u, cols)).first()
    assert (p.platform, p.platform_confidence, p.country, p.vertical, p.currency, p.traffic_rank, p.last_light, p.last_checkout) == ("woo", "low", "FR", "books", "USD", 5, "4", "3")


def test_provider_upsert_keeps_first_seen_and_raises_confidence(spark, rows):
    cols = "host_id long, provider_id string, role string, confidence string, score double, active boolean, first_seen int, last_seen int, confirmations int, misses int"
    old = spark.createDataFrame([(1, "a", "gateway", "high", 0.9, False, 1, 1, 1, 1), (1, "b", "wallet", "low", 0.2, False, 1, 1, 3, 0)], cols)
    new = spark.createDataFrame([(1, "a", "gateway", "low", 0.95, True, 2, 2, 1, 0), (1, "c", "bnpl", "low", 0.1, True, 2, 2, 1, 0)], cols)
    assert rows(state.upsert_providers(old, new), "provider_id", "confidence", "score", "active", "first_seen", "last_seen", "confirmations", "misses") == [("a", "high", 0.9, True, 1, 2, 2, 0), ("b", "low", 0.2, False, 1, 1, 3, 0), ("c", "low", 0.1, True, 2, 2, 1, 0)]


def test_limits_halve_and_restart_after_a_lift(spark, rows):
    c = [(7, 1, 1, "complaint", 0.5), (7, 2, 2, "complaint", 0.5), (7, 3, 3, "lift", 0.0), (7, 4, 4, "complaint", 0.8), (8, 1, 5, "complaint", 0.02), (8, 2, 6, "complaint", 0.5)]
    assert rows(state.fold_limits(spark.createDataFrame(c, "asn long, ts int, id long, kind string, factor double"))) == [(7, 0.8, 3, False), (8, 0.01, 2, False)]


def test_token_bucket_goes_into_debt(spark, rows):
    r = spark.createDataFrame([("k", float(t)) for t in (0, 0, 0, 10)], "key string, at double")
    assert [x[0] for x in rows(state.token_bucket(r, 1.0, 2.0), "wait", "at")] == [0.0, 0.0, 0.0, 1.0]


def test_report_other_is_a_sum_and_market_other_is_distinct(spark):
    from tillwatch.operators import share

    stores = spark.createDataFrame([(h, "DE", "woo") for h in range(10)], "host_id long, country string, platform string")
    p = [(h, "big", "gateway") for h in range(10)] + [(0, "x", "gateway"), (0, "y", "gateway"), (1, "x", "gateway")]
    providers = spark.createDataFrame(p, "host_id long, provider_id string, role string")
    live = {r.provider_id: r.stores for r in share.market_share(stores, providers, 5).collect()}
    report = {r.provider_id: r.n for r in reports.psp_share(stores, providers, 5).collect()}
    assert live == {"big": 10, "other": 2} and report == {"big": 10, "other": 3}
    empty = share.market_share(stores.limit(0), providers, 5)
    assert empty.count() == 0
    none = spark.createDataFrame([(h, None, "woo") for h in range(6)], "host_id long, country string, platform string")
    assert share.market_share(none, providers, 5).count() == 2


def test_flows(spark, rows):
    e = [(h, "provider_removed", "paypal") for h in range(31)] + [(h, "provider_added", "adyen") for h in range(30)] + [(0, "provider_added", "paypal")]
    assert rows(reports.flows(spark.createDataFrame(e, "host_id long, event_type string, entity_id string"), 30)) == [("paypal", "adyen", 30)]


def test_sketch_is_near_the_exact_count(spark):
    o = spark.range(2000).select((F.col("id") % 700).alias("host_id"), F.lit("stripe").alias("p"), at(ts(1)).alias("first_seen"))
    approx = reports.merged_state(reports.monthly_state(o, ["p"]), ["month", "p"]).first().hosts
    assert abs(approx - reports.monthly_exact(o, ["p"]).first().hosts) <= 35


def test_spike_day(spark):
    e = [(k, ts(d, h)) for k, (d, h) in enumerate([(d, 1) for d in range(1, 8)] + [(8, h) for h in range(15)])]
    out = quality.daily_spikes(spark.createDataFrame(e, "id long, detected_at timestamp_ntz"), "2024-01-09", 3).orderBy("day").collect()
    assert [r.n for r in out] == [1, 1, 15] and [r.spike for r in out] == [False, False, True]


def test_abuse_detectors(spark):
    cols = "org_id string, id long, ts timestamp_ntz, endpoint string, records long, ip string, denial string, domain string, request_id string"
    old = [("A", d, ts(d), "search", 30, "198.51.1.1", None, None, None) for d in range(14)]
    now = [("A", 100 + k, ts(14, 1), "search", 10, "203.0.5.5", "outside_segment" if k < 6 else None, None, None) for k in range(12)]
    now += [("A", 200 + k, ts(14, 2), "search", 0, "203.0.6.6", "field_profile_insufficient", None, None) for k in range(3)]
    now += [("B", 300 + k, ts(14, 3), "lookup", 1, None, None, f"d{k}", None) for k in range(45)]
    s = usage.Limits(records_min=100, outside_min=10, probes_min=3, network_min=15, lookups_min=40, critical_lookups=40)
    found = {(r.org_id, r.detector): (r.severity, r.value, r.reference) for r in usage.detect(spark.createDataFrame(old + now, cols), at(ts(14, 12)), s).where("org_id is not null").collect()}
    assert found[("A", "outside_segment")] == ("medium", 6.0, 15.0)
    assert found[("A", "records_spike")] == ("high", 120.0, 30.0)
    assert found[("A", "field_probing")][1] == 3.0 and found[("A", "new_network")][1] == 15.0
    assert found[("B", "enumeration")] == ("critical", 45.0, 45.0)
    assert usage.merge_incidents(spark.createDataFrame([("B", "enumeration", "low")], "org_id string, detector string, severity string"), spark.createDataFrame([("B", "enumeration", "critical")], "org_id string, detector string, severity string")).first()[2:5] == ("critical", 1, True)


def test_watchlist_never_scanned_is_all_stale(spark):
    w = spark.createDataFrame([(True, None), (True, None)], "watched boolean, checkout_at timestamp_ntz")
    assert quality.watchlist_stale(w, at(ts(1)), 8).first().stale == 1.0


def test_eval_counts_only_labelled_hosts(spark):
    gold = spark.createDataFrame([(1, "provider", "a", True), (2, "provider", "a", False)], "host_id long, entity_type string, entity_id string, present boolean")
    said = spark.createDataFrame([(1, "provider", "a"), (2, "provider", "b"), (3, "provider", "a")], "host_id long, entity_type string, entity_id string")
    r = quality.confusion(gold, said, ["entity_type"]).first()
    assert (r.tp, r.fp, r.fn, r.recall) == (1, 1, 0, 1.0)


def test_search_pages_follow_the_cursor(spark):
    stores = spark.createDataFrame([(k, f"d{k}", "DE", "woo", None if k == 3 else k % 2 + 1) for k in range(6)], "host_id long, domain string, country string, platform string, traffic_rank long")
    got, cursor = [], None
    while True:
        page = search.page(stores, "rank", cursor, 2).collect()
        got += [r.host_id for r in page[:2]]
        if len(page) <= 2:
            break
        last = page[1]
        cursor = search.encode_cursor("rank", last.traffic_rank if last.traffic_rank is not None else search.NO_RANK, last.host_id)
    assert got == [0, 2, 4, 1, 5, 3]
    with pytest.raises(ValueError):
        search.page(stores, "domain", cursor)
    with pytest.raises(PermissionError):
        visibility.Segment(frozenset({"DE"})).narrowed(("FR",))


def test_ip_allow_list(spark):
    req = spark.createDataFrame([("a", "10.1.2.3"), ("a", "11.0.0.1"), ("a", None), ("b", "9.9.9.9")], "org_id string, ip string")
    net = spark.createDataFrame([("a", "10.0.0.0/8"), ("a", "bad")], "org_id string, cidr string")
    assert {(r.org_id, r.ip): r.allowed for r in visibility.ip_allowed(req, net).collect()} == {("a", "10.1.2.3"): True, ("a", "11.0.0.1"): False, ("a", None): False, ("b", "9.9.9.9"): True}


def test_hostnames(spark):
    raw = ["https://user@WWW.Shop.example.co.uk:8080/x?y", "*.a.de.", "münchen.de", "1.2.3.4", "localhost", "[::1]", "-bad.de", "", None]
    df = hosts.with_host(spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string"), "raw").orderBy("k")
    assert [r.hostname for r in df.collect()] == ["shop.example.co.uk", "a.de", "xn--mnchen-3ya.de", None, None, None, None, None, None]
    e = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.shop.de",), ("de",), ("brand.myshopify.com",)], "h string").select(hosts.etld1(F.col("h"))).collect()
    assert [r[0] for r in e] == ["b.co.uk", None, "shop.de", None, "brand.myshopify.com"]


def test_masks(spark):
    d = spark.createDataFrame([(1, "write a@b.de or mailto:c@d.fr, call +49 30 1234567 or tel:12345; 12.99"), (2, None), (3, "")], "k int, t string")
    got = {r.k: (r.masked, r.emails, r.phones) for r in text.mask_personal(d, "t").collect()}
    assert got[1][1:] == (2, 2) and "1234567" not in got[1][0] and "12.99" in got[1][0]
    assert got[3] == ("", 0, 0) and got[2][0] is None


def test_page_features(spark):
    html = """<html lang="de"><head><title> Ein  Laden </title><link rel="alternate" hreflang="de-AT" href="/at"><link rel="icon" href="/f.ico"><meta name="generator" content="Shop 1.2.3">
    <script src="/a.js"></script><script>var cart = 1; Stripe.elements.create()</script><script type="application/ld+json">{"@type":"Product","offers":{"@type":"Offer","addressCountry":{"name":"Germany"}}}</script></head>
    <body><a href="/cart">In den   Warenkorb</a><form action="/pay"><input type="submit" value="Kaufen"></form><iframe src="https://pay.example/x"></iframe></body></html>"""
    pages = spark.createDataFrame([(1, html, "https://shop.example/"), (2, None, None), (3, "<p", "x")], "id long, html string, url string")
    got = {r.id: r for r in text.page_features(pages, "id").withColumn("globals", text.js_globals(F.col("inline_scripts"))).collect()}
    p = got[1]
    assert (p.title, p.lang, p.hreflangs, p.script_srcs, p.links, p.form_actions, p.iframe_srcs, p.favicon) == ("Ein Laden", "de", ["de-at"], ["https://shop.example/a.js"], ["https://shop.example/cart"], ["https://shop.example/pay"], ["https://pay.example/x"], "https://shop.example/f.ico")
    assert p.json_ld_types == ["Product", "Offer"] and p.schema_country == "Germany" and set(p.button_texts) == {"in den warenkorb", "kaufen"}
    assert "Stripe.elements.create" in p.globals and "cart" in p.globals and got[2].title == "" and got[3].links == []


def _page(**given):
    base = {"page_type": "checkout", "url": "u", "html": "", "headers": {}, "cookie_names": [], "script_srcs": [], "iframe_srcs": [], "form_actions": [], "network_hosts": [], "js_globals": [], "favicon_sha256": None, "checkout_labels": []}
    return base | given


def test_rules_and_scores(spark):
    from tillwatch.schemas import PAGE_SIGNALS

    pages = [_page(script_srcs=["https://js.stripe.com/v3"], network_hosts=["api.stripe.com"], js_globals=["Stripe.elements"], headers={"server": "nginx/1"}, cookie_names=["wc_1"], checkout_labels=["Mit PayPal zahlen"], html="<div class='x'>Powered by Woo</div>"), _page(page_type="homepage", script_srcs=["https://js.stripe.com/v3"])]
    df = spark.createDataFrame(pages, PAGE_SIGNALS).withColumn("host_id", F.lit(1))
    r = lambda i, s, p, m="host_suffix", t="provider", target="stripe", w=0.5, scope="any": {"rule_id": i, "target_type": t, "target_id": target, "signal_type": s, "match": m, "pattern": p, "weight": w, "page_scope": scope}
    rules = readers.rules(spark, [r("1", "script_src", "stripe.com"), r("2", "network_host", "*.stripe.com", scope="checkout"), r("3", "js_global", "Stripe", "contains"), r("4", "js_global", "Stripe.elements", "contains"), r("5", "header", "Server: nginx", "contains", target="x"), r("6", "cookie", r"wc_\d", "regex", "platform", "woo"), r("7", "checkout_label", "paypal", "contains", target="paypal"), r("8", "html_pattern", "powered by (\\w+)", "regex", "platform", "woo", 0.4), r("9", "script_src", "stripe", "url_contains", scope="product")])
    found = {(x.rule_id, x.page_type): x.signal_value for x in detect.match_rules(df, rules, ["host_id"]).collect()}
    assert set(found) == {("1", "checkout"), ("1", "homepage"), ("2", "checkout"), ("4", "checkout"), ("5", "checkout"), ("6", "checkout"), ("7", "checkout"), ("8", "checkout")}
    assert found["8", "checkout"] == "<div class='x'>Powered by Woo</div>" and found["2", "checkout"] == "api.stripe.com"
    s = {x.target_id: x for x in detect.scores(detect.match_rules(df, rules, ["host_id"]), ["host_id"]).collect()}
    assert (s["stripe"].score, s["stripe"].confidence, s["stripe"].active_on_checkout) == (1.0, "high", True)
    assert s["paypal"].confidence == "medium" and s["woo"].score == 0.9
    assert detect.best_platform(detect.scores(detect.match_rules(df, rules, ["host_id"]), ["host_id"]), ["host_id"]).first().platform == "woo"
    for bad in ({"weight": 2.0}, {"signal_type": "smell"}, {"needs_verification": True}):
        with pytest.raises(ValueError):
            readers.rules(spark, [r("1", "script_src", "a") | bad])


def test_ties_and_categories(spark):
    b = spark.createDataFrame([(1, "FR", 0.3), (1, "DE", 0.3), (2, "GB", 0.6)], "k int, choice string, weight double")
    got = {r.k: (r.winner, r.confidence) for r in detect.votes(b, ["k"], (0.5, 0.6), (0.2, 0.1)).collect()}
    assert got == {1: ("DE", "low"), 2: ("GB", "high")}
    s = spark.createDataFrame([("platform", "a", 0.5, 1, "low"), ("platform", "b", 0.5, 1, "low")], "target_type string, target_id string, score double, types long, confidence string").withColumn("k", F.lit(1))
    assert detect.best_platform(s, ["k"]).first().platform == "b"
    h = spark.createDataFrame([("js.stripe.com",), ("x.org",), (None,)], "host string")
    p = spark.createDataFrame([(1, "*.stripe.com", "psp"), (2, "com", "other")], "place int, pattern string, category string")
    assert {r.host: r.found.category if r.found else None for r in hosts.suffix_match(h, p).collect()} == {"js.stripe.com": "psp", "x.org": None, None: None}


def test_blocks(spark):
    long_ = "word " * 600
    cases = [(403, "", "", ""), (200, "Just a moment", "cf_chl_opt", ""), (200, "access denied", "g-recaptcha", ""), (200, "Shop", "datadome", long_), (200, "Shop", "hcaptcha.com", "x"), (200, "", "", "Not available in your country"), (200, "", "", "Please confirm you are over 18"), (200, "Shop", "", long_)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, s int, t string, h string, x string")
    got = [r.b and r.b.reason for r in df.select("k", detect.block(F.col("s"), F.col("t"), F.col("h"), F.col("x")).alias("b")).orderBy("k").collect()]
    assert got == ["http_403_429", "antibot_challenge", "captcha", None, "captcha", "geo_blocked", "age_gate", None]


def test_alert_rules(spark, rows):
    e = spark.createDataFrame([(1, 1, "provider_added", "stripe", ts(2), "DE", "woo", "a.de", "low"), (2, 1, "provider_removed", "stripe", ts(2), "DE", "woo", "a.de", None), (3, 1, "provider_added", "stripe", ts(0), "DE", "woo", "a.de", "high")], "id long, host_id long, event_type string, entity_id string, detected_at timestamp_ntz, country string, platform string, domain string, confidence string")
    r = spark.createDataFrame([(9, ts(1), ["provider_added", "provider_removed"], [], ["DE"], [], [], "medium", True)], "rule_id long, created_at timestamp_ntz, event_types array<string>, entities array<string>, countries array<string>, platforms array<string>, domains array<string>, min_confidence string, enabled boolean")
    assert rows(alerts.match(e, r)) == [(9, 2)]
    assert rows(alerts.match(e, r, spark.createDataFrame([(9, 2)], "rule_id long, event_id long"))) == []


def test_exports(spark, tmp_path):
    data = spark.createDataFrame([("a.de", ["x", "y"], True, None), ("b.de", [], False, 3)], "domain string, lists array<string>, flag boolean, n long")
    exports.write_csv(data, str(tmp_path / "c"), {"export": "1"})
    assert {tuple(r) for r in exports.read_csv(spark, str(tmp_path / "c")).fillna("").collect()} == {("a.de", "x|y", "true", ""), ("b.de", "", "false", "3")}
    exports.write_parquet(data, str(tmp_path / "p"), {"export": "1"})
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and '"export": "1"' in spark.read.text(str(tmp_path / "p.meta")).first()[0]
    wm = "00112233445566778899aabbccddeeff"
    ordered = exports.watermarked(data.select("domain"), wm, F.col("domain")).collect()
    placed = spark.createDataFrame([(r.domain, k) for k, r in enumerate(ordered)], "domain string, place long")
    assert exports.order_breaks(placed, wm, F.col("domain"), "place").count() == 0
    assert exports.order_breaks(placed.withColumn("place", -F.col("place")), wm, F.col("domain"), "place").count() == 1
    shape = spark.createDataFrame([], "domain string, country string, provider_ids array<string>, rank long")
    one, two = (exports.canaries(shape, wm, "trap.example").collect() for _ in range(2))
    assert one == two and 3 <= len(one) <= 10 and all(r.domain.endswith(".trap.example") for r in one)
    exports.write_observations(spark.createDataFrame([(1, dt.date(2024, 1, 5)), (2, dt.date(2024, 2, 5))], "k long, d date"), str(tmp_path / "o"), "d", ["k"])
    assert spark.read.parquet(str(tmp_path / "o")).where("month = 202402").count() == 1
    assert exports.approval(5, 10, 3) == "refused" and exports.approval(5, 3, 9) == "approval" and exports.approval(1, 3, 9) == "queued"
    jobs = exports.run_jobs([{"id": 1}, {"id": 2}], lambda j: 1 // (j["id"] - 1))
    assert [j["status"] for j in jobs] == ["failed", "done"]


def test_readers(spark, tmp_path, rows):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    names = lambda kind, path: sorted(r.hostname for r in readers.read(spark, kind, path).where("hostname is not null").collect())
    assert names("ranked", put("r.csv", "1,a.de\nx,b.de\n2,münchen.de\n3,bad\n")) == ["a.de", "xn--mnchen-3ya.de"]
    assert names("manual", put("m.csv", "domain,note\n# c\n\na.de,x\nb.de\n")) == ["a.de", "b.de"]
    assert names("webgraph", put("v.txt", "# ids\n1\tde.shop\n2\tcom.example.www\n")) == ["example.com", "shop.de"]
    assert names("certificates", put("c.jsonl", '{"data":{"leaf_cert":{"all_domains":["*.a.de","b.de"]}}}\nnot json\n')) == ["a.de", "b.de"]
    assert names("czds", put("z.zone", "a.shop. 3600 in ns x.y.\na.shop. IN NS z.y.\nb.shop. 60 IN A 1.2.3.4\n@ IN SOA x\n")) == ["a.shop"]
    with pytest.raises(ValueError):
        readers.read(spark, "rumour", "x")
    gold = put("g.csv", "domain,entity_type,entity_id,present,labeled_by,labeled_at,notes\nA.de,provider,x,true,m,1,\na.de,provider,x,false,m,2,\nb.de,smell,x,true,m,1,\n")
    assert rows(readers.gold_labels(spark, gold)) == [("a.de", "provider", "x", False)]
    f = put("f.csv", "domain,entity_type,entity_id,confidence,confidence_score,rule_id,rule_version,active_on_checkout\na.de,provider,x,medium,,r,1,true\n")
    assert readers.findings(spark, f).first().confidence_score == 0.6
    ranges = readers.ip_ranges(spark, put("i.tsv", "1.0.0.0\t1.0.0.255\t13335\tUS\tCLOUD\n2.0.0.0\t2.0.0.9\t0\tNONE\tNot routed\n3.0.0.0\t3.0.1.9\t5\tNONE\tX\n"))
    pts = spark.createDataFrame([("1.0.0.7",), ("3.0.1.9",), ("9.9.9.9",)], "ip string").withColumn("n", addresses.ip_number(F.col("ip")))
    assert rows(hosts.range_join(pts, ranges, "n", "low", "high"), "ip", "asn", "country") == [("1.0.0.7", 13335, "US"), ("3.0.1.9", 5, None), ("9.9.9.9", None, None)]
    log = readers.log_lines(spark, put("l.txt", "2024-01-02T03:04:05Z AS13335 mail a long note\nrubbish\n# c\n"), ("ts", "target", "source", "note"))
    assert rows(log, "target", "source", "note") == [("AS13335", "mail", "a long note")]
    sig = readers.signature_rules(spark, put("t.json", r'{"Shop X":{"scriptSrc":["shopx\\.js\\;confidence:50","y"],"js":{"ShopX":""},"headers":{"X-By":"ShopX\\;version:\\1"}}}'))
    assert rows(sig, "signal_type", "pattern", "weight") == [("header", "X-By:ShopX", 0.5), ("js_global", "ShopX", 0.5), ("script_src", "shopx\\.js", 0.5), ("script_src", "y", 0.5)]
    state0 = spark.createDataFrame([("a.de", 9, "ranked", "1", "1", "b0")], "hostname string, rank long, source string, first_seen string, last_seen string, batch_id string")
    recs = readers.read(spark, "ranked", put("r2.csv", "3,a.de\n4,new.de\n5,bad\n"))
    h, src, n = readers.ingest(state0, recs, "ranked", "b1", "2")
    assert rows(h) == [("a.de", 3), ("new.de", 4)] and n.first().asDict() == {"seen": 3, "invalid": 1, "new": 1, "updated": 1}
    assert ("a.de", "ranked", "1", "2", "b1") in rows(src)
