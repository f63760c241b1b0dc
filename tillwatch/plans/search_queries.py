"""Search, filters, joins, pages and shares, as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import wilson_sql
from ..operators import reports, search, share, versions, visibility
from ..operators.search import Filters
from ..session import dealt
from .analog import MIN_CELL, StoredViews, Views, sql
from .registry import query

EVENTS = ("visible", "provider", "method", "event")


def _filtered(name: str, where: str, f: Filters, *views: str):
    """A query for one filter: the stores that pass it."""

    def run(spark, sf_dir):
        v = Views(spark, sf_dir)
        return search.apply_filters(v.visible, f, v.providers, v.methods, v.events).select("host_id", "domain", "country", "platform")

    query(name, sql(f"SELECT host_id, domain, country, platform FROM visible v WHERE {where}", "visible", *views))(run)


_has = lambda cond: f"EXISTS (SELECT 1 FROM provider p WHERE p.host_id = v.host_id AND {cond})"
_filtered("f01_in_lists", "country IN ('NATION_6', 'NATION_7', 'NATION_18') AND platform IN ('BUILDING', 'MACHINERY')", Filters(countries=("NATION_6", "NATION_7", "NATION_18"), platforms=("BUILDING", "MACHINERY")))
_filtered("f02_has_all_providers", _has("provider_id = 3") + " AND " + _has("provider_id = 7"), Filters(has_providers=(3, 7)), "provider")
_filtered("f03_lacks_providers", "NOT " + _has("provider_id IN (1, 2, 3, 4, 5)"), Filters(lacks_providers=(1, 2, 3, 4, 5)), "provider")
_filtered("f04_role_in", _has("role IN ('N', 'R')"), Filters(roles=("N", "R")), "provider")
_filtered("f05_has_methods", "EXISTS (SELECT 1 FROM method m WHERE m.host_id = v.host_id AND method_id = 'Brand#11') AND EXISTS (SELECT 1 FROM method m WHERE m.host_id = v.host_id AND method_id = 'Brand#22')", Filters(has_methods=("Brand#11", "Brand#22")), "method")
_filtered("f06_provider_count_between", "(SELECT count(*) FROM provider p WHERE p.host_id = v.host_id) BETWEEN 0 AND 12", Filters(min_providers=0, max_providers=12), "provider")
_filtered("f07_min_confidence", _has("confidence IN ('medium', 'high')"), Filters(min_confidence="medium"), "provider")
_filtered("f08_seen_ranges_same_row", _has("first_seen >= TIMESTAMP '1995-01-01' AND last_seen <= TIMESTAMP '1995-06-30'"), Filters(first_seen_from="1995-01-01 00:00:00", last_seen_to="1995-06-30 00:00:00"), "provider")
_filtered("f09_changed_in_window", "EXISTS (SELECT 1 FROM event e WHERE e.host_id = v.host_id AND detected_at >= TIMESTAMP '2024-01-10' AND detected_at < TIMESTAMP '2024-01-12')", Filters(changed_from="2024-01-10 00:00:00", changed_to="2024-01-12 00:00:00"), "event")
_filtered("f10_prefix", "lower(domain) LIKE 'customer#00000001%'", Filters(prefix="Customer#00000001%"))
_filtered("f11_substring", "domain ILIKE '%R#0000000%'", Filters(contains="R#0000000"))


@query("f12_visible", sql("SELECT host_id, domain, country FROM visible", "visible"))
def f12(spark, sf_dir):
    return Views(spark, sf_dir).visible.select("host_id", "domain", "country")


@query("f13_czds_only", sql("SELECT host_id FROM source GROUP BY host_id HAVING bool_and(source = 'czds')", "source"))
def f13(spark, sf_dir):
    return visibility.czds_only(Views(spark, sf_dir).sources)


@query("f14_opted_out", sql("SELECT host_id FROM store s WHERE optout OR EXISTS (SELECT 1 FROM source d WHERE d.host_id = s.host_id AND d.source = 'czds' AND d.seen < TIMESTAMP '1993-01-01')", "store", "source"))
def f14(spark, sf_dir):
    v = Views(spark, sf_dir)
    verified = v.sources.where((F.col("source") == "czds") & (F.col("seen") < F.to_timestamp_ntz(F.lit("1993-01-01 00:00:00")))).select("host_id").distinct().withColumn("verified", F.lit(True))
    return v.stores.join(verified, "host_id", "left").where(F.col("optout") | F.col("verified")).select("host_id")


@query("f15_segment", sql("SELECT host_id, country FROM visible WHERE country IN ('NATION_6', 'NATION_7')", "visible"))
def f15(spark, sf_dir):
    held = visibility.Segment(frozenset({"NATION_6", "NATION_7", "NATION_18"})).narrowed(("NATION_6", "NATION_7"))
    return Views(spark, sf_dir).visible.where(held.clause()).select("host_id", "country")


@query("f16_basic_profile", sql("SELECT host_id, domain, country, region, platform, optout FROM store", "store"))
def f16(spark, sf_dir):
    return visibility.with_profile(Views(spark, sf_dir).stores, full=False)


@query("f17_json_text_comparison", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') >= '4'")
def f17(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return Views(spark, sf_dir).t("events").where(k >= "4").select("event_id", k.alias("k"))


@query("f19_tuple_comparison", "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) > (700, 50)")
def f19(spark, sf_dir):
    here = F.struct(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return Views(spark, sf_dir).t("orders").where(here > F.struct(F.lit(700).cast("bigint").alias("a"), F.lit(50).cast("bigint").alias("b"))).select("o_orderkey", "o_custkey")


@query("f20_due_queue", sql("SELECT host_id, traffic_rank FROM store WHERE traffic_rank <= 5000 AND (host_id % 3 <> 0 OR platform = 'BUILDING') ORDER BY traffic_rank, host_id LIMIT 50", "store"))
def f20(spark, sf_dir):
    due = (F.col("traffic_rank") <= 5000) & ((F.col("host_id") % 3 != 0) | (F.col("platform") == "BUILDING"))
    return Views(spark, sf_dir).stores.where(due).orderBy("traffic_rank", "host_id").limit(50).select("host_id", "traffic_rank")


@query("f21_half_open_window", sql("SELECT id, event_type FROM event WHERE detected_at >= TIMESTAMP '2024-01-05' AND detected_at < TIMESTAMP '2024-01-06'", "event"))
def f21(spark, sf_dir):
    at = lambda d: F.to_timestamp_ntz(F.lit(f"{d} 00:00:00"))
    return Views(spark, sf_dir).events.where((F.col("detected_at") >= at("2024-01-05")) & (F.col("detected_at") < at("2024-01-06"))).select("id", "event_type")


@query("j01_inner_chain", sql("SELECT s.host_id, s.region, count(*) AS n FROM store s JOIN source d ON s.host_id = d.host_id GROUP BY 1, 2", "store", "source"))
def j01(spark, sf_dir):
    v = Views(spark, sf_dir)
    return v.stores.join(v.sources, "host_id").groupBy("host_id", "region").agg(F.count("*").alias("n"))


@query("j02_left_outer", sql("SELECT e.id, s.country FROM event e LEFT JOIN visible s ON e.host_id = s.host_id", "visible", "event"))
def j02(spark, sf_dir):
    v = Views(spark, sf_dir)
    return v.events.join(v.visible, "host_id", "left").select("id", "country")


@query("j03_semi_anti", sql("SELECT host_id FROM store s WHERE host_id IN (SELECT host_id FROM provider WHERE role = 'A') AND host_id NOT IN (SELECT host_id FROM event WHERE event_type = 'provider_removed')", "store", "provider", "event"))
def j03(spark, sf_dir):
    v = Views(spark, sf_dir)
    out = v.stores.join(v.providers.where("role = 'A'").select("host_id"), "host_id", "left_semi")
    return out.join(v.events.where("event_type = 'provider_removed'").select("host_id"), "host_id", "left_anti").select("host_id")


_CELLS = "cell AS (SELECT nullif(country, 'NATION_18') AS country, nullif(platform, 'BUILDING') AS platform, host_id FROM store)"


@query("j04_null_safe_cells", sql("SELECT a.host_id, t.total FROM cell a JOIN (SELECT country, platform, count(DISTINCT host_id) AS total FROM cell GROUP BY 1, 2) t ON a.country IS NOT DISTINCT FROM t.country AND a.platform IS NOT DISTINCT FROM t.platform", "store", ctes=_CELLS))
def j04(spark, sf_dir):
    cells = Views(spark, sf_dir).stores.select(F.nullif("country", F.lit("NATION_18")).alias("country"), F.nullif("platform", F.lit("BUILDING")).alias("platform"), "host_id")
    return share.same_cell(cells, share.cell_totals(cells)).select("host_id", "total")


@query("j05_removed_by_added", sql("SELECT DISTINCT a.host_id, a.entity_id AS removed, b.entity_id AS added FROM event a JOIN event b ON a.host_id = b.host_id AND a.entity_id <> b.entity_id WHERE a.event_type = 'provider_removed' AND b.event_type = 'provider_added'", "event"))
def j05(spark, sf_dir):
    e = Views(spark, sf_dir).events
    of = lambda kind, name: e.where(F.col("event_type") == kind).select("host_id", F.col("entity_id").alias(name)).distinct()
    return of("provider_removed", "removed").join(of("provider_added", "added"), "host_id").where("removed <> added").distinct()


@query("j06_latest_version", "SELECT o_custkey AS rule_id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY 1")
def j06(spark, sf_dir):
    return Views(spark, sf_dir).t("orders").groupBy(F.col("o_custkey").alias("rule_id")).agg(F.max("o_orderkey").alias("version"), F.max_by("o_orderstatus", "o_orderkey").alias("state"))


@query("j07_latest_run_per_type", "SELECT o_custkey AS host_id, o_orderpriority AS scan_type, o_orderkey AS run_id FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def j07(spark, sf_dir):
    runs = Views(spark, sf_dir).t("orders").where(F.col("o_orderdate") <= F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))).select(F.col("o_custkey").alias("host_id"), F.col("o_orderpriority").alias("scan_type"), F.col("o_orderkey").alias("run_id"), "o_orderdate")
    return search.latest_by(runs, ["host_id", "scan_type"], [F.desc("o_orderdate"), F.desc("run_id")]).select("host_id", "scan_type", "run_id")


@query("j15_names_with_default", sql("SELECT p.host_id, p.provider_id, coalesce(s_name, CAST(p.provider_id AS VARCHAR)) AS name FROM provider p LEFT JOIN supplier ON s_suppkey = p.provider_id AND s_acctbal > 0", "provider"))
def j15(spark, sf_dir):
    v = Views(spark, sf_dir)
    names = v.t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("provider_id"), "s_name")
    return v.providers.join(names, "provider_id", "left").select("host_id", "provider_id", F.coalesce("s_name", F.col("provider_id").cast("string")).alias("name"))


def _share_sql(where_role: str = "", keys: str = "country, platform", min_cell: int = MIN_CELL) -> str:
    a, b = keys.split(", ")
    low, high = wilson_sql("CAST(n AS DOUBLE)", "CAST(total AS DOUBLE)")
    return sql(
        f"""SELECT r.{a}, r.{b}, provider_id, n AS stores, total, n / total AS share, {low} AS lo, {high} AS hi FROM (
  SELECT {a}, {b}, provider_id, n FROM counts WHERE n >= {min_cell}
  UNION ALL SELECT m.{a}, m.{b}, 'other', count(DISTINCT host_id) FROM member m JOIN counts c ON m.{a} IS NOT DISTINCT FROM c.{a} AND m.{b} IS NOT DISTINCT FROM c.{b} AND m.provider_id = c.provider_id WHERE n < {min_cell} GROUP BY 1, 2) r
JOIN totals t ON r.{a} IS NOT DISTINCT FROM t.{a} AND r.{b} IS NOT DISTINCT FROM t.{b}""",
        "visible", "provider",
        ctes=f"""totals AS (SELECT {a}, {b}, count(DISTINCT host_id) AS total FROM visible GROUP BY 1, 2 HAVING count(DISTINCT host_id) >= {min_cell}),
member AS (SELECT DISTINCT v.host_id, {a}, {b}, CAST(provider_id AS VARCHAR) AS provider_id FROM visible v JOIN provider p ON v.host_id = p.host_id {where_role}),
counts AS (SELECT {a}, {b}, provider_id, count(DISTINCT host_id) AS n FROM member GROUP BY 1, 2, 3)""",
    )


@query("a06_market_share", _share_sql())
def a06(spark, sf_dir):
    v = Views(spark, sf_dir)
    return share.market_share(v.visible, v.providers, MIN_CELL)


@query("a06_market_share_regions", _share_sql(keys="region, platform"))
def a06_regions(spark, sf_dir):
    v = Views(spark, sf_dir)
    return share.market_share(v.visible, v.providers, MIN_CELL, keys=("region", "platform"))


@query("a06_market_share_role", _share_sql("WHERE role = 'N'"))
def a06_role(spark, sf_dir):
    v = Views(spark, sf_dir)
    return share.market_share(v.visible, v.providers, MIN_CELL, "N")


@query("a07_snapshot", sql(
    f"""SELECT country, platform, role, provider_id, n AS stores FROM counts WHERE n >= {MIN_CELL}
UNION ALL SELECT m.country, m.platform, m.role, 'other', count(DISTINCT host_id) FROM member m JOIN counts c ON m.country = c.country AND m.platform = c.platform AND m.role IS NOT DISTINCT FROM c.role AND m.provider_id = c.provider_id WHERE n < {MIN_CELL} GROUP BY 1, 2, 3
UNION ALL SELECT country, platform, NULL, NULL, count(DISTINCT host_id) FROM visible GROUP BY 1, 2""",
    "visible", "provider",
    ctes="""member AS (SELECT DISTINCT v.host_id, country, platform, r.role, CAST(provider_id AS VARCHAR) AS provider_id FROM visible v JOIN (SELECT host_id, provider_id, role FROM provider UNION ALL SELECT host_id, provider_id, NULL FROM provider) r ON v.host_id = r.host_id),
counts AS (SELECT country, platform, role, provider_id, count(DISTINCT host_id) AS n FROM member GROUP BY 1, 2, 3, 4)""",
))
def a07(spark, sf_dir):
    v = Views(spark, sf_dir)
    return share.snapshot(v.visible, v.providers, MIN_CELL)


@query("a08_snapshot_read", _share_sql("WHERE role = 'R'").replace("JOIN totals t ON", "JOIN (SELECT * FROM totals WHERE country IN ('NATION_6', 'NATION_18', 'NATION_12')) t ON"))
def a08(spark, sf_dir):
    from .source_queries import snapshot_folder

    cells = versions.current(spark, snapshot_folder(spark, sf_dir))
    return share.from_snapshot(cells, MIN_CELL, "R", F.col("country").isin("NATION_6", "NATION_18", "NATION_12"))


@query("l06_top_per_cell", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY country, platform ORDER BY provider_id = 'other', stores DESC, provider_id) AS INTEGER) AS place FROM ({_share_sql()})) WHERE place <= 5 OR provider_id = 'other'")
def l06(spark, sf_dir):
    return share.top_per_cell(a06(spark, sf_dir), 5)


_LABEL = "labelled AS (SELECT host_id, coalesce(country, '??') || '|' || coalesce(platform, 'unknown') AS cell FROM visible),\ntotals AS (SELECT cell, count(DISTINCT host_id) AS total FROM labelled GROUP BY 1)"


def _suppressed_sql(key: str, rows: str, view: str) -> str:
    return sql(
        f"""SELECT c.cell, {key}, CAST(sum(n) AS BIGINT) AS n, total FROM (SELECT cell, CASE WHEN n < {MIN_CELL} THEN 'other' ELSE {key} END AS {key}, n FROM (
  SELECT cell, {key}, count(*) AS n FROM labelled l JOIN (SELECT DISTINCT host_id, CAST({key} AS VARCHAR) AS {key} FROM {rows}) r ON l.host_id = r.host_id GROUP BY 1, 2)) c
JOIN totals t ON c.cell = t.cell WHERE total >= {MIN_CELL} GROUP BY c.cell, {key}, total""",
        "visible", view, ctes=_LABEL,
    )


@query("a09_suppression", sql(f"SELECT count(*) AS cells, count(*) FILTER (total < {MIN_CELL}) AS withheld, CAST(sum(total) AS BIGINT) AS stores FROM totals", "visible", ctes=_LABEL))
def a09(spark, sf_dir):
    return reports.withheld_cells(Views(spark, sf_dir).visible, MIN_CELL)


@query("a10_psp_share", _suppressed_sql("provider_id", "(SELECT * FROM provider WHERE role IN ('N', 'R'))", "provider"))
def a10(spark, sf_dir):
    v = Views(spark, sf_dir)
    return reports.psp_share(v.visible, v.providers, MIN_CELL, ("N", "R"))


@query("a11_method_share", _suppressed_sql("method_id", "method", "method"))
def a11(spark, sf_dir):
    v = Views(spark, sf_dir)
    return reports.method_share(v.visible, v.methods, MIN_CELL)


@query("a12_bnpl_share", sql(f"SELECT l.cell, count(b.host_id) AS n, count(*) AS total FROM labelled l LEFT JOIN (SELECT host_id FROM method WHERE method_type = 'PROMO BURNISHED' UNION SELECT host_id FROM provider WHERE role = 'R') b ON l.host_id = b.host_id GROUP BY 1 HAVING count(*) >= {MIN_CELL}", "visible", "provider", "method", ctes=_LABEL))
def a12(spark, sf_dir):
    v = Views(spark, sf_dir)
    return reports.bnpl_share(v.visible, v.providers, v.methods, MIN_CELL, role="R", kind="PROMO BURNISHED")


@query("a13_providers_per_store", sql(f"SELECT cell, CAST(sum(coalesce(n, 0)) AS BIGINT) / count(*) AS mean, count(*) AS total FROM labelled l LEFT JOIN (SELECT host_id, count(DISTINCT provider_id) AS n FROM provider GROUP BY 1) p ON l.host_id = p.host_id GROUP BY 1 HAVING count(*) >= {MIN_CELL}", "visible", "provider", ctes=_LABEL))
def a13(spark, sf_dir):
    v = Views(spark, sf_dir)
    return reports.providers_per_store(v.visible, v.providers, MIN_CELL)


@query("a14_flows", sql("SELECT a.entity_id AS removed, b.entity_id AS added, count(DISTINCT a.host_id) AS stores FROM event a JOIN event b ON a.host_id = b.host_id AND a.entity_id <> b.entity_id WHERE a.event_type = 'provider_removed' AND b.event_type = 'provider_added' GROUP BY 1, 2 HAVING count(DISTINCT a.host_id) >= 5", "event"))
def a14(spark, sf_dir):
    return reports.flows(Views(spark, sf_dir).events, 5)


@query("a15_monthly_cumulative", sql("SELECT month, provider_id, CAST(sum(n) OVER (PARTITION BY provider_id ORDER BY month) AS BIGINT) AS stores FROM (SELECT m.month, p.provider_id, coalesce(n, 0) AS n FROM months m CROSS JOIN (SELECT DISTINCT provider_id FROM news) p LEFT JOIN news ON news.month = m.month AND news.provider_id = p.provider_id) QUALIFY stores > 0", "visible", "provider", ctes="""first AS (SELECT v.host_id, provider_id, strftime(first_seen, '%Y-%m') AS month FROM visible v JOIN provider p ON v.host_id = p.host_id),
news AS (SELECT provider_id, month, count(DISTINCT host_id) AS n FROM first GROUP BY 1, 2), months AS (SELECT DISTINCT month FROM first)"""))
def a15(spark, sf_dir):
    v = Views(spark, sf_dir)
    return reports.monthly_cumulative(v.visible, v.providers)


@query("a05_monthly_distinct_exact", sql("SELECT strftime(first_seen, '%Y%m') AS month, role, count(DISTINCT host_id) AS hosts FROM provider GROUP BY 1, 2", "provider"))
def a05(spark, sf_dir):
    return reports.monthly_exact(Views(spark, sf_dir).providers, ["role"])


@query("a05_monthly_distinct_sketch", sql("SELECT strftime(first_seen, '%Y%m') AS month, role, true AS near FROM provider GROUP BY 1, 2", "provider"))
def a05_sketch(spark, sf_dir):
    """Whether the merged sketches lie within a tenth of the exact counts."""
    p = Views(spark, sf_dir).providers
    merged = reports.merged_state(reports.monthly_state(p, ["role"]), ["month", "role"])
    found = [c for c in merged.columns if c not in ("month", "role")][0]
    exact = reports.monthly_exact(p, ["role"])
    return merged.join(exact.withColumnRenamed("hosts", "_exact"), ["month", "role"]).select("month", "role", (F.abs(F.col(found) - F.col("_exact")) <= F.greatest(F.lit(1.0), 0.1 * F.col("_exact"))).alias("near"))


@query("a01_grouped_counts", sql("SELECT confidence, role, count(*) AS n FROM provider GROUP BY 1, 2", "provider"))
def a01(spark, sf_dir):
    return Views(spark, sf_dir).providers.groupBy("confidence", "role").agg(F.count("*").alias("n"))


@query("a02_distinct_hosts", sql("SELECT country, platform, provider_id, count(DISTINCT v.host_id) AS stores FROM visible v JOIN provider p ON v.host_id = p.host_id GROUP BY 1, 2, 3", "visible", "provider"))
def a02(spark, sf_dir):
    v = Views(spark, sf_dir)
    own, held = dealt("host_id", v.visible, v.providers)
    return own.join(held, "host_id").groupBy("country", "platform", "provider_id").agg(F.countDistinct("host_id").alias("stores"))


@query("a35_row_estimate", sql("SELECT count(*) AS rows FROM visible WHERE country = 'NATION_6'", "visible"))
def a35(spark, sf_dir):
    return Views(spark, sf_dir).visible.where("country = 'NATION_6'").agg(F.count("*").alias("rows"))


@query("n01_recent_events", sql("SELECT host_id, id, event_type, CAST(row_number() OVER (PARTITION BY host_id ORDER BY detected_at DESC, id DESC) AS INTEGER) AS rn FROM event QUALIFY rn <= 10", "event"))
def n01(spark, sf_dir):
    return search.recent_events(Views(spark, sf_dir).events).select("host_id", "id", "event_type", "rn")


@query("n02_limit_by", sql("SELECT host_id, reason, step FROM stop QUALIFY row_number() OVER (PARTITION BY host_id, reason ORDER BY scan_ts DESC, step) <= 2", "stop"))
def n02(spark, sf_dir):
    return search.latest_by(Views(spark, sf_dir).stops, ["host_id", "reason"], [F.desc("scan_ts"), F.col("step")], 2).select("host_id", "reason", "step")


@query("n03_newest_distinct_top", sql("SELECT host_id, step FROM (SELECT * FROM stop WHERE reason = 'R' QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY scan_ts DESC, step) = 1) ORDER BY scan_ts DESC, host_id LIMIT 40", "stop"))
def n03(spark, sf_dir):
    first = search.latest_by(Views(spark, sf_dir).stops.where("reason = 'R'"), ["host_id"], [F.desc("scan_ts"), F.col("step")])
    return first.orderBy(F.desc("scan_ts"), "host_id").limit(40).select("host_id", "step")


@query("l01_keyset_page", sql(f"SELECT host_id, domain FROM visible WHERE (coalesce(traffic_rank, {search.NO_RANK}), host_id) > (5000, 10) ORDER BY coalesce(traffic_rank, {search.NO_RANK}), host_id LIMIT 101", "visible"))
def l01(spark, sf_dir):
    return search.page(Views(spark, sf_dir).visible, "rank", search.encode_cursor("rank", 5000, 10), 100).select("host_id", "domain")


@query("l03_event_feed", sql("SELECT id, host_id, event_type FROM event WHERE id < 600 ORDER BY id DESC LIMIT 101", "event"))
def l03(spark, sf_dir):
    return search.feed(Views(spark, sf_dir).events, 600).select("id", "host_id", "event_type")


@query("l04_nulls_order", sql("SELECT host_id, CAST(row_number() OVER (ORDER BY traffic_rank ASC NULLS FIRST, host_id) AS INTEGER) AS place FROM store ORDER BY place LIMIT 60", "store"))
def l04(spark, sf_dir):
    from pyspark.sql import Window

    first = Views(spark, sf_dir).stores.orderBy(F.col("traffic_rank").asc_nulls_first(), "host_id").limit(60)
    return first.select("host_id", F.row_number().over(Window.orderBy(F.col("traffic_rank").asc_nulls_first(), "host_id")).alias("place"))


@query("l08_sample", "SELECT event_id FROM events ORDER BY md5('seed:' || event_id), event_id LIMIT 100")
def l08(spark, sf_dir):
    e = Views(spark, sf_dir).t("events")
    return e.orderBy(F.md5(F.concat(F.lit("seed:"), F.col("event_id").cast("string")).cast("binary")), "event_id").limit(100).select("event_id")


@query("l10_candidate_hosts", "SELECT o_custkey AS host_id FROM orders GROUP BY 1 ORDER BY max(o_orderdate) DESC, o_custkey LIMIT 30")
def l10(spark, sf_dir):
    last = Views(spark, sf_dir).t("orders").groupBy(F.col("o_custkey").alias("host_id")).agg(F.max("o_orderdate").alias("at"))
    return last.orderBy(F.desc("at"), "host_id").limit(30).select("host_id")


@query("c06_store_documents", sql("""SELECT v.host_id, (SELECT coalesce(string_agg(provider_id || ':' || role || ':' || confidence, ',' ORDER BY provider_id, role, confidence), '') FROM provider p WHERE p.host_id = v.host_id) AS providers,
(SELECT coalesce(string_agg(DISTINCT method_id, ',' ORDER BY method_id), '') FROM method m WHERE m.host_id = v.host_id) AS methods,
(SELECT count(*) FROM (SELECT id FROM event e WHERE e.host_id = v.host_id LIMIT 10)) AS changes FROM visible v""", *EVENTS))
def c06(spark, sf_dir):
    v = Views(spark, sf_dir)
    d = search.documents(v.visible, v.providers, v.methods, v.events)
    listed = F.transform("providers", lambda p: F.concat_ws(":", p["provider_id"].cast("string"), p["role"], p["confidence"]))
    return d.select("host_id", F.array_join(listed, ",").alias("providers"), F.array_join("methods", ",").alias("methods"), F.size("recent_changes").cast("bigint").alias("changes"))


@query("c07_search_page", sql("SELECT host_id, domain, country, region, platform, (SELECT string_agg(provider_id || ':' || role || ':' || confidence, ',' ORDER BY provider_id, role, confidence) FROM provider p WHERE p.host_id = v.host_id) AS providers FROM visible v WHERE country IN ('NATION_6', 'NATION_12') AND EXISTS (SELECT 1 FROM provider p WHERE p.host_id = v.host_id AND role = 'N') ORDER BY domain, host_id LIMIT 26", "visible", "provider"))
def c07(spark, sf_dir):
    request = search.SearchRequest(Filters(countries=("NATION_6", "NATION_12"), roles=("N",)), "domain", None, 25)
    listed = F.transform("providers", lambda p: F.concat_ws(":", p["provider_id"].cast("string"), p["role"], p["confidence"]))
    return search.search(StoredViews(spark, sf_dir), request).select("host_id", "domain", "country", "region", "platform", F.array_join(listed, ",").alias("providers"))
