"""Evaluation, dashboards, usage and alerts, as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alerts, ordered, quality, usage
from .analog import NOW, Views, sql
from .registry import query

_AT = lambda t=NOW: F.to_timestamp_ntz(F.lit(t))
GOLD = "gold AS (SELECT l.doc_id AS host_id, lang AS entity_type, source AS entity_id, quality = 1 AS present FROM labels l JOIN documents d ON l.doc_id = d.doc_id), said AS (SELECT doc_id AS host_id, lang AS entity_type, source AS entity_id FROM documents WHERE n_chars > 1500)"


def _gold(v: Views):
    d = v.t("documents").select("doc_id", "lang", "source", "n_chars")
    gold = v.t("labels").join(d, "doc_id").select(F.col("doc_id").alias("host_id"), F.col("lang").alias("entity_type"), F.col("source").alias("entity_id"), (F.col("quality") == 1).alias("present"))
    said = d.where("n_chars > 1500").select(F.col("doc_id").alias("host_id"), F.col("lang").alias("entity_type"), F.col("source").alias("entity_id"))
    return gold, said


def _eval_sql(by: str) -> str:
    return f"""WITH {GOLD}, c AS (SELECT {by}, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM
  (SELECT DISTINCT host_id, entity_type, entity_id, 1 AS t FROM gold WHERE present) FULL JOIN (SELECT DISTINCT s.*, 1 AS p FROM said s WHERE EXISTS (SELECT 1 FROM gold g WHERE g.host_id = s.host_id AND g.entity_type = s.entity_type)) USING (host_id, entity_type, entity_id) GROUP BY {by}),
r AS (SELECT *, CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) END AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM r"""


@query("a16_eval_by_type", _eval_sql("entity_type"))
def a16(spark, sf_dir):
    return quality.confusion(*_gold(Views(spark, sf_dir)), ["entity_type"])


@query("a16_eval_by_entity", _eval_sql("entity_type, entity_id"))
def a16_entity(spark, sf_dir):
    return quality.confusion(*_gold(Views(spark, sf_dir)), ["entity_type", "entity_id"])


@query("a17_eval_per_rule", f"""WITH {GOLD}, fired AS (SELECT DISTINCT CAST(n_chars % 5 AS VARCHAR) AS rule_id, doc_id AS host_id, source AS entity_id FROM documents WHERE n_chars > 1000)
SELECT rule_id, entity_id, tp, fp, coalesce(total, 0) - tp AS fn FROM (SELECT rule_id, f.entity_id, count(g.host_id) AS tp, count(*) - count(g.host_id) AS fp FROM fired f LEFT JOIN (SELECT DISTINCT host_id, entity_id FROM gold WHERE present) g USING (host_id, entity_id)
  WHERE f.host_id IN (SELECT host_id FROM gold) GROUP BY 1, 2) LEFT JOIN (SELECT entity_id, count(*) AS total FROM (SELECT DISTINCT host_id, entity_id FROM gold WHERE present) GROUP BY 1) USING (entity_id)""")
def a17(spark, sf_dir):
    v = Views(spark, sf_dir)
    fired = v.t("documents").where("n_chars > 1000").select((F.col("n_chars") % 5).cast("string").alias("rule_id"), F.col("doc_id").alias("host_id"), F.col("source").alias("entity_id"))
    return quality.per_rule(fired, _gold(v)[0])


@query("a18_eval_reached_only", _eval_sql("entity_type").replace("JOIN documents d ON l.doc_id = d.doc_id)", "JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 2 = 0)").replace("n_chars > 1500)", "n_chars > 1500 AND doc_id % 2 = 0)"))
def a18(spark, sf_dir):
    v = Views(spark, sf_dir)
    gold, said = _gold(v)
    reached = v.t("documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("host_id"))
    return quality.confusion(gold.join(reached, "host_id", "left_semi"), said.join(reached, "host_id", "left_semi"), ["entity_type"])


@query("a19_gate", f"SELECT entity_type, precision, CASE entity_type WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.95 END AS target, coalesce(precision >= CASE entity_type WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.95 END, true) AS passed FROM ({_eval_sql('entity_type')})")
def a19(spark, sf_dir):
    return quality.gate(a16(spark, sf_dir), {"en": 0.5, "de": 0.95}).select("entity_type", "precision", "target", "passed")


@query("a21_walk_outcomes", sql("SELECT CASE WHEN grouping(platform) = 1 THEN 'all' ELSE platform END AS platform, count(*) AS walks, count(*) FILTER (step >= 2) / count(*) AS to_checkout, count(*) FILTER (step >= 4) / count(*) AS to_payment, count(*) FILTER (reason = 'R') / count(*) AS blocked FROM (SELECT CASE WHEN platform = 'F' THEN '(none)' ELSE platform END AS platform, step, reason FROM stop) GROUP BY ROLLUP (platform)", "stop"))
def a21(spark, sf_dir):
    walks = Views(spark, sf_dir).stops.select(F.when(F.col("platform") == "F", "").otherwise(F.col("platform")).alias("platform"), (F.col("step") >= 2).alias("to_checkout"), (F.col("step") >= 4).alias("to_payment"), (F.col("reason") == "R").alias("blocked"))
    return quality.walk_outcomes(walks)


_FRESH = "seen AS (SELECT s.host_id, s.optout AS watched, max(d.seen) FILTER (d.source = 'ranked') AS light_at, max(d.seen) FILTER (d.source = 'manual') AS checkout_at FROM store s LEFT JOIN source d ON s.host_id = d.host_id GROUP BY 1, 2), age AS (SELECT watched, (epoch(TIMESTAMP '1999-01-01') - epoch(light_at)) / 86400 AS light, (epoch(TIMESTAMP '1999-01-01') - epoch(checkout_at)) / 86400 AS checkout FROM seen)"


def _seen(v: Views):
    found = v.stores.join(v.sources, "host_id", "left").groupBy("host_id", F.col("optout").alias("watched"))
    return found.agg(F.max(F.when(F.col("source") == "ranked", F.col("seen"))).alias("light_at"), F.max(F.when(F.col("source") == "manual", F.col("seen"))).alias("checkout_at"))


@query("a22_freshness", sql("SELECT median(light) AS light_median, count(*) FILTER (light > 400) / count(light) AS light_stale, count(*) - count(light) AS light_never, median(checkout) AS checkout_median, count(*) FILTER (checkout > 500) / count(checkout) AS checkout_stale, count(*) - count(checkout) AS checkout_never FROM age", "store", "source", ctes=_FRESH))
def a22(spark, sf_dir):
    return quality.freshness(_seen(Views(spark, sf_dir)), _AT("1999-01-01 00:00:00"), 400, 500)


@query("a22_watchlist_freshness", sql("SELECT count(*) AS n, count(*) FILTER (checkout > 300) / count(checkout) AS stale FROM age WHERE watched", "store", "source", ctes=_FRESH))
def a22_watch(spark, sf_dir):
    return quality.watchlist_stale(_seen(Views(spark, sf_dir)), _AT("1999-01-01 00:00:00"), 300)


@query("a23_stop_distribution", sql("SELECT platform, step, reason, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS BIGINT) AS share FROM stop GROUP BY 1, 2, 3", "stop"))
def a23(spark, sf_dir):
    return quality.stop_distribution(Views(spark, sf_dir).stops)


@query("a24_stop_marginals", sql("SELECT dimension, value, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY dimension) AS BIGINT) AS share FROM (SELECT 'reason' AS dimension, reason AS value FROM stop UNION ALL SELECT 'step', CAST(step AS VARCHAR) FROM stop UNION ALL SELECT 'platform', platform FROM stop) GROUP BY 1, 2", "stop"))
def a24(spark, sf_dir):
    return quality.stop_marginals(Views(spark, sf_dir).stops)


@query("a25_weekly_trend", sql("SELECT strftime(CAST(scan_ts AS DATE) - CAST(dayofweek(scan_ts) AS INTEGER), '%Y-%m-%d') AS week, reason, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY week) AS BIGINT) AS share FROM stop GROUP BY 1, 2", "stop"))
def a25(spark, sf_dir):
    return quality.weekly_trend(Views(spark, sf_dir).stops).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("a26_release_comparison", sql("SELECT version, CAST(dense_rank() OVER (ORDER BY seen, version) AS INTEGER) AS place, reason, n, share FROM (SELECT *, min(first) OVER (PARTITION BY version) AS seen, n / CAST(sum(n) OVER (PARTITION BY version) AS BIGINT) AS share FROM (SELECT step AS version, reason, count(*) AS n, min(scan_ts) AS first FROM stop GROUP BY 1, 2))", "stop"))
def a26(spark, sf_dir):
    return quality.release_comparison(Views(spark, sf_dir).stops, "step")


@query("a27_usage_summary", sql("SELECT CASE WHEN grouping(endpoint) = 0 THEN 'endpoint' WHEN grouping(day) = 0 THEN 'day' ELSE 'total' END AS scope, coalesce(endpoint, day, '') AS key, count(*) AS requests, CAST(coalesce(sum(records), 0) AS BIGINT) AS records, count(DISTINCT ip) AS addresses, count(*) FILTER (error) AS errors FROM (SELECT endpoint, strftime(ts, '%Y-%m-%d') AS day, records, ip, json_extract_string(params, '$.k') >= '40' AS error FROM usage WHERE org_id = 3 AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-04-01') GROUP BY GROUPING SETS ((endpoint), (day), ())", "usage"))
def a27(spark, sf_dir):
    return usage.summarise(Views(spark, sf_dir).usage, 3, "2024-01-01 00:00:00", "2024-04-01 00:00:00")


@query("a03_distinct_and_sums", sql("SELECT org_id, count(DISTINCT ip) AS addresses, CAST(coalesce(sum(records), 0) AS BIGINT) AS records FROM usage GROUP BY 1", "usage"))
def a03(spark, sf_dir):
    return Views(spark, sf_dir).usage.groupBy("org_id").agg(F.countDistinct("ip").alias("addresses"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


@query("a04_extremes_and_means", "SELECT o_custkey AS worker, strftime(max(o_orderdate), '%Y-%m-%d') AS last, strftime(min(o_orderdate), '%Y-%m-%d') AS first, count(*) AS n, CAST(sum(epoch(o_orderdate)) AS BIGINT) / count(*) AS mean FROM orders GROUP BY 1")
def a04(spark, sf_dir):
    o, day = Views(spark, sf_dir).t("orders"), "yyyy-MM-dd"
    seconds = F.sum(F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return o.groupBy(F.col("o_custkey").alias("worker")).agg(F.date_format(F.max("o_orderdate"), day).alias("last"), F.date_format(F.min("o_orderdate"), day).alias("first"), F.count("*").alias("n"), (seconds / F.count("*")).alias("mean"))


@query("a28_host_rollup", "SELECT l_suppkey AS third_party, CAST(sum(l_quantity) AS BIGINT) AS request_count, arg_max(l_returnflag, (n, -ascii(l_returnflag))) AS resource_type FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a28(spark, sf_dir):
    lines = Views(spark, sf_dir).t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return lines.groupBy(F.col("l_suppkey").alias("third_party")).agg(F.sum("q").cast("bigint").alias("request_count"), F.max_by("l_returnflag", F.struct("n", -F.ascii("l_returnflag"))).alias("resource_type"))


@query("a31_nearest_rank", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1")
def a31(spark, sf_dir):
    return ordered.order_statistics(Views(spark, sf_dir).t("lineitem"), F.col("l_extendedprice"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ("l_returnflag",))


@query("a32_queue_dashboard", "SELECT o_orderpriority AS scan_type, count(*) AS depth, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') / count(*) AS blocked FROM orders GROUP BY 1")
def a32(spark, sf_dir):
    s = F.col("o_orderstatus")
    return Views(spark, sf_dir).t("orders").groupBy(F.col("o_orderpriority").alias("scan_type")).agg(F.count("*").alias("depth"), F.count_if(s == "F").alias("done"), (F.count_if(s == "P") / F.count("*")).alias("blocked"))


@query("a34_event_type_counts", sql("SELECT event_type, count(*) AS n FROM event GROUP BY 1", "event"))
def a34(spark, sf_dir):
    return Views(spark, sf_dir).events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("n04_spike_days", sql("SELECT strftime(day, '%Y-%m-%d') AS day, n, mean7, n >= 5 AND n >= 1.02 * greatest(mean7, 1.0) AS spike FROM (SELECT day, n, CAST(coalesce(sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) / 7 AS mean7 FROM (SELECT day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS day) LEFT JOIN (SELECT date_trunc('day', detected_at) AS day, count(*) AS n FROM event GROUP BY 1) USING (day))) WHERE day > TIMESTAMP '2024-01-01'", "event"))
def n04(spark, sf_dir):
    return quality.daily_spikes(Views(spark, sf_dir).events, "2024-01-31", 30, 1.02).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("n06_share_of_total", sql("SELECT country, platform, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY country) AS BIGINT) AS share FROM store GROUP BY 1, 2", "store"))
def n06(spark, sf_dir):
    return quality.with_share(Views(spark, sf_dir).stores.groupBy("country", "platform").agg(F.count("*").alias("n")), within=["country"])


@query("n07_last_event_of_kind", sql("SELECT host_id, event_type, id FROM event WHERE event_type IN ('provider_added', 'provider_removed') QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY detected_at DESC, id DESC) = 1", "event"))
def n07(spark, sf_dir):
    e = Views(spark, sf_dir).events.where("event_type in ('provider_added', 'provider_removed')")
    last = e.groupBy("host_id").agg(F.max_by(F.struct("event_type", "id"), F.struct("detected_at", "id")).alias("x"))
    return last.select("host_id", "x.event_type", "x.id")


@query("n08_period_delta", sql("SELECT strftime(week, '%Y-%m-%d') AS week, n, n - lag(n) OVER (ORDER BY week) AS delta FROM (SELECT date_trunc('week', detected_at) AS week, count(*) AS n FROM event GROUP BY 1) QUALIFY delta IS NOT NULL", "event"))
def n08(spark, sf_dir):
    weeks = Views(spark, sf_dir).events.groupBy(F.date_trunc("week", "detected_at").alias("week")).agg(F.count("*").alias("n"))
    return weeks.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "n", (F.col("n") - F.lag("n").over(Window.orderBy("week"))).alias("delta")).where("delta is not null")


@query("n09_chain_breaks", "SELECT o_custkey, o_orderkey FROM (SELECT *, coalesce(lag(h) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), '') AS before FROM (SELECT *, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)) WHERE sha256(before || CAST(o_orderkey AS VARCHAR)) <> h")
def n09(spark, sf_dir):
    log = Views(spark, sf_dir).t("orders").withColumn("row_hash", F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256))
    return usage.chain_breaks(log, ["o_custkey"], ["o_orderkey"], F.col("o_orderkey").cast("string")).select("o_custkey", "o_orderkey")


@query("b06_removed_spikes", sql("SELECT entity_id, count(*) FILTER (detected_at >= TIMESTAMP '2024-01-19') AS today, count(*) FILTER (detected_at < TIMESTAMP '2024-01-19') / 7 AS mean7 FROM event WHERE event_type = 'provider_removed' AND detected_at < TIMESTAMP '2024-01-20' AND detected_at >= TIMESTAMP '2024-01-12' GROUP BY 1 HAVING today >= 2 AND today > 1.1 * greatest(mean7, 1.0)", "event"))
def b06(spark, sf_dir):
    return quality.removed_spikes(Views(spark, sf_dir).events, _AT("2024-01-20 00:00:00"), 1.1, 2)


@query("b07_new_alerts", sql("SELECT DISTINCT event_type AS kind, host_id AS subject FROM event WHERE id % 2 = 0 EXCEPT SELECT event_type, host_id FROM event WHERE id % 5 = 0", "event"))
def b07(spark, sf_dir):
    e = Views(spark, sf_dir).events.select(F.col("event_type").alias("kind"), F.col("host_id").alias("subject"), "id")
    return quality.new_alerts(e.where("id % 2 = 0"), e.where("id % 5 = 0")).select("kind", "subject").distinct()


@query("b08_breaches", sql("SELECT 'reach' AS kind, platform AS subject, count(*) FILTER (step >= 4) / count(*) AS value, count(*) AS n FROM stop GROUP BY platform HAVING count(*) >= 20 AND value < 0.6", "stop"))
def b08(spark, sf_dir):
    m = Views(spark, sf_dir).stops.groupBy(F.col("platform").alias("subject")).agg((F.count_if(F.col("step") >= 4) / F.count("*")).alias("value"), F.count("*").alias("n"))
    return quality.breaches(m.where("n >= 20").select(F.lit("reach").alias("kind"), "subject", "value", "n"), [("reach", "<", 0.6), ("light_stale", ">", 0.05)])


@query("b09_stop_growth", sql("SELECT platform, reason, a / ta AS before, b / tb AS after FROM (SELECT *, CAST(sum(a) OVER (PARTITION BY platform) AS BIGINT) AS ta, CAST(sum(b) OVER (PARTITION BY platform) AS BIGINT) AS tb FROM (SELECT platform, reason, count(*) FILTER (scan_ts < TIMESTAMP '1995-06-10') AS a, count(*) FILTER (scan_ts >= TIMESTAMP '1995-06-10') AS b FROM stop WHERE scan_ts >= TIMESTAMP '1995-06-03' AND scan_ts < TIMESTAMP '1995-06-17' GROUP BY 1, 2)) WHERE ta >= 20 AND tb >= 20 AND b / tb - a / ta >= 0.01", "stop"))
def b09(spark, sf_dir):
    return quality.stop_growth(Views(spark, sf_dir).stops, _AT("1995-06-17 00:00:00"), 0.01)


_LOG = """log AS (SELECT id, org_id, ts, endpoint, records, ip, CASE WHEN endpoint = 'error' THEN 'outside_segment' WHEN endpoint = 'signup' THEN 'field_profile_insufficient' END AS denial, json_extract_string(params, '$.k') AS domain, CAST(id AS VARCHAR) AS request_id FROM usage)"""


def _log(v: Views):
    denial = F.when(F.col("endpoint") == "error", "outside_segment").when(F.col("endpoint") == "signup", "field_profile_insufficient")
    return v.usage.select("id", "org_id", "ts", "endpoint", "records", "ip", denial.alias("denial"), F.get_json_object("params", "$.k").alias("domain"), F.col("id").cast("string").alias("request_id"))


@query("b10_abuse_detectors", sql("""SELECT org_id, 'outside_segment' AS detector, 'medium' AS severity, CAST(outside AS DOUBLE) AS value, CAST(requests AS DOUBLE) AS reference FROM c WHERE requests >= 10 AND outside / requests >= 0.15
UNION ALL SELECT org_id, 'records_spike', CASE WHEN records / mean >= 3 THEN 'critical' ELSE 'high' END, records, mean FROM c WHERE records >= 100 AND records > 1.05 * mean
UNION ALL SELECT org_id, 'enumeration', CASE WHEN lookups >= 3000 THEN 'critical' ELSE 'high' END, lookups, dist FROM c WHERE lookups >= 5 AND dist / lookups >= 0.9
UNION ALL SELECT org_id, 'field_probing', 'medium', probes, 0 FROM c WHERE probes >= 5
UNION ALL SELECT org_id, 'new_network', 'low', sum(n), count(*) FROM (SELECT org_id, net, count(*) AS n FROM nets f WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.org_id = f.org_id AND k.net = f.net) AND org_id IN (SELECT org_id FROM known) GROUP BY 1, 2 HAVING count(*) >= 1) GROUP BY 1""", "usage", ctes=_LOG + """,
c AS (SELECT org_id, count(*) FILTER (fresh) AS requests, count(*) FILTER (fresh AND denial = 'outside_segment') AS outside, CAST(coalesce(sum(records) FILTER (fresh), 0) AS DOUBLE) AS records, greatest(CAST(coalesce(sum(records) FILTER (NOT fresh), 0) AS BIGINT) / 14.0, 1.0::DOUBLE) AS mean,
  count(*) FILTER (fresh AND endpoint = 'view') AS lookups, count(DISTINCT coalesce(domain, request_id)) FILTER (fresh AND endpoint = 'view') AS dist, count(*) FILTER (fresh AND denial = 'field_profile_insufficient') AS probes
  FROM (SELECT *, ts >= TIMESTAMP '2024-01-20' AS fresh FROM log WHERE ts >= TIMESTAMP '2024-01-06' AND ts < TIMESTAMP '2024-01-21') GROUP BY 1),
nets AS (SELECT org_id, ts, regexp_extract(ip, '^[0-9]+[.][0-9]+') || '.0.0/16' AS net FROM log), known AS (SELECT DISTINCT org_id, net FROM nets WHERE ts >= TIMESTAMP '2023-12-22' AND ts < TIMESTAMP '2024-01-20')"""))
def b10(spark, sf_dir):
    s = usage.Limits(records_multiplier=1.05, records_min=100, outside_share=0.15, outside_min=10, lookups_min=5, network_min=1, critical_multiplier=3.0)
    return usage.detect(_log(Views(spark, sf_dir)), _AT("2024-01-21 00:00:00"), s, "view")


@query("b11_merged_incidents", sql("SELECT org_id, detector, CASE max(r) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, CAST(sum(new) AS BIGINT) AS hits, max(r) = 3 AS restricted, min(new) = 1 AS opened FROM (SELECT org_id, endpoint AS detector, id % 4 AS r, 0 AS new FROM usage WHERE ts < TIMESTAMP '2024-01-15' UNION ALL SELECT org_id, endpoint, id % 4, 1 FROM usage WHERE ts >= TIMESTAMP '2024-01-15') GROUP BY 1, 2", "usage"))
def b11(spark, sf_dir):
    u = Views(spark, sf_dir).usage.select("org_id", F.col("endpoint").alias("detector"), F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), (F.col("id") % 4 + 1).cast("int")).alias("severity"), "ts")
    new = F.col("ts") >= _AT("2024-01-15 00:00:00")
    return usage.merge_incidents(u.where(~new), u.where(new))


_RULES = """rule AS (SELECT r_regionkey AS rule_id, CASE r_regionkey WHEN 0 THEN ['provider_added'] WHEN 1 THEN ['provider_removed', 'provider_added'] WHEN 2 THEN ['click'] ELSE ['view', 'purchase'] END AS kinds, CASE r_regionkey WHEN 1 THEN ['NATION_6', 'NATION_18'] ELSE [] END AS countries, CASE r_regionkey WHEN 2 THEN 'high' WHEN 3 THEN 'medium' END AS least FROM region)"""


def _alert_rules(v: Views):
    none = F.array().cast("array<string>")
    k = F.col("r_regionkey")
    of = lambda *x: F.array(*[F.lit(y) for y in x])
    kinds = F.when(k == 0, of("provider_added")).when(k == 1, of("provider_removed", "provider_added")).when(k == 2, of("click")).otherwise(of("view", "purchase"))
    return v.t("region").select(k.alias("rule_id"), _AT("2024-01-05 00:00:00").alias("created_at"), kinds.alias("event_types"), none.alias("entities"), F.when(k == 1, of("NATION_6", "NATION_18")).otherwise(none).alias("countries"), none.alias("platforms"), none.alias("domains"), F.when(k == 2, "high").when(k == 3, "medium").alias("min_confidence"), F.lit(True).alias("enabled"))


@query("b01_alert_matches", sql("""SELECT rule_id, e.id AS event_id FROM event e JOIN rule ON list_contains(kinds, e.event_type) LEFT JOIN store s ON s.host_id = e.host_id LEFT JOIN conf c ON c.host_id = e.host_id
WHERE detected_at >= TIMESTAMP '2024-01-05' AND (len(countries) = 0 OR list_contains(countries, s.country)) AND (least IS NULL OR coalesce(c.r, 2) >= CASE least WHEN 'high' THEN 2 ELSE 1 END) AND e.id % 10 <> 0""", "store", "event", "provider", ctes=_RULES + ", conf AS (SELECT host_id, min(CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS r FROM provider GROUP BY 1)"))
def b01(spark, sf_dir):
    v = Views(spark, sf_dir)
    least = v.providers.groupBy("host_id").agg(F.min_by("confidence", F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).otherwise(2)).alias("confidence"))
    events = v.events.join(v.stores.select("host_id", "country", "platform", "domain"), "host_id", "left").join(least, "host_id", "left")
    delivered = v.events.where("id % 10 = 0").select(F.col("id").alias("event_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rule_id"))
    return alerts.match(events, _alert_rules(v), delivered)


@query("b02_current_confidence", sql("SELECT e.id, coalesce(p.confidence, 'high') AS confidence FROM event e LEFT JOIN provider p ON p.host_id = e.host_id AND CAST(p.provider_id AS VARCHAR) = e.entity_id", "event", "provider"))
def b02(spark, sf_dir):
    v = Views(spark, sf_dir)
    now = v.providers.select("host_id", F.col("provider_id").cast("string").alias("entity_id"), "confidence")
    return v.events.join(now, ["host_id", "entity_id"], "left").select("id", F.coalesce("confidence", F.lit("high")).alias("confidence"))


@query("b03_digests", sql("SELECT host_id % 4 AS rule_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS events, count(*) AS n FROM event WHERE host_id % 4 IN (0, 1) GROUP BY 1", "event"))
def b03(spark, sf_dir):
    v = Views(spark, sf_dir)
    deliveries = v.events.select((F.col("host_id") % 4).alias("rule_id"), F.col("id").alias("event_id"))
    rules = spark.range(4).select(F.col("id").alias("rule_id"), F.element_at(F.array(*[F.lit(x) for x in ("daily", "weekly", "instant", "instant")]), (F.col("id") + 1).cast("int")).alias("mode"))
    found = alerts.digests(deliveries, rules, _AT("2024-01-29 07:10:00"))  # a Monday
    return found.select("rule_id", F.array_join(F.transform("events", lambda x: x.cast("string")), ",").alias("events"), "n")


@query("b04_delivery_retry", "SELECT event_id, CASE WHEN event_id % 6 + 1 > 4 THEN 'failed' ELSE 'pending' END AS status, CASE event_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 3.0 WHEN 2 THEN 7.0 WHEN 3 THEN 13.0 END::DOUBLE AS wait_hours, event_id % 6 + 1 AS attempts FROM events")
def b04(spark, sf_dir):
    return alerts.retry(Views(spark, sf_dir).t("events").select("event_id", (F.col("event_id") % 6).alias("attempts")))


@query("b05_scan_to_alert", "SELECT o_orderkey, CAST(greatest(0, epoch(TIMESTAMP '1996-01-01') - epoch(o_orderdate)) AS BIGINT) AS seconds FROM orders")
def b05(spark, sf_dir):
    d = Views(spark, sf_dir).t("orders").select("o_orderkey", F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.col("o_orderdate").alias("detected_at"), _AT("1996-01-01 00:00:00").alias("sent_at"))
    return alerts.scan_to_alert(d).select("o_orderkey", "seconds")


@query("b13_review_due", "SELECT c_custkey AS org_id, strftime(max(o_orderdate), '%Y-%m-%d') AS reviewed, max(o_orderdate) < TIMESTAMP '1997-01-01' AS overdue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '1998-01-01'")
def b13(spark, sf_dir):
    v = Views(spark, sf_dir)
    last = v.t("orders").join(v.t("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("org_id")).agg(F.max("o_orderdate").alias("at"))
    return last.where(F.col("at") < _AT("1998-01-01 00:00:00")).select("org_id", F.date_format("at", "yyyy-MM-dd").alias("reviewed"), (F.col("at") < _AT("1997-01-01 00:00:00")).alias("overdue"))


@query("c13_worker_liveness", "SELECT user_id, CASE WHEN user_id % 7 = 0 OR age > 86400 THEN 'stopped' WHEN age > 17280 THEN 'stale' ELSE 'live' END AS state FROM (SELECT user_id, CAST(epoch(TIMESTAMP '2024-01-31') - epoch(max(ts)) AS BIGINT) AS age FROM events GROUP BY 1)")
def c13(spark, sf_dir):
    beats = Views(spark, sf_dir).t("events").groupBy("user_id").agg(F.max("ts").alias("beat")).withColumn("stopped", F.col("user_id") % 7 == 0)
    return quality.liveness(beats, _AT(), 8640).select("user_id", "state")


@query("x19_rate_limit", sql("SELECT org_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS window, count(*) AS n FROM usage GROUP BY 1, 2 HAVING count(*) > 3", "usage"))
def x19(spark, sf_dir):
    from ..operators.visibility import over_rate

    return over_rate(Views(spark, sf_dir).usage, 3, 3600).select("org_id", "window", "n")


@query("x20_quota", sql("SELECT org_id, CAST(coalesce(sum(records) FILTER (ts >= TIMESTAMP '2024-01-20'), 0) AS BIGINT) AS today, CAST(sum(records) AS BIGINT) AS month, today >= 2000 OR month >= 40000 AS spent FROM usage WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1", "usage"))
def x20(spark, sf_dir):
    from ..operators.visibility import quota_state

    return quota_state(Views(spark, sf_dir).usage, "2024-01-20 12:00:00", 2000, 40000)


@query("x25_networks", sql("SELECT DISTINCT ip, regexp_extract(ip, '^[0-9]+[.][0-9]+') || '.0.0/16' AS net FROM usage", "usage"))
def x25(spark, sf_dir):
    return Views(spark, sf_dir).usage.select("ip", usage.network(F.col("ip")).alias("net")).distinct()
