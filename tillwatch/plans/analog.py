"""The engine's tables read off the star-schema test tables: customers as stores, suppliers as providers, and so on.

Each view has a DataFrame form and the SQL of the same rows, so that queries can be held against another engine.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import fingerprint, shared_folder

MIN_CELL = 5
NOW = "2024-01-31 00:00:00"


_SCHEMAS: dict[tuple[str, str], tuple[str, StructType]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its footers are read for the schema once an application and again when its files change, as a catalogue would."""
    path = f"{sf_dir}/{name}.parquet"
    key, files = (spark.sparkContext.applicationId, path), fingerprint(spark, path)
    if _SCHEMAS.get(key, ("",))[0] != files:
        _SCHEMAS[key] = files, spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key][1]).parquet(path)


class Views:
    """Views over one folder of tables; each is built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.t = functools.partial(table, spark, sf_dir)

    @property
    def stores(self) -> DataFrame:
        geo = self.t("nation").join(F.broadcast(self.t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows, fixed
        rank = F.when(F.col("c_acctbal") > 0, F.floor(F.lit(10000) - F.col("c_acctbal")) + 1)
        return self.t("customer").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("host_id"), F.col("c_name").alias("domain"), F.col("n_name").alias("country"), F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("platform"), rank.alias("traffic_rank"), (F.col("c_acctbal") < 0).alias("optout"),
        )

    @property
    def sources(self) -> DataFrame:
        kind = F.when(F.col("o_orderstatus") == "P", "czds").when(F.col("o_orderstatus") == "F", "ranked").otherwise("manual")
        return self.t("orders").select(F.col("o_custkey").alias("host_id"), kind.alias("source"), F.col("o_orderdate").alias("seen"))

    @property
    def providers(self) -> DataFrame:
        lines = self.t("orders").join(self.t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        best = F.substring(F.min("o_orderpriority"), 1, 1)
        return lines.groupBy(F.col("o_custkey").alias("host_id"), F.col("l_suppkey").alias("provider_id")).agg(
            F.min("l_returnflag").alias("role"), F.when(best <= "2", "high").when(best == "3", "medium").otherwise("low").alias("confidence"),
            F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.count("*").alias("confirmations"),
        )

    @property
    def methods(self) -> DataFrame:
        lines = self.t("orders").join(self.t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(self.t("part"), F.col("l_partkey") == F.col("p_partkey"))
        return lines.groupBy(F.col("o_custkey").alias("host_id"), F.col("p_brand").alias("method_id")).agg(F.min("p_type").alias("method_type"), F.min("l_shipdate").alias("first_seen"))

    @property
    def events(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "signup", "provider_added").when(F.col("event_type") == "error", "provider_removed").otherwise(F.col("event_type"))
        return self.t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("host_id"), kind.alias("event_type"), F.get_json_object("props", "$.k").alias("entity_id"), F.col("ts").alias("detected_at"))

    @property
    def usage(self) -> DataFrame:
        return self.t("events").select(
            F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("org_id"), F.col("ts"), F.col("event_type").alias("endpoint"),
            F.floor("value").alias("records"), F.col("props").alias("params"),
            F.concat_ws(".", F.lit("203"), (F.col("user_id") % 7).cast("string"), (F.col("event_id") % 200).cast("string"), F.lit("9")).alias("ip"),
        )

    @property
    def stops(self) -> DataFrame:
        """Observed walks: a line shipped is a walk that stopped, by flag and status."""
        return self.t("lineitem").select(F.col("l_orderkey").alias("host_id"), F.col("l_linestatus").alias("platform"), F.col("l_returnflag").alias("reason"), F.col("l_linenumber").alias("step"), F.col("l_shipdate").alias("scan_ts"))

    @property
    def visible(self) -> DataFrame:
        from ..operators.visibility import client_visible

        return client_visible(self.stores, self.sources)


class StoredViews(Views):
    """The same views, with the children of stores kept as tables clustered by host, as a database would keep them.

    A table is written on first use and anew when the files that it is made of change. A search's existence tests then read two
    columns of one table, and a page's hosts skip all row groups but theirs.
    """

    def _kept(self, name: str, df: DataFrame, made_of: tuple[str, ...]) -> DataFrame:
        files = "/".join(fingerprint(self.spark, f"{self.sf_dir}/{t}.parquet") for t in made_of)
        folder = f"{shared_folder(self.spark)}/{name}-{uuid.uuid5(uuid.NAMESPACE_URL, self.sf_dir + files)}"
        key = self.spark.sparkContext.applicationId, folder
        if key not in _SCHEMAS:
            df.repartitionByRange("host_id").sortWithinPartitions("host_id").write.mode("overwrite").parquet(folder)
            _SCHEMAS[key] = "", df.schema
        return self.spark.read.schema(_SCHEMAS[key][1]).parquet(folder)

    @property
    def providers(self) -> DataFrame:
        return self._kept("providers", super().providers, ("orders", "lineitem"))

    @property
    def methods(self) -> DataFrame:
        return self._kept("methods", super().methods, ("orders", "lineitem", "part"))

    @property
    def events(self) -> DataFrame:
        return self._kept("events", super().events, ("events",))

    @property
    def sources(self) -> DataFrame:
        """Kinds of sources, once a host."""
        return self._kept("sources", super().sources.select("host_id", "source").distinct(), ("orders",))


SQL = {
    "store": """store AS (SELECT c_custkey AS host_id, c_name AS domain, n_name AS country, r_name AS region, c_mktsegment AS platform,
  CASE WHEN c_acctbal > 0 THEN CAST(floor(10000 - c_acctbal) AS BIGINT) + 1 END AS traffic_rank, c_acctbal < 0 AS optout
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "source": """source AS (SELECT o_custkey AS host_id, CASE o_orderstatus WHEN 'P' THEN 'czds' WHEN 'F' THEN 'ranked' ELSE 'manual' END AS source, o_orderdate AS seen FROM orders)""",
    "visible": """visible AS (SELECT * FROM store s WHERE NOT optout AND EXISTS (SELECT 1 FROM source d WHERE d.host_id = s.host_id AND d.source <> 'czds'))""",
    "provider": """provider AS (SELECT o_custkey AS host_id, l_suppkey AS provider_id, min(l_returnflag) AS role,
  CASE WHEN substr(min(o_orderpriority), 1, 1) <= '2' THEN 'high' WHEN substr(min(o_orderpriority), 1, 1) = '3' THEN 'medium' ELSE 'low' END AS confidence,
  min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(*) AS confirmations FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)""",
    "method": """method AS (SELECT o_custkey AS host_id, p_brand AS method_id, min(p_type) AS method_type, min(l_shipdate) AS first_seen
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "event": """event AS (SELECT event_id AS id, user_id AS host_id, CASE event_type WHEN 'signup' THEN 'provider_added' WHEN 'error' THEN 'provider_removed' ELSE event_type END AS event_type,
  json_extract_string(props, '$.k') AS entity_id, ts AS detected_at FROM events)""",
    "usage": """usage AS (SELECT event_id AS id, user_id % 10 AS org_id, ts, event_type AS endpoint, CAST(floor(value) AS BIGINT) AS records, props AS params,
  '203.' || (user_id % 7) || '.' || (event_id % 200) || '.9' AS ip FROM events)""",
    "stop": """stop AS (SELECT l_orderkey AS host_id, l_linestatus AS platform, l_returnflag AS reason, l_linenumber AS step, l_shipdate AS scan_ts FROM lineitem)""",
}


def sql(body: str, *views: str, ctes: str = "") -> str:
    """SQL over named views; `visible` brings what it needs."""
    names: list[str] = []
    for v in views:
        for n in (["store", "source", "visible"] if v == "visible" else [v]):
            if n not in names:
                names.append(n)
    parts = [SQL[n] for n in names] + ([ctes] if ctes else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
