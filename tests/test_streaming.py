from tillwatch.operators import reports, state
from tillwatch.streaming import jobs


def test_streamed_changes_equal_batch(spark, tmp_path, rows):
    from pyspark.sql import functions as F

    scans = [(h, 10 * h + k, f"2024-01-0{k}", "timeout" if (h + k) % 5 == 0 else "reached_payment_step", [x for j, x in enumerate("abcd") if (h * 7 + k * 3 + j * 5) % 4]) for h in range(6) for k in range(1, 9)]
    df = spark.createDataFrame(scans, "host_id long, scan_id long, ts string, status string, entities array<string>").withColumn("ts", F.to_timestamp("ts"))
    for part, on in enumerate(("ts < '2024-01-04'", "ts >= '2024-01-04' and ts < '2024-01-07'", "ts >= '2024-01-07'")):
        df.where(on).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = jobs.changes(jobs.observations(spark, str(tmp_path / "in"), df.schema)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    batch = state.diff(df, df.select("scan_id", F.explode("entities").alias("entity_id")))[0]
    cols = ("host_id", "entity_id", "event_type", "scan_id")
    assert rows(spark.read.parquet(str(tmp_path / "out")), *cols) == rows(batch, *cols) and rows(batch)


def test_states_append_and_alerts(spark, tmp_path, rows):
    o = spark.range(400).selectExpr("id % 50 as host_id", "concat('p', id % 3) as provider_id", "timestamp_ntz '2024-01-03 00:00:00' + make_interval(0, 0, 0, cast(id % 40 as int)) as ts")
    o.repartition(4).write.parquet(str(tmp_path / "obs"))
    stream = jobs.observations(spark, str(tmp_path / "obs"), o.schema, 1)
    jobs.market_share_states(stream, str(tmp_path / "mv"), str(tmp_path / "c1"), ["provider_id"]).awaitTermination()
    keys = ("month", "provider_id", "hosts")
    assert rows(jobs.merged_share(spark, str(tmp_path / "mv"), ["provider_id"]), *keys) == rows(reports.monthly_exact(o, ["provider_id"], "ts"), *keys)
    jobs.append(stream, str(tmp_path / "table"), str(tmp_path / "c2"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 400
    e = spark.createDataFrame([(k, 1, "provider_added", "x", "2024-01-02", "DE", "w", "d", None) for k in range(5)], "id long, host_id long, event_type string, entity_id string, detected_at string, country string, platform string, domain string, confidence string")
    e.repartition(2).write.parquet(str(tmp_path / "ev"))
    r = spark.createDataFrame([(7, "2024-01-01", ["provider_added"], [], [], [], [], "high", True)], "rule_id long, created_at string, event_types array<string>, entities array<string>, countries array<string>, platforms array<string>, domains array<string>, min_confidence string, enabled boolean")
    jobs.alert_deliveries(jobs.observations(spark, str(tmp_path / "ev"), e.schema, 1), r, str(tmp_path / "al"), str(tmp_path / "c3")).awaitTermination()
    assert sorted(x.event_id for x in spark.read.parquet(str(tmp_path / "al")).collect()) == [0, 1, 2, 3, 4]


def test_late_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    from pyspark.sql import functions as F

    schema = "ts timestamp, event_type string"
    batches = [["2024-01-01 00:10:00", "2024-01-01 00:50:00"], ["2024-01-03 05:00:00"], ["2024-01-01 00:20:00", "2024-01-03 04:30:00"], ["2024-01-09 00:00:00"], ["2024-01-09 00:00:01"]]
    q = lambda: jobs.late_tolerant_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).select("window.start", "event_type", "n").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    for times in batches:
        spark.createDataFrame([(t, "click") for t in times], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q()
    found = {(str(r.start), r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {("2024-01-01 00:00:00", 2), ("2024-01-03 05:00:00", 1), ("2024-01-03 04:00:00", 1)}  # the row of 00:20 came after its window was told


def test_idle_hosts_are_forgotten(spark, tmp_path, rows):
    from pyspark.sql import functions as F

    days = [(1, 1, "2024-01-01"), (2, 2, "2024-03-01"), (1, 3, "2024-03-02"), (2, 4, "2024-03-03"), (1, 5, "2024-03-04")]
    for host, scan, day in days:
        one = spark.createDataFrame([(host, scan, day, "reached_payment_step", ["x"])], "host_id long, scan_id long, d string, status string, entities array<string>").withColumn("ts", F.to_timestamp("d")).drop("d")
        one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.changes(jobs.observations(spark, f"{tmp_path}/in", one.schema), idle_days=30).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "host_id", "event_type", "scan_id") == [(1, "added", 5), (2, "added", 4)]


def test_a_batch_reads_and_writes_the_state_of_a_host_once():
    from pyspark.sql import Row

    calls = []

    class Store:
        def __init__(self, value=None):
            self.value = value

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "update":
                    self.value = args[0]
                return self.value if name == "get" else self.value is not None if name == "exists" else iter(())

            return call

    handle = Store()
    handle.getValueState = handle.getMapState = lambda *a: Store()
    sightings = jobs.Sightings(30)
    sightings.init(handle)
    scan = lambda k: Row(at=k, scan_id=k, status="reached_payment_step", entities=[str((k + j) % 9) for j in range(6)])
    for part in (range(50), range(50, 100)):
        calls.clear()
        assert len(list(sightings.handleInputRows((1,), iter([scan(k) for k in part]), None))) >= 50
        assert len(calls) <= 3  # messages to the JVM; there were over 300


def test_hosts_with_news_outlive_their_first_timer(spark, tmp_path, rows):
    from pyspark.sql import functions as F

    days = [(1, 1, "2024-01-01", ["y"]), (1, 2, "2024-01-20", ["x"]), (2, 3, "2024-02-10", []), (2, 4, "2024-02-11", []), (1, 5, "2024-02-12", ["x"]), (2, 6, "2024-04-01", []), (2, 7, "2024-04-02", []), (1, 8, "2024-04-03", ["x"]), (1, 9, "2024-04-04", ["x"])]
    for host, scan, day, entities in days:
        one = spark.createDataFrame([(host, scan, day, "reached_payment_step", entities)], "host_id long, scan_id long, d string, status string, entities array<string>").withColumn("ts", F.to_timestamp("d")).drop("d")
        one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.changes(jobs.observations(spark, f"{tmp_path}/in", one.schema), idle_days=30).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "host_id", "entity_id", "event_type", "scan_id") == [(1, "x", "added", 5), (1, "x", "added", 9), (1, "y", "removed", 5)]
