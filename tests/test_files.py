"""Export files read back by other tools, writes that fail, retention."""

import csv
import io
import os
import time
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tillwatch.operators import exports, file_sink

COLUMNS = "domain string, lists array<string>, flag boolean, n bigint, at timestamp"


def rows_of(spark, n, parts=3):
    df = spark.createDataFrame([(f"s{k}.example" if k % 7 else None, ["a", "b,c"][: k % 3], k % 2 == 0 if k % 5 else None, k, None) for k in range(n)], COLUMNS)
    return df.repartition(parts) if parts else df


def listed(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith("."))


def test_parquet_footers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    exports.write_parquet(rows_of(spark, 100), path, {"export": "é-1", "watermark": "ab"})
    files = [f for f in listed(path) if f.endswith(".parquet")]
    found = [pq.read_metadata(f"{path}/{f}") for f in files]
    assert sum(m.num_rows for m in found) == 100 and len(files) == 3 and "_SUCCESS" in listed(path)
    assert all(m.metadata[b"export"].decode() == "é-1" and m.metadata[b"watermark"] == b"ab" and m.row_group(0).column(0).compression == "ZSTD" for m in found)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == list(range(100))
    assert spark.read.parquet(path).schema["at"].dataType.typeName().startswith("timestamp")
    told = file_sink.footers(spark, path).collect()
    assert sum(r.rows for r in told) == 100 and {r.metadata["export"] for r in told} == {"é-1"}
    exports.write_parquet(rows_of(spark, 0), path, {"export": "2"})  # overwritten; an empty export has one file with its schema
    assert len([f for f in listed(path) if f.endswith(".parquet")]) == 1 and spark.read.parquet(path).count() == 0


def test_row_groups(spark, tmp_path):
    exports.write_parquet(spark.range(120_001).coalesce(1), str(tmp_path / "g"), {})
    (name,) = [f for f in listed(tmp_path / "g") if f.endswith(".parquet")]
    m = pq.read_metadata(str(tmp_path / "g" / name))
    assert [m.row_group(k).num_rows for k in range(m.num_row_groups)] == [50_000, 50_000, 20_001]


def test_csv_lines(spark, tmp_path):
    path = str(tmp_path / "c")
    exports.write_csv(rows_of(spark, 50), path, {"export": "1", "kind": "snapshot"})
    back = []
    for f in listed(path):
        if f.endswith(".csv"):
            with open(f"{path}/{f}", encoding="utf-8", newline="") as lines:
                assert lines.readline() == "# export=1 kind=snapshot\n"
                back += list(csv.DictReader(lines))
    assert len(back) == 50 and {r["lists"] for r in back} == {"", "a", "a|b,c"} and {r["flag"] for r in back} == {"true", "false", ""}
    assert exports.read_csv(spark, path).count() == 50
    assert {r.line for r in file_sink.first_lines(spark, path).collect()} == {"# export=1 kind=snapshot"}


def test_report_is_one_zip(spark, tmp_path):
    path = str(tmp_path / "r")
    one = spark.createDataFrame([("a, b", 1), ('say "x"', 2), (None, 3)], "name string, n int").repartition(3)
    exports.write_report({"first": one, "empty": one.where("n > 9"), "last": spark.range(2)}, path)
    assert [f for f in listed(path) if not f.startswith("_")] == ["report.zip"]
    with zipfile.ZipFile(f"{path}/report.zip") as z:
        assert z.testzip() is None
        read = {n: list(csv.reader(io.TextIOWrapper(z.open(n), "utf-8", newline=""))) for n in z.namelist()}
    assert read["empty.csv"] == [["name", "n"]] and read["last.csv"] == [["id"], ["0"], ["1"]]
    assert sorted(read["first.csv"][1:]) == [["", "3"], ["a, b", "1"], ['say "x"', "2"]]
    exports.write_report({"only": one}, path)
    assert sorted({r.metric for r in file_sink.zip_lines(spark, path).collect()}) == ["only"]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "f")
    exports.write_csv(rows_of(spark, 10), path, {"export": "old"})
    before = listed(path)
    broken = rows_of(spark, 40, 4).withColumn("n", F.when(F.col("n") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        exports.write_csv(broken, path, {"export": "new"})
    assert listed(path) == before and exports.read_csv(spark, path).count() == 10
    with pytest.raises(Exception, match="lost"):
        exports.write_parquet(broken, str(tmp_path / "none"), {})
    assert not os.path.exists(tmp_path / "none") or listed(tmp_path / "none") == []
    file_sink.write(exports.as_text(rows_of(spark, 5)), path, "csv", {"export": "more"}, mode="append")
    assert exports.read_csv(spark, path).count() == 15


def test_months_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    days = ["2020-01-31", "2021-05-31", "2021-06-01", "2024-06-15"]
    exports.write_observations(spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("ts"), F.lit(1).alias("k")), path, "ts", ["k"])
    assert exports.expire_months(spark, path, "2024-06-15", 36, dry_run=True) == ["202001", "202105"]
    assert spark.read.parquet(path).count() == 4
    assert exports.expire_months(spark, path, "2024-06-15", 36) == ["202001", "202105"] and exports.expire_months(spark, path, "2024-06-15", 36) == []
    assert sorted(str(r.ts) for r in spark.read.parquet(path).collect()) == days[2:]
    assert exports.expire_months(spark, path, "2024-06-15", exports.RETENTION["scans"]) == ["202106"]
    assert exports.expire_months(spark, str(tmp_path / "absent"), "2024-06-15", 1) == []


def test_captures_are_swept(spark, tmp_path):
    now = time.time()
    for prefix, name, days in (("light", "h1/old.gz", 91), ("light", "h1/new.gz", 89), ("checkout", "h2/x/old.har", 200), ("other", "old.gz", 400)):
        at = tmp_path / prefix / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x")
        os.utime(at, (now - 86400 * days,) * 2)
    (tmp_path / "checkout").mkdir(exist_ok=True)
    before = F.current_timestamp() - F.expr("INTERVAL 90 DAYS")
    left = lambda: sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    all_ = left()
    for dry in (True, False):
        assert {r.prefix: r.removed for r in exports.sweep_captures(spark, str(tmp_path), before, dry_run=dry).collect()} == {"light": 1, "checkout": 1}
        assert left() == (all_ if dry else ["light/h1/new.gz", "other/old.gz"])
    assert {r.removed for r in exports.sweep_captures(spark, str(tmp_path), before).collect()} == {0}


def test_plans_of_optouts_go(spark, rows):
    plans = spark.createDataFrame([(1,), (2,), (3,), (None,)], "host_id long")
    hosts = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "host_id long, domain string")
    domains = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "domain string, optout boolean")
    assert rows(exports.without_optouts(plans, hosts, domains)) == [(2,), (3,), (None,)]
