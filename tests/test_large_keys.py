"""Queries over tables like those of larger scales: keys beyond 65,536, titles that a scan cuts, many rows to a task."""

import pytest

from tillwatch.plans import registry

KEYS = [k + far for far in (0, 65536, 245 * 65536, 246 * 65536, 2**24, 2**32) for k in range(1, 60)]


@pytest.fixture()
def customers(spark, tmp_path):
    spark.createDataFrame([(k,) for k in KEYS], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def test_two_families_of_large_keys(spark, customers):
    got = {r.c_custkey: r.asn for r in registry.queries()["j08_two_families"](spark, customers).collect()}
    assert got == {k: k if k % 7 == 0 else None for k in KEYS}


def test_addresses_as_of_large_keys(spark, customers):
    got = {r.c_custkey: r.asn for r in registry.queries()["j08_addresses_as_of"](spark, customers).collect()}
    assert got == {k: {0: k, 1: k, 2: k, 4: -3, 5: -12, 6: k if k % 3 == 0 else None}.get(k % 8) for k in KEYS}


def test_title_with_references_that_its_sql_keeps(spark, tmp_path):
    titles = {1: ("a&amp;&amp", "a&&amp"), 2: ("&lt;b&gt; &amp;amp;", "&lt;b&gt; &amp;"), 3: ("a & b&copy;", "a & b&copy;")}
    pages = [(k, f"https://s.example/{k}", f'<html lang="EN"><head><title>{t}</title></head><body><a href="/x?a=1&b=2">x</a><script>var t = a && b;</script></body></html>') for k, (t, _) in titles.items()]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: tuple(r)[1:] for r in registry.queries()["d01_page_features"](spark, str(tmp_path)).collect()}
    assert got == {k: (t, "en", 1, 0, 1) for k, (_, t) in titles.items()}


def test_portions_of_a_batch_are_few_rows_and_few_bytes():
    import pyarrow as pa

    from tillwatch.functions import text

    texts = ["x" * 10] * 1000 + ["y" * (3 << 20)] * 3 + [None, "z" * (9 << 20), ""]
    parts = list(text.portions(pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["t", "k"]), "t"))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(len(texts)))
    for p in parts:
        assert 0 < p.num_rows <= text.PORTION_ROWS
        assert p.num_rows == 1 or sum(len(t or "") for t in p.column("t").to_pylist()) <= text.PORTION_BYTES
    assert list(text.portions(pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["t"]), "t")) == []


def test_tasks_follow_from_the_bytes_of_files(spark, tmp_path, monkeypatch):
    from tillwatch import session
    from tillwatch.operators import share

    path = str(tmp_path / "a b%.parquet")
    spark.range(50_000).selectExpr("id as host_id", "id % 7 as provider_id", "'A' as country", "'B' as platform", "'N' as role").repartition(3).write.parquet(path)
    held = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "a b%.parquet").glob("*.parquet"))
    monkeypatch.setattr(session, "TASK_BYTES", size // 50)
    assert 50 <= session.tasks_for(held, held) <= 51  # a file counts once
    assert [f.rdd.getNumPartitions() for f in session.dealt("host_id", held)] == [session.tasks_for(held)]
    plan = share.snapshot(held, held, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan  # it would be moved below the distinct members, which would be computed anew
