"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tillwatch.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def _plain(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>" else float(v) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)
    return list(frame.columns), sorted(repr(tuple(clean(v) for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    assert _plain(QUERIES[name](spark, SF).toPandas()) == _plain(duck.sql(ORACLES[name]).df())


def test_masked_texts_equal_brute_force(spark):
    """The one query that SQL can't say (its pattern looks behind)."""
    import re

    from tillwatch.functions import text

    assert set(QUERIES) - set(ORACLES) == {"x12_masked_texts"}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = QUERIES["x12_masked_texts"](spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        t, n = docs[r.doc_id], 0
        if t is not None:
            t, a = re.subn(text.MAILTO, "mailto:" + text.EMAIL_MARK, t)
            t, b = re.subn(text.EMAIL, text.EMAIL_MARK, t)
            t, n = re.subn(text.TEL, "tel:" + text.PHONE_MARK, t)
            t = re.sub(text.PHONE, lambda m: text.PHONE_MARK if 7 <= sum(c.isdigit() for c in m[0]) <= 15 else m[0], t)
            assert (r.emails, r.phones) == (a + b, t.count(text.PHONE_MARK))
        assert r.masked == t


def test_canaries_of_large_user_ids(spark, tmp_path):
    users = [(1, 3_000_000), (2, 6_000_000_003), (3, 6_000_000_004), (4, 6)]
    spark.createDataFrame([(k, u, "click") for k, u in users], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["j14_canary_lookup"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(k, f"c-{u}.trap.example") for k, u in users if k != 3]


def test_share_has_all_kinds_of_cells(spark):
    from tillwatch.operators import reports
    from tillwatch.plans.analog import MIN_CELL, Views

    sf = "/root/testdata/sf0.01"
    found = QUERIES["a06_market_share"](spark, sf).collect()
    assert any(r.provider_id == "other" for r in found) and any(r.provider_id != "other" for r in found)
    assert all(r.lo <= r.share <= r.hi and r.total >= MIN_CELL for r in found)
    assert reports.withheld_cells(Views(spark, sf).visible, MIN_CELL).first().withheld > 0


def test_snapshot_reads_as_live(spark, rows):
    from tillwatch.operators import share
    from tillwatch.plans.analog import Views

    v = Views(spark, "/root/testdata/sf0.01")
    cells = share.snapshot(v.visible, v.providers, 5).cache()
    for role in (None, "N", "A"):
        assert rows(share.from_snapshot(cells, 5, role)) == rows(share.market_share(v.visible, v.providers, 5, role))
