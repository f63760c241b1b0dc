"""Operators over ordered rows that never put a key's rows into one task: as-of joins, carried sums, exact order statistics.

Rows are dealt out by ranges of their whole order (key, place, and a number that tells rows of one place apart), so a hot key
is cut into slices like any other stretch of rows. A slice is worked on by itself; what it tells the slices after it is one row
a slice and key. Slices are stored before they are used twice, as a range partitioning is sampled anew whenever it is computed.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import address
from ..session import shared_folder

#: Ranges that a round of the selection counts, rows that are then sorted, and keys whose ranges are broadcast.
RANGES, SORTED_ROWS, BROADCAST_KEYS = 1024, 10_000, 10_000


def stored(df: DataFrame) -> DataFrame:
    """The rows from a table in the application's shared folder: computed once, whatever is lost."""
    path = f"{shared_folder(df.sparkSession)}/ordered-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A small frame that a loop goes on with, its lineage cut in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _tie(df: DataFrame) -> Column:
    """What tells rows of one place apart: a hash of the row, then a number. Only rows that are equal in all but maps are told by the number, which may differ when a task runs again."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.struct(F.xxhash64(*plain).alias("h"), F.monotonically_increasing_id().alias("n"))


def sliced(df: DataFrame, *order: str) -> DataFrame:
    """Rows with `_row` (tells rows of one place apart) and `_slice`: slices ascend with the order, and no slice is larger for a hot key."""
    numbered = df.withColumn("_row", _tie(df))
    return stored(numbered.repartitionByRange(*order, "_row").withColumn("_slice", F.spark_partition_id()))


def as_of(points: DataFrame, point: Column, starts: DataFrame, start: Column, found: str = "found") -> DataFrame:
    """Points with the last start at or before them, a struct of its row in `found` (null before the first, and for a null point).

    Points and starts are sorted together by ranges. Within a slice, the last start is carried from row to row and from batch to
    batch; each slice reports its last start, and rows before a slice's first start take the report of the slice before. Points
    move once, starts are never copied, and a hot point is spread over slices. Of equal starts the last row counts.
    """
    p, s = F.struct(*points.columns), F.struct(*starts.columns)
    shape = lambda d: d.schema["_x"].dataType.simpleString()
    left, right = points.select(point.alias("_k"), F.lit(1).alias("_kind"), p.alias("_x")), starts.where(start.isNotNull()).select(start.alias("_k"), F.lit(0).alias("_kind"), s.alias("_x"))
    p_type, s_type = shape(left), shape(right)
    both = left.select("_k", "_kind", F.col("_x").alias("_p"), F.lit(None).cast(s_type).alias("_s")).unionByName(right.select("_k", "_kind", F.lit(None).cast(p_type).alias("_p"), F.col("_x").alias("_s")))
    names = ["_p", "_f", "_slice", "_open", "_end"]
    dealt = both.withColumn("_row", _tie(both)).repartitionByRange("_k", "_kind", "_row").sortWithinPartitions("_k", "_kind", "_row")

    def carry(batches):
        held = where = None
        for batch in batches:
            begun, s = batch.column("_kind").to_numpy() == 0, batch.column("_s")
            held, where = s[:0] if held is None else held, batch.slice(0, 1)
            pool = pa.concat_arrays([held, s])
            last = np.maximum.accumulate(np.where(begun, np.arange(len(begun)) + len(held), len(held) - 1))
            rows = np.flatnonzero(~begun)
            at = last[rows]
            yield pa.RecordBatch.from_arrays([batch.column("_p").take(pa.array(rows)), pool.take(pa.array(at, mask=at < 0)), batch.column("_slice").take(pa.array(rows)), pa.array(at < 0), pa.array(np.zeros(len(rows), bool))], names=names)
            held = pool.slice(last[-1], 1) if len(last) and last[-1] >= 0 else held
        if where is not None and len(held):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, where.column("_p").type), held, where.column("_slice"), pa.array([False]), pa.array([True])], names=names)

    carried = stored(dealt.select("_kind", "_p", "_s", F.spark_partition_id().alias("_slice")).mapInArrow(carry, f"_p {p_type}, _f {s_type}, _slice int, _open boolean, _end boolean"))
    ends = carried.where("_end").select("_slice", "_f")
    slices = carried.select("_slice").distinct().join(ends, "_slice", "left")
    before = F.last("_f", ignorenulls=True).over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))  # a row a slice
    reports = slices.select("_slice", before.alias("_b"))
    rows = carried.where("not _end").join(F.broadcast(reports), "_slice", "left")  # as many rows as there are partitions
    return rows.select("_p.*", F.when(F.col("_open"), F.col("_b")).otherwise(F.col("_f")).alias(found))


def address_ranges(points: DataFrame, ranges: DataFrame, ip: str) -> DataFrame:
    """Points with the range that holds their address, if any: an as-of join of addresses and range starts, families apart.

    ranges: low and high addresses as text in `low_ip`, `high_ip`, closed and disjoint within a family; further columns come along
    (null where no range holds the point, or it is no address).
    """
    key = lambda a: F.concat(a["family"].cast("string"), a["digits"])
    kept = ranges.withColumns({"_low": key(address(F.col("low_ip"))), "_high": key(address(F.col("high_ip")))}).where("_low is not null and _high >= _low and left(_low, 1) = left(_high, 1)")
    keyed = points.withColumn("_key", key(address(F.col(ip))))
    rows = as_of(keyed, F.col("_key"), kept, F.col("_low"), "_r")
    held = F.when((F.col("_r._high") >= F.col("_key")) & (F.substring("_r._high", 1, 1) == F.substring("_key", 1, 1)), F.col("_r"))
    return rows.select(*points.columns, *[held[c].alias(c) for c in ranges.columns])


def order_statistics(df: DataFrame, value: Column, wanted: dict[str, float], by: tuple[str, ...] = (), between: bool = False) -> DataFrame:
    """Exact quantiles by selection: `by`, and a column for each name of `wanted` (its fraction).

    Each round counts a group's values in RANGES equal ranges between two values known to enclose the wanted rank, and narrows
    them to the least and greatest value of the range that holds it; once they are one value, or enclose SORTED_ROWS at most, the
    rank is picked. No buffer grows with a group, however many values it has. Ranks are nearest ranks (the least value that
    `fraction` of all don't exceed), or with `between` interpolated between two neighbours, as a median is. Nulls, NaN and
    infinite values take no part; a group without values has nulls. Ties are values like others.
    """
    group = F.struct(*by) if by else F.lit(0)
    whole = df.select(group.alias("_g"), value.alias("_v")).schema["_v"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    rows = df.select(group.alias("_g"), value.cast("bigint" if whole else "double").alias("_v"))
    sound = F.col("_v").isNotNull() if whole else F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf"))
    rows = rows.select("_g", F.when(sound, F.col("_v")).alias("_v"))
    ends = rows.groupBy("_g").agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    place = lambda f: (F.col("n") - 1) * F.lit(float(f)) if between else F.greatest(F.ceil(F.col("n") * F.lit(float(f))), F.lit(1)) - 1
    ranks = [F.struct(F.lit(f"{name}{side}").alias("name"), (cut(place(f)) + 1).cast("bigint").alias("k")) for name, f in wanted.items() for side, cut in ((("<", F.floor), (">", F.ceil)) if between else (("", F.floor),))]
    state = checkpointed(ends.select("*", F.explode(F.array(*ranks)).alias("r")).select("_g", "r.name", "r.k", "lo", "hi", F.col("n").alias("inside"), F.col("n").alias("n")).where("n > 0"))

    def meet(open_: DataFrame) -> DataFrame:
        few = open_.count() <= BROADCAST_KEYS * len(ranks)
        j = rows.join(F.broadcast(open_) if few else open_, "_g")
        return j.where("_v between lo and hi")

    while (wide := state.where(f"lo < hi and inside > {SORTED_ROWS}")).limit(1).count():
        gap = (lambda a, b: (F.col(a).cast("decimal(20,0)") - F.col(b).cast("decimal(20,0)")).cast("double")) if whole else (lambda a, b: F.col(a) / 2.0 - F.col(b) / 2.0)
        share = F.coalesce(F.try_divide(gap("_v", "lo"), gap("hi", "lo")), F.when(F.col("_v") > F.col("lo"), 1.0).otherwise(0.0))  # the gap of the smallest doubles is 0
        counted = meet(wide).withColumn("bucket", F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).groupBy("_g", "name", "k", "n", "bucket").agg(F.count("*").alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("inside").over(Window.partitionBy("_g", "name").orderBy("bucket"))  # RANGES rows at most
        narrowed = counted.withColumn("upto", upto).where("upto >= k and upto - inside < k").select("_g", "name", (F.col("k") - F.col("upto") + F.col("inside")).alias("k"), "lo", "hi", "inside", "n")
        state = checkpointed(narrowed.unionByName(state.where(f"not (lo < hi and inside > {SORTED_ROWS})")))
    few = meet(state.where("lo < hi"))
    order = Window.partitionBy("_g", "name").orderBy("_v")  # SORTED_ROWS rows at most
    picked = few.withColumn("_n", F.row_number().over(order)).where("_n = k").select("_g", "name", F.col("_v").alias("v"))
    at = picked.unionByName(state.where("lo = hi").select("_g", "name", F.col("lo").alias("v")))
    found = at.groupBy("_g").agg(*[F.max(F.when(F.col("name") == f"{name}{side}", F.col("v"))).alias(f"{name}{side}") for name in wanted for side in (("<", ">") if between else ("",))])
    out = ends.select("_g", "n").join(found, "_g", "left")

    def told(name: str, f: float) -> Column:
        if not between:
            return F.col(f"`{name}`").alias(name)
        low, high = F.col(f"`{name}<`").cast("double"), F.col(f"`{name}>`").cast("double")
        return (low + (high - low) * (place(f) - F.floor(place(f)))).alias(name)

    return out.select(*([f"_g.{c}" for c in by] if by else []), *[told(name, f) for name, f in wanted.items()])
