"""Mixing sources to target weights, in DataFrame operations alone.

Each document gets a hash-random key. The key space is cut into equal ranges; (source, range) is what the data are
dealt out and sorted by, so a hot source spreads over all tasks. Sums per (source, range) give each range's offset by a
prefix sum over at most `ranges` rows a source, and a running sum within a range gives each document's place in its
source. A source takes whole epochs while its budget lasts and cuts the last epoch at the exact word.

The key is a hash of id and text, so rows that share an id, or have none, spread as well.

Nulls: a null text has size 0, a null source is a source of its own (last), a null id counts as the empty text for its
key. Repeated rows are documents of their own with one key, cut in the order of id and size. A table without words
gives targets of 0. Other columns of any name don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Cuts of the key space. A range of the largest source holds rows / RANGES documents, whatever their order.
RANGES_HEX = 3


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Water-filling over sources: source, source_size, target.

    `sizes` has source and source_size, one row a source. Resharing the excess until no source is above its cap ends at
    target = min(cap * size, level * weight); as caps are reached in the order of cap / weight, the level follows from
    prefix sums in that order.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = weighed.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    filled = filled.withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(Window.partitionBy())
    return filled.withColumn("at", level["level"]).select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("weight"))).alias("target"))


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of each document: id, source, size, source_size, target, taken.

    taken counts words, repeats included: whole epochs, and what the cut leaves of the last one. `carry` names further
    columns to hand through.
    """
    named = F.coalesce(df[id_col].cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit(seed + ":"), named, F.lit(":"), F.md5(F.coalesce(df[text_col], F.lit("")).cast("binary"))).cast("binary"))
    sized = df.select(df[id_col].alias("i"), df[source_col].alias("source"), F.coalesce(F.regexp_count(df[text_col], F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), key.alias("key"), *[df[c].alias(f"c_{k}") for k, c in enumerate(carry)])
    sized = sized.withColumn("range", F.substring("key", 1, RANGES_HEX))
    dealt = common.checkpointed(sized.repartition("source", "range"))  # a narrow table; texts are read once
    ranges = dealt.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    in_source = Window.partitionBy("source").orderBy("range")
    placed = ranges.withColumn("ahead", F.sum("range_size").over(in_source) - F.col("range_size"))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    placed = placed.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("range").alias("r"), "ahead", "source_size", "target")
    in_range = Window.partitionBy("source", "range").orderBy("key", "i", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = dealt.withColumn("upto", F.sum("size").over(in_range))
    joined = running.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - (F.col("ahead") + F.col("upto") - F.col("size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return joined.select(F.col("i").alias(id_col), "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"), *[F.col(f"c_{k}").alias(c) for k, c in enumerate(carry)])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over the whole `documents`."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * CAST(2 AS DOUBLE) AS cap,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM sources),
filled AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM sources) AS BIGINT) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed),
goal AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM filled WHERE level * weight < cap ORDER BY cap / weight, level LIMIT 1)), cap) AS target
  FROM filled),
placed AS (
  SELECT s.*, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - (upto - size))) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
