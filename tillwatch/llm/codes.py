"""Product codes of vectors, with nearest codebook entries found by LAESA.

A vector of whole numbers is cut into equal parts; each part position has its own codebook. LAESA measures the distance of
every part to a few fixed pivots once; these distances are stored beside the parts. A round measures only pivots against
entries. By the triangle inequality, |d(part, pivot) - d(entry, pivot)| bounds d(part, entry) from below for every pivot;
entries are tried in the order of the greatest such bound, the squared distance is evaluated in exact integers, and a part
is done once the next bound exceeds its best distance. Bounds are floats and are lowered by more than their error, so
pruning never changes a result; ties go to the lower index.

A round sums parts by entry within each task, in arrays of one codebook's size, and then over tasks; entries that no
part chose stay. What goes through the driver is one codebook (parts x entries x width), whatever the number of rows.

Vectors that are null, or hold null or non-finite components, take no part. Vectors shorter than the longest one, and
lengths that the number of parts doesn't divide, are filled up with zeros. The codebooks begin as the first rows by id (null last),
then by vector; fewer rows give fewer entries. Repeated rows count as often as they occur. Null labels are one label. Whole
numbers must stay below 2^28 in size, so that distances are 64-bit. An empty table gives no rows. Only named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .cover_tree import quantised

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 3
#: Relative error that pivot distances kept as 32-bit floats may have, and more.
SLACK = 1e-6
#: Most labels whose sums are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of parts (rows, positions, width) to points (positions, points, width): rows, positions, points."""
    return np.stack([np.sqrt(((a - b[:, k]) ** 2).sum(axis=-1).astype(np.float64)) for k in range(b.shape[1])], axis=-1)


def pivots_of(books: np.ndarray, pivots: int) -> np.ndarray:
    """Base prototypes of every position: entries whose distances to those before add up to most."""
    each = roots(books.transpose(1, 0, 2), books)  # entries, positions, entries
    total, chosen = each[0].copy(), [np.zeros(len(books), np.int64)]
    for _ in range(1, min(pivots, books.shape[1])):
        chosen.append(total.argmax(axis=1))
        total += each[chosen[-1], np.arange(len(books))]
    return np.stack([books[np.arange(len(books)), c] for c in chosen], axis=1)


class Search:
    """Nearest entries of parts under fixed codebooks."""

    def __init__(self, books: np.ndarray, pivots: np.ndarray):
        self.books = books
        self.away = roots(books.transpose(1, 0, 2), pivots).transpose(1, 0, 2).astype(np.float32)  # positions, entries, pivots
        self.evaluated = 0

    def nearest(self, x: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part; `away`: distances of the parts to the pivots."""
        rows, positions, width = x.shape
        low = np.zeros((rows, positions, self.books.shape[1]), np.float32)
        for k in range(away.shape[2]):
            mine, theirs = away[:, :, None, k], self.away[None, :, :, k]
            np.maximum(low, np.abs(mine - theirs) - SLACK * (mine + theirs + 1), out=low)
        low = low.reshape(rows * positions, -1)
        order = low.argsort(axis=1, kind="stable")
        low = np.take_along_axis(low, order, 1).astype(np.float64) ** 2 * (1 - SLACK)
        x, position = x.reshape(-1, width), np.tile(np.arange(positions), rows)
        best, who = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), self.books.shape[1])
        live = np.arange(len(x))
        for k in range(self.books.shape[1]):
            live = live[low[live, k] <= best[live]]
            if not len(live):
                break
            self.evaluated += len(live)
            entry = order[live, k]
            d = ((x[live] - self.books[position[live], entry]) ** 2).sum(axis=1)
            better = (d < best[live]) | ((d == best[live]) & (entry < who[live]))
            best[live[better]], who[live[better]] = d[better], entry[better]
        return who.reshape(rows, positions), best.reshape(rows, positions)


def measured(rows: DataFrame, width: int, parts: int, pivots: np.ndarray) -> DataFrame:
    """Rows (i, label, x) with the distances of their parts to the pivots, stored: the once that LAESA measures them."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), width)
            away = roots(x.reshape(len(x), parts, width // parts), pivots).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel(), pa.int64()))
            near = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts * pivots.shape[1], pa.int32()), pa.array(away.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("label"), flat, near], names=["i", "label", "x", "away"])

    schema = f"i {rows.schema['i'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, x array<long>, away array<float>"
    return common.stored(rows.mapInArrow(run, schema))


def taken_up(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    return batch.column("x").flatten().to_numpy().reshape(n, parts, -1), batch.column("away").flatten().to_numpy().reshape(n, parts, -1)


def updated(kept: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts that are nearest to it."""
    parts, entries, width = books.shape
    shared = kept.sparkSession.sparkContext.broadcast((books, pivots))

    def run(batches):
        search = Search(*shared.value)
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, away = taken_up(batch, parts)
                cell = (np.arange(parts) * entries + search.nearest(x, away)[0]).ravel()
                order = cell.argsort(kind="stable")
                new = np.flatnonzero(np.diff(cell[order], prepend=-1))
                sums[cell[order[new]]] += np.add.reduceat(x.reshape(-1, width)[order], new, axis=0)
                counts += np.bincount(cell, minlength=len(counts))
        cells = np.flatnonzero(counts)
        place = (cells[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums[cells].ravel()), pa.array(np.repeat(counts[cells], width))], names=["place", "s", "n"])

    summed = kept.mapInArrow(run, "place long, s long, n long").groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = books.ravel().copy()
    for place, s, n in summed.collect():  # one codebook
        out[place] = int(s) // n
    return out.reshape(books.shape)


def coded(kept: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """i, label, code (an entry a part), error."""
    parts = len(books)
    shared = kept.sparkSession.sparkContext.broadcast((books, pivots))

    def run(batches):
        search = Search(*shared.value)
        for batch in batches:
            if batch.num_rows:
                who, d = search.nearest(*taken_up(batch, parts))
                code = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * parts, pa.int32()), pa.array(who.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("label"), code, pa.array(d.sum(axis=1))], names=["i", "label", "code", "error"])

    schema = f"i {kept.schema['i'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code array<int>, error long"
    return kept.mapInArrow(run, schema)


def encode(df: DataFrame, vector: Column, id_col: str = "vec_id", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors: id, label, code array<int>, error; and the codebooks (parts, entries, width). `vector` is an array of whole numbers; rows where it is null are dropped."""
    common.session(df.sparkSession)
    rows = df.select(df[id_col].alias("i"), df[label_col].alias("label"), vector.cast("array<long>").alias("x")).where("x is not null")
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    first = rows.orderBy(F.col("i").asc_nulls_last(), "x").limit(entries).select("x").toArrow().column("x").combine_chunks()
    books = matrix(first, width).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    if not len(first):
        return rows.select(F.col("i").alias(id_col), F.col("label").alias(label_col), F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error")), books
    fixed = pivots_of(books, pivots)
    kept = measured(rows, width, parts, fixed)
    for _ in range(rounds):
        books = updated(kept, books, fixed)
    return coded(kept, books, fixed).select(F.col("i").alias(id_col), F.col("label").alias(label_col), "code", "error"), books


def with_label_errors(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """Codes with the sum of error over all rows of the same label (null: one label) in label_error."""
    codes = common.stored(codes)
    sums = common.checkpointed(codes.groupBy(F.col(label_col).alias("of")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col(label_col).eqNullSafe(F.col("of"))).drop("of")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over the whole `embeddings`."""
    codes, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), quantised(F.col("embedding"), 256))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return with_label_errors(codes).select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Two rounds and the final assignment, one after the other; distances by |a|^2 - 2ab + |b|^2 over doubles, exact for whole numbers of this size."""

    def nearest(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (
  SELECT r, p, v, arg_min(e, d * 64 + e) AS e, min(d) AS d
  FROM (SELECT r, p, part.v, e, CAST(list_dot_product(part.v, part.v) - 2 * list_dot_product(part.v, book{k}.v) + list_dot_product(book{k}.v, book{k}.v) AS BIGINT) AS d
        FROM part JOIN book{k} USING (p))
  GROUP BY r, p, v)"""

    def moved(k: int) -> str:
        return f"""book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.v, o.v) AS v
  FROM book{k} o LEFT JOIN (
    SELECT p, e, list(CAST(floor(s / c) AS DOUBLE) ORDER BY i) AS v
    FROM (SELECT p, e, i, sum(v[i]) AS s, count(*) AS c FROM near{k}, (SELECT unnest(generate_series(1, (SELECT max(len(v)) FROM part))) AS i) GROUP BY p, e, i)
    GROUP BY p, e) n USING (p, e))"""

    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
part AS MATERIALIZED (SELECT r, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS v FROM kept, (SELECT unnest(generate_series(0, 15)) AS p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM part WHERE r <= 64),
{nearest(0)},
{moved(0)},
{nearest(1)},
{moved(1)},
{nearest(2)},
code AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near2 JOIN kept USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM book2)) AS codebooks_sha256
FROM code
"""


OP13_SQL = _sql()
