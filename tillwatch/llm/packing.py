"""Packing documents into sequences of bounded length: large-item matching, then best fit.

Lengths are whole numbers from 1 to the capacity, so all that decides a packing is how many pieces there are of each
length. The packing is made on these counts (at most `capacity` of them, whatever the number of pieces), as runs of equal
bins: first the pieces above one third of the capacity, of which a bin takes two at most, from the longest on, each with
the longest remaining one that fits; then the rest from the longest on, each into the bin whose gap is the smallest that
takes it, a new bin where none does. That is greedy matching and best fit piece by piece, run by run: bins that hold the
same lengths are filled alike, so a step moves a whole run of them. The plan is some thousand runs, broadcast as arrays.

A piece finds its place by its rank among those of its length. Ranks come from the number a piece has among those of its
length in its task, plus the sum of the counts of the tasks before: pieces of one hot length are never in one task. Pieces
carry no tokens through the shuffle unless asked to.

Tokenising is that of `bpe` (code-point classes, cached merges), whose ids are those of the tokenizers library with the
vocabulary's JSON file, special tokens in a text being ordinary text; a test holds them together.

Null texts are empty and give one piece, the end token. Repeated rows are documents of their own. Very long documents are cut
into pieces of the capacity, of which the first takes what is left over. An empty table gives no rows. Only named columns are
read, so further ones of any name don't matter, unless carried.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

CAPACITY, END = 2048, 0


def tokenised(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """Documents' ids, with the end token, cut into pieces: id, piece, start, length, ids_crc32, and the ids themselves (packed 32-bit, little-endian) if asked for."""
    shared = common.session(df.sparkSession).sparkContext.broadcast((ranks, bpe.pair_table(ranks)))
    key = f"{uuid.uuid4()}"

    def run(batches):
        merges = bpe.merges_of(shared, key)
        for batch in batches:
            for part, data, offsets in common.chunks(batch, "t"):
                found, rows = bpe.encoded_rows(data, offsets, merges)
                found = np.insert(found.astype("<u4"), rows[1:], end)
                begins = rows[:-1] + np.arange(len(rows) - 1)
                sizes = np.diff(rows) + 1
                counts = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                head = (sizes - (counts - 1) * capacity)[doc]  # the first piece takes the remainder
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                packed, at = found.tobytes(), (4 * (begins[doc] + start)).tolist()
                cut = [packed[a : a + 4 * n] for a, n in zip(at, length.tolist())]
                columns = [part.column("i").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(cut, pa.binary())] * ids, names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, schema)


def runs_of(counts: np.ndarray, capacity: int) -> np.ndarray:
    """The packing of counts[length] pieces of each length: rows (length, first rank, sequence of that rank, pieces a sequence, offset in it), by length and rank."""
    left, used = [int(c) for c in counts], [0] * (capacity + 1)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap to runs (first bin, how many)
    runs, bins = [], 0

    def put(length: int, pieces: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], first, each, offset))
        used[length] += pieces
        left[length] -= pieces

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    third = capacity // 3  # pieces above it are large
    for length in range(capacity, third, -1):
        while left[length]:
            other = next((k for k in range(min(length, capacity - length), third, -1) if left[k] > (k == length)), 0)
            n = left[length] if not other else left[length] // 2 if other == length else min(left[length], left[other])
            put(length, n, bins, 1, 0)
            if other:
                put(other, n, bins, 1, length)
            leave(capacity - length - other, bins, n)
            bins += n
    for length in range(third, 0, -1):
        while left[length]:
            gap = min((g for g in gaps if g >= length), default=0)
            first, n = gaps[gap].pop() if gap else (bins, left[length])
            if gap and not gaps[gap]:
                del gaps[gap]
            room, offset = gap or capacity, capacity - gap if gap else 0
            each = room // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, first, each, offset)
                leave(room - each * length, first, full)
            some = left[length] if full < n else 0  # too few to fill one more
            if some:
                put(length, some, first + full, each, offset)
                leave(room - some * length, first + full, 1)
            if gap:
                leave(gap, first + full + (some > 0), n - full - (some > 0))
            else:
                bins += full + (some > 0)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def numbered(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pieces with their task (`at`) and their number among those of their length in it (`k`), stored: numbers stay as they are, whatever is computed again."""

    def run(batches):
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            if len(length) and not ((length >= 1) & (length <= capacity)).all():
                raise ValueError(f"pieces must be 1 to {capacity} long")
            order = length.argsort(kind="stable")
            k = np.empty(len(length), np.int64)
            k[order] = np.arange(len(length)) - np.searchsorted(length[order], length[order])
            k += seen[length.astype(np.int64)]
            seen += np.bincount(length.astype(np.int64), minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(k), task, np.int32)), pa.array(k)], names=[*batch.schema.names, "at", "k"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return common.stored(pieces.mapInArrow(run, f"{fields}, at int, k long"))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (any frame with a `length` of 1 to `capacity`; names `at` and `k` are taken) with their sequence_id and offset. Every sequence is gapless from 0."""
    spark = common.session(pieces.sparkSession)
    kept = numbered(pieces, capacity)
    sizes = kept.groupBy("length", "at").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("at")) - F.col("n")  # a row a task that has the length
    sizes = common.checkpointed(sizes.withColumn("ahead", ahead))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():  # at most one row a length
        counts[length] = n
    shared = spark.sparkContext.broadcast(runs_of(counts, capacity))

    def run(batches):
        plan = shared.value
        key = plan[:, 0] << np.int64(48) | plan[:, 1]
        for batch in batches:
            length, k, before = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "k", "ahead"))
            rank = k + before
            row = plan[np.searchsorted(key, length << np.int64(48) | rank, "right") - 1]
            more = rank - row[:, 1]
            sequence, offset = row[:, 2] + more // row[:, 3], row[:, 4] + more % row[:, 3] * length
            own = batch.select([c for c in batch.schema.names if c not in ("at", "k", "ahead")])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sequence), pa.array(offset)], names=[*own.schema.names, "sequence_id", "offset"])

    ranked = kept.join(sizes.drop("n"), ["length", "at"]).select(*pieces.columns, "at", "k", "ahead")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def sequences(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sequences themselves, of placed pieces with their ids: sequence_id, ids array<int>, documents array<(id, piece, offset)> in order. A sequence is at most as long as the capacity."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col(id_col).alias("id"), "piece")))
    whole = placed.groupBy("sequence_id").agg(inside.alias("inside"))

    def run(batches):
        for batch in batches:
            bounds, packed = batch.column("ids").offsets.to_pylist(), batch.column("ids").flatten().to_pylist()
            rows = [np.frombuffer(b"".join(packed[a:b]), "<u4").astype(np.int32) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(rows, pa.list_(pa.int32())), batch.column("documents")], names=["sequence_id", "ids", "documents"])

    listed = whole.select("sequence_id", "inside.ids", F.transform("inside", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("documents"))
    return listed.mapInArrow(run, f"sequence_id long, ids array<int>, documents {listed.schema['documents'].dataType.simpleString()}")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over the whole `documents`."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return place(tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, ids=False))
