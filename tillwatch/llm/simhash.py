"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints of equal value are one node. Two fingerprints that differ in at most DISTANCE of 64 bits agree in at least
two of six chunks, so the index's top level has a node for each pair of chunks and pattern of their bits: the patterns
that groups of fingerprints share under a mask. A top node's fingerprints are sorted by Gray rank, where neighbours share
long bit patterns; below it, halves of the sorted run are nodes with the bits on which all members agree, down to single
fingerprints. Pairs of nodes are descended together, and each carries the bits that are settled and how many of them
differ: a level adds the differences of the bits on which both nodes newly agree, and a pair is pruned as a whole once they
are more than DISTANCE. Nodes whose members differ in at most DISTANCE bits altogether are linked without comparing any.
Only a spanning set of links leaves a task, never all pairs of a group.

Top nodes of over BLOCK fingerprints (sizes come from a grouped count that is joined, so that Spark can split a large one)
are cut into blocks by a hash, and pairs of blocks are tasks of their own, so no group grows a task. Links become components
by large and small stars, without a driver-side list.

Nulls and empty texts have fingerprint zero. Null ids are allowed; a component's id is its smallest non-null id.
Repeated rows share a component. An empty table gives no rows. Columns are carried in a struct, so names can't clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .similar import similar_links

DISTANCE, SHINGLE, SEED = 4, 4, 42
#: Bits of the six chunks; fingerprints of one pattern that a task compares with as many others; pairs of nodes that are descended at once.
CHUNKS = (11, 11, 11, 11, 10, 10)
BLOCK, PAIRS = 4096, 100_000
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def _masks() -> list[int]:
    """The bits of each pair of chunks, as signed 64-bit integers."""
    ends = np.cumsum(CHUNKS)
    chunk = [((1 << size) - 1) << int(end - size) for size, end in zip(CHUNKS, ends)]
    both = [a | b for a, b in combinations(chunk, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def fingerprints_of(texts: list[bytes | None]) -> np.ndarray:
    """Fingerprints as unsigned integers."""
    import xxhash

    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = (text or b"").translate(_LOWER).split()
        if len(words) <= SHINGLE:
            shingles = [b" ".join(words)] if words else []
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
            shingles = [joined[a:b] for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
        hashes += [digest(s, SEED) for s in shingles]
        counts.append(len(shingles))
    out = np.zeros(len(texts), np.uint64)
    counts = np.array(counts)
    if len(full := np.flatnonzero(counts)):
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = (np.cumsum(counts) - counts)[full]
        most = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) > counts[full][:, None]
        out[full] = np.packbits(most, axis=1).view(">u8").ravel()
    return out


def fingerprints(df: DataFrame, carry: Column, text: Column) -> DataFrame:
    """Fingerprints of all rows: row (the carried struct), fp long."""
    common.session(df.sparkSession)
    sent = df.select(carry.alias("row"), text.alias("t"))

    def run(batches):
        for batch in batches:
            found = [fingerprints_of(part.column("t").cast(pa.binary()).to_pylist()) for part, _, _ in common.chunks(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], names=["row", "fp"])

    return sent.mapInArrow(run, f"row {sent.schema['row'].dataType.simpleString()}, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the reflected Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


class _Patterns:
    """Bits that all, and that any, of a range of fingerprints have, for many ranges at once."""

    def __init__(self, fps: np.ndarray, longest: int):
        self.every, self.some = [fps], [fps]
        for k in range(max(0, longest.bit_length() - 1)):
            a, b = self.every[-1], self.some[-1]
            self.every.append(a[: -(1 << k)] & a[1 << k :])
            self.some.append(b[: -(1 << k)] | b[1 << k :])

    def of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level = np.frexp(high - low)[1] - 1
        every, some = np.empty(len(low), np.uint64), np.empty(len(low), np.uint64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            a, b = low[at], high[at] - (1 << k)
            every[at] = self.every[k][a] & self.every[k][b]
            some[at] = self.some[k][a] | self.some[k][b]
        return every, some


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ranges, and the range of each."""
    sizes = high - low
    own = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(own)) - (np.cumsum(sizes) - sizes)[own] + low[own], own


def group_links(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of many groups: rows sorted by group, then Gray rank; group: a number per row."""
    n = len(fps)
    if not n:
        return fps, fps
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.append(starts[1:], n)
    patterns = _Patterns(fps, int((ends - starts).max()))
    label = np.arange(n)

    def link(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal label
        while len(apart := np.flatnonzero(label[u] != label[v])):
            u, v = u[apart], v[apart]
            np.minimum.at(label, np.maximum(label[u], label[v]), np.minimum(label[u], label[v]))
            while (label != (flat := label[label])).any():
                label = flat

    todo = [(starts, ends, starts, ends, np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint8))]
    while todo:
        a, b, c, d, settled, gap = todo.pop()
        if len(a) > PAIRS:
            todo += [tuple(x[k : k + PAIRS] for x in (a, b, c, d, settled, gap)) for k in range(0, len(a), PAIRS)]
            continue
        every, some = patterns.of(a, b)
        other, any_ = patterns.of(c, d)
        agreed = ~(every ^ some) & ~(other ^ any_)
        gap = gap + np.bitwise_count((every ^ other) & agreed & ~settled)
        tight = np.bitwise_count((every & other) ^ (some | any_)) <= DISTANCE
        near = np.flatnonzero(tight)
        for low, high in ((a[near], b[near]), (c[near], d[near])):
            members, own = _ranges(low, high)
            link(members, a[near][own])
        rest = np.flatnonzero((gap <= DISTANCE) & ~tight)
        if not len(rest):
            continue
        a, b, c, d, settled, gap = (x[rest] for x in (a, b, c, d, agreed, gap))
        same, first = a == c, (b - a) >= (d - c)
        m = np.where(first, (a + b) // 2, (c + d) // 2)
        one, two, three = np.flatnonzero(same), np.flatnonzero(~same & first), np.flatnonzero(~same & ~first)
        parts = [(a, m, a, m, one), (m, b, m, b, one), (a, m, m, b, one), (a, m, c, d, two), (m, b, c, d, two), (a, b, c, m, three), (a, b, m, d, three)]
        todo.append(tuple(np.concatenate([p[k][p[4]] for p in parts]) for k in range(4)) + tuple(np.concatenate([x[p[4]] for p in parts]) for x in (settled, gap)))
    linked = np.flatnonzero(label != np.arange(n))
    return fps[linked], fps[label[linked]]


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that span all pairs of `nodes` (fp, distinct) within DISTANCE."""
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(_masks())])
    rows = nodes.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    shared = common.checkpointed(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    counted = rows.join(shared.hint("merge"), ["t", "key"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("bigint")
    own = F.pmod(F.xxhash64("fp"), blocks)
    pairs = F.when(F.col("n") > BLOCK, F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda x: F.shiftleft(F.least(own, x), 31) + F.greatest(own, x))).otherwise(F.array(F.lit(0).cast("bigint")))
    dealt = counted.select("t", "key", "fp", F.explode(pairs).alias("pair"))
    dealt = dealt.repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair", gray_rank(F.col("fp"))).select("t", "key", "pair", "fp")

    def run(batches):
        rest = None
        for batch in batches:
            rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
            if rest.num_rows < 20_000:
                continue
            group = _numbered(rest)
            last = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            if last:
                yield _linked(group[:last], rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None and rest.num_rows:
            yield _linked(_numbered(rest), rest)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _numbered(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for name in ("t", "key", "pair"):
        x = table.column(name).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _linked(group: np.ndarray, table: pa.Table) -> pa.RecordBatch:
    u, v = group_links(group, table.column("fp").to_numpy().view(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """Each row's fingerprint and component: id, fp long, component_id. With a similarity, texts whose shingle sets are as
    similar are linked too, as far from each other as their fingerprints may be."""
    if similarity is None:
        hashed = common.checkpointed(fingerprints(df, F.struct(df[id_col].alias("i")), df[text_col]).select("row.i", "fp"))
    else:
        hashed = common.checkpointed(fingerprints(df, F.struct(df[id_col].alias("i"), F.xxhash64(df[text_col]).alias("h")), df[text_col]).select("row.i", "row.h", "fp"))
    nodes = common.checkpointed(hashed.groupBy("fp").agg(F.min("i").alias("first")))
    found = links(nodes.select("fp"))
    if similarity is not None:
        of = hashed.select("h", "fp").distinct()
        more = similar_links(df, text_col, similarity).join(of.toDF("a", "u"), "a").join(of.toDF("b", "v"), "b")
        found = found.unionByName(more.where("u <> v").select("u", "v"))
    roots = components(found)
    joined = common.checkpointed(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = common.checkpointed(joined.groupBy("root").agg(F.min("first").alias("component_id")))  # stored, so that the partition of a large component can be split
    named = joined.join(least, "root").select(F.col("fp").alias("node"), "component_id")
    return hashed.join(named, hashed["fp"] == named["node"]).select(F.col("i").alias(id_col), "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over the whole `documents`."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
