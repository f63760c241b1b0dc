"""Links between texts whose sets of five-word shingles are similar: what SimHash can't see.

At a similarity of 0.8, SimHashes of 64 bits differ in ten bits and more, and no mask of them is both met and selective.
Candidates therefore share one of BANDS keys, each made of ROWS least shingle hashes. Buckets are of distinct texts; those
of over BLOCK texts are cut into blocks by a hash, and pairs of blocks are tasks of their own, so no bucket grows a task.
Only keys are counted and dealt; texts join those of shared buckets, and their shingle sets decide. A task leaves a spanning
set of links, never all pairs of a bucket. Two texts of similarity s meet with 1 - (1 - s ** ROWS) ** BANDS: 0.93 at 0.8,
0.99 at 0.9.

Texts are told apart by xxhash64. Nulls and texts without words have no links; shorter texts are one shingle of all their
words. An empty table gives no rows. Only the text is read, so further columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 5, 4
#: Texts of a bucket that a task compares with as many others.
BLOCK = 128
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def shingle_hashes(text: bytes) -> list[int]:
    """Hashes of a text's shingles, repeats included; no words: none."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return []
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words))]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
    return [digest(joined[a:b]) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]


def band_keys(texts: list[bytes | None]) -> np.ndarray:
    """BANDS keys of every text; those of texts without words are zero."""
    factors = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
    hashes = [shingle_hashes(t or b"") for t in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((len(texts), BANDS), np.uint64)
    if len(full := np.flatnonzero(counts)):
        every = np.array([x for h in hashes for x in h], np.uint64)
        starts = (np.cumsum(counts) - counts)[full]
        for k, factor in enumerate(factors):
            least = np.minimum.reduceat(every * factor, starts)
            mixed = (out[full, k // ROWS] ^ least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            out[full, k // ROWS] = mixed ^ (mixed >> np.uint64(29))
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets as sorted arrays: common over all."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bucket_links(h: list[int], texts: list[bytes], least: float) -> list[tuple[int, int]]:
    """Spanning links of one bucket: what is linked already isn't compared again."""
    sets = [np.unique(np.array(shingle_hashes(t), np.uint64)) for t in texts]
    label, out = np.arange(len(h)), []
    sizes = np.array([len(s) for s in sets])
    for i in range(1, len(h)):
        near = np.minimum(sizes[:i], sizes[i]) >= least * np.maximum(sizes[:i], sizes[i])
        for j in np.flatnonzero(near).tolist():
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= least:
                label[label == label[i]] = label[j]
                out.append((h[i], h[j]))
    return out


def similar_links(df: DataFrame, text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between hashes of texts (xxhash64) that are similar and share a band."""
    common.session(df.sparkSession)
    texts = df.select(df[text_col].alias("t")).where("t is not null").withColumn("h", F.xxhash64("t"))

    def keyed(batches):
        for batch in batches:
            for part, _, _ in common.chunks(batch, "t"):
                keys = band_keys(part.column("t").cast(pa.binary()).to_pylist()).view(np.int64)
                full = np.flatnonzero(keys.any(axis=1))
                h = part.column("h").to_numpy()[full]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(full))), pa.array(keys[full].ravel()), pa.array(np.repeat(h, BANDS))], names=["band", "key", "h"])

    rows = common.checkpointed(texts.select("t", "h").mapInArrow(keyed, "band int, key long, h long").distinct())
    shared = common.checkpointed(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("bigint")
    own = F.pmod(F.xxhash64("h"), blocks)
    pairs = F.when(F.col("n") > BLOCK, F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda x: F.shiftleft(F.least(own, x), 31) + F.greatest(own, x))).otherwise(F.array(F.lit(0).cast("bigint")))
    dealt = common.checkpointed(rows.join(shared.hint("merge"), ["band", "key"]).select("band", "key", "h", F.explode(pairs).alias("pair")))
    wanted = texts.join(dealt.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("t").alias("t"))
    met = dealt.join(wanted, "h").repartition("band", "key", "pair").sortWithinPartitions("band", "key", "pair", "h")

    def run(batches):
        group, h, own = None, [], []
        for batch in batches:
            for *key, code, text in zip(*(batch.column(c).to_pylist() for c in ("band", "key", "pair", "h")), batch.column("t").cast(pa.binary()).to_pylist()):
                if key != group:
                    yield from linked(h, own)
                    group, h, own = key, [], []
                h.append(code)
                own.append(text)
        yield from linked(h, own)

    def linked(h, own):
        if len(h) > 1 and (found := bucket_links(h, own, least)):
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.select("band", "key", "pair", "h", "t").mapInArrow(run, "a long, b long").distinct()
