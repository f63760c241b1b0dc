"""Quality: perplexity under an interpolated modified Kneser-Ney model of byte sequences, trained on trusted text.

Counts of all five-byte sequences of the trusted texts are summed by Spark; lower orders follow from the distinct longer
sequences. The count table is cut into shards by the two bytes before the last, on which all longer orders of one position
agree. Texts are taken in packs of a few megabytes: a pack asks each shard for its own distinct sequences, requests and
counts meet in a join by shard, and the answers go back to the packs, which add up their texts. Requests of many packs are
dealt into groups, so that neither a shard nor a group outgrows a task; the counts are sent once a group. Nothing is
broadcast but the counts of two-byte sequences (65,536 at most). Packs are named by a hash of their content, so a scan
that is repeated finds its own answers; texts that a repeated scan cuts into other packs are an error.

A tenth of the trusted texts, by a hash of the id, is left out of training. A text is kept up to a quantile, over the
trusted texts of its own language, of the perplexity of unseen text: that of left-out texts as it is, that of the others
times the ratio of the two medians. Nulls and empty texts have no perplexity and aren't kept. Rows without a language are
a language of their own; one without trusted texts takes the quantile over all. Labels that repeat an id count once; the
best says so. With no trusted text, every text is equally likely byte by byte and kept. Repeated rows give repeated
results. Only named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: Most sequences in a shard (a pair of bytes that has more is one); bytes of a pack; scanned partitions whose requests a task answers.
SHARD_KEYS, PACK_BYTES, GROUP_PARTS = 500_000, 8_000_000, 16
#: Quantile of trusted texts that is kept; one of so many trusted texts is left out of training.
KEPT, LEFT_OUT = 0.998, 10
_LOWER = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8)


def sequences(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The five bytes that end at each byte, as one number; bytes before a text are zeros."""
    c = _LOWER[data].astype(np.int64)
    keys = c.copy()
    place = np.arange(len(c)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER):
        keys[k:] |= np.where(place[k:] >= k, c[:-k], 0) << (8 * k)
    return keys


def _packs(batches):
    """Rows i, g, t in packs of about PACK_BYTES: pack (a hash of the content), i, g, sizes, body."""
    held, size = [], 0

    def packed():
        sizes = np.concatenate([np.diff(offsets) for _, _, offsets in held])
        body = b"".join(data.tobytes() for _, data, _ in held)
        i, g = (pa.chunked_array([part.column(c) for part, _, _ in held]).combine_chunks() for c in "ig")
        return xxhash.xxh3_64_intdigest(sizes.tobytes() + body) - (1 << 63), i, g, sizes, body

    for batch in batches:
        for part, data, offsets in common.chunks(batch, "t"):
            if held and size + len(data) > PACK_BYTES:
                yield packed()
                held, size = [], 0
            held.append((part, data, offsets))
            size += len(data)
    if held:
        yield packed()


def packs(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Packs as rows: pack, i, g and size (arrays), body (compressed, or null)."""
    kind = docs.schema["i"].dataType.simpleString()

    def run(batches):
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for pack, i, g, sizes, body in _packs(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pack]), one(i), one(g), one(pa.array(sizes.astype(np.int64))), pa.array([pa.compress(body, "zstd", asbytes=True) if texts else None], pa.binary())], names=["pack", "i", "g", "size", "body"])

    return docs.mapInArrow(run, f"pack long, i array<{kind}>, g array<string>, size array<bigint>, body binary")


def _unpacked(table: pa.Table):
    """Each pack of a table: ids, languages, text buffer, offsets."""
    for row in table.combine_chunks().to_batches():
        for k in range(row.num_rows):
            sizes = row.column("size")[k].values.to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            body = row.column("body")[k].as_buffer()
            data = np.frombuffer(pa.decompress(body, int(offsets[-1]), "zstd") if offsets[-1] else b"", np.uint8)
            yield row.column("i")[k].values, row.column("g")[k].values, data, offsets


def count(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Counts of the sequences of the texts whose id (i) is in `trusted` (k): key, n. A pack sends a sequence once."""
    named = packs(docs, texts=False).select("pack", F.explode("i").alias("k")).join(trusted.select("k").hint("merge"), "k")

    def run(held: pa.Table, wanted: pa.Table) -> pa.Table:
        parts = []
        for ids, _, data, offsets in _unpacked(held) if wanted.num_rows else ():
            own = np.flatnonzero(pa.compute.is_in(ids, value_set=wanted.column("k").combine_chunks()).to_numpy(zero_copy_only=False))
            for k in range(0, len(own), 512):
                texts = [data[offsets[j] : offsets[j + 1]] for j in own[k : k + 512]]
                keys = sequences(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
                parts.append(np.unique(keys, return_counts=True))
                if len(parts) > 8:
                    parts = [_summed(parts)]
        keys, n = _summed(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"key": keys, "n": n})

    found = packs(docs).groupBy("pack").cogroup(named.groupBy("pack")).applyInArrow(run, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken off counts of one, two, and three or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(k - 0.05, max(0.05, d)) for k, d in zip((1, 2, 3), found))])


def _level(keys: np.ndarray, n: np.ndarray, off: np.ndarray, lower) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys with log-probabilities, contexts with log back-off weights, of one order."""
    contexts, back = np.unique(keys >> 8, return_inverse=True)
    total = np.bincount(back, n)
    taken = off[np.minimum(n, 3)]
    weight = np.log(np.bincount(back, taken) / total)
    logp = np.log((n - taken) / total[back] + np.exp(weight[back] + lower(keys)))
    return keys, logp.astype(np.float32), contexts, weight.astype(np.float32)


def _look(level: tuple, keys: np.ndarray, lower) -> np.ndarray:
    """Log-probabilities of keys by one order, which backs off to `lower`."""
    known, logp, contexts, weight = level
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    out = logp[at].astype(np.float64) if len(known) else np.zeros(len(keys))
    if len(miss := np.flatnonzero(known[at] != keys) if len(known) else np.arange(len(keys))):
        wanted = keys[miss] >> 8
        where = np.minimum(np.searchsorted(contexts, wanted), max(0, len(contexts) - 1))
        out[miss] = lower(keys[miss]) + (np.where(contexts[where] == wanted, weight[where], 0.0) if len(contexts) else 0.0)
    return out


class Shard:
    """The model for positions whose third and fourth bytes of five are those of the shard; keys are sorted."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, off: dict[int, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]):
        ones, counts = np.unique(pairs[0] & 255, return_counts=True) if len(pairs[0]) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        single = np.full(256, -np.log(256.0))
        if len(ones):
            share = np.full(256, 0.5 * len(ones) / counts.sum() / 256)
            share[ones] += (counts - 0.5) / counts.sum()
            single = np.log(share)
        self.single = single
        self.levels = {2: _level(*pairs, off[2], self._below(1))} if len(pairs[0]) else {2: (np.zeros(0, np.int64),) * 4}
        tables = {ORDER: (keys, n)}
        for k in range(ORDER - 1, 2, -1):
            tables[k] = np.unique(tables[k + 1][0] & ((1 << 8 * k) - 1), return_counts=True)
        for k in range(3, ORDER + 1):
            self.levels[k] = _level(*tables[k], off[k], self._below(k - 1)) if len(keys) else (np.zeros(0, np.int64),) * 4

    def _below(self, k: int):
        if k == 1:
            return lambda keys: self.single[keys & 255]
        return lambda keys: _look(self.levels[k], keys & ((1 << 8 * k) - 1), self._below(k - 1))

    def logp(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of each sequence's last byte after the four before it."""
        return self._below(ORDER)(keys)


class Whole:
    """What all shards need of the (stored) table of counts: discounts of all orders, counts of pairs, and where shards begin."""

    def __init__(self, counts: DataFrame, limit: int):
        self.off, table = {}, counts
        for k in range(ORDER, 1, -1):
            self.off[k] = discounts(*table.agg(*[F.count_if(F.col("n") == c) for c in (1, 2, 3, 4)]).first())
            if k > 2:
                table = table.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("key")).agg(F.count("*").alias("n"))
        two = table.orderBy("key").toArrow()  # 65,536 rows at most
        self.pairs = two.column("key").to_numpy(), two.column("n").to_numpy()
        bounds, held = [0], 0
        for row in counts.groupBy(_pair().alias("pair")).count().orderBy("pair").collect():  # as many at most
            if held and held + row["count"] > limit:
                bounds.append(row["pair"])
                held = 0
            held += row["count"]
        self.bounds = np.array(bounds, np.int64)

    def part_of(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, (keys >> 8) & 0xFFFF, "right") - 1


def _pair() -> Column:
    return F.shiftright(F.col("key"), 8).bitwiseAND(F.lit(0xFFFF))


def answered(docs: DataFrame, counts: DataFrame, whole: Whole) -> DataFrame:
    """For each pack of `docs`, its distinct sequences with their log-probabilities: pack, keys and logp (as bytes), in several rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(whole)
    groups = max(1, -(-common.partitions_of(docs) // GROUP_PARTS))

    def ask(batches):
        for pack, _, _, sizes, body in _packs(batches):
            data, offsets = np.frombuffer(body, np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            found = [np.unique(sequences(data[offsets[k] : offsets[min(k + 512, len(sizes))]], offsets[k : k + 513] - offsets[k])) for k in range(0, len(sizes), 512)]
            keys = np.unique(np.concatenate(found))
            parts = shared.value.part_of(keys)
            order = np.argsort(parts, kind="stable")
            keys, parts = keys[order], parts[order]
            starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(parts))
            n = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(parts[starts].astype(np.int32)), pa.array(np.full(n, pack % groups, np.int32)), pa.array(np.full(n, pack)), pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], names=["part", "grp", "pack", "keys"])

    def answer(counted: pa.Table, asked: pa.Table) -> pa.Table:
        keys, n = counted.column("key").to_numpy(), counted.column("n").to_numpy()
        order = np.argsort(keys)
        shard = Shard(keys[order], n[order], shared.value.off, shared.value.pairs)
        found = [shard.logp(np.frombuffer(x, np.int64)).astype(np.float32).tobytes() for x in asked.column("keys").to_pylist()]
        return pa.table({"pack": asked.column("pack"), "keys": asked.column("keys"), "logp": pa.array(found, pa.binary())})

    asked = docs.mapInArrow(ask, "part int, grp int, pack long, keys binary")
    cuts = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(whole.bounds, [*whole.bounds[1:], 1 << 16]))], "part int, low int, high int")
    parts = F.broadcast(cuts.select("part", F.explode(F.sequence("low", F.col("high") - 1)).alias("pair")))  # 65,536 rows
    dealt = counts.withColumn("pair", _pair().cast("int")).join(parts, "pair").select("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "key", "n")
    return dealt.groupBy("part", "grp").cogroup(asked.groupBy("part", "grp")).applyInArrow(answer, "pack long, keys binary, logp binary")


def perplexities(docs: DataFrame, counts: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows i, g, t of a frame under the model of stored counts: i, g, n (bytes), s (log-likelihood)."""
    answers = answered(docs, counts, Whole(counts, SHARD_KEYS if limit is None else limit))
    kind = docs.schema["i"].dataType.simpleString()
    schema = pa.schema([("i", packs(docs, False).limit(0).toArrow().schema.field("i").type.value_type), ("g", pa.string()), ("n", pa.int64()), ("s", pa.float64())])

    def run(held: pa.Table, found: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in found.column("keys").to_pylist()]])
        logp = np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(x, np.float32) for x in found.column("logp").to_pylist()]]).astype(np.float64)
        order = np.argsort(known)
        known, logp = known[order], logp[order]
        out = []
        for ids, langs, data, offsets in _unpacked(held):
            sums = np.zeros(len(offsets) - 1)
            for k in range(0, len(sums), 512):
                upto = min(k + 512, len(sums))
                rows = offsets[k : upto + 1] - offsets[k]
                keys = sequences(data[offsets[k] : offsets[upto]], rows)
                at = np.searchsorted(known, keys)
                if len(keys) and (not len(known) or at.max() == len(known) or not (known[at] == keys).all()):
                    raise RuntimeError("another scan gave other packs: store the frame before it is scored")
                full = np.flatnonzero(np.diff(rows))
                if len(full):
                    sums[k + full] = np.add.reduceat(logp[at], rows[full])
            out.append(pa.table([ids, langs, pa.array(np.diff(offsets)), pa.array(sums)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return packs(docs).groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, f"i {kind}, g string, n long, s double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", kept: float = KEPT) -> DataFrame:
    """Per row: id, lang, n_bytes, perplexity, threshold, keep."""
    common.session(docs.sparkSession)
    trusted = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).alias("q")).where("q = 1").select("k", (F.pmod(F.xxhash64("k"), F.lit(LEFT_OUT)) == 0).alias("out"))
    sent = docs.select(docs[id_col].alias("i"), docs[lang_col].cast("string").alias("g"), docs[text_col].alias("t"))
    counts = common.checkpointed(count(sent, trusted.where("not out")))
    scored = perplexities(sent, counts)
    scored = common.checkpointed(scored.select("i", "g", "n", F.when(F.col("n") > 0, F.round(F.exp(-F.col("s") / F.col("n")), 6)).alias("perplexity")))
    sure = scored.join(trusted.hint("merge"), scored["i"] == F.col("k")).where("perplexity is not null").select("g", "perplexity", "out")
    middle = lambda out: F.percentile_approx(F.when(F.col("out") == out, F.col("perplexity")), 0.5, 10_000)
    unseen, seen = sure.agg(middle(True), middle(False)).first()
    ratio = unseen / seen if unseen and seen else 1.0
    sure = sure.withColumn("perplexity", F.when(F.col("out"), F.col("perplexity")).otherwise(F.col("perplexity") * ratio))
    by_lang = sure.groupBy(F.col("g").alias("h")).agg(F.percentile_approx("perplexity", kept, 10_000).alias("own"))
    overall = sure.agg(F.percentile_approx("perplexity", kept, 10_000)).first()[0]
    threshold = F.coalesce("own", F.lit(overall if overall is not None else float("inf")).cast("double"))
    out = scored.join(by_lang, F.col("g").eqNullSafe(F.col("h")), "left")
    return out.select(F.col("i").alias(id_col), F.col("g").alias("lang"), F.col("n").alias("n_bytes"), "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents`, trained on those that `labels` calls good."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
