"""Language identification with interpolated Kneser-Ney character models, one per language.

A text becomes letters, lower-cased code point by code point, and one space after each word. Counts of all four-letter
sequences of all training texts are summed by Spark; lower orders follow from the distinct longer sequences. The models
of all languages share sorted arrays of sequence keys (16 bits a letter) with one column of log-probabilities a
language; what isn't in the arrays backs off. Where the sequences are too many for one broadcast, the count table is cut
into shards by the two letters before the last, on which all longer orders of one position agree, so a position is looked
up in one shard alone: each shard gives partial sums per distinct text, and sums over shards give the entropy. A text gets the language of the lowest cross-entropy per letter. It is
rejected if that lies far above the entropy that unseen text of the language has, with both the spread that so few letters
may have and a share of the distance to the nearest other language allowed for. Unseen text is a tenth of the training
rows, by a hash of the text: their sequences are counted apart and train nothing. A language without such rows is
calibrated by what it was trained on, and one with no others is trained on them.

Nulls and texts without letters are `und`, score 0. Rows without a language don't train. With no training rows at all,
every text is `und`. Repeated rows count as often as they occur. Ties go to the language that sorts first. Columns are
carried in a struct, so names can't clash.
"""

from __future__ import annotations

from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER, BITS = 4, 16
#: Most sequences that a shard holds, which bounds what is broadcast at once; beyond it, the models have several shards.
MAX_ENTRIES = 3_000_000
#: One of so many training texts is left out for calibration.
LEFT_OUT = 10
#: Rejection: share of the way to the nearest other language, and standard errors beyond that.
REJECT_SHARE, REJECT_ERRORS = 0.85, 6.0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case 16-bit letter of each code point, 0 where it is none."""
    table = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            code = (ord(low) if len(low) == 1 else c) & 0xFFFF
            table[c] = code if code > 32 else 33
    return table


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sequences that end at each symbol, and the n + 1 offsets of rows in them."""
    _, _, points, rows = common.decoded(data, offsets)
    symbols = letters()[points]
    word = symbols > 0
    begin = np.zeros(len(points) + 1, bool)
    begin[rows] = True
    keep = word.copy()
    keep[1:] |= word[:-1] & ~begin[1:-1]  # one space after a word
    at = np.flatnonzero(keep)
    rows = np.searchsorted(at, rows)
    c = np.where(word[at], symbols[at], 32).astype(np.uint64)
    keys = c.copy()
    place = np.arange(len(c)) - np.repeat(rows[:-1], np.diff(rows))
    for k in range(1, ORDER):
        keys[k:] |= np.where(place[k:] >= k, c[:-k], 0).astype(np.uint64) << np.uint64(BITS * k)
    return keys, rows


def count(df: DataFrame, lang: Column, text: Column) -> DataFrame:
    """Counts of all sequences: lang, key, n, and how often they occur in texts left out of training: left. Each task sends a sequence once a language."""

    def run(batches):
        found: dict[tuple[str, bool], list] = {}
        for batch in batches:
            table = pa.table({"g": batch.column("g"), "t": batch.column("t"), "o": batch.column("o")})
            for name in table.column("g").unique().to_pylist():
                for out in (False, True):
                    own = table.filter(pa.compute.and_(pa.compute.equal(table.column("g"), name), pa.compute.equal(table.column("o"), out))).combine_chunks()
                    for part in own.to_batches():
                        for _, data, offsets in common.chunks(part, "t"):
                            keys, _ = sequences(data, offsets)
                            parts = found.setdefault((name, out), [])
                            parts.append(np.unique(keys, return_counts=True))
                            if len(parts) > 8:
                                found[name, out] = [_summed(parts)]
        for (name, out), parts in found.items():
            keys, n = _summed(parts)
            for k in range(0, len(keys), 50_000):
                own, times = keys[k : k + 50_000].view(np.int64), n[k : k + 50_000]
                none = np.zeros(len(own), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(own), pa.array(none if out else times), pa.array(times if out else none)], names=["lang", "key", "n", "left"])

    import pyarrow.compute  # noqa: F401

    out = F.pmod(F.xxhash64(text), F.lit(LEFT_OUT)) == 0
    sent = df.select(lang.cast("string").alias("g"), text.alias("t"), out.alias("o")).where("g is not null and t is not null")
    return sent.mapInArrow(run, "lang string, key long, n long, left long").groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("left").alias("left"))


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of each row's values, which depend on that row alone; rows: n + 1 offsets."""
    out = np.zeros((len(rows) - 1, values.shape[1]))
    if len(own := np.flatnonzero(np.diff(rows))):
        out[own] = np.add.reduceat(values.astype(np.float64), rows[own], axis=0)
    return out


def decided(model, sums: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy per letter and rejection of rows, from sums of log-probabilities and numbers of letters."""
    if not model.names:
        return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
    entropy = -sums / np.maximum(n, 1)[:, None]
    best = np.round(entropy, 9).argmin(axis=1)
    low = entropy[np.arange(len(n)), best]
    score = 1 / np.exp(-np.sqrt(n)[:, None] * (entropy - low[:, None])).sum(axis=1)
    rejected = (n == 0) | (low > model.limit[best] + REJECT_ERRORS * model.spread[best] / np.sqrt(np.maximum(n, 1)))
    return [model.names[b] if k else "und" for b, k in zip(best, n)], np.where(n > 0, score, 0.0), np.where(n > 0, low, 0.0), rejected


class Model:
    """Sorted keys per order with log-probabilities, sorted contexts with log back-off weights; a column a language.

    With `whole`, a shard of the models for positions whose pair (see `pair_of`) lies in [low, high): it needs the whole
    table's names, discounts, single letters, and the two-letter sequences of its own contexts.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], whole: Whole | None = None, twos: dict | None = None, low: int = 0, high: int = 1 << 2 * BITS):
        self.low, self.high = low, high
        self.names = whole.names if whole else sorted(counts)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        tables = [self._orders(*counts.get(name, none)) for name in self.names]
        if whole:
            for name, table in zip(self.names, tables):
                table[:2] = [whole.ones[name], twos.get(name, none)]
        chars = len(np.unique(np.concatenate([t[0][0] for t in tables]))) if tables else 0
        self.floor = -np.log(chars + 2.0)
        self.keys, self.logp, self.contexts, self.logg = [], [], [], []
        for n in range(ORDER):
            keys = np.unique(np.concatenate([t[n][0] for t in tables])) if tables else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(BITS))
            logp, logg = np.zeros((len(keys), len(tables)), np.float32), np.zeros((len(contexts), len(tables)), np.float32)
            lower = self._back_off(keys, n) if tables else logp
            for j, table in enumerate(tables):
                own, c = table[n]
                discount = whole.discounts[n][j] if whole else self._discount(int((c == 1).sum()), int((c == 2).sum()))
                ctx, back = np.unique(own >> np.uint64(BITS), return_inverse=True)
                total, kinds = np.bincount(back, c), np.bincount(back)
                weight = np.log(discount * kinds / total)
                logg[np.searchsorted(contexts, ctx), j] = weight
                at = np.searchsorted(keys, own)
                share = np.zeros(len(keys))
                share[at] = (c - discount) / total[back]
                backed = lower[:, j] + logg[np.searchsorted(contexts, keys >> np.uint64(BITS)), j]
                logp[:, j] = np.log(share + np.exp(backed.astype(np.float64)))
            self.keys.append(keys), self.logp.append(logp), self.contexts.append(contexts), self.logg.append(logg)

    @staticmethod
    def _orders(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts from one letter to ORDER; below the top, the number of distinct longer keys."""
        out = [(keys, n)]
        for k in range(ORDER - 1, 0, -1):
            out.insert(0, np.unique(out[0][0] & np.uint64((1 << BITS * k) - 1), return_counts=True))
        return out

    @staticmethod
    def _discount(one: int, two: int) -> float:
        return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5

    def _back_off(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Log-probabilities at the order below n."""
        if n == 0:
            return np.full((len(keys), len(self.names)), self.floor, np.float32)
        return self.score(keys & np.uint64((1 << BITS * n) - 1), n - 1)

    def score(self, keys: np.ndarray, n: int = ORDER - 1) -> np.ndarray:
        """Log-probability of each key's last letter after the others, a column a language."""
        if not len(keys):
            return np.zeros((0, len(self.names)), np.float32)
        known = self.keys[n]
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        out = self.logp[n][at] if len(known) else np.zeros((len(keys), len(self.names)), np.float32)
        if len(miss := np.flatnonzero(known[at] != keys) if len(known) else np.arange(len(keys))):
            contexts = keys[miss] >> np.uint64(BITS)
            where = np.searchsorted(self.contexts[n], contexts)
            where[where == len(self.contexts[n])] = 0
            weight = np.where((self.contexts[n][where] == contexts)[:, None], self.logg[n][where], 0) if len(self.contexts[n]) else 0
            out[miss] = self._back_off(keys[miss], n) + weight
        return out

    def under(self, counts: dict) -> np.ndarray:
        """Of each language's counted positions: how many, sums of their log-probabilities under each language, and of squares under their own; a row a language."""
        out = np.zeros((len(self.names), len(self.names) + 2))
        for j, name in enumerate(self.names):
            if name in counts:
                keys, times = counts[name]
                logp = self.score(keys).astype(np.float64)
                out[j] = times.sum(), *(logp * times[:, None]).sum(axis=0), (logp[:, j] ** 2 * times).sum()
        return out

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: letters, how many of them are this shard's own, and the sums of the log-probabilities of these."""
        keys, rows = sequences(data, offsets)
        letters_n = np.diff(rows)
        if self.low > 0 or self.high < 1 << 2 * BITS:
            pair = pair_of(keys)
            own = np.flatnonzero((pair >= self.low) & (pair < self.high))
            keys, rows = keys[own], np.searchsorted(own, rows)
        return letters_n, np.diff(rows), row_sums(self.score(keys), rows)

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy per letter and rejection of each row."""
        n, _, sums = self.sums(data, offsets)
        return decided(self, sums, n)


def calibrated(names: list[str], unseen: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy and spread of each language's unseen text (see `under`; or of its own, if there is none) under itself, and the entropy from which a text is foreign."""
    if not names:
        return (np.zeros(0),) * 3
    found = np.where(unseen[:, :1] > 0, unseen, trained)
    n, sums, squares = found[:, 0], found[:, 1:-1], found[:, -1]
    across = -sums / n[:, None]
    entropy = across.diagonal().copy()
    spread = np.sqrt(np.maximum(squares / n - entropy**2, 0))
    far = np.where(np.eye(len(names), dtype=bool), np.inf, across).min(axis=0) if len(names) > 1 else entropy + 1
    return entropy, spread, entropy + REJECT_SHARE * np.maximum(far - entropy, 0.2)


def pair_of(keys: np.ndarray) -> np.ndarray:
    """The letter before the last, then the one before that: where in the shards' order a sequence belongs."""
    return ((keys >> np.uint64(BITS)) & np.uint64(0xFFFF)) << np.uint64(BITS) | (keys >> np.uint64(2 * BITS)) & np.uint64(0xFFFF)


class Whole:
    """What every shard needs of the whole (stored) table of counts: names, discounts of all orders, counts of single letters."""

    def __init__(self, counts: DataFrame):
        steps, table = [], counts
        for k in range(ORDER, 0, -1):
            steps.insert(0, {r["lang"]: (r["one"], r["two"]) for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()})
            if k == 2:
                self.twos = table
            if k > 1:
                table = common.checkpointed(table.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("key")).agg(F.count("*").alias("n")))
        self.names = sorted(steps[0])
        self.discounts = [[Model._discount(*step[name]) for name in self.names] for step in steps]
        self.ones = _by_language(table)


class Shards:
    """Models in several shards, each of which is broadcast; calibrated over all."""

    def __init__(self, counts: DataFrame, left: DataFrame, limit: int):
        context = common.session(counts.sparkSession).sparkContext
        whole = Whole(counts)
        shift = lambda k: F.shiftright("key", BITS * k).bitwiseAND(F.lit(0xFFFF).cast("long"))
        last, pair = shift(1), F.shiftleft(shift(1), BITS).bitwiseOR(shift(2))
        parts, found, held = [0], [], 0
        unseen = trained = 0
        for at, size in self._sizes(counts, last, pair, limit):
            if held and held + size > limit:
                parts.append(at)
                held = 0
            held += size
        for low, high in zip(parts, [*parts[1:], 1 << 2 * BITS]):
            own = _by_language(counts.where((pair >= low) & (pair < high)))
            shard = Model(own, whole, _by_language(whole.twos.where((last >= low >> BITS) & (last <= (high - 1) >> BITS))), low, high)
            trained = trained + shard.under(own)
            unseen = unseen + shard.under(_by_language(left.where((pair >= low) & (pair < high))))
            found.append(context.broadcast(shard))
        self.shards, self.names = found, whole.names
        self.entropy, self.spread, self.limit = calibrated(whole.names, unseen, trained)

    @staticmethod
    def _sizes(counts: DataFrame, last: Column, pair: Column, limit: int) -> list[tuple[int, int]]:
        """Where in their order sequences begin, and how many there are: by the letter before the last, and by both where one letter has too many."""
        sizes = {r["c"]: r["count"] for r in counts.groupBy(last.alias("c")).count().collect()}  # 65,536 rows at most
        wide = [c for c, size in sizes.items() if size > limit]
        out = [(c << BITS, size) for c, size in sizes.items() if size <= limit]
        out += [(r["p"], r["count"]) for r in counts.where(last.isin(wide)).groupBy(pair.alias("p")).count().collect()]
        return sorted(out)


def _by_language(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and their counts, by language."""
    table = counts.select("lang", "key", "n").toArrow()
    names, keys, n = table.column("lang").to_pandas().to_numpy(), table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    found = {}
    for name in sorted(set(names)):
        own = names == name
        order = np.argsort(keys[own])
        found[name] = (keys[own][order], n[own][order])
    return found


def train(counts: DataFrame, max_entries: int | None = None) -> Model | Shards:
    """Models from all the counts of `count`, in shards of at most about `max_entries` (by default MAX_ENTRIES)."""
    every = common.checkpointed(counts)
    trained = every.where("n > 0").select("lang", "key", "n")
    left = every.where("left > 0").select("lang", "key", F.col("left").alias("n"))
    counts = trained.unionByName(left.join(trained.select("lang").distinct(), "lang", "left_anti"))
    limit = MAX_ENTRIES if max_entries is None else max_entries
    if counts.count() > limit:
        return Shards(counts, left, limit)
    own = _by_language(counts)
    model = Model(own)
    model.entropy, model.spread, model.limit = calibrated(model.names, model.under(_by_language(left)), model.under(own))
    return model


def _identify_sharded(df: DataFrame, model: Shards, carry: Column, text: Column) -> DataFrame:
    """As `identify`: each shard scans all texts, partial sums are added by text, and labels go back to the rows."""
    h = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    texts = df.select(h.alias("h"), text.alias("t"))
    columns = [f"s{k}" for k in range(len(model.names))]
    fields = ", ".join(f"{c} double" for c in columns)

    def scanned(shard):
        def run(batches):
            for batch in batches:
                for part, data, offsets in common.chunks(batch, "t"):
                    n, own, sums = shard.value.sums(data, offsets)
                    at = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([part.column("h").take(pa.array(at)), pa.array(n[at].astype(np.int64)), *map(pa.array, sums[at].T)], names=["h", "n", *columns])

        return texts.mapInArrow(run, f"h string, n long, {fields}")

    every = None
    for k, shard in enumerate(model.shards):
        part = scanned(shard).withColumn("k", F.lit(k))
        every = part if every is None else every.unionByName(part)
    once = every.groupBy("h", "k").agg(F.max("n").alias("n"), *[F.max(c).alias(c) for c in columns])  # equal texts have equal sums
    total = once.groupBy("h").agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in columns])
    light = SimpleNamespace(names=model.names, spread=model.spread, limit=model.limit)  # without the handles of the broadcasts

    def judge(batches):
        for batch in batches:
            if batch.num_rows:
                sums = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
                found, score, low, rejected = decided(light, sums, batch.column("n").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(found, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], names=["h", "lang_pred", "score", "cross_entropy", "rejected"])

    labels = total.mapInArrow(judge, "h string, lang_pred string, score double, cross_entropy double, rejected boolean")
    out = df.select(carry.alias("row"), h.alias("h")).join(labels, "h", "left")
    rest = {"lang_pred": "und", "score": 0.0, "cross_entropy": 0.0, "rejected": True}  # texts without letters are in no shard
    return out.select("row", *[F.coalesce(c, F.lit(x)).alias(c) for c, x in rest.items()])


def identify(df: DataFrame, model: Model | Shards, carry: Column, text: Column) -> DataFrame:
    """Labels of all rows: row (the carried struct), lang_pred, score, cross_entropy, rejected."""
    if isinstance(model, Shards):
        return _identify_sharded(df, model, carry, text)
    shared = common.session(df.sparkSession).sparkContext.broadcast(model)
    sent = df.select(carry.alias("row"), text.alias("t"))

    def run(batches):
        for batch in batches:
            for part, data, offsets in common.chunks(batch, "t"):
                names, score, low, rejected = shared.value.label(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], names=["row", "lang_pred", "score", "cross_entropy", "rejected"])

    return sent.mapInArrow(run, f"row {sent.schema['row'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean")


def trained_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | Shards:
    """Models from the rows whose id isn't held out."""
    common.session(docs.sparkSession)
    return train(count(docs.where(common.crc_mod(id_col, 4) != 2), F.col(lang_col), F.col(text_col)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over the whole `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, trained_on(docs), F.struct("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out")), F.col("text"))
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected", "cross_entropy")
