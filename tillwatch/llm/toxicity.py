"""Toxicity: deobfuscate words by a noisy channel, then score the restored text.

A character model (interpolated trigrams over a-z, other letters, and word ends) is counted over all texts. A token that
looks disguised - signs or digits among letters, a letter three times in a row, letters set apart by spaces or dots -
becomes a lattice: each sign may stand for letters, be an empty separator, or end a word; a run of one letter may stand
for one or two. Viterbi decoding finds the likeliest reading. A logistic model over restored words, fitted to labelled
documents, gives the score.

Labels are looked at for at most FIT_ROWS documents, the smallest by a hash of the id (a document with several labels is
toxic if any label is above 0). The model has the FIT_WORDS words of the greatest z-value that occur in LEAST_SHARE of the
toxic documents and reach LEAST_Z: a bound on the model, whatever the size of the corpus. Nulls and empty texts score as texts without words. Without labels of both kinds, every score is
the share of toxic labels (0 without labels). Repeated rows give repeated results. Only named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents, and words, that the fit looks at; least z-value of a word, and least share of the toxic documents.
FIT_ROWS, FIT_WORDS, LEAST_Z, LEAST_SHARE = 20_000, 300, 6.0, 0.01
#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
SEPARATORS = " ._-*~'"
#: Costs of a substitution, of an empty separator, of a sign or separator that ends a word, and of a run of letters that counts once.
SUBSTITUTED, SKIPPED, ENDED, REPEATED = 0.7, 0.2, 4.5, 0.7
END, OTHER, SYMBOLS = 0, 27, 28
DISGUISED = re.compile(r"[^\W\d_][0-9$@!|+€(*._~'-]+[^\W_$]|[0-9$@!|+€(][^\W\d_]|([^\W\d_])\1\1")
TRIMMED = re.compile(r"^[^\w$@!|+€(]+|(?:[^\w$@!|+€(]|\$\$+|[!+|]+)+$")
PARTS = re.compile(r"[\W\d_]+")
SPACED = re.compile(r"(?<!\S)[^\s]{1}(?: [^\s]{1}){2,}(?!\S)")


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Symbol of each code point: 1 to 26 for a to z with or without marks, OTHER for other letters, END."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            base = unicodedata.normalize("NFD", x)[0].lower() if c < 0x2000 else x
            table[c] = ord(base) - 96 if "a" <= base <= "z" else OTHER
    return table


def count_characters(docs: DataFrame, text_col: str) -> DataFrame:
    """Counts of three symbols in a row over all texts: code, n; SYMBOLS ** 3 rows at most."""

    def run(batches):
        counts = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, data, offsets in common.chunks(batch, "t"):
                s = folded()[common.decoded(data, offsets)[2]]
                s = s[np.append(True, (s[1:] > 0) | (s[:-1] > 0))] if len(s) else s  # one end a word
                s = np.concatenate([[END, END], s, [END]])
                counts += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["code", "n"])

    return docs.select(docs[text_col].alias("t")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Channel:
    """The character model and the lattice decoder."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        three = np.zeros((SYMBOLS, SYMBOLS, SYMBOLS))
        three.ravel()[codes] = n
        lower = np.full(SYMBOLS, 1 / SYMBOLS)
        for counts in (three.sum(axis=(0, 1)), three.sum(axis=0), three):  # absolute discounting, order by order
            total, kinds = counts.sum(axis=-1, keepdims=True), (counts > 0).sum(axis=-1, keepdims=True)
            share = np.maximum(counts - 0.75, 0) / np.maximum(total, 1)
            lower = np.where(total > 0, share + 0.75 * kinds / np.maximum(total, 1) * lower, lower)
        self.cost = (-np.log(lower)).tolist()

    def decode(self, token: str) -> str:
        """The likeliest reading of a disguised token, as words with spaces between."""
        best = {(END, END): (0.0, "")}
        k = 0
        while k < len(token):
            c, run = token[k], 1
            while k + run < len(token) and token[k + run] == c:
                run += 1
            readings: list[tuple[float, str]] = []
            symbol = folded()[ord(c)]
            if symbol:
                letter = chr(96 + symbol) if symbol != OTHER else c
                readings = [(0.0, letter * run)] if run < 3 else []
                readings += [(REPEATED, letter), (REPEATED, letter * 2)] if run > 2 else [(4.0, letter)] if run > 1 else []
            else:
                readings = [(SUBSTITUTED * (1 + (run > 1) * 0.5), x) for x in SIGNS.get(c, "")]
                readings += [(SKIPPED, "")] if c in SEPARATORS else []
                if c in SEPARATORS or not SIGNS.get(c) or 0 < k < len(token) - run:
                    readings.append((ENDED, " "))
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, out) in best.items():
                for extra, text in readings:
                    total, x, y = cost + extra, a, b
                    for t in text:
                        s = END if t == " " else int(folded()[ord(t)])
                        if s == END and y == END:
                            continue
                        total += self.cost[x][y][s]
                        x, y = y, s
                    new = out + text
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, new)
            best = after
            k += run
        return min((cost + (self.cost[a][b][END] if b else 0.0), out) for (a, b), (cost, out) in best.items())[1]


class Restorer(dict):
    """Token to its restored words, kept while there is room."""

    def __init__(self, channel: Channel):
        super().__init__()
        self.channel = channel

    def __missing__(self, token: str) -> tuple[str, ...]:
        core = TRIMMED.sub("", token)
        if DISGUISED.search(core):
            found = tuple({core, *filter(None, PARTS.split(core)), *self.channel.decode(core).split()})
        else:
            found = (core,) if core else ()
        if len(self) > 300_000:
            self.clear()
        self[token] = found
        return found

    def words(self, text: str | None) -> set[str]:
        """Distinct restored words of a text."""
        text = (text or "").lower()
        tokens = set(text.split())
        out = {w for t in tokens for w in self[t]}
        for m in SPACED.finditer(text):
            out.update(self.channel.decode(m[0]).split())
        return out


class Model:
    """Words with weights over a channel."""

    def __init__(self, channel: Channel, words: list[str], weights: np.ndarray, bias: float):
        self.channel, self.bias = channel, bias
        self.weights = dict(zip(words, weights.tolist()))

    def scorer(self):
        restorer = Weights(Restorer(self.channel), self.weights)
        return lambda text: 1 / (1 + np.exp(-(self.bias + restorer.total(text))))


class Weights(dict):
    """Token to the weighted words in it; most have none."""

    def __init__(self, restorer: Restorer, weights: dict[str, float]):
        super().__init__()
        self.restorer, self.weights = restorer, weights

    def __missing__(self, token: str) -> tuple[str, ...] | None:
        words = tuple(w for w in Restorer.__missing__(self.restorer, token) if w in self.weights) or None
        self.restorer.clear()
        if len(self) > 400_000:
            self.clear()
        self[token] = words
        return words

    def total(self, text: str | None) -> float:
        text = (text or "").lower()
        found = {w for ws in map(self.__getitem__, set(text.split())) if ws for w in ws}
        for m in SPACED.finditer(text):
            found.update(w for w in self.restorer.channel.decode(m[0]).split() if w in self.weights)
        return sum(map(self.weights.__getitem__, sorted(found)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from all texts' characters, and from the labels whose id isn't held out."""
    spark = common.session(docs.sparkSession)
    table = count_characters(docs, text_col).toArrow()
    channel = Channel(table.column("code").to_numpy(), table.column("n").to_numpy())
    usable = labels.where((common.crc_mod(id_col, 5) != 0) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    some = usable.groupBy(F.col(id_col).alias("i")).agg((F.max(label_col) > 0).cast("int").alias("y")).orderBy(F.xxhash64("i"), "i").limit(FIT_ROWS).toArrow()
    known = dict(zip(some.column("i").to_pylist(), some.column("y").to_pylist()))
    if len(set(known.values())) < 2:
        share = float(np.mean(list(known.values()))) if known else 0.0
        return Model(channel, [], np.zeros(0), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    ids = F.broadcast(spark.createDataFrame([(i,) for i in known], f"i {docs.schema[id_col].dataType.simpleString()}"))  # FIT_ROWS at most
    chosen = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).join(ids, "i")
    shared = spark.sparkContext.broadcast(channel)

    def count(batches):
        restorer, counts = Restorer(shared.value), {}
        for batch in batches:
            for i, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
                for word in restorer.words(text):
                    counts.setdefault(word, [0, 0])[known[i]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x for x, _ in counts.values()], pa.int64()), pa.array([x for _, x in counts.values()], pa.int64())], names=["word", "clean", "toxic"])

    n1 = sum(known.values())
    n0 = len(known) - n1
    p = n1 / len(known)
    words = chosen.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = F.col("clean") + F.col("toxic")
    z = (F.col("toxic") - n * p) / F.sqrt(n * p * (1 - p))
    best = words.where((F.col("toxic") >= max(5, LEAST_SHARE * n1)) & (z >= LEAST_Z)).orderBy(z.desc(), "word").limit(FIT_WORDS)
    vocabulary = [r["word"] for r in best.collect()]
    if not vocabulary:
        return Model(channel, [], np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    place = {w: k for k, w in enumerate(vocabulary)}

    def rows(batches):
        restorer = Restorer(shared.value)
        for batch in batches:
            x = [[place[w] for w in restorer.words(t) if w in place] for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(x, pa.list_(pa.int32()))], names=["i", "x"])

    found = chosen.mapInArrow(rows, f"i {docs.schema[id_col].dataType.simpleString()}, x array<int>").orderBy("i", "x").toArrow()
    x, y = np.zeros((found.num_rows, len(vocabulary))), np.array([known[i] for i in found.column("i").to_pylist()], float)
    for k, at in enumerate(found.column("x").to_pylist()):
        x[k, at] = 1
    return Model(channel, vocabulary, *fitted(x, y))


def score(df: DataFrame, model: Model, carry: Column, text: Column) -> DataFrame:
    """Scores of all rows: row (the carried struct), score."""
    shared = common.session(df.sparkSession).sparkContext.broadcast(model)
    sent = df.select(carry.alias("row"), text.alias("t"))

    def run(batches):
        scorer = shared.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([scorer(t) for t in batch.column("t").to_pylist()], pa.float64())], names=["row", "score"])

    return sent.mapInArrow(run, f"row {sent.schema['row'].dataType.simpleString()}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over the whole `documents`, with the labels of `labels`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, F.struct("doc_id", (common.crc_mod("doc_id", 5) == 0).alias("held_out")), F.col("text"))
    return out.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
