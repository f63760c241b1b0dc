"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials that the patterns label.

Values of pattern matches are labelled credentials, looked for in all documents. For each kind, the FIT_VALUES distinct
values of least hash make a prefix tree over character classes; states whose futures agree within Hoeffding bounds are merged, red states first,
into a small probabilistic automaton. Every token of at least ASSIGN_LEAST characters of every text is then scored by the log-likelihood per
symbol, its end included, under each automaton. A token is a find if it is at least as likely as all but a few of the labelled values
of that kind, and likelier than under the letter model of ordinary tokens, and lies in no pattern's span.

Spans are in code points, end exclusive. A null or empty text has none. No labelled credentials: the patterns' spans
only. Repeated rows give repeated results. Only the named columns are read; the others may have any name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The patterns of the base kinds, on bytes (so letters are ASCII ones), in the order that ties take.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
#: Values a kind, and ordinary tokens that inference looks at.
FIT_VALUES, FIT_PLAIN = 300, 2_000
#: Distinct values from which a kind has an automaton.
FEWEST = 5
#: Shapes of tokens whose judgement a worker remembers.
REMEMBERED = 100_000
#: Confidence of the merge test; share of labelled values that may be less likely than a find.
ALPHA, TAIL = 0.05, 0.02

_CLASS = bytes(0 if 48 <= c < 58 else 1 if 97 <= c < 103 else 2 if 103 <= c < 123 else 3 if 65 <= c < 91 else c for c in range(256))
_SIZE = {0: 10, 1: 6, 2: 20, 3: 26}


#: Candidates: tokens of as many bytes as the shortest value that a pattern takes, and more.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{%d,}[A-Za-z0-9+/_=-]" % (ASSIGN_LEAST - 2))


def base_spans(text: bytes) -> list[tuple[int, int, str, bytes]]:
    """Pattern matches in bytes: start, end, kind, value."""
    found = [(m.start(), m.end(), "assign", m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return found


class Automaton:
    """A probabilistic automaton over character classes, by merging the states of a prefix tree."""

    def __init__(self, values: list[bytes], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.through, self.ends = [0], [0]
        self.moves: list[dict[int, int]] = [{}]
        for value in values:
            state = 0
            self.through[0] += 1
            for symbol in value.translate(_CLASS):
                self.moves[state][symbol] = self.moves[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.moves.append({})
                    self.through.append(0)
                    self.ends.append(0)
                state = self.next[state][symbol]
                self.through[state] += 1
            self.ends[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.logp = [{s: math.log(n / (t + 1) / _SIZE.get(s, 1)) for s, n in m.items()} for m, t in zip(self.moves, self.through)]
        self.logend = [math.log((n + 0.5) / (t + 1)) for n, t in zip(self.ends, self.through)]
        scores = sorted(self.score(v.translate(_CLASS), -math.inf) for v in values)
        self.least = scores[int(TAIL * len(scores))] if scores else math.inf

    def _differ(self, a: int, na: int, b: int, nb: int) -> bool:
        return abs(a / na - b / nb) > self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether two states and all that follows them agree."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            na, nb = self.through[a], self.through[b]
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for s in self.moves[a].keys() | self.moves[b].keys():
                if self._differ(self.moves[a].get(s, 0), na, self.moves[b].get(s, 0), nb):
                    return False
                if s in self.next[a] and s in self.next[b] and self.next[b][s] > b:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the states from a on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.through[a] += self.through[b]
            self.ends[a] += self.ends[b]
            for s, n in self.moves[b].items():
                self.moves[a][s] = self.moves[a].get(s, 0) + n
                if s in self.next[a]:
                    todo.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]

    def _merge(self) -> None:
        red, blue = [0], deque([(0, s) for s in sorted(self.next[0])])
        settled = {0}
        while blue:
            parent, symbol = blue.popleft()
            state = self.next[parent][symbol]
            if state in settled:
                continue
            for other in red:
                if self._compatible(other, state):
                    self.next[parent][symbol] = other
                    self._fold(other, state)
                    break
            else:
                red.append(state)
                settled.add(state)
            blue = deque((r, s) for r in red for s in sorted(self.next[r]) if self.next[r][s] not in settled)

    def score(self, shape: bytes, least: float) -> float:
        """Log-likelihood per symbol of a value of this shape (its characters' classes), the end of the value being one: so a length that the values don't have costs. -inf as soon as it can't reach `least`."""
        n = len(shape) + 1
        left, state, total = least * n, 0, 0.0
        for symbol in shape:
            p = self.logp[state].get(symbol)
            if p is None:
                return -math.inf
            total += p
            if total < left:
                return -math.inf
            state = self.next[state][symbol]
        return (total + self.logend[state]) / n


class Model:
    """The automata of all kinds, and a model of ordinary tokens' letters, each after the one before."""

    def __init__(self, values: dict[str, list[bytes]], plain: list[bytes]):
        self.automata = [Automaton(v) for _, v in sorted(values.items()) if len(v) >= FEWEST]
        self.known: dict[bytes, float] = {}
        pairs = np.ones((256, 256))
        for token in plain:
            codes = np.frombuffer(token, np.uint8)
            np.add.at(pairs, (codes[:-1], codes[1:]), 1)
        self.plain = np.log(pairs / pairs.sum(axis=1, keepdims=True))

    def accepts(self, token: bytes) -> bool:
        shape = token.translate(_CLASS)
        score = self.known.get(shape)
        if score is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            score = self.known[shape] = max((x for a in self.automata if (x := a.score(shape, a.least)) >= a.least), default=-math.inf)
        if score == -math.inf:
            return False
        codes = np.frombuffer(token, np.uint8)
        return bool(score > self.plain[codes[:-1], codes[1:]].mean())


def outside(found: list[tuple]):
    """A test whether [start, end) meets any of the spans, by bisection over their union."""
    starts, ends = [], []
    for a, b in sorted(x[:2] for x in found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return lambda start, end: (k := bisect_right(ends, start)) < len(starts) and starts[k] < end


def spans(text: bytes, model: Model | None) -> tuple[list[tuple[int, int, str]], int]:
    """All spans of a text in code points, by start and kind, and how many are of base kinds."""
    found = [x[:3] for x in base_spans(text)]
    n = len(found)
    if model is not None and model.automata:
        inside = outside(found)
        for m in CANDIDATE.finditer(text):
            if model.accepts(m[0]) and not inside(m.start(), m.end()):
                found.append((m.start(), m.end(), "format"))
    if found and not text.isascii():
        before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        found = [(int(before[a]), int(before[b]), k) for a, b, k in found]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]))), n


def _order(value: bytes) -> tuple[int, bytes]:
    """What Spark sorts by xxhash64 and value."""
    h = xxhash.xxh64_intdigest(value, 42)
    return h - (1 << 64) if h >> 63 else h, value


def infer(docs: DataFrame, id_col: str, text_col: str) -> Model:
    """Automata from the labelled values of all documents: those of least hash of each kind, and so with ordinary tokens."""
    limits = dict.fromkeys(KINDS, FIT_VALUES)

    def run(batches):
        found: dict[str, set[bytes]] = {}
        for batch in batches:
            for text in batch.column("t").cast(pa.binary()).to_pylist():
                base = base_spans(text or b"")
                for _, _, kind, value in base:
                    found.setdefault(kind, set()).add(value)
                if base:
                    inside = outside(base)
                    tokens = [m[0] for m in CANDIDATE.finditer(text) if not inside(m.start(), m.end())]
                else:
                    tokens = CANDIDATE.findall(text or b"")
                found.setdefault("plain", set()).update(tokens)
            for kind, values in found.items():
                if len(values) > 4 * limits.get(kind, FIT_PLAIN):
                    found[kind] = set(sorted(values, key=_order)[: limits.get(kind, FIT_PLAIN)])
        for kind, values in found.items():
            own = sorted(values, key=_order)[: limits.get(kind, FIT_PLAIN)]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own), pa.string()), pa.array([v.decode() for v in own], pa.string())], names=["kind", "value"])

    sent = common.session(docs.sparkSession) and docs.select(docs[text_col].alias("t"))
    found = sent.mapInArrow(run, "kind string, value string").distinct()
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    most = max(FIT_VALUES, FIT_PLAIN)  # as a constant, it also bounds what each task sends
    rows = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).where(F.col("k") <= F.when(F.col("kind").isin(*KINDS), FIT_VALUES).otherwise(FIT_PLAIN)).orderBy("kind", "k").collect()
    values: dict[str, list[bytes]] = {}
    for row in rows:
        values.setdefault(row["kind"], []).append(row["value"].encode())
    return Model({k: v for k, v in values.items() if k in KINDS}, values.get("plain", []))


def scan(df: DataFrame, model: Model | None, carry: Column, text: Column) -> DataFrame:
    """Spans of all rows: row (the carried struct), found array<struct<start, end, kind>> in order."""
    shared = common.session(df.sparkSession).sparkContext.broadcast(model)
    sent = df.select(carry.alias("row"), text.alias("t"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("start", "end", "kind"), x)) for x in spans(text or b"", shared.value)[0]] for text in batch.column("t").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], names=["row", "found"])

    return sent.mapInArrow(run, f"row {sent.schema['row'].dataType.simpleString()}, found array<struct<start:int,end:int,kind:string>>")


def redacted(text: Column, found: Column) -> Column:
    """A text with each maximal run of found spans replaced by [SECRET]."""
    step = lambda a, s: F.struct(
        F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("[SECRET]"))).otherwise(F.lit(""))).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    return F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over the whole `documents`."""
    docs = common.session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, infer(docs, "doc_id", "text"), F.struct("doc_id"), F.col("text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "row.doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(listed(F.filter("found", lambda s: s["kind"] != "format")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )
