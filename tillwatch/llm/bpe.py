"""Byte-level BPE encoding and decoding, with vectorised pre-tokenisation.

Texts become arrays of code-point classes. A small automaton over the classes decides where a pre-token starts; as
transition functions compose associatively, blocks of text are scanned side by side: first each block's composed
function, then the state at each block's start, then the start marks. No regular expression runs. The slices between
marks go through a cached pair merging; their byte offsets are kept, so ids can be mapped back to the text.

Nulls and empty texts give no ids. Repeated rows give repeated results. An empty table gives an empty result. Only the
two named columns are read, so other columns of any name don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

LETTER, NUMBER, OTHER, QUOTE, SPACE, WHITE = range(6)
# Symbols: what a character and its neighbour tell; FIRST is added at the start of a text.
(_L, _N, _O, _Q1, _Q2, _S_LAST, _S_MID, _W_LAST, _W_MID), FIRST = range(9), 9
# States: free, in letters, numbers, others, after a space that waits for its word, in white space, one or two letters of a contraction left.
FREE, IN_L, IN_N, IN_O, WAIT, IN_W, C1, C2 = range(8)
STATES, SYMBOLS = 8, 18
#: Length of the blocks that are scanned side by side.
BLOCK = 256
#: Cached pre-tokens per worker, and the longest one that is kept. Bytes of a word, by how many count.
CACHE_ENTRIES, KEY_BYTES = 400_000, 24
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
NO_PAIR = np.iinfo(np.int32).max


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start mark, by symbol and state."""
    step, mark = np.zeros((SYMBOLS, STATES), np.uint8), np.zeros((SYMBOLS, STATES), np.uint8)
    for state in range(STATES):
        for symbol in range(FIRST):
            if symbol == _L and state in (C1, C2):
                to, starts = (FREE if state == C1 else C1), 0
            elif symbol in (_L, _N, _O):
                run = (IN_L, IN_N, IN_O)[symbol]
                to, starts = run, int(state not in (run, WAIT))
            elif symbol in (_Q1, _Q2):  # a quote within or after other signs, or after a space, begins no contraction
                to, starts = (IN_O, 0) if state in (IN_O, WAIT) else ((C1, C2)[symbol - _Q1], 1)
            elif symbol == _S_LAST:
                to, starts = WAIT, 1
            elif symbol == _W_LAST:
                to, starts = FREE, 1
            else:
                to, starts = IN_W, int(state != IN_W)
            step[symbol, state], mark[symbol, state] = to, starts
    step[FIRST:] = step[:FIRST, FREE][:, None]
    mark[FIRST:] = 1
    return step, mark


@lru_cache(maxsize=1)
def point_classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    for c in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = WHITE
    table[0x20], table[0x27] = SPACE, QUOTE
    return table


def symbols_of(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The automaton's symbol for each code point; rows: n + 1 char offsets of the texts."""
    kinds = point_classes()[points]
    n = len(points)
    white = np.empty(n + 1, bool)
    white[:n] = kinds >= SPACE
    white[n] = True
    after = white[1:].copy()
    filled = rows[:-1][rows[1:] > rows[:-1]]
    lasts = rows[1:][rows[1:] > rows[:-1]] - 1
    after[lasts] = True  # the end of a text counts like white space
    out = np.array([_L, _N, _O, _O, _S_LAST, _W_LAST], np.uint8)[kinds]
    out += (after & (kinds >= SPACE)).astype(np.uint8)
    quotes = np.flatnonzero(kinds == QUOTE)
    if len(quotes):
        ends = rows[np.searchsorted(rows, quotes, "right")]
        at = lambda k: np.where(quotes + k < ends, points[np.minimum(quotes + k, n - 1)], 0)
        one, two = at(1), at(2)
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = _Q1
        pairs = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[quotes[pairs]] = _Q2
    out[filled] += FIRST
    return out


def start_marks(symbols: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token starts, by an associative scan of transition functions over blocks."""
    step, mark = automaton()
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, _O, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.intp) * STATES
    step, mark = step.ravel(), mark.ravel()
    composed = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for column in columns:
        composed = step[column[:, None] + composed]
    state, entry = FREE, np.empty(blocks, np.uint8)
    for k, function in enumerate(composed.tolist()):
        entry[k] = state
        state = function[state]
    marks = np.empty((BLOCK, blocks), np.uint8)
    for k, column in enumerate(columns):
        at = column + entry
        marks[k] = mark[at]
        entry = step[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Pre-tokens of a text buffer: its bytes, where in them pre-tokens start, and n + 1 offsets of the rows in those starts."""
    data, starts, points, rows = common.decoded(data, offsets)
    marks = start_marks(symbols_of(points, rows))
    return data.tobytes(), starts[marks], np.searchsorted(marks, rows)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always merge the leftmost pair of lowest rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : ends[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, ends[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table of token pairs that merge: keys (left << 32 | right, -1 where empty) and the ids they give."""
    keys, ids = [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None:
                keys.append(left << 32 | right)
                ids.append(rank)
    size = 1 << max(4, (4 * len(keys)).bit_length())
    table, values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    for key, slot, value in zip(keys, slots_of(np.array(keys, np.int64), size).tolist() if keys else [], ids):
        while table[slot] != -1:
            slot = (slot + 1) % size
        table[slot], values[slot] = key, value
    return table, values


def slots_of(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def pair_ids(left: np.ndarray, right: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The id that each pair merges to, NO_PAIR where it doesn't; negative ids never merge."""
    keys, values = table
    wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
    out = np.full(wanted.shape, NO_PAIR, np.int32)
    open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
    wanted, flat = wanted.ravel()[open_], out.ravel()
    slots = slots_of(wanted, len(keys))
    while len(open_):
        found = keys[slots]
        hit = found == wanted
        flat[open_[hit]] = values[slots[hit]]
        on = ~hit & (found != -1)
        open_, wanted, slots = open_[on], wanted[on], (slots[on] + 1) % len(keys)
    return flat.reshape(out.shape)


def merged_all(pieces: list[bytes], ranks: dict[bytes, int], singles: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Packed ids of many short pre-tokens: each round merges the leftmost pair of lowest rank of every one."""
    width = max(map(len, pieces))
    lengths = np.array([len(x) for x in pieces])
    flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(-1, width)
    ids = np.where(np.arange(width) < lengths[:, None], singles[flat], -1).astype(np.int32)
    pairs = pair_ids(ids[:, :-1], ids[:, 1:], table) if width > 1 else np.zeros((len(pieces), 0), np.int32)
    rows, cols = np.arange(len(pieces)), np.arange(width)
    live_ids, live_pairs = ids, pairs
    while width > 1:
        low = live_pairs.min(axis=1)
        on = low < NO_PAIR
        if not on.all():
            ids[rows[~on]] = live_ids[~on]
            rows, live_ids, live_pairs, low = rows[on], live_ids[on], live_pairs[on], low[on]
        if not len(rows):
            break
        at = live_pairs.argmin(axis=1)
        k = np.arange(len(rows))
        live_ids[k, at] = low
        shift = np.minimum(cols + (cols > at[:, None]), width - 1)
        live_ids = np.take_along_axis(live_ids, shift, 1)
        live_ids[:, -1] = -1
        live_pairs = np.take_along_axis(live_pairs, np.minimum(shift[:, :-1], width - 2), 1)
        live_pairs[:, -1] = NO_PAIR
        live_pairs[k, at] = pair_ids(live_ids[k, at], np.where(at + 1 < width, live_ids[k, np.minimum(at + 1, width - 1)], -1), table) if width > 1 else NO_PAIR
        left = at > 0
        live_pairs[k[left], at[left] - 1] = pair_ids(live_ids[k[left], at[left] - 1], live_ids[k[left], at[left]], table)
    packed, counts = ids.astype("<u4"), (ids >= 0).sum(axis=1).tolist()
    whole = map(ranks.get, pieces)
    return [packed[i, :n].tobytes() if w is None else np.uint32(w).tobytes() for i, (n, w) in enumerate(zip(counts, whole))]


class Merges:
    """Merged pre-tokens in an open hash table of bounded size, looked up by arrays.

    A key of up to KEY_BYTES bytes is kept whole, as words and a length, so a hit is exact; longer pre-tokens are merged
    as they come. Values are slices of a pool of ids. A full table starts anew.
    """

    def __init__(self, model: tuple[dict[bytes, int], tuple[np.ndarray, np.ndarray]]):
        self.ranks, self.table = model
        self.singles = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.size, self.used = 2 * CACHE_ENTRIES, 0
        self.keys = np.zeros((self.size, KEY_BYTES // 8), np.uint64)
        self.lengths = np.full(self.size, -1, np.int32)
        self.at, self.counts = np.zeros(self.size, np.int64), np.zeros(self.size, np.int32)
        self.pool, self.pool_used = np.zeros(8 * CACHE_ENTRIES, np.int32), 0

    def slots(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each key is (-1: nowhere), where the search for it ended, and its hash."""
        hashed = lengths.astype(np.uint64)
        for k in range(words.shape[1]):
            hashed = (hashed ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
        at = (hashed % np.uint64(self.size)).astype(np.int64)
        found, left = np.full(len(at), -1, np.int64), np.arange(len(at))
        while len(left):
            here = at[left]
            hit = (self.lengths[here] == lengths[left]) & (self.keys[here] == words[left]).all(axis=1)
            found[left[hit]] = here[hit]
            left = left[~hit & (self.lengths[here] >= 0)]
            at[left] = (at[left] + 1) % self.size
        return found, at, hashed

    def keep(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put ids into the pool: where and how many."""
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        at = self.pool_used + np.cumsum(counts) - counts
        end = self.pool_used + int(counts.sum())
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(end, np.int32)])
        self.pool[self.pool_used : end] = np.frombuffer(b"".join(ids), "<i4")
        self.pool_used = end
        return at, counts

    def encode(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens of a text that begin at `starts`, and how many each has."""
        if self.used > CACHE_ENTRIES or self.pool_used > 6 * CACHE_ENTRIES:
            self.clear()
        n = len(starts)
        lengths = np.diff(np.append(starts, len(raw)))
        padded = raw + bytes(KEY_BYTES)
        loads = np.ndarray((len(raw) + KEY_BYTES - 7,), "<u8", padded, strides=(1,))
        words = np.empty((n, KEY_BYTES // 8), np.uint64)
        for k in range(KEY_BYTES // 8):
            words[:, k] = loads[starts + np.minimum(8 * k, lengths)] & _MASKS[np.clip(lengths - 8 * k, 0, 8)]
        at, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        short = np.flatnonzero(lengths <= KEY_BYTES)
        while len(short):
            found, free, hashed = self.slots(words[short], lengths[short])
            hit = found >= 0
            at[short[hit]], counts[short[hit]] = self.at[found[hit]], self.counts[found[hit]]
            short, free, hashed = short[~hit], free[~hit], hashed[~hit]
            if not len(short):
                break
            _, first = np.unique(hashed, return_index=True)
            _, alone = np.unique(free[first], return_index=True)  # of new keys that want one slot, one gets it now
            first = first[alone]
            first = first[np.argsort(lengths[short[first]], kind="stable")]
            new, slot = short[first], free[first]
            pieces = [raw[a:b] for a, b in zip(starts[new].tolist(), (starts[new] + lengths[new]).tolist())]
            ids = [x for k in range(0, len(pieces), 8192) for x in merged_all(pieces[k : k + 8192], self.ranks, self.singles, self.table)]
            self.keys[slot], self.lengths[slot] = words[new], lengths[new]
            self.at[slot], self.counts[slot] = self.keep(ids)
            self.used += len(slot)
        if len(long_ := np.flatnonzero(lengths > KEY_BYTES)):
            pieces = [raw[a:b] for a, b in zip(starts[long_].tolist(), (starts[long_] + lengths[long_]).tolist())]
            some = sorted({x for x in pieces if len(x) <= 96}, key=len)
            known = dict(zip(some, [x for k in range(0, len(some), 8192) for x in merged_all(some[k : k + 8192], self.ranks, self.singles, self.table)]))
            at[long_], counts[long_] = self.keep([known[x] if x in known else np.array(merged(x, self.ranks), "<u4").tobytes() for x in pieces])
        return _gathered(self.pool, at, counts), counts

    def decode(self, ids: np.ndarray) -> bytes:
        return _gathered(self.token_bytes, self.token_at[ids], self.token_sizes[ids]).tobytes()


def _gathered(pool: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Slices of a pool, one after the other."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.repeat(at - (ends - counts), counts) + np.arange(ends[-1])]


#: The merges that this worker keeps from task to task, by the model's broadcast; one at a time.
_AT_HAND: dict[str, Merges] = {}


def merges_of(shared, key: str) -> Merges:
    if key not in _AT_HAND:
        _AT_HAND.clear()
        _AT_HAND[key] = Merges(shared.value)
    return _AT_HAND[key]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encoded_rows(data: np.ndarray, offsets: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a text buffer, and the n + 1 offsets of its rows in them."""
    raw, starts, rows = pretokens(data, offsets)
    ids, counts = merges.encode(raw, starts)
    return ids, np.concatenate([[0], np.cumsum(counts)])[rows]


def encode(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Ids and the byte offset of each id in its text: id, n_tokens long, ids array<int>, offsets array<int>; with `decoded` also the text of the ids.

    The vocabulary (bounded: one file, and the pairs that merge to its tokens) goes to the executors as a broadcast; texts stay where they are scanned.
    """
    shared = common.session(df.sparkSession).sparkContext.broadcast((ranks, pair_table(ranks)))
    key = f"{uuid.uuid4()}"

    def run(batches):
        merges = merges_of(shared, key)
        for batch in batches:
            for part, data, offsets in common.chunks(batch, "t"):
                ids, rows = encoded_rows(data, offsets, merges)
                sizes = merges.token_sizes[ids]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                places = ends[:-1] - np.repeat(ends[rows[:-1]], np.diff(rows))
                listed = lambda x: pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(x, pa.int32()))
                columns = {id_col: part.column("i"), "n_tokens": pa.array(np.diff(rows), pa.int64()), "ids": listed(ids), "offsets": listed(places)}
                if decoded:
                    text, at = merges.decode(ids), ends[rows].tolist()
                    columns["decoded"] = pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<int>, offsets array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row of ids: id, text. Ids outside the vocabulary are an error; null ids give the empty text."""
    shared = common.session(df.sparkSession).sparkContext.broadcast(ranks)

    def run(batches):
        merges = Merges((shared.value, None))
        for batch in batches:
            texts = [merges.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[ids_col].alias("x")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and decoding in one pass: id, n_tokens, ids_sha256, decoded_sha256."""
    shared = common.session(df.sparkSession).sparkContext.broadcast((ranks, pair_table(ranks)))
    key = f"{uuid.uuid4()}"

    def run(batches):
        merges = merges_of(shared, key)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part, data, offsets in common.chunks(batch, "t"):
                ids, rows = encoded_rows(data, offsets, merges)
                packed, text = ids.astype("<u4").tobytes(), merges.decode(ids)
                ends = np.concatenate([[0], np.cumsum(merges.token_sizes[ids])])[rows].tolist()
                counts, rows = np.diff(rows), rows.tolist()
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(counts, pa.int64()), pa.array([sha(packed[4 * a : 4 * b]) for a, b in zip(rows, rows[1:])], pa.string()), pa.array([sha(text[a:b]) for a, b in zip(ends, ends[1:])], pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: the whole `documents`, with the 50k byte-level vocabulary."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
