"""Removal of repeated substrings with a sparse suffix array.

Every WINDOW-byte window picks an anchor: the leftmost GRAM-byte gram of least hash in it. Equal windows pick equal
anchors at equal offsets, so windows need only be compared within an anchor's group. Neighbouring windows with one
anchor are a run; a task sends each distinct (anchor gram, run content) once, with its first place. In a group, all
but the first of equal runs are repeats as they are. Where runs around one gram differ, the texts around the first of
each are fetched, suffixes to the right of the anchor and reversed prefixes to its left are sorted deep-shallow, and
windows fall into classes by the common prefixes of neighbours in either order: each window that isn't the first of its
class is a repeat.

A run that occurs everywhere is sent at most once a task. A first pass finds the grams around which too many runs
differ, as at the edges of a passage that many documents share: their runs are dealt out by content, and their windows,
with their bytes, by a hash, so no group grows a task; the windows that a hash brings together are sorted like all others.
Hashes of grams, runs and windows only bring texts together: their bytes decide. Runs of one hash claim to be a repeat of
the first; claims that go on side by side are one stretch, cut into cells of CELL bytes of its source, and each distinct
content of a cell is sent once a block to where all are compared. A cell with two contents (hashes that collided) starts
the job again under hashes of another seed, up to SEEDS. Places go back to documents by id, and texts move once, for both joins.

Order of places: id (null last), then start; rows that repeat id and text are one document and get equal results; rows
that repeat an id with another text are further documents, ordered by start and a hash of the text. Nulls and empty texts lose
nothing, as do texts shorter than WINDOW. An empty table gives no rows. Only named columns are read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .suffixes import sort_suffixes

WINDOW, GRAM = 100, 32
PLACES = WINDOW - GRAM + 1
#: A text is cut into pieces that overlap by WINDOW - 1 bytes, so that a window lies in one piece.
PIECE = 1 << 20
#: Runs of one gram from which its windows are compared by hash, in many tasks; the least part of all runs, which bounds how many such grams there are.
HOT_RUNS, HOT_SHARE = 4096, 1_000_000
#: Runs, and windows, that a task holds at once before it sends them.
BLOCK_RUNS, BLOCK_WINDOWS = 4_000_000, 500_000
#: Bytes of a stretch that are compared at once, cells that a task holds before it sends them, and seeds of hashes that are tried.
CELL, BLOCK_CELLS, SEEDS = 4096, 10_000, 8
_LAST_ID = (1 << 63) - 1
_POSITION_BITS = 26
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    base, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(2024 + seed).integers(1, 1 << 63, 256, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of the pieces [start, end) of a buffer: piece, first window, length, anchor's place, gram hash, run hash."""
    powers = 1 << (len(data) + 1).bit_length()
    base, inverse = _powers(powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * base[: len(data)], out=sums[1:])
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = _least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), PLACES)
    piece = np.repeat(np.arange(len(starts)), ends - starts - WINDOW + 1)
    first = np.cumsum(ends - starts - WINDOW + 1) - (ends - starts - WINDOW + 1)
    windows = np.arange(len(piece)) - first[piece] + starts[piece]
    anchors = (least[windows] & low).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (piece[1:] != piece[:-1])))
    sizes = np.diff(np.append(new, len(piece)))
    at, anchor = windows[new], anchors[new]
    until = at + sizes - 1 + WINDOW
    content = (sums[until] - sums[at]) * inverse[at]
    content = _mixed(content ^ _mixed((sizes * 256 + anchor - at).astype(np.uint64)))
    return piece[new], at, sizes, anchor, grams[anchor], content


# A run's place in one number, in the order of places: start, windows, offset of the anchor. Texts of one id are told apart by a tag, their hash.
def _packed(start, size, offset):
    return (start.astype(np.int64) << 7 | size) << 7 | offset


def _unpacked(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return z >> 14, (z >> 7) & 127, z & 127


# Kinds of rows: 0 a run, 1 removed bytes, 2 an open run; of grams with too many runs 3 a run, 4 an open run or a window of
# one; 5 a cell's content, 6 a cell that has several. Removed bytes that a hash claims have a source: id d0, tag s, start o.
_ROWS = "kind int, g long, s long, d long, tag long, z long, e long, d0 long, o long"
_NAMES = ["kind", "g", "s", "d", "tag", "z", "e", "d0", "o"]


def _batch(kind, g, s, d, tag, z, e, d0=0, o=0) -> pa.RecordBatch:
    n = len(d)
    col = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), n))
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(kind, np.int32), n)), col(g), col(s), col(d), col(tag), col(z), col(e), col(d0), col(o)], names=_NAMES)


def _texts_beside(batch: pa.RecordBatch, lefts: list[bytes] | None = None, rights: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.binary()) if x is not None else pa.nulls(batch.num_rows, pa.binary()) for x in (lefts, rights)]], names=[*_NAMES, "l", "r"])


def _first_of_runs(g, s, d, tag, z):
    """Places in order without repeated rows, and which are the first of their gram and content."""
    order = np.lexsort((tag, z, d, s, g))
    g, s, d, tag, z = g[order], s[order], d[order], tag[order], z[order]
    if len(g):
        own = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (tag[1:] != tag[:-1]) | (z[1:] != z[:-1]))
        g, s, d, tag, z = g[own], s[own], d[own], tag[own], z[own]
    first = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])) if len(g) else np.zeros(0, bool)
    return g, s, d, tag, z, first


def _intervals(d: np.ndarray, tag: np.ndarray, z: np.ndarray, source: tuple[np.ndarray, ...] | None = None) -> pa.RecordBatch:
    """Whole runs as removed bytes; neighbours of one text become one row, and with sources (d, tag, z) those of one stretch of one source. z: start; e: end."""
    start, size, _ = _unpacked(z)
    end = start + size - 1 + WINDOW
    zero = np.zeros(len(d), np.int64)
    d0, tag0, shift = (source[0], source[1], _unpacked(source[2])[0] - start) if source else (zero, zero, zero)
    order = np.lexsort((start, shift, tag0, d0, tag, d))
    d, tag, start, end, d0, tag0, shift = (x[order] for x in (d, tag, start, end, d0, tag0, shift))
    if not len(d):
        return _batch(1, 0, 0, d, tag, start, end)
    apart = np.append(True, start[1:] > end[:-1])
    for x in (d, tag, d0, tag0, shift):
        apart[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(apart)
    o = start[at] + shift[at] if source else 0
    return _batch(1, d[at] ^ tag[at], tag0[at], d[at], tag[at], start[at], np.maximum.reduceat(end, at), d0[at], o)


def _claims(d: np.ndarray, tag: np.ndarray, z: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """What repeats by its hash, each with the place of the first of its content."""
    of = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))[~first]
    return _intervals(d[~first], tag[~first], z[~first], (d[of], tag[of], z[of]))


def _task_runs(batches, size_of_piece: int, limit: int, letters: np.ndarray):
    """A task's runs, in blocks of about `limit`: gram, content, place, and whether it is the first of its gram and content."""
    found: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        for part, data, offsets in common.chunks(batch, "t"):
            d, tag = part.column("d").to_numpy(), part.column("tag").to_numpy()
            long_ = np.flatnonzero(np.diff(offsets) >= WINDOW)
            counts = np.maximum(1, -(-(np.diff(offsets)[long_] - WINDOW + 1) // size_of_piece))
            doc = np.repeat(long_, counts)
            step = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * size_of_piece
            begin = offsets[doc] + step
            end = np.minimum(begin + size_of_piece + WINDOW - 1, offsets[doc + 1])
            for k in range(0, len(doc), 4096):
                b, e, own = begin[k : k + 4096], end[k : k + 4096], doc[k : k + 4096]
                for lo, hi in _spans(b, e):
                    piece, at, size, anchor, g, s = runs_of(data[b[lo] : e[hi - 1]], b[lo:hi] - b[lo], e[lo:hi] - b[lo], letters)
                    who = own[lo:hi][piece]
                    found.append([g.view(np.int64), s.view(np.int64), d[who], tag[who], _packed(at + b[lo] - offsets[who], size, anchor - at)])
                    held += len(g)
                    if held >= limit:
                        yield _first_of_runs(*(np.concatenate(x) for x in zip(*found)))
                        found, held = [], 0
    if found:
        yield _first_of_runs(*(np.concatenate(x) for x in zip(*found)))


def _counter(size_of_piece: int, limit: int, letters: np.ndarray):
    def run(batches):
        """How many runs each gram has, where it has several in a block; with a null gram, how many runs there are."""
        for g, *_, first in _task_runs(batches, size_of_piece, limit, letters):
            grams, n = np.unique(g[first], return_counts=True)
            several = n > 1
            yield pa.RecordBatch.from_arrays([pa.array([*grams[several].tolist(), None], pa.int64()), pa.array(np.append(n[several], n.sum()))], names=["g", "n"])

    return run


def _sender(busy, size_of_piece: int, limit: int, letters: np.ndarray):
    def run(batches):
        """Each distinct run of a block with its first place (kind 0 or 3), and what repeats within the block (kind 1)."""
        for g, s, d, tag, z, first in _task_runs(batches, size_of_piece, limit, letters):
            for k in range(0, len(g), 50_000):
                at = np.flatnonzero(first[k : k + 50_000]) + k
                yield _batch(np.where(np.isin(g[at], busy.value), 3, 0), g[at], s[at], d[at], tag[at], z[at], 0)
            yield _claims(d, tag, z, first)

    return run


def _spans(begin: np.ndarray, end: np.ndarray, limit: int = 4 * PIECE):
    """Slices of pieces within `limit` bytes each."""
    at = 0
    while at < len(begin):
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + limit, "right")))
        yield at, upto
        at = upto


def _dealt(df: DataFrame, fine: int) -> DataFrame:
    """Rows of one gram in one task and in a row; those of kind `fine`, of one gram and content."""
    own = F.col("kind") == fine
    return df.repartition(F.when(own, F.xxhash64("g", "s")).otherwise(F.col("g"))).sortWithinPartitions(own, "g", F.when(own, F.col("s")))


def _groups(batches, fine: int, rows: int = 50_000):
    """Tables of whole groups, from batches of `_dealt`."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows >= rows:
            own, g, s = rest.column("kind").to_numpy() == fine, rest.column("g").to_numpy(), rest.column("s").to_numpy()
            ends = np.flatnonzero((own[1:] != own[:-1]) | (g[1:] != g[:-1]) | (own[1:] & (s[1:] != s[:-1])))
            if len(ends):
                yield rest.slice(0, int(ends[-1]) + 1)
                rest = rest.slice(int(ends[-1]) + 1)
    if rest is not None and rest.num_rows:
        yield rest


def _judge_runs(batches):
    """Repeats of equal runs (kind 1), and the first of each run of grams with several (kind 2) or too many (kind 4)."""
    for table in _groups(batches, 3):
        kind = table.column("kind").to_numpy()
        if (kind == 1).any():
            yield from table.filter(pa.array(kind == 1)).to_batches()
        g, s, d, tag, z = (table.column(c).to_numpy()[kind != 1] for c in _NAMES[1:6])
        busy = np.unique(g[kind[kind != 1] == 3])
        g, s, d, tag, z, first = _first_of_runs(g, s, d, tag, z)
        if not len(g):
            continue
        yield _claims(d, tag, z, first)
        g, s, d, tag, z = g[first], s[first], d[first], tag[first], z[first]
        own = np.isin(g, busy)
        several = own.copy()
        same = g[1:] == g[:-1]
        several[1:] |= same
        several[:-1] |= same
        yield _batch(np.where(own, 4, 2)[several], g[several], s[several], d[several], tag[several], z[several], 0)


def _fetch(batches):
    """Contents of the cells that claims and their sources cover (kind 5). The text around each open run: right of its anchor, and reversed left of it (kind 2). Of the runs of a gram that
    has too many, each window, its hash, and its first place in a block (kind 4), and what repeats there (kind 1)."""
    import xxhash

    digest, seen = xxhash.xxh3_128_digest, set()
    cells: set[tuple[int, int, int, int, bytes]] = set()  # source's id, tag, start, end; content
    windows: list[tuple[int, int, int, int]] = []
    known: dict[bytes, int] = {}  # the windows of a block, told apart by their bytes

    def first_windows():
        g, _, d, tag, z, first = _first_of_runs(*(np.array([w[k] for w in windows], np.int64) for k in (0, 0, 1, 2, 3)))
        texts = list(known)
        texts = [texts[k] for k in g[first].tolist()]
        hashes = np.frombuffer(b"".join(map(digest, texts)), np.int64).reshape(-1, 2)
        windows.clear()
        known.clear()
        yield _texts_beside(_batch(4, hashes[:, 0], hashes[:, 1], d[first], tag[first], z[first], 0), texts)
        yield _texts_beside(_intervals(d[~first], tag[~first], z[~first]))

    def contents():
        *place, texts = zip(*cells)
        cells.clear()
        d, tag, z, e = (np.array(x, np.int64) for x in place)
        g = np.zeros(len(d), np.uint64)
        for x in (d, tag, z, e):
            g = _mixed(g + x.view(np.uint64))
        g = g.view(np.int64)
        yield _texts_beside(_batch(5, g, 0, d, tag, z, e), texts)

    for batch in batches:
        own: list[tuple[int, int, int, int, bytes, bytes]] = []
        texts = batch.column("t").cast(pa.binary()).to_pylist()
        asked = batch.column("open")
        ends = np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        fields = {f.name: asked.flatten().field(f.name).to_numpy(zero_copy_only=False) for f in asked.type.value_type}
        for text, d, tag, lo, hi in zip(texts, batch.column("d").to_pylist(), batch.column("tag").to_pylist(), [0, *ends], ends):
            if (d, tag) in seen:  # rows that repeat are one document
                continue
            seen.add((d, tag))
            kinds = fields["kind"][lo:hi]
            at = np.flatnonzero(kinds == 1) + lo
            begin, shift = fields["o"][at], fields["z"][at] - fields["o"][at]
            for d0, tag0, a, e, by in zip(*(x.tolist() for x in (fields["d0"][at], fields["s"][at], begin, fields["e"][at] - shift, shift))):
                while a < e:
                    upto = min(a - a % CELL + CELL, e)
                    cells.add((d0, tag0, a, upto, text[a + by : upto + by]))
                    a = upto
                if len(cells) >= BLOCK_CELLS:
                    yield from contents()
            at = np.flatnonzero(kinds != 1) + lo
            start, size, offset = (x.tolist() for x in _unpacked(fields["z"][at]))
            for kind, g, z, a, n, o in zip(kinds[at - lo].tolist(), fields["g"][at].tolist(), fields["z"][at].tolist(), start, size, offset):
                if kind == 4:
                    windows += [(known.setdefault(text[b : b + WINDOW], len(known)), d, tag, _packed(np.int64(b), 1, 0)) for b in range(a, a + n)]
                    if len(windows) >= BLOCK_WINDOWS:
                        yield from first_windows()
                else:
                    own.append((g, d, tag, z, text[a : a + o][::-1], text[a + o : a + n - 1 + WINDOW]))
        if own:
            g, d, tags, z, lefts, rights = zip(*own)
            yield _texts_beside(_batch(2, g, 0, d, tags, z, 0), lefts, rights)
    if windows:
        yield from first_windows()
    if cells:
        yield from contents()


def repeated_windows(g: np.ndarray, z: np.ndarray, lefts: list[bytes], rights: list[bytes]) -> np.ndarray:
    """Which windows of runs, by run and shift, repeat an earlier one. Runs are in the order of group and place."""
    n = len(g)
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])).tolist() + [n]
    orders, heads = [], []
    for texts, shared in ((rights, GRAM), (lefts, 0)):
        order, lcp = np.empty(n, np.int64), np.empty(n, np.int64)
        for a, b in zip(starts, starts[1:]):
            o, c = sort_suffixes(texts[a:b], shared=shared)
            order[a:b], lcp[a:b] = np.array(o) + a, c
        orders.append(order)
        heads.append(lcp)
    _, size, offset = _unpacked(z)
    out = np.zeros((n, PLACES), bool)

    def classes(k: int, depth: int) -> np.ndarray:
        own = np.empty(n, np.int64)
        own[orders[k]] = np.cumsum(heads[k] < depth)
        return own

    for shift in range(PLACES):  # the window starts `shift` bytes left of the anchor
        first = offset - shift  # its place among the run's windows
        valid = np.flatnonzero((first >= 0) & (first < size))
        if len(valid):
            key = classes(0, WINDOW - shift)[valid] * (n + 1) + classes(1, shift)[valid]
            _, firsts = np.unique(key, return_index=True)
            again = np.ones(len(valid), bool)
            again[firsts] = False
            out[valid[again], first[valid[again]]] = True
    return out


def _again(g, s, d, tag, z, texts: list[bytes]) -> np.ndarray:
    """Rows that repeat a window of an earlier place: windows of one hash are sorted, and equal neighbours are one class."""
    order = np.lexsort((tag, z, d, s, g))
    starts = np.flatnonzero(np.append(True, (np.diff(g[order]) != 0) | (np.diff(s[order]) != 0))).tolist() + [len(order)]
    out = np.zeros(len(order), bool)
    for a, b in zip(starts, starts[1:]):
        if b - a > 1:
            own = order[a:b]
            places, lcp = sort_suffixes([texts[i] for i in own])
            first = None
            for p, same in sorted(zip(np.cumsum(np.array(lcp) < WINDOW).tolist(), places)):
                place = own[same]
                if p == first and not (d[place] == at[0] and tag[place] == at[1] and z[place] == at[2]):
                    out[place] = True
                elif p != first:
                    first, at = p, (d[place], tag[place], z[place])
    return out


def _judge_windows(batches):
    """Repeated windows (kind 1), by sorting the texts around open runs, and the windows that stand alone; cells with several contents (kind 6)."""
    for table in _groups(batches, 4, 20_000):
        kind = table.column("kind").to_numpy()
        if (kind == 1).any():
            yield from table.filter(pa.array(kind == 1)).select(_NAMES).to_batches()
        if (own := kind == 4).any():
            g, s, d, tag, z = (table.column(c).to_numpy()[own] for c in _NAMES[1:6])
            again = _again(g, s, d, tag, z, table.column("l").filter(pa.array(own)).to_pylist())
            yield _intervals(d[again], tag[again], z[again])
        if (own := kind == 5).any():
            held: dict[tuple[int, ...], bytes] = {}
            cells = table.filter(pa.array(own))
            places = list(zip(*(cells.column(c).to_numpy().tolist() for c in ("d", "tag", "z", "e"))))
            if other := [p for p, text in zip(places, cells.column("l").to_pylist()) if held.setdefault(p, text) != text]:
                yield _batch(6, 0, 0, *map(list, zip(*other)))
        if not (kind == 2).any():
            continue
        table = table.filter(pa.array(kind == 2))
        g, d, tag, z = (table.column(c).to_numpy() for c in ("g", "d", "tag", "z"))
        order = np.lexsort((tag, z, d, g))
        order = order[np.append(True, (np.diff(g[order]) != 0) | (np.diff(d[order]) != 0) | (np.diff(tag[order]) != 0) | (np.diff(z[order]) != 0))]
        lefts, rights = (table.column(c).combine_chunks().to_pylist() for c in "lr")
        lefts, rights = [lefts[i] for i in order], [rights[i] for i in order]
        g, d, tag, z = g[order], d[order], tag[order], z[order]
        grams: dict[tuple[int, bytes], int] = {}  # told apart by their bytes
        same = np.array([grams.setdefault((h, r[:GRAM]), len(grams)) for h, r in zip(g.tolist(), rights)], np.int64)
        order = np.argsort(same, kind="stable")
        g, d, tag, z = same[order], d[order], tag[order], z[order]
        lefts, rights = [lefts[i] for i in order], [rights[i] for i in order]
        again = repeated_windows(g, z, lefts, rights)
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        run, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        start, _, _ = _unpacked(z[run])
        yield _batch(1, 0, 0, d[run], tag[run], start + begin, start + end - 1 + WINDOW)


def busy_grams(sent: DataFrame, letters: np.ndarray) -> np.ndarray:
    """Grams with too many runs for one task: HOT_SHARE at most, as each has at least that part of all runs."""
    counts = sent.mapInArrow(_counter(PIECE, BLOCK_RUNS, letters), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    counts = common.checkpointed(counts.where(F.col("g").isNull() | (F.col("n") >= HOT_RUNS)))
    every = counts.where("g is null").agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("g").isNotNull() & (F.col("n") >= max(HOT_RUNS, every // HOT_SHARE))).orderBy("g")
    return np.array([r["g"] for r in found.collect()], np.int64)


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text with the bytes to remove: i (the id), t (the text), cut array<struct<b, e>> (not merged, unordered)."""
    common.session(df.sparkSession)
    docs = df.select(df[id_col].alias("i"), F.coalesce(df[id_col].cast("long"), F.lit(_LAST_ID)).alias("d"), F.xxhash64(df[text_col]).alias("tag"), df[text_col].alias("t"))
    texts = docs.repartition("d", "tag")
    for seed in range(SEEDS):
        judged, more = _judged(docs.select("d", "tag", "t"), texts, _letters(seed))
        if more.where("kind = 6").isEmpty():
            break
    else:
        raise RuntimeError(f"hashes of {SEEDS} seeds collided")
    cuts = judged.where("kind = 1").unionByName(more.where("kind = 1")).select("d", "tag", F.struct(F.col("z").alias("b"), "e").alias("cut"))
    return texts.join(cuts.groupBy("d", "tag").agg(F.collect_list("cut").alias("cut")), ["d", "tag"], "left").select("i", "t", "cut")


def _judged(sent: DataFrame, texts: DataFrame, letters: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """What repeats by the hashes of one seed, and what bytes say of it and of the rest."""
    busy = sent.sparkSession.sparkContext.broadcast(busy_grams(sent, letters))
    judged = common.stored(_dealt(sent.mapInArrow(_sender(busy, PIECE, BLOCK_RUNS, letters), _ROWS), 3).mapInArrow(_judge_runs, _ROWS))
    claims = judged.where("kind = 1")
    sources = claims.selectExpr("d0 d", "s tag", "o z", "o + e - z e").distinct().selectExpr("d", "tag", "1 kind", "0L g", "tag s", "z", "e", "d d0", "z o")
    asked = judged.where("kind in (1, 2, 4)").select("d", "tag", "kind", "g", "s", "z", "e", "d0", "o").unionByName(sources)
    open_ = asked.groupBy("d", "tag").agg(F.collect_list(F.struct("kind", "g", "s", "z", "e", "d0", "o")).alias("open"))
    around = texts.join(open_, ["d", "tag"]).select("d", "tag", "t", "open").mapInArrow(_fetch, f"{_ROWS}, l binary, r binary")
    return judged, common.stored(_dealt(around, 4).mapInArrow(_judge_windows, _ROWS).where("kind in (1, 6)"))


def kept_of(text: bytes, cuts: list[dict] | None) -> tuple[bytes, int]:
    """What is left of a text, and how many maximal runs went."""
    if not cuts:
        return text, 0
    out, at, spans = [], 0, 0
    for b, e in sorted((c["b"], c["e"]) for c in cuts):
        if b > at or not spans:
            out.append(text[at:b])
            spans += 1
        at = max(at, e)
    return b"".join([*out, text[at:]]), spans


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("t").cast(pa.binary()).to_pylist()]
            kept = [kept_of(t, c) for t, c in zip(texts, batch.column("cut").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, (k, _) in zip(texts, kept)], pa.int64()), pa.array([n for _, n in kept], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in kept], pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return removed(df, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over the whole `documents`."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
