"""Packing, fill-in-middle and vector codes against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.llm import bpe, codes, cover_tree, infill, packing

TEXTS = [None, "", " \n\t", "a", "one two  three, four", "naïve 日本語 \U0001f600 x" * 3, "holds <S> itself", "ends with <", "word " * 5000, "x" * 3000, "same", "same"]
SCHEMA = "doc_id long, text string, length string, k string, at int, sequence_id string, i long, t string, label int, form string"


def documents(spark, texts=TEXTS):
    """Null and repeated ids, and further columns whose names the operators use inside."""
    rows = [(None if k == 3 else min(k, len(texts) - 2), t, "l", "k", 1, "s", 2, "t", 3, "f") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# --- 11 --------------------------------------------------------------------------------------------------------------
def sequentially(lengths, capacity):
    """What bins hold by greedy matching of large pieces, then best fit of small ones, a piece at a time (which of equal gaps a piece takes doesn't change it)."""
    large, small = sorted((x for x in lengths if 3 * x > capacity), reverse=True), sorted((x for x in lengths if 3 * x <= capacity), reverse=True)
    bins = []
    while large:
        first = large.pop(0)
        other = next((x for x in large if first + x <= capacity), None)
        if other:
            large.remove(other)
        bins.append([first] + [other] * bool(other))
    for x in small:
        fit = min((b for b in bins if sum(b) + x <= capacity), key=lambda b: capacity - sum(b), default=None)
        bins.append([x]) if fit is None else fit.append(x)
    return sorted(map(sum, bins))


def filled(runs, counts, capacity):
    """The bins that runs give; every offset must follow what is before it."""
    bins = {}
    for length, n in enumerate(counts):
        own = runs[runs[:, 0] == length]
        for rank in range(n):
            _, first, sequence, each, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            bins.setdefault(int(sequence + (rank - first) // each), []).append((int(offset + (rank - first) % each * length), length))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@pytest.mark.parametrize("capacity", [6, 7, 20, 50])
def test_runs_are_the_bins_of_piecewise_packing(capacity):
    r = random.Random(capacity)
    for _ in range(60):
        top = r.choice([2, capacity // 3, capacity // 2, capacity])
        lengths = [r.randint(1, max(1, top)) for _ in range(r.randint(0, 120))] + [max(1, top // 2)] * r.choice([0, 40])
        counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, int)
        bins = filled(packing.runs_of(counts, capacity), counts, capacity)
        assert sorted(bins) == list(range(len(bins)))
        assert sorted(sum(x for _, x in b) for b in bins.values()) == sequentially(lengths, capacity)
        assert sorted(x for b in bins.values() for _, x in b) == sorted(lengths)


def test_large_counts_make_few_runs():
    counts = np.random.default_rng(1).integers(0, 10**9, 2049)
    counts[0] = 0
    runs = packing.runs_of(counts, 2048)
    bins = int((runs[:, 2] + 1).max())
    assert len(runs) < 20_000 and bins >= (counts * np.arange(2049)).sum() / 2048


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_packed_documents(spark, ranks):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = TEXTS + ["<|endoftext|> inside", "it's 12 o'clock é"]
    placed = packing.place(packing.tokenised(documents(spark, texts), ranks)).cache()
    rows = placed.collect()
    want = sorted((None if k == 3 else min(k, len(texts) - 2), library.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in enumerate(texts) if k != 3)
    got = {}
    for r in sorted((r for r in rows if r.doc_id is not None and r.doc_id != len(texts) - 2), key=lambda r: (r.doc_id, r.piece)):
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and r.start == len(got.get(r.doc_id, []))
        assert r.length == 2048 or r.piece == 0
        got[r.doc_id] = got.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    assert sorted(got.items()) == [w for w in want if w[0] != len(texts) - 2]
    for s in packing.sequences(placed).collect():
        own = sorted((r for r in rows if r.sequence_id == s.sequence_id), key=lambda r: r.offset)
        assert len(s.ids) <= 2048 and s.ids == [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert [tuple(d) for d in s.documents] == [(r.doc_id, r.piece, r.offset) for r in own]


def test_packing_of_a_hot_length(spark):
    lengths = [100] * 3000 + list(range(1, 900))
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long").repartition(7)
    rows = packing.place(df, 1000).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(x for b in bins.values() for _, x in b) == sorted(lengths)
    assert sorted(sum(x for _, x in b) for b in bins.values()) == sequentially(lengths, 1000)
    for inside in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(inside), sorted(inside)[1:])) and min(inside)[0] == 0
    with pytest.raises(Exception, match="1 to 50 long"):
        packing.place(df, 50).collect()


# --- 12 --------------------------------------------------------------------------------------------------------------
def infilled(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("units", [1, 3, 1000, infill.UNITS])
def test_infill_equals_brute_force(spark, units):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = [t if units > 1 or len(t or "") < 200 else t[:200] for t in TEXTS]
    df = documents(spark, texts).repartition(3)
    rows = infill.transform(df, units=units, texts=True)
    want = []
    for r in df.collect():
        n, form, prefix, middle, output = infilled(r.doc_id, r.text)
        want.append((r.doc_id, n, form, prefix, middle, sha(output), sha(r.text or ""), output))
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want))
    assert infill.transform(df.limit(0)).count() == 0


def test_infill_forms_and_restoring(spark):
    texts = [f"text {k} of < some > words <P" for k in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = infill.transform(df, texts=True)
    found = rows.select("doc_id", "form", infill.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert {r.doc_id: r.t for r in found} == dict(enumerate(texts))
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_infill_shuffles_once(spark):
    df = spark.createDataFrame([(k % 9, f"text {k % 9}") for k in range(90)], "doc_id long, text string").repartition(5)
    rows = infill.transform(df)
    assert rows.count() == 90 and len({tuple(r) for r in rows.collect()}) == 9
    plan = rows.rdd._jrdd.rdd().toDebugString()
    assert plan.count("ShuffledRDD") == 1


# --- 13 --------------------------------------------------------------------------------------------------------------
def encoded(rows, parts, entries, rounds):
    """Codes, errors and codebooks by trying every entry."""
    longest = max(len(x) for _, x in rows)
    width = -(-longest // parts)
    cut = [[list(x + [0] * (width * parts - len(x)))[p * width : (p + 1) * width] for p in range(parts)] for _, x in rows]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min((far(v, b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[near(p, v[p])[1] for v in cut] for p in range(parts)]
        books = [[[sum(v[p][i] for v, c in zip(cut, chosen[p]) if c == e) // chosen[p].count(e) for i in range(width)] if e in chosen[p] else b for e, b in enumerate(books[p])] for p in range(parts)]
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    return [([e for _, e in f], sum(d for d, _ in f)) for f in found], books


@pytest.mark.parametrize("seed", range(4))
def test_codes_equal_brute_force(spark, seed):
    r = random.Random(seed)
    spread = (3, 100, 1 << 20, 2)[seed]
    rows = [(k, [r.randint(-spread, spread) for _ in range(8 if seed != 1 else r.choice([0, 5, 8]))]) for k in range(60)]
    rows += [rows[7]] * 30 + [(None, [1] * 8), (3, [0] * 8)]
    df = spark.createDataFrame([(i, x, "c", k % 3 or None) for k, (i, x) in enumerate(rows)], "vec_id long, x array<long>, code string, label int").repartition(3)
    found, books = codes.encode(df, F.col("x"), parts=4, entries=9, rounds=2)
    want, theirs = encoded(rows, 4, 9, 2)
    assert books.tolist() == theirs
    assert sorted((repr(x.vec_id), x.code, x.error) for x in found.collect()) == sorted((repr(i), *w) for (i, _), w in zip(rows, want))
    sums = {}
    for k, (_, e) in enumerate(want):
        sums[k % 3 or None] = sums.get(k % 3 or None, 0) + e
    assert {(x.label, x.label_error) for x in codes.with_label_errors(found).collect()} == set(sums.items())


def test_label_errors_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(k, k % 4 or None, k) for k in range(50)], "vec_id long, label int, error long")
    want = sorted(map(tuple, codes.with_label_errors(df).collect()))
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 1)
    assert sorted(map(tuple, codes.with_label_errors(df).collect())) == want


def test_pivots_prune_evaluations():
    r = np.random.default_rng(2)
    x = (r.integers(0, 12, (4000, 1, 1)) * 500 + r.integers(0, 60, (4000, 16, 4))).astype(np.int64)
    books = np.ascontiguousarray(x[:64].transpose(1, 0, 2))
    pivots = codes.pivots_of(books, codes.PIVOTS)
    search = codes.Search(books, pivots)
    who, d = search.nearest(x, codes.roots(x, pivots).astype(np.float32))
    each = ((x[:, :, None] - books[None]) ** 2).sum(axis=-1)
    assert (d == each.min(axis=-1)).all() and (who == each.argmin(axis=-1)).all()
    assert search.evaluated < 0.3 * x.shape[0] * 16 * 64


def test_embeddings_are_pruned(spark):
    """Entries evaluated for the given vectors: fewer than half of all."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    x = np.array([r.x for r in df.select(cover_tree.quantised(F.col("embedding"), 256).alias("x")).collect()]).reshape(-1, 16, 4)
    books = np.ascontiguousarray(x[:64].transpose(1, 0, 2))
    pivots = codes.pivots_of(books, codes.PIVOTS)
    search = codes.Search(books, pivots)
    search.nearest(x, codes.roots(x, pivots).astype(np.float32))
    assert search.evaluated < 0.5 * x.shape[0] * 16 * 64
