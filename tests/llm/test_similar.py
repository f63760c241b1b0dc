"""Links between similar texts against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tillwatch.llm import simhash, similar

R = random.Random(11)


def _word():
    return "".join(R.choice("abcdefghijklm") for _ in range(R.randrange(2, 8)))


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _similarity(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a | b else 0


def _families(n, copies, edits):
    texts = []
    for _ in range(n):
        words = [_word() for _ in range(R.randrange(120, 300))]
        texts.append(" ".join(words))
        for _ in range(copies):
            own = list(words)
            for k in R.sample(range(len(own)), edits):
                own[k] = _word()
            texts.append(" ".join(own))
    return texts


def _hashes(df):
    return {r.h: r.t for r in df.select("t", F.xxhash64("t").alias("h")).collect()}


@pytest.mark.parametrize("block", [128, 3])
def test_near_copies_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    texts = _families(25, 4, 3)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "h long, t string").repartition(4)
    found = similar.similar_links(df, "t").collect()
    of = _hashes(df)
    assert all(_similarity(of[a], of[b]) >= 0.8 for a, b in found)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df.select(F.col("h").alias("doc_id"), F.col("t").alias("text")), similarity=0.8).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if _similarity(texts[i], texts[j]) >= 0.8]
    met = sum(got[i] == got[j] for i, j in pairs) / len(pairs)
    assert len(pairs) > 50 and met >= 0.95
    assert all(_family(i) == _family(c) for i, c in got.items())


def _family(k):
    return k % 125 // 5


def test_edges_of_input(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \n", 5), (4, "one two", 5), (4, "One  TWO", 5), (None, "word " * 30_000, 5), (6, "word " * 29_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, band int")
    of = {r.h: r.text for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    found = {frozenset((of[a], of[b])) for a, b in similar.similar_links(df).collect()}
    assert found == {frozenset(("one two", "One  TWO")), frozenset(("word " * 30_000, "word " * 29_000))}
    assert similar.similar_links(df.limit(0)).count() == 0
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, similarity=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, None: 6, 6: 6}


def test_similarity_is_of_sets():
    a, b = "a b c d e f g", "a b c d e f h"
    keys = similar.band_keys([a.encode(), a.upper().encode(), None, b""])
    assert (keys[0] == keys[1]).all() and not keys[2:].any() and keys[0].all()
    assert similar.bucket_links([7, 9], [a.encode(), b.encode()], 0.5) == [(9, 7)]
    assert similar.bucket_links([7, 9], [a.encode(), b.encode()], 0.51) == []


def test_kept_texts_are_shuffled_once(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (None, "g h", None, None, 3), (None, "g h", None, None, 3), (4, None, "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    before = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        node = kept._jdf.queryExecution().executedPlan()
        while "Join" not in node.nodeName():
            node = node.children().apply(0)
        seen, todo = [], [node.children().apply(0)]
        while todo:
            node = todo.pop()
            seen.append(node.nodeName())
            todo += [node.children().apply(k) for k in range(node.children().size())]
        assert seen.count("Exchange") == 1
        assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "g h"), (1, "a b c d e f"), (4, None)]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
