"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units (a run of ASCII letters, or one other code point). Two hashes of the id place the cuts between
prefix, middle and suffix; two more choose the form. Every document leaves its scan as pieces of at most `units` units, keyed by
the document and the piece's position in the output. `repartitionAndSortWithinPartitions` brings them into that order, and
each task streams them, sentinels between, into one incremental digest after the other: no document is ever put together
in memory. To restore, the streamed output (not the input) is keyed anew by the position that its sentinels tell, and sorted
again; as the partitioner is the same, the second sort moves nothing between tasks.

Forms: `plain` is the text itself, `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle. Texts
that hold a sentinel are plain, so an output tells its parts.

A document is its id, its text and the task that reads it, by a 128-bit hash: repeated rows of one task are pieces at the same positions, which
are read once and counted, and give as many equal rows; those of different tasks stay apart, so that no task gets all
copies of a hot row. A null text counts as empty, and so is plain; a null id is hashed as no digits. Very long texts are cut like others. An
empty table gives no rows. Only the two named columns are read, so further columns of any name don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Sentinels before prefix, suffix and middle, and the parts of each form in their order of output.
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ORDERS = {"plain": (), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
RESTORED = ("prefix", "middle", "suffix")
#: Hundredths of texts that stay plain, and of the others' that are spm. Units in a piece.
PLAIN_FROM, SPM_BELOW, UNITS = 90, 20, 16384
#: Bytes of text that a task of the sort takes, about.
TASK_BYTES = 16_000_000
SCHEMA = "{} {}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def unit_starts(text: str) -> np.ndarray:
    """Code points at which units begin."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (points | 32) - np.uint32(97) < 26
    first = np.ones(len(points), bool)
    first[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(first)


def choices(doc_id, text: str, n: int) -> tuple[str, int, int]:
    """Form, and the units after which prefix and middle end."""
    named = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(named[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or h3 % 100 >= PLAIN_FROM or any(s in text for s in SENTINELS.values()):
        return "plain", n, n
    return "spm" if h4 % 100 < SPM_BELOW else "psm", *sorted((h1 % (n + 1), h2 % (n + 1)))


def pieces_of(doc_id, text: str, units: int) -> Iterator[tuple[int, object]]:
    """(position in the output, piece) of one document; at position 0, what is known of it: id, units, form, code points of prefix and middle."""
    at = unit_starts(text)
    form, a, b = choices(doc_id, text, len(at))
    ends = np.append(at, len(text))
    bounds = {"prefix": (0, a), "middle": (a, b), "suffix": (b, len(at))}
    sizes = (None, None) if form == "plain" else (int(ends[a]), int(ends[b] - ends[a]))
    yield 0, (doc_id, len(at), form, *sizes)
    position = 1
    for part in ORDERS[form] or (None,):
        if part:
            yield position, SENTINELS[part].encode()
            position += 1
        low, high = bounds[part] if part else (0, len(at))
        for k in range(low, high, units):
            yield position, text[ends[k] : ends[min(k + units, high)]].encode("utf-8", "surrogatepass")
            position += 1


def owner(key: tuple) -> int:
    """The partition's number before the modulus: from the document's hash."""
    return int.from_bytes(key[0][:6], "big")


def once(items: Iterator[tuple]) -> Iterator[tuple[object, int]]:
    """Values of equal keys in a sorted stream, once each, with their number."""
    for _, same in groupby(items, itemgetter(0)):
        value, n = next(same)[1], 1
        for _ in same:
            n += 1
        yield value, n


def streamed(items: Iterator[tuple], texts: bool) -> Iterator[tuple]:
    """Digest each document's output as it passes, and key its pieces by the position that they have in the restored text; last, what is known of it."""
    for name, own in groupby(items, lambda x: x[0][0]):
        pieces = once(own)
        known, copies = next(pieces)
        digest, order, at, output = hashlib.sha256(), ORDERS[known[2]], -1, []
        for k, (piece, _) in enumerate(pieces):
            digest.update(piece)
            if texts:
                output.append(piece)
            if at + 1 < len(order) and piece == SENTINELS[order[at + 1]].encode():
                at += 1
            else:
                yield (name, RESTORED.index(order[at]) if order else 0, k), piece
        yield (name, len(RESTORED), 0), (known, copies, digest.hexdigest(), b"".join(output).decode("utf-8", "replace") if texts else None)


def restored(items: Iterator[tuple], texts: bool) -> Iterator[tuple]:
    """Rows of the documents of a stream in restored order."""
    digest = hashlib.sha256()
    for (_, part, _), value in items:
        if part < len(RESTORED):
            digest.update(value)
        else:
            (doc_id, n, form, prefix, middle), copies, output, text = value
            for _ in range(copies):
                yield (doc_id, n, form, prefix, middle, output, digest.hexdigest(), *([text] if texts else []))
            digest = hashlib.sha256()


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS) -> RDD:
    """((document, position in the output), piece) of all documents."""

    def cut(task: int, rows):
        for doc_id, text in rows:
            text = text or ""
            name = hashlib.blake2b(f"{doc_id}\0".encode() + text.encode("utf-8", "surrogatepass"), digest_size=16).digest() + task.to_bytes(4, "big")
            for position, piece in pieces_of(doc_id, text, units):
                yield (name, position), piece

    return df.select(df[id_col], df[text_col].cast("string")).rdd.mapPartitionsWithIndex(cut)


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS, texts: bool = False) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; with `texts` also the output itself, whose pieces then meet in one row."""
    spark = common.session(df.sparkSession)
    size = df.agg(F.sum(F.octet_length(df[text_col].cast("string")))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    sort = lambda keyed: keyed.repartitionAndSortWithinPartitions(tasks, owner)
    out = sort(pieces(df, id_col, text_col, units)).mapPartitions(lambda items: streamed(items, texts), preservesPartitioning=True)
    rows = sort(out).mapPartitions(lambda items: restored(items, texts))
    schema = SCHEMA.format(f"`{id_col}`", df.schema[id_col].dataType.simpleString()) + ", output string" * texts
    return spark.createDataFrame(rows, schema, verifySchema=False)


def restore(output, form):
    """The text that an output of a form was made of, as a column."""
    cut = lambda a, b: F.substring_index(F.substring_index(output, SENTINELS[a], -1), SENTINELS[b], 1) if b else F.substring_index(output, SENTINELS[a], -1)
    psm = F.concat(cut("prefix", "suffix"), cut("middle", None), cut("suffix", "middle"))
    spm = F.concat(cut("prefix", "middle"), cut("middle", None), cut("suffix", "prefix"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over the whole `documents`."""
    return transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
hashed AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
  FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
