"""Media columns: interleaved sequences of text and media, with payloads resolved by digest.

`parse_pages` reads HTML into ordered items: text, or a reference to a payload with its source and caption. A source
`media:<digest>` names a payload by the digest of its bytes; any other is referred to by the digest of the source itself,
under which a fetched payload can be held. `store` keeps
payloads losslessly as 8-bit grey PNG images of 64 samples a row. `resolve` joins references to payloads by digest;
`interleave` puts each page's items back in order. A payload moves once per distinct digest and task, and features are
computed once per distinct payload, before the join; a payload that many pages share is never repeated per page.

Nulls: a null text is the empty payload (64 zeros), null HTML has no items; a reference without a payload keeps its
position and caption, with null features. Repeated rows give repeated results in `store`'s references; rows of
`interleave` that repeat a page id are one page. Empty tables give empty results. Only named columns are read.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<pos:int,kind:string,text:string,digest:string,caption:string,source:string>"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(payload: bytes) -> bytes:
    """The payload with zeros up to a positive multiple of WIDTH."""
    return payload + bytes(-len(payload) % WIDTH if payload else WIDTH)


def to_png(samples: bytes) -> bytes:
    """Samples as an 8-bit grey image, WIDTH to a row, unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image of `to_png`; anything else, or a chunk that doesn't match its checksum, is an error."""
    if image[:8] != _SIGNATURE:
        raise ValueError("no PNG image")
    at, data, width, height = 8, [], 0, 0
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("no 8-bit grey image of the stored width")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a row of the image is filtered")
    return lines[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Shape and distribution of the samples: rows, mean, deviation, entropy in bits, most frequent sample."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts / counts.sum()
    values = np.arange(256)
    mean = float((share * values).sum())
    spread = float(np.sqrt(max(0.0, (share * values**2).sum() - mean**2)))
    some = share[share > 0]
    return f"rows={len(samples) // WIDTH};mean={mean:.4f};std={spread:.4f};bits={float(-(some * np.log2(some)).sum()):.4f};mode={int(counts.argmax())}"


class _Page(HTMLParser):
    """Items of a page in reading order."""

    SILENT = frozenset({"script", "style", "template", "noscript"})
    MEDIA = frozenset({"img", "video", "audio", "source", "embed"})
    PREFIX = "media:"

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.texts, self.silent, self.caption, self.figure = [], [], 0, None, []

    def flush(self) -> None:
        text = " ".join(" ".join(self.texts).split())
        self.texts = []
        if text:
            self.items.append(["text", text, None, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.MEDIA:
            found = dict(attrs)
            if source := (found.get("src") or "").strip():
                digest = source[len(self.PREFIX) :] if source.startswith(self.PREFIX) else hashlib.sha256(source.encode("utf-8", "replace")).hexdigest()
                self.flush()
                self.items.append(["media", None, digest, found.get("alt"), source])
                self.figure.append(self.items[-1])
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption = " ".join(" ".join(self.caption).split())
            for item in self.figure:
                item[3] = caption or item[3]
            self.caption = None
        elif tag == "figure":
            self.figure = []
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "section", "article", "td"):
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.texts if self.caption is None else self.caption).append(data)


def items_of(text: str | None) -> list[dict]:
    page = _Page()
    page.feed(text or "")
    page.close()
    page.flush()
    return [dict(zip(("pos", "kind", "text", "digest", "caption", "source"), (k, *item))) for k, item in enumerate(page.items)]


def parse_pages(df: DataFrame, carry: Column, page: Column) -> DataFrame:
    """Pages as ordered items: row (the carried struct), items."""
    sent = common.session(df.sparkSession) and df.select(carry.alias("row"), page.alias("h"))
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("source", pa.string())]))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(map(items_of, batch.column("h").to_pylist()), kind)], names=["row", "items"])

    return sent.mapInArrow(run, f"row {sent.schema['row'].dataType.simpleString()}, items array<{ITEM}>")


def pages_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A page for each text, which shows the text's payload by its digest: id, n_bytes, html."""

    def run(batches):
        for batch in batches:
            pages, sizes = [], []
            for i, text in zip(batch.column("i").to_pylist(), batch.column("t").cast(pa.binary()).to_pylist()):
                digest = hashlib.sha256(padded(text or b"")).hexdigest()
                i = html.escape(str(i))
                pages.append(f'<article><p>document {i}</p><figure><img src="media:{digest}" alt="payload"><figcaption>text of document {i}</figcaption></figure></article>')
                sizes.append(len(text or b""))
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], names=[id_col, "n_bytes", "html"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, html string")


def store(df: DataFrame, text_col: str) -> DataFrame:
    """The stored form of each distinct payload: digest, media. A task sends a payload once; another drops what tasks repeat."""

    def keep(batches):
        seen: set[bytes] = set()
        for batch in batches:
            digests, images = [], []
            for text in batch.column("t").cast(pa.binary()).to_pylist():
                samples = padded(text or b"")
                digest = hashlib.sha256(samples)
                if digest.digest() not in seen:
                    seen.add(digest.digest())
                    digests.append(digest.hexdigest())
                    images.append(to_png(samples))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=["digest", "media"])

    def once(batches):
        last = None
        for batch in batches:
            new = []
            for k, d in enumerate(batch.column("digest").to_pylist()):
                if d != last:
                    new.append(k)
                    last = d
            yield batch.take(pa.array(new, pa.int64()))

    sent = df.select(df[text_col].alias("t")).mapInArrow(keep, "digest string, media binary")
    return sent.repartition("digest").sortWithinPartitions("digest").mapInArrow(once, "digest string, media binary")


def described(media: DataFrame) -> DataFrame:
    """What the stored bytes of each payload give when read back: digest and FEATURES."""

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            images = batch.column("media").to_pylist()
            read = [from_png(x) for x in images]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(map(len, read), pa.int64()), pa.array(map(sha, read), pa.string()), pa.array([zlib.crc32(x[-WIDTH:]) for x in read], pa.int64()), pa.array(map(len, images), pa.int64()), pa.array(map(sha, images), pa.string()), pa.array(map(feature_of, read), pa.string())], names=["digest", *[x.split()[0] for x in FEATURES.split(", ")]])

    return media.mapInArrow(run, f"digest string, {FEATURES}")


def resolve(items: DataFrame, payloads: DataFrame) -> DataFrame:
    """Items (row, items) with the columns of `payloads` joined by digest: row, item, and a struct of the payload's columns."""
    one = items.select("row", F.explode_outer("items").alias("item")).withColumn("wanted", F.col("item.digest"))
    texts = one.where("wanted is null").select("row", "item")
    columns = [c for c in payloads.columns if c != "digest"]
    held = payloads.select(F.col("digest").alias("held"), F.struct(*columns).alias("payload"))
    media = one.where("wanted is not null").join(held, F.col("wanted") == F.col("held"), "left").select("row", "item", "payload")
    return texts.withColumn("payload", F.lit(None).cast(held.schema["payload"].dataType)).unionByName(media)


def interleave(pages: DataFrame, payloads: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """Each page's items in order with their payloads: id, items array<struct<item, payload>>. A page without items has an empty array."""
    found = resolve(parse_pages(pages, F.struct(pages[id_col].alias("i")), pages[html_col]), payloads)
    entry = F.when(F.col("item").isNotNull(), F.struct(F.col("item.pos").alias("pos"), "item", "payload"))
    return found.groupBy(F.col("row.i").alias(id_col)).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["item"].alias("item"), x["payload"].alias("payload"))).alias("items"))


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of `pages` in reading order: page_id, pos, kind, text, source, caption, digest."""
    found = parse_pages(common.session(spark).read.parquet(f"{sf_dir}/pages.parquet"), F.struct("page_id"), F.col("html"))
    return found.select("row.page_id", F.explode("items").alias("item")).select("page_id", "item.pos", "item.kind", "item.text", "item.source", "item.caption", "item.digest")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: every text of `documents` is the payload of a page of its own."""
    docs = common.session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    pages = pages_of(docs, "doc_id", "text")
    found = resolve(parse_pages(pages, F.struct("doc_id", "n_bytes"), F.col("html")), described(store(docs, "text")))
    return found.where("item.kind = 'media'").select("row.doc_id", "row.n_bytes", "payload.*", F.col("item.pos").alias("position"), F.col("item.caption").alias("caption"))
