"""Stored captures: manifests with compressed pages become page signals; certificate leaves become names."""

from __future__ import annotations

import base64
import binascii
import errno
import gzip
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hosts import url_host
from ..functions.text import cookie_names, js_globals, page_features, portions
from ..operators import file_sink
from ..schemas import PAGE_SIGNALS

MANIFEST = (
    "host_id long, pages array<struct<page_type:string,url:string,final_url:string,html_key:string,headers:map<string,string>,"
    "scripts:array<string>,iframes:array<string>,external_hosts:array<string>>>"
)
_NONE = "array<string>"
#: What a store says of a name that is no file's.
_NO_FILE = (errno.ENOENT, errno.ENOTDIR, errno.ENAMETOOLONG)
#: Texts that a Python worker holds unzipped at once: one may be many times as long as its file.
_AT_ONCE = 16


def _unzipped(body: bytes | None) -> str | None:
    """A compressed text; null if it can't be read."""
    try:
        return gzip.decompress(body).decode("utf-8", "replace")
    except (OSError, EOFError, TypeError, zlib.error):
        return None


def unzipped(files: DataFrame, key: str, content: str) -> DataFrame:
    """Compressed texts with their keys: `_key`, `html` (null where one can't be read)."""

    def run(batches):
        for batch in batches:
            for part in portions(batch, content):
                bodies = part.column(content)
                for k in range(0, len(bodies), _AT_ONCE):
                    yield pa.RecordBatch.from_arrays([part.column(key).slice(k, _AT_ONCE), pa.array([_unzipped(b) for b in bodies.slice(k, _AT_ONCE).to_pylist()], pa.string())], names=["_key", "html"])

    return files.select(key, content).mapInArrow(run, "_key string, html string")


def stored(pages: DataFrame, path: str, folder: str, html: str = "html") -> DataFrame:
    """Pages with an `html_key` in place of their text: each text becomes a compressed file of its own in a folder below a path; without a text both are null.

    Tasks write the files and pass their keys on, in the one pass in which the result is read. Each attempt of a task writes to a
    place of its own, so files of attempts that failed stay, but no row names them. Write the result once; reading it anew stores the pages anew.
    """
    schema = T.StructType([*pages.drop(html).schema.fields, T.StructField("html_key", T.StringType())])
    rest = schema.names[:-1]

    def run(batches):
        store, root = file_sink.store_of(path)
        place, n = f"{folder}/{uuid.uuid4()}", 0
        for batch in batches:
            for part in portions(batch, html):
                below, keys = f"{place}/{n}", []
                store.create_dir(f"{root}/{below}", recursive=True)
                for k, text in enumerate(part.column(html).to_pylist()):
                    keys.append(None if text is None else f"{below}/{k}.html.gz")
                    if text is not None:
                        with store.open_output_stream(f"{root}/{keys[-1]}", compression=None) as out:
                            out.write(gzip.compress(text.encode("utf-8"), 6))
                n += 1
                yield pa.RecordBatch.from_arrays([*part.select(rest).columns, pa.array(keys, pa.string())], names=schema.names)

    own, cores = pages.select(*rest, html), pages.sparkSession.sparkContext.defaultParallelism
    return (own.repartition(cores) if own.rdd.getNumPartitions() < cores else own).mapInArrow(run, schema)


def _fetched(pages: DataFrame, path: str) -> DataFrame:
    """Pages with the text of their key, `html`; null without one, or where it can't be read. A page's file is opened by its name, so that no folder is listed."""
    schema = T.StructType([*pages.schema.fields, T.StructField("html", T.StringType())])

    def run(batches):
        store, root = file_sink.store_of(path)

        def text(key: str | None) -> str | None:
            if not key or "\0" in key or ".." in key.split("/"):
                return None
            try:
                with store.open_input_file(f"{root}/{key}") as f:
                    body = f.read()
            except OSError as e:
                if e.errno not in _NO_FILE and store.get_file_info(f"{root}/{key}").is_file:
                    raise  # the store failed, not the page
                return None
            return _unzipped(body)

        for batch in batches:
            for k in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(k, _AT_ONCE)
                texts = pa.array([text(key) for key in part.column("html_key").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=schema.names)

    return pages.mapInArrow(run, schema)


def _listed(pages: DataFrame, path: str) -> DataFrame:
    """As `_fetched`, in stores that only Spark's readers reach: all files are listed and meet their pages in a join."""
    spark = pages.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    files = spark.read.format("binaryFile").load(path, recursiveFileLookup=True, pathGlobFilter="*.gz")
    bodies = unzipped(files.withColumn("_key", F.expr(f"substring(path, {len(root) + 2})")), "_key", "content")
    return pages.join(bodies, F.col("html_key") == F.col("_key"), "left").drop("_key")


def captures(spark: SparkSession, path: str, lines: bool = False, manifests: str | None = None) -> DataFrame:
    """Page signals of all captures below a folder: host_id, place (in its manifest) and PAGE_SIGNALS.

    Manifests (`*.json`, one a host; with `lines`, one a line; below `manifests` if that folder is named, which spares a listing of all
    pages) list pages; a page's HTML is the compressed file of its key, a path below the folder, and its features come from there.
    A page without one, or with one that can't be read, has what the manifest says.
    """
    read = spark.read.schema(MANIFEST).json(manifests or path, multiLine=not lines, recursiveFileLookup=True, pathGlobFilter="*.json")
    page = read.select("host_id", F.posexplode("pages").alias("place", "p")).select("host_id", "place", "p.*").withColumn("url", F.coalesce("final_url", "url", F.lit("")))
    # manifests are small beside the pages that they name, so few partitions of them are dealt out
    tasks = 4 * spark.sparkContext.defaultParallelism
    page = page.repartition(tasks, "host_id", "place") if page.rdd.getNumPartitions() < tasks else page
    try:
        file_sink.store_of(path)
        page = _fetched(page, path)
    except (OSError, pa.ArrowInvalid):
        page = _listed(page, path)
    kept = [c for c in page.columns if c not in ("host_id", "url")]
    f = page_features(page, "host_id", kept=["url", *kept])
    read_from = lambda c: F.when(F.col("html") != "", F.col(c))
    j = f.select("host_id", "url", *kept, *[read_from(c).alias(c) for c in ("script_srcs", "iframe_srcs", "form_actions", "inline_scripts")])
    headers = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    given = lambda c, m: F.coalesce(c, m, F.array().cast(_NONE))
    own = url_host(F.col("url"))
    outer = F.filter(F.array_distinct(F.transform(F.concat(given("script_srcs", F.lit(None)), given("iframe_srcs", F.lit(None)), given("form_actions", F.lit(None))), url_host)), lambda h: h.isNotNull() & (h != own))
    values = {
        "page_type": F.coalesce("page_type", F.lit("homepage")), "url": F.col("url"), "html": F.coalesce("html", F.lit("")), "headers": headers,
        "cookie_names": F.coalesce(F.array_sort(F.array_distinct(cookie_names(F.try_element_at(headers, F.lit("set-cookie"))))), F.array().cast(_NONE)),
        "script_srcs": given("script_srcs", F.col("scripts")), "iframe_srcs": given("iframe_srcs", F.col("iframes")), "form_actions": given("form_actions", F.lit(None)),
        "network_hosts": F.array_sort(F.array_union(given("external_hosts", F.lit(None)), outer)), "js_globals": F.coalesce(js_globals(F.col("inline_scripts")), F.array().cast(_NONE)),
    }
    return j.select("host_id", "place", *[values.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in PAGE_SIGNALS.fields])


_ALTERNATIVE, _COMMON = bytes.fromhex("551d11"), bytes.fromhex("550403")
_SEQUENCE, _SET, _OID, _OCTETS, _INTEGER, _BITS, _EXTENSIONS, _DNS = 0x30, 0x31, 0x06, 0x04, 0x02, 0x03, 0xA3, 0x82
#: Encodings of a name's text by its tag.
_TEXTS = {0x0C: "utf-8", 0x12: "ascii", 0x13: "ascii", 0x14: "latin-1", 0x16: "ascii", 0x1C: "utf-32-be", 0x1E: "utf-16-be"}


def _element(der: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Tag, begin and end of the content of the DER element at a place; it must end by `end`."""
    if at + 2 > end:
        raise ValueError("an element is cut short")
    tag, n, at = der[at], der[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            raise ValueError("a length has no sound form")
        n, at = int.from_bytes(der[at : at + size], "big"), at + size
    if at + n > end:
        raise ValueError("an element runs out of its parent")
    return tag, at, at + n


def _inside(der: bytes, begin: int, end: int) -> list[tuple[int, int, int]]:
    """The elements that fill a stretch."""
    found = []
    while begin < end:
        found.append(_element(der, begin, end))
        begin = found[-1][2]
    return found


def _expect(element: tuple[int, int, int], *tags: int) -> tuple[int, int]:
    if element[0] not in tags:
        raise ValueError("an element is of another kind")
    return element[1:]


def certificate_names(der: bytes) -> list[str]:
    """Names of a certificate: alternative names of its extension, then common names of its subject that hold a dot. A walk down the tree; a ValueError if that is not a certificate's."""
    (whole,) = _inside(der, 0, len(der))
    signed, algorithm, signature = _inside(der, *_expect(whole, _SEQUENCE))
    _expect(algorithm, _SEQUENCE), _expect(signature, _BITS)
    fields = _inside(der, *_expect(signed, _SEQUENCE))
    if fields and fields[0][0] == 0xA0:  # the version, which only old certificates leave out
        fields = fields[1:]
    if len(fields) < 6:
        raise ValueError("fields are missing")
    for field, tag in zip(fields, (_INTEGER, _SEQUENCE, _SEQUENCE, _SEQUENCE, _SEQUENCE, _SEQUENCE)):
        _expect(field, tag)
    names: list[str] = []
    for field in fields[6:]:
        if field[0] == _EXTENSIONS:
            (listed,) = _inside(der, *field[1:])
            for extension in _inside(der, *_expect(listed, _SEQUENCE)):
                parts = _inside(der, *_expect(extension, _SEQUENCE))
                if len(parts) < 2 or der[slice(*_expect(parts[0], _OID))] != _ALTERNATIVE:
                    continue
                (general,) = _inside(der, *_expect(parts[-1], _OCTETS))
                names += [der[a:b].decode("ascii", "ignore") for tag, a, b in _inside(der, *_expect(general, _SEQUENCE)) if tag == _DNS]
    for relative in _inside(der, *fields[4][1:]):
        for pair in _inside(der, *_expect(relative, _SET)):
            kind, value = _inside(der, *_expect(pair, _SEQUENCE))
            if der[slice(*_expect(kind, _OID))] == _COMMON and value[0] in _TEXTS:
                said = der[value[1] : value[2]].decode(_TEXTS[value[0]], "ignore")
                if "." in said and said not in names:
                    names.append(said)
    return names


def leaf_names(leaf: bytes) -> list[str] | None:
    """Names of a log's leaf that holds a certificate. A leaf with a certificate yet to be signed: None (the final one follows in the log); an unknown kind, or no certificate: none."""
    if len(leaf) < 12 or leaf[10:12] != b"\0\0":
        return None if leaf[10:12] == b"\0\1" else []
    try:
        return certificate_names(leaf[15 : 15 + int.from_bytes(leaf[12:15], "big")])
    except ValueError:
        return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def names_of_leaves(leaves: pd.Series) -> pd.Series:
    """Names of base64 leaves; null for leaves that hold no certificate, none for texts that aren't base64."""

    def one(leaf: str) -> list[str] | None:
        try:
            return leaf_names(base64.b64decode(leaf))
        except binascii.Error:
            return []

    return leaves.map(one, na_action="ignore")


def certificate_log(entries: DataFrame, leaf: str = "leaf_input") -> DataFrame:
    """Names in log entries, as a domain list: rank (null), raw. For the entries themselves, see `log_stream`."""
    return entries.select(F.explode(names_of_leaves(leaf)).alias("raw")).select(F.lit(None).cast("bigint").alias("rank"), "raw")
