"""The corpus pipeline: STAGES over `documents`, each stage on what its predecessor kept.

Language identification drops texts that it rejects; of near-duplicates, the document with the smallest id stays; found
secrets are cut out of the texts; mixing repeats documents, drops them, or cuts them to a prefix, to each source's budget;
byte-level BPE encoding and decoding ends it.

To the near-duplicate stage, rows are told apart by id and a hash of the text, so dissimilar texts of one id, or without
one, all stay; of a group's rows it keeps the first by id (null last), then by that hash. Texts without words leave the mix, as it takes none of their words. Any stage
takes an empty table. Further columns of the input are dropped: every stage but the last returns those of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwatch.llm import bpe, common, language, mix, secrets, simhash, similar

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing lang is filled in."""
    model = language.trained_on(docs)
    found = language.identify(docs, model, F.struct(*COLUMNS), F.col("text")).where(~F.col("rejected"))
    return found.select("row.doc_id", "row.text", F.coalesce("row.lang", "lang_pred").alias("lang"), "row.source", "row.n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: by SimHash, and by shingle sets that its distance misses."""
    hashed = F.xxhash64("text").alias("h"), F.xxhash64("source", "lang").alias("w")
    key = ["none", "id", "h", "w"]
    keyed = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), *hashed)
    found = simhash.near_duplicates(keyed.select(F.struct(*key).alias("k"), "text"), "k", "text", similar.SIMILARITY)
    first = found.where(F.col("k") == F.col("component_id")).select("k.*").distinct()
    once = keyed.groupBy(*key).agg(*[F.first(c).alias(c) for c in COLUMNS[:-1]], F.min("n_chars").alias("n_chars"))  # equal rows, put together within tasks
    return once.join(first, key, "left_semi").select(*COLUMNS)  # by columns, not a struct: its cast to the other side's nullability would shuffle the texts again


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of what was found."""
    model = secrets.infer(common.session(spark) and docs, "doc_id", "text")
    found = secrets.scan(docs, model, F.struct(*COLUMNS), F.col("text"))
    hit = F.size("found") > 0
    text = F.when(hit, secrets.redacted(F.col("row.text"), F.col("found"))).otherwise(F.col("row.text"))
    return found.select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.when(hit, F.length(text).cast("bigint")).otherwise(F.col("row.n_chars")).alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: whole documents as often as whole epochs do, and the first words of those that a budget cuts."""
    keyed = docs.select(*COLUMNS).withColumn("h", F.xxhash64("text"))
    same = Window.partitionBy("doc_id", "source", "h")
    taken = mix.mix(keyed, carry=("h",)).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("h").alias("g"), "size", "taken")
    taken = taken.withColumn("m", F.row_number().over(Window.partitionBy("i", "s", "g").orderBy(F.desc("taken"))))
    keyed = keyed.withColumn("n", F.row_number().over(same.orderBy("n_chars")))
    on = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("g")) & (F.col("n") == F.col("m"))
    parts = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.floor(F.col("taken") / F.col("size")).cast("int")), F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(F.array().cast("array<bigint>")))
    rows = keyed.join(taken, on).withColumn("words", F.explode(parts))
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each with the white space before it
    text = F.when(F.col("words") > 0, F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("words") > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, their byte offsets, and the text that the ids decode to, of every document."""
    return bpe.encode(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), decoded=True)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixed_sources),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: Language models, automata and merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents`; what a stage keeps is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
