"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of `documents`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtide.llm import bpe, decontaminate, neardup, pii, quality
from backtide.llm.common import stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier predicts to be of class 1; the labels are those of the rows given. Null and
    empty texts are scored as empty ones, null ids and repeated rows each on their own; an empty table gives an empty one;
    other columns of docs are left out."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).filter("quality_predicted = 1").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of 0.8 or more): that of the smallest id. Of rows that repeat an id the
    smallest stays (by text, then the other columns); rows without an id stay. An empty table gives an empty one; texts
    without words are nobody's copies; other columns of docs are left out."""
    kept = neardup.near_duplicates(docs.select("doc_id", "text"), percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.join(kept, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*").select(*COLUMNS)
    return one.union(docs.filter("doc_id is null").select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts and null ids stay, all rows of an id with a passage
    go; an empty table gives an empty one; other columns of docs are left out."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.without_leaks(docs, found).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    marked = stash(pii.with_candidates(docs.select(*COLUMNS)), "candidates")
    clean = pii.redact(pii.find_spans(marked, pii.fit_spans(marked)))
    return clean.withColumn("n_chars", F.when(F.size("pii") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it: one row for each row of docs, null texts as empty ones, with
    the columns named here only."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = docs.select("doc_id", "lang", "source", "text", bpe.round_trip(F.col("text"), path, pattern).alias("coded")).select("*", "coded.ids", "coded.decoded")
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("decodes"),
        "ids",
    )


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: No stage but the decontamination could be put into SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
