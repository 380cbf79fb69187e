"""Contiguous shards of near-equal bytes, cut on global prefix sums that come from per-partition totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash

#: Groups of equal texts up to this share of a shard's bytes are never cut.
WHOLE = 0.1


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the rows of a sorted partition: its number, the row's number, the bytes before the row and those before
    its group of equal texts; -1 for a group that the partition begins with, which may have begun in an earlier one."""
    part, rows, size, last, begun = TaskContext.get().partitionId(), 0, 0, None, -1
    for batch in batches:
        own, n = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False), batch.num_rows
        before = np.cumsum(own) - own + size
        starts = np.empty(n, "i8")
        for i, group in enumerate(batch.column(batch.schema.get_field_index("digest")).to_pylist()):
            if group != last:
                begun, last = (-1 if last is None else int(before[i])), group
            starts[i] = begun
        columns = [*batch.columns, pa.array([part] * n, pa.int32()), pa.array(np.arange(rows, rows + n)), pa.array(before), pa.array(starts)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "row", "before", "begun"])
        rows, size = rows + n, size + int(own.sum())


def shard_by_bytes(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", overhead: int = 16, whole: float = WHOLE) -> DataFrame:
    """Assign every row of docs to one of n_shards contiguous shards of near-equal bytes; equal texts lie together.

    Returns (key, size, text_crc32, shard, slot): size is the text's UTF-8 bytes plus overhead, slot counts the rows of
    a shard from 0. Groups of equal texts are in order of their least key, rows of a group in order of their key. A group
    of `whole` times a shard's bytes at most goes to the shard in which its middle lies; of a larger one, which could not
    be kept whole with near-equal bytes, every row goes to where its own middle lies, so only the groups on the borders
    of shards are cut. A shard's bytes differ from the mean by such a group or one row at most.

    Keys, sizes, checksums and digests are shuffled, never texts: by digest (a group is one row before it is joined), and
    by ranges. A null text has no bytes and equals an empty one; null keys come first; repeated rows and ties each get a
    slot of their own, also when one row repeats very often. An empty table gives an empty one; other columns are left
    out. Keys are kept exactly, whatever their type.
    """
    sized = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"),
    )
    # Written before it is joined: a join of two shuffles is split where a digest is hot, one on top of a grouping is not.
    groups = stash(sized.groupBy("digest").agg(F.min("doc_id").alias("group_key"), F.sum("size").alias("group_bytes")), "groups")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows are dealt by their place in the input, so that no key is one range.
    order = ("group_key", "digest", "doc_id", "tie")
    laid = sized.withColumn("tie", F.monotonically_increasing_id()).join(groups, "digest").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = laid.select("doc_id", "size", "text_crc32", "digest", "group_bytes")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in laid.schema) + ", part int, row long, before long, begun long"
    placed = stash(laid.mapInArrow(_running, schema), "shards")
    drop_stash(groups)

    # One row for each partition: totals, and where the group that it begins with has begun.
    ends = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min_by("digest", "row").alias("first"), F.max_by("digest", "row").alias("last"), F.max("begun").alias("begun"))
    offsets, total, rows, group, start = [], 0, 0, None, 0
    for r in ends.orderBy("part").collect():
        start = start if r["first"] == group else total
        offsets.append((r["part"], total, rows, start))
        group, start = r["last"], start if r["begun"] < 0 else total + r["begun"]
        total, rows = total + r["bytes"], rows + r["rows"]
    table = spark.createDataFrame(offsets, "part int, byte_offset long, row_offset long, group_start long")
    cut = placed.join(F.broadcast(table), "part")
    start = F.when(F.col("begun") < 0, F.col("group_start")).otherwise(F.col("byte_offset") + F.col("begun"))
    twice = F.when(F.col("group_bytes") <= int(whole * total / n_shards), 2 * start + F.col("group_bytes")).otherwise(2 * (F.col("byte_offset") + F.col("before")) + F.col("size"))
    cut = cut.select("doc_id", "size", "text_crc32", twice.alias("twice"), (F.col("row_offset") + F.col("row")).alias("position"))
    cut = cut.withColumn("shard", F.expr(f"cast(least({n_shards - 1}, twice * {n_shards} div {max(1, 2 * total)}) as int)"))
    starts = cut.groupBy("shard").agg(F.min("position").alias("first"))
    return cut.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, *, key: str = "doc_id") -> None:
    """Write the rows of docs into path/shard=N, each shard in key order; keys have to be unique here."""
    laid = docs.join(assigned.select(F.col("doc_id").alias(key), "shard", "slot"), key)
    laid.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
