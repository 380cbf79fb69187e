"""Features and scores of exploration tasks: which cell read is worth looking at first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import read_cells
from .versions import CELL


def with_identity(rids: DataFrame, contexts: DataFrame, rid: str = "rid") -> DataFrame:
    """rids with writer_user and writer_api; without a context each request is its own user with an unknown API."""
    known = contexts.select(F.col("rid").alias(rid), F.col("user_id").alias("writer_user"), F.col("api_id").alias("writer_api"))
    joined = rids.join(known, rid, "left")
    return joined.withColumn("writer_user", F.coalesce("writer_user", F.concat(F.lit("request:"), F.col(rid)))).withColumn("writer_api", F.coalesce("writer_api", F.lit("unknown-api")))


def writer_diversity(history: DataFrame, contexts: DataFrame) -> DataFrame:
    """(cell, diversity): distinct (user, API) among the writes that begin a run of values."""
    origins = history.select(*CELL, F.col("raw_origin.rid").alias("rid")).distinct()
    return with_identity(origins, contexts).groupBy(*CELL).agg(F.count_distinct("writer_user", "writer_api").alias("diversity"))


def read_fanout(reads: DataFrame) -> DataFrame:
    return reads.groupBy("rid").agg(F.count_distinct("tbn", "pk").alias("fanout"))


def history_count(history: DataFrame) -> DataFrame:
    return history.groupBy(*CELL).agg(F.count("*").alias("history"))


def child_breadth(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(rid, tbn, table_rows, table_cells): rows read of a table and known cells in them, at least one each."""
    pairs = read_cells(reads.select("rid", "tbn", "pk").distinct(), writes)
    rows = F.count_distinct("tbn", "pk").alias("table_rows")
    return pairs.groupBy("rid", "tbn").agg(rows, F.greatest(F.count_distinct("tbn", "pk", "col"), F.lit(1)).alias("table_cells"))


def _damp(count: Column) -> Column:
    return 1 / (1 + F.log(1 + count.cast("double")))


def score_tasks(candidates: DataFrame, history: DataFrame, reads: DataFrame, writes: DataFrame, contexts: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """One row for each cell read: its writers, features and priority. alpha and beta sum to 1 and are not negative."""
    if alpha < 0 or beta < 0 or not math.isclose(alpha + beta, 1.0):
        raise ValueError("alpha and beta must not be negative and must sum to 1")
    task = ["rid", *CELL, "read_seq", "read_time"]
    writers = candidates.select(*task, F.col("version.origin_rid").alias("writer"), "certain").distinct()
    fan = read_fanout(reads)
    summed = writers.select(*task, "writer").distinct().join(fan.withColumnRenamed("rid", "writer"), "writer", "left").groupBy(*task).agg(
        F.coalesce(F.sum("fanout"), F.lit(0)).alias("fanout"), F.count("*").alias("writers")
    )
    scored = (
        summed.join(writer_diversity(history, contexts), list(CELL)).join(history_count(history), list(CELL)).join(child_breadth(reads, writes), ["rid", "tbn"])
    )
    most = 1 / (1 + math.log(2))
    two = F.col("table_rows") == 2
    return (
        scored.withColumn("rarity", _damp(F.col("diversity"))).withColumn("cost", _damp(F.col("fanout")))
        .withColumn("base_priority", alpha * F.col("rarity") + beta * F.col("cost"))
        .withColumn("history_penalty", _damp(F.col("history")) / most)
        .withColumn("scan_penalty", F.when(two, 1.0).otherwise(_damp(F.col("table_rows")) / most))
        .withColumn("compactness", F.when(two, 1 + 1 / (1 + F.col("table_cells").cast("double"))).otherwise(1.0))
        .withColumn("priority", F.col("base_priority") * F.col("history_penalty") * F.col("scan_penalty") * F.col("compactness"))
    )
