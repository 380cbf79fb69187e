"""Access logs derived from an event table, so that every operator has data of any size."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtide.session import shared_dir
from backtide.sources.logs import numbered_lines


@dataclass
class Logs:
    """reads (rid tbn pk seq time xmin xmax), writes (rid tbn pk col op vtype vtext time xid seq line), deletes (rid tbn pk time xid
    seq line), contexts (rid user_id api_id), requests (rid time method path), gold (rid), root (rid: one row)."""

    reads: DataFrame
    writes: DataFrame
    deletes: DataFrame
    contexts: DataFrame
    requests: DataFrame
    gold: DataFrame
    root: DataFrame


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .select("event_id", F.col("ts").alias("time"), "user_id", "event_type", "value", k.alias("k"))
        .withColumn("rid", F.concat(F.lit("r"), F.expr("event_id div 5")))
        .withColumn("tbn", F.concat(F.lit("t"), F.col("k") % 4))
        .withColumn("pk", F.col("user_id").cast("string"))
    )


def from_events(spark: SparkSession, sf_dir: str) -> Logs:
    events = _events(spark, sf_dir)
    reads = events.filter(F.col("event_type").isin("view", "click")).select(
        "rid", "tbn", "pk", F.col("event_id").alias("seq"), "time", (F.col("event_id") - F.col("k") % 50 * 20).alias("xmin"), F.col("event_id").alias("xmax")
    )
    writes = events.filter(F.col("event_type").isin("signup", "purchase")).select(
        "rid", "tbn", "pk", F.concat(F.lit("c"), F.col("k") % 3).alias("col"),
        F.when(F.col("event_type") == "signup", "insert").otherwise("update").alias("op"),
        F.lit("int").alias("vtype"), F.floor(F.col("value") / 25).cast("int").cast("string").alias("vtext"),
        "time", F.col("event_id").alias("xid"), F.lit(0).cast("long").alias("seq"), F.col("event_id").alias("line"),
    )
    deletes = events.filter("event_type = 'error' and event_id % 10 = 0").select(
        "rid", "tbn", "pk", "time", F.col("event_id").alias("xid"), F.lit(0).cast("long").alias("seq"), F.col("event_id").alias("line")
    )
    first = F.min_by(F.struct("event_id", "event_type", "user_id", "time"), "event_id").alias("first")
    grouped = events.groupBy("rid").agg(first, F.min("user_id").alias("user_id"))
    contexts = grouped.select("rid", F.concat(F.lit("u"), "user_id").alias("user_id"), F.col("first.event_type").alias("api_id"))
    requests = grouped.select(
        "rid", F.col("first.time").alias("time"), F.when(F.col("first.event_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.concat_ws("/", F.lit(""), F.col("first.event_type"), F.col("first.user_id")).alias("path"),
    )
    gold = requests.select("rid").filter(F.substring("rid", 2, 20).cast("long") % 7 < 3)
    root = reads.agg(F.max_by("rid", "seq").alias("rid"))
    return Logs(reads, writes, deletes, contexts, requests, gold, root)


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): a JSON record for each read, as several loggers write it: keys one or two, ids under two names,
    some without a number or bounds, some with the value they saw, of a column that may be unknown, and some with one
    bound only, which is an error."""
    e = F.col("event_id")
    two, bounds = e % 5 == 0, e % 8 != 1
    record = F.struct(
        F.when(e % 2 == 0, F.col("rid")).alias("rid"), F.when(e % 2 == 1, F.col("rid")).alias("request_id"), F.concat(F.lit("Public."), F.upper("tbn")).alias("tbn"),
        F.col("time").cast("string").alias("time"), F.when(~two, F.col("user_id")).alias("pk"), F.when(two, F.array("user_id", F.col("user_id") + 1)).alias("pks"),
        F.when(e % 3 != 0, e).alias("seq"), F.when(bounds, e - F.col("k") % 50 * 20).alias("xmin"), F.when(bounds & (e % 17 != 0), e).alias("xmax"),
        F.when((e % 4 == 1) & ~two, F.create_map(F.concat(F.lit("C"), F.when(e % 7 == 0, 9).otherwise(F.col("k") % 3)), e % 5)).alias("cells"),
    )
    return _events(spark, sf_dir).filter(F.col("event_type").isin("view", "click")).select("event_id", F.to_json(record).alias("value"))


def write_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): a JSON record for each write of one or two cells, and for each delete of one or two rows; some
    have no number."""
    e, gone = F.col("event_id"), F.col("event_type") == "error"
    cell = lambda name, value: F.struct(name.alias("col"), value.alias("new"))
    first = cell(F.concat(F.lit("C"), F.col("k") % 3), F.floor(F.col("value") / 25).cast("int"))
    second = cell(F.lit("c9"), F.col("user_id").cast("int"))
    record = F.struct(
        "rid", "tbn", F.col("time").cast("string").alias("time"), F.when(gone, "delete").when(F.col("event_type") == "signup", "INSERT").alias("event"),
        F.when(~gone, F.col("pk")).alias("pk"), F.when(gone, F.when(e % 2 == 0, F.array("pk")).otherwise(F.array("pk", F.lit("x")))).alias("pks"), e.alias("xid"),
        F.when(e % 3 == 0, e).alias("seq"), F.when(~gone, F.when(e % 2 == 0, F.array(first)).otherwise(F.array(first, second))).alias("cells"),
    )
    return _events(spark, sf_dir).filter(F.col("event_type").isin("signup", "purchase", "error")).select("event_id", F.to_json(record).alias("value"))


def written(lines: DataFrame, name: str) -> DataFrame:
    """The lines, written as text in order of event_id and read again with their numbers."""
    path = f"{shared_dir(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.orderBy("event_id").select("value").write.text(path)
    return numbered_lines(lines.sparkSession, path)
