"""Earliest and latest reads, even samples, seed writers, window positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from backtide.session import materialise

from .versions import ROW


def one_read_per_row(reads: DataFrame, latest: bool = False) -> DataFrame:
    """Of each request's reads of a row the earliest (first on ties) or the latest (last on ties)."""
    order = [F.desc("time"), F.desc("seq")] if latest else ["time", "seq"]
    return reads.withColumn("_n", F.row_number().over(Window.partitionBy("rid", *ROW).orderBy(*order))).filter("_n = 1").drop("_n")


def sample_evenly(items: DataFrame, order: str, size: int) -> DataFrame:
    """size items at even distances of all items in order (the last one if size is 1); all if there are fewer.

    Positions come from counts of ranges of the order column, so no task holds all items. The ranges are written before
    they are counted: their bounds are sampled anew at each run. Items that are equal in order may come in any order."""
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(items.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "sample-ranges")
    placed = placed.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    counts = [(r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()]
    total, starts = 0, {}
    for part, count in counts:
        starts[part] = total
        total += count
    if total <= size:
        return placed.drop("_part", "_row")
    wanted = [total - 1] if size == 1 else sorted({round(i * (total - 1) / (size - 1)) for i in range(size)})
    bounds = sorted(starts.items(), key=lambda x: x[1])
    picks = []
    for at in wanted:
        part, start = max((b for b in bounds if b[1] <= at), key=lambda b: b[1])
        picks.append((part, at - start + 1))
    chosen = items.sparkSession.createDataFrame(picks, "_part int, _row int")
    return placed.join(F.broadcast(chosen), ["_part", "_row"]).drop("_part", "_row")


def seed_writers(links: DataFrame, threshold: int = 30) -> DataFrame:
    """Writers (rid, rows) that wrote `threshold` rows or more: bulk loads whose links say nothing."""
    return links.groupBy("rid").agg(F.count_distinct(*ROW).alias("rows")).filter(F.col("rows") >= threshold)


def next_in_ring(candidates: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """candidates with `alternate`: the next value of the group in order, the first after the last, null if alone."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = F.coalesce(F.lead(value).over(w), F.first(value).over(whole))
    return candidates.withColumn("alternate", F.when(F.count("*").over(whole) > 1, ring))
