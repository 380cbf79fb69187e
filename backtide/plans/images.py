"""Traces of rows with their images, which a judge lets pass or stops.

A judge may be slow and dear (a remote model), so it is asked once for each distinct payload, whatever level, trace or
run it comes from: its decisions lie in a memo table, keyed by the digest of the payload and of the judge's name.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backtide.operators.selection import one_read_per_row
from backtide.operators.taint import judge_batches
from backtide.operators.versions import ROW, as_of, crowded
from backtide.session import discard, materialise

_MEMO = "digest string, tainted boolean"


def image_text(cells: Column) -> Column:
    """JSON text of a row image, a map of column to JSON text, with its columns in order."""
    quoted = lambda name: F.regexp_extract(F.to_json(F.struct(name.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    parts = F.transform(F.array_sort(F.map_entries(cells)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def read_memo(spark: SparkSession, path: str) -> DataFrame:
    """(digest, tainted) of a memo table; empty if there is none yet. A digest judged twice has its first decision."""
    try:
        memo = spark.read.schema(_MEMO).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        memo = spark.createDataFrame([], _MEMO)
    return memo.groupBy("digest").agg(F.min("tainted").alias("tainted"))


def judge_once(candidates: DataFrame, payload: list[str], judge: Callable[[pd.DataFrame], list[bool]], memo: str, name: str, batch_size: int = 40) -> DataFrame:
    """candidates with `tainted`. The judge sees the payload columns of each distinct digest that the memo table at the
    path `memo` does not have, and its decisions are added there. Several searches may share a memo."""
    spark = candidates.sparkSession
    digest = F.sha2(F.concat_ws("\x1f", F.lit(name), F.to_json(F.struct(*payload))), 256)
    keyed = materialise(candidates.withColumn("digest", digest), "judged")
    unseen = keyed.select("digest", *payload).dropDuplicates(["digest"]).join(read_memo(spark, memo), "digest", "left_anti")
    judge_batches(unseen, ["digest", *payload], judge, batch_size).select("digest", "tainted").write.mode("append").parquet(memo)
    return keyed.join(read_memo(spark, memo), "digest").drop("digest")


def image_links(reads: DataFrame, images: DataFrame, *, latest: bool = False) -> DataFrame:
    """(child, tbn, pk, parent, event, read_time, write_time, row): each request's earliest (or latest) read of a row and
    the last write of it not after, by another request, with the row as it was written. images: (rid, tbn, pk, event,
    time, line, cells map<string,string> of JSON text)."""
    history = images.select("rid", *ROW, "event", "time", "line", image_text(F.col("cells")).alias("row"))
    found = as_of(one_read_per_row(reads, latest).select("rid", *ROW, "time", "seq"), history, ROW, "time", "time", inclusive=True, tie=("line",), hot=crowded(ROW, reads, history))
    out = found.filter("found is not null and found.rid <> rid")
    return out.select(F.col("rid").alias("child"), *ROW, F.col("found.rid").alias("parent"), "found.event", F.col("time").alias("read_time"), F.col("found.time").alias("write_time"), "found.row")


def image_trace(reads: DataFrame, images: DataFrame, root: DataFrame, judge: Callable[[pd.DataFrame], list[bool]], memo: str, *, name: str = "judge", attack: str = "", latest: bool = False) -> tuple[DataFrame, DataFrame]:
    """((rid, level) of the requests reached, links with `tainted`) of a trace that follows only what the judge finds
    tainted. Links that it does not are kept beside, as reads that were checked and pruned.

    Each level asks the judge for the links of its requests at once. A payload is the root, the attack, the child, the row
    and its image, and both times."""
    links = materialise(image_links(reads, images, latest=latest), "image-links")
    start = root.select("rid").distinct()
    payload = ["root", "attack", "child", "tbn", "pk", "parent", "event", "read_time", "write_time", "row"]
    first = F.lit(start.first()["rid"]) if not start.isEmpty() else F.lit("")
    frontier = materialise(start.withColumn("level", F.lit(0)), "image-frontier")
    visited, judged, level = frontier, [], 0
    while not frontier.isEmpty():
        level += 1
        asked = links.join(frontier.select(F.col("rid").alias("child")), "child").withColumn("root", first).withColumn("attack", F.lit(attack))
        found = materialise(judge_once(asked, payload, judge, memo, name).drop("root", "attack"), "image-judged")
        judged.append(found)
        new = found.filter("tainted").select(F.col("parent").alias("rid")).distinct().join(visited, "rid", "left_anti")
        frontier = materialise(new.withColumn("level", F.lit(level)), "image-frontier")
        visited = visited.unionByName(frontier)
    shown = judged[0] if judged else links.limit(0).withColumn("tainted", F.lit(True))
    for part in judged[1:]:
        shown = shown.unionByName(part)
    discard(links)
    return visited, shown
