"""Request ids in free text: a client's output, or a drawn graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: an id after a request-id header, an id after an arrow and a status, a request node of a graph.
HEADER = r"(?i)(?:X-Request[-_ ]?Id|Request[-_ ]?Id)\s*[:=]?\s*([A-Za-z0-9][A-Za-z0-9_.:-]{1,})"
ARROW = r"->\s*\d{3}\s+([A-Za-z0-9][A-Za-z0-9_.:-]{1,})"
NODE = r'R:([^"\\\n]+)'


def _usable(value: Column) -> Column:
    low = F.lower(value)
    short = value.rlike("^[0-9]{1,3}$")
    return (value != "") & ~low.isin("none", "null") & ~low.rlike("^(?:x-request|request)") & ~short


def ids_in_output(lines: DataFrame) -> DataFrame:
    """(rid, line, text, is_root) of lines (line, value): each id at the first line that has it; the last new one is the
    root. Header ids of a line come before arrow ids."""
    found = F.concat(F.regexp_extract_all("value", F.lit(HEADER), 1), F.regexp_extract_all("value", F.lit(ARROW), 1))
    rows = lines.select("line", "value", F.posexplode(found).alias("place", "raw")).withColumn("rid", F.regexp_replace("raw", "^[,;)]+|[,;)]+$", ""))
    first = rows.filter(_usable(F.col("rid"))).groupBy("rid").agg(F.min(F.struct("line", "place", "value")).alias("at"))
    last = first.agg(F.max_by("rid", F.struct("at.line", "at.place")).alias("root"))
    return first.join(F.broadcast(last)).select("rid", F.col("at.line").alias("line"), F.col("at.value").alias("text"), (F.col("rid") == F.col("root")).alias("is_root"))


def ids_in_graph(lines: DataFrame) -> DataFrame:
    """Distinct request ids (rid) of a drawn graph's lines, cut at the first #."""
    found = lines.select(F.explode(F.regexp_extract_all("value", F.lit(NODE), 1)).alias("rid"))
    return found.select(F.substring_index("rid", "#", 1).alias("rid")).distinct()


def merge_requests(spark, folder: str) -> DataFrame:
    """All request logs of a folder as one table (rid, time, method, path); records without an id are dropped. An empty
    result is an error."""
    rows = spark.read.schema("rid string, time string, method string, path string").json(f"{folder}/*.jsonl").filter("rid <> ''")
    if rows.isEmpty():
        raise ValueError(f"no requests in {folder}")
    return rows
