"""Traces and policies as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_trace(folder: str, *, kind: str = "parquet", **relations: DataFrame) -> None:
    """Write each relation (links, requests, pruned, unresolved, ...) to a folder of its own."""
    for name, relation in relations.items():
        relation.write.format(kind).mode("overwrite").save(f"{folder}/{name}")


def graph_lines(dag: DataFrame) -> DataFrame:
    """(line) of a DOT graph's edges from evaluate.collapsed_dag; dashed if uncertain."""
    style = F.when(F.col("uncertain"), ", style=dashed").otherwise("")
    quoted = lambda c: F.concat(F.lit('"R:'), F.regexp_replace(c, r'["\\]', "_"), F.lit('"'))
    return dag.select(F.concat(quoted("parent"), F.lit(" -> "), quoted("child"), F.lit(' [label="'), F.regexp_replace("label", '"', "'"), F.lit('"'), style, F.lit("];")).alias("line"))


def policy_document(tables: DataFrame, rows: DataFrame, limits: DataFrame) -> DataFrame:
    """One row (value) with the policy as JSON: blocked tables, blocked and gray rows as table[pk], thresholds."""
    name = F.concat("tbn", F.lit("["), "pk", F.lit("]"))
    listed = rows.agg(
        F.array_sort(F.collect_set(F.when(F.col("verdict") == "block", name))).alias("block_rows"), F.array_sort(F.collect_set(F.when(F.col("verdict") == "gray", name))).alias("gray_rows")
    )
    blocked = tables.agg(F.array_sort(F.collect_set(F.when(F.col("block"), F.col("tbn")))).alias("block_tables"))
    parts = blocked.join(F.broadcast(listed)).join(F.broadcast(limits.select(F.struct("*").alias("thresholds"))))
    return parts.select(F.to_json(F.struct(F.lit(2).alias("schema_version"), "block_tables", "block_rows", "gray_rows", "thresholds")).alias("value"))


def request_times(links: DataFrame) -> DataFrame:
    """(rid, time): the first event of each request in links (child, parent, read_time, write_time), as reader or writer."""
    ends = links.select(F.col("parent").alias("rid"), F.col("write_time").alias("time")).unionByName(links.select(F.col("child").alias("rid"), F.col("read_time").alias("time")))
    return ends.groupBy("rid").agg(F.min("time").alias("time"))


def row_graph_lines(links: DataFrame, root: DataFrame) -> DataFrame:
    """(line) of a row trace's DOT graph, without its frame: a node for each request, with its time and the root marked, and
    for each link a node for the row, an edge from its writer and one to its reader. Lines may be written in any order."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(c, r"([\\\"])", r"\\$1"), "\n", r"\\n")
    quoted = lambda *parts: F.concat(F.lit('"'), *[p if not isinstance(p, str) else F.lit(p) for p in parts], F.lit('"'))
    starts = root.select("rid", F.lit(True).alias("is_root")).distinct()
    nodes = request_times(links).join(starts, "rid", "full")
    shape = F.when(F.col("is_root"), ", shape=doubleoctagon").otherwise(", shape=box")
    stamp = F.coalesce(F.concat(F.lit(r"\n"), F.col("time").cast("string")), F.lit(""))
    requests = nodes.select(F.concat(quoted("R:", escaped(F.col("rid"))), F.lit(" [label="), quoted("R:", escaped(F.col("rid")), stamp), shape, F.lit("];")).alias("line"))
    data = quoted("D:", escaped(F.col("tbn")), "[", escaped(F.col("pk")), "]#", escaped(F.col("child")))
    edges = links.select(F.explode(F.array(
        F.concat(data, F.lit(" [label="), quoted("D:", escaped(F.col("tbn")), "[", escaped(F.col("pk")), "]"), F.lit(", shape=ellipse];")),
        F.concat(quoted("R:", escaped(F.col("parent"))), F.lit(" -> "), data, F.lit(' [label="WRITE"];')),
        F.concat(data, F.lit(" -> "), quoted("R:", escaped(F.col("child"))), F.lit(' [label="READ"];')),
    )).alias("line"))
    return requests.unionByName(edges)


def policy_profile(reads: DataFrame, writes: DataFrame, requests: DataFrame, sampled_roots: int = 128, depth: int = 4) -> DataFrame:
    """One row about the traffic that a policy was learned from."""
    from backtide.operators.policy import endpoints

    ends = endpoints(requests).agg(F.count_distinct("rid").alias("request_count"), F.count_distinct("endpoint").alias("endpoint_template_count"))
    reading = reads.join(requests.select("rid"), "rid", "left_semi")
    counts = reading.agg(F.count("*").alias("read_event_count"), F.least(F.count_distinct("rid"), F.lit(sampled_roots)).alias("sampled_root_count"))
    written = writes.agg(F.count("*").alias("write_event_count"))
    return ends.join(F.broadcast(counts)).join(F.broadcast(written)).withColumn("trace_depth", F.lit(depth))


def write_policy(folder: str, tables: DataFrame, rows: DataFrame, limits: DataFrame, profile: DataFrame) -> None:
    """A policy as files: its document and profile, one line each, and the metrics of all tables and rows as JSON lines, as
    many files as there are tasks, so that no line holds them all."""
    policy_document(tables, rows, limits).write.mode("overwrite").text(f"{folder}/policy")
    write_trace(folder, kind="json", profile=profile, table_metrics=tables, row_metrics=rows)
