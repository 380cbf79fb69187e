"""Every registered query of the engine itself: name -> function of (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from backtide.functions import normalize
from backtide.operators import evaluate, export, policy, priority, resolve, selection, taint
from backtide.operators.versions import CELL, ROW, versions
from backtide.plans import images, search, trace, variants
from backtide.session import materialise, shared_dir
from backtide.sources import logs as sources
from backtide.sources.bridge import Logs, from_events, read_lines, write_lines, written
from backtide.streaming import cdc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _on_logs(use: Callable[[Logs], DataFrame]) -> Query:
    QUERIES[use.__name__] = lambda spark, sf_dir: use(from_events(spark, sf_dir))
    return QUERIES[use.__name__]


def _on_tables(use: Query) -> Query:
    QUERIES[use.__name__] = use
    return use


def _r6(column: str) -> Column:
    return F.round(column, 6).alias(column)


def _row_writes(logs: Logs) -> DataFrame:
    return logs.writes.select("rid", *ROW, "time", "line").union(logs.deletes.select("rid", *ROW, "time", "line"))


def _candidates(logs: Logs) -> DataFrame:
    return resolve.request_candidates(logs.reads, logs.writes, logs.deletes)


def _pairs(logs: Logs) -> DataFrame:
    return materialise(resolve.read_cells(logs.reads, logs.writes).filter("col is not null"), "read-cells")


def _history(logs: Logs, key: str) -> DataFrame:
    """versions(), written once for all that reads them."""
    return materialise(versions(logs.writes, logs.deletes, key), "history")


# Names and values


@_on_tables
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.concat(F.lit(" Public.App."), F.initcap("event_type"), F.lit(" "))
    return events.select("event_id", normalize.table_name(raw).alias("tbn"), normalize.table_name(raw, True).alias("tbn_cased"), normalize.column_name(raw).alias("col"))


@_on_tables
def path_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return pages.select("page_id", normalize.path_template(path).alias("template"))


@_on_tables
def logged_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", normalize.logged_path(F.regexp_replace("url", "^[a-z]+://[^/]*", "")).alias("logged"))


@_on_tables
def identity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    login = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("u"), "user_id"))
    attribute = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("a"), "user_id"))
    cookie = F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("c"), "user_id"))
    return e.select("event_id", normalize.identity(login, attribute, cookie, F.col("event_id").cast("string")).alias("who"))


# Histories


@_on_logs
def typed_runs(logs: Logs) -> DataFrame:
    return versions(logs.writes, logs.deletes).select(*CELL, "xid", "pos", "raw_run", "vtype", "vtext")


@_on_logs
def origin_of_run(logs: Logs) -> DataFrame:
    return versions(logs.writes, logs.deletes).select(*CELL, "xid", F.col("raw_origin.rid").alias("origin_rid"), F.col("raw_origin.pos").alias("origin_pos"))


@_on_logs
def delete_adjusted_origin(logs: Logs) -> DataFrame:
    return versions(logs.writes, logs.deletes, "xid").select(*CELL, "xid", F.col("origin.rid").alias("origin_rid"), F.col("origin.pos").alias("origin_pos"), F.coalesce("next_delete", F.lit(-1)).alias("next_delete"))


@_on_logs
def last_write_per_xid(logs: Logs) -> DataFrame:
    coarse = logs.writes.withColumn("xid", F.expr("xid div 200"))
    history = versions(coarse, logs.deletes.withColumn("xid", F.expr("xid div 200")), "xid")
    return history.filter("is_last_in_xid").select(*CELL, "xid", "line")


@_on_logs
def asof_time_cell(logs: Logs) -> DataFrame:
    found = resolve.resolve_by_time(_pairs(logs), _history(logs, "time"))
    return found.filter("found is not null").select("rid", *CELL, F.col("seq").alias("read_seq"), F.col("found.xid").alias("latest_xid"), F.col("found.rid").alias("latest_rid"), F.col("found.origin.rid").alias("origin_rid"))


@_on_logs
def asof_time_row(logs: Logs) -> DataFrame:
    return policy.row_links(logs.reads, _row_writes(logs)).select("child", *ROW, "parent", F.col("read_time").cast("string").alias("read_time"), F.col("write_time").cast("string").alias("write_time"))


@_on_logs
def asof_xid_low_high(logs: Logs) -> DataFrame:
    found = resolve.snapshot_bounds(_pairs(logs), _history(logs, "xid"))
    return found.select("rid", *CELL, F.col("seq").alias("read_seq"), F.coalesce("low.xid", F.lit(-1)).alias("low_xid"), F.coalesce("high.xid", F.lit(-1)).alias("high_xid"))


@_on_logs
def snapshot_rules(logs: Logs) -> DataFrame:
    ruled = resolve.snapshot_reads(logs.reads, logs.writes, logs.deletes)[0]
    return ruled.groupBy("rule").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@_on_logs
def snapshot_window_writers(logs: Logs) -> DataFrame:
    ruled, history = resolve.snapshot_reads(logs.reads, logs.writes, logs.deletes, written=True)
    return resolve.window_writers(ruled.drop("version"), history).select("rid", *CELL, F.col("seq").alias("read_seq"), F.col("version.xid").alias("writer_xid"), "rule")


@_on_logs
def observed_disambiguation(logs: Logs) -> DataFrame:
    seen = F.when(F.col("read_seq") % 3 == 0, (F.col("read_seq") % 4).cast("string"))
    found = _candidates(logs).withColumn("seen_text", seen).withColumn("seen_type", F.when(seen.isNotNull(), "int"))
    return resolve.match_observed(found).select("rid", *CELL, "read_seq", F.col("version.xid").alias("latest_xid"), "certain", (F.col("rule") == "observed").alias("observed"))


@_on_logs
def request_candidates(logs: Logs) -> DataFrame:
    return _candidates(logs).select("rid", *CELL, "read_seq", F.col("version.xid").alias("latest_xid"), F.col("version.origin_rid").alias("origin_rid"), "certain", "rule")


@_on_logs
def candidate_order(logs: Logs) -> DataFrame:
    return resolve.numbered_candidates(_candidates(logs)).select("rid", "place", *CELL, "read_seq", F.col("version.xid").alias("latest_xid"))


@_on_logs
def unresolved_cells(logs: Logs) -> DataFrame:
    return resolve.unresolved(logs.reads, logs.writes, _candidates(logs))


@_on_logs
def next_alternate(logs: Logs) -> DataFrame:
    found = _candidates(logs).filter("not certain").withColumn("xid", F.col("version.xid"))
    return selection.next_in_ring(found, ["rid", *CELL, "read_seq"], ["xid"], "xid").select("rid", *CELL, "read_seq", "xid", F.coalesce("alternate", F.lit(-1)).alias("alternate"))


# Logs as JSON lines


@_on_tables
def loaded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = sources.read_log(written(read_lines(spark, sf_dir), "read-log"), mode="quarantine")[0]
    seen = F.array_join(F.transform(F.map_entries("seen"), lambda e: F.concat_ws(":", e["key"], e["value"]["vtype"], e["value"]["vtext"])), ",")
    return reads.select("rid", "tbn", "pk", "seq", F.col("time").cast("string").alias("time"), F.coalesce("xmin", F.lit(-1)).alias("xmin"), F.coalesce("xmax", F.lit(-1)).alias("xmax"), F.coalesce(seen, F.lit("")).alias("seen"), "line")


@_on_tables
def loaded_read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_log(written(read_lines(spark, sf_dir), "read-log"), mode="quarantine")[1].select("line", "error")


@_on_tables
def loaded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.write_log(written(write_lines(spark, sf_dir), "write-log"), mode="quarantine")[0].select("rid", *CELL, "op", "vtype", "vtext", "xid", "seq", "line")


@_on_tables
def loaded_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.write_log(written(write_lines(spark, sf_dir), "write-log"), mode="quarantine")[1].select("rid", *ROW, "xid", "seq", "line")


@_on_tables
def loaded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row accesses of records that have an array of keys."""
    return sources.row_accesses(written(read_lines(spark, sf_dir), "read-log"), arrays_only=True, mode="quarantine")[0].select("rid", *ROW, "event", "line")


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = from_events(spark, sf_dir)
    return resolve.resolve_reads(sources.read_log(written(read_lines(spark, sf_dir), "read-log"), mode="quarantine")[0], logs.writes, logs.deletes)


@_on_tables
def observed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of logged reads, some of which tell the values they saw."""
    found = resolve.candidates_of(_observed(spark, sf_dir))
    return found.select("rid", *CELL, "read_seq", F.col("version.xid").alias("latest_xid"), F.col("version.origin_rid").alias("origin_rid"), "certain", "rule")


@_on_tables
def unresolved_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unresolved_reads(_observed(spark, sf_dir)).withColumn("read_time", F.col("read_time").cast("string"))


# Selections


@_on_logs
def earliest_read(logs: Logs) -> DataFrame:
    return selection.one_read_per_row(logs.reads).select("rid", *ROW, "seq")


@_on_logs
def latest_read(logs: Logs) -> DataFrame:
    return selection.one_read_per_row(logs.reads, latest=True).select("rid", *ROW, "seq")


@_on_logs
def even_sample(logs: Logs) -> DataFrame:
    return selection.sample_evenly(logs.reads.select("rid", "seq"), "seq", 16)


@_on_logs
def seed_writers(logs: Logs) -> DataFrame:
    return selection.seed_writers(logs.writes.select(F.concat(F.lit("u"), "pk").alias("rid"), F.col("col").alias("tbn"), "line").withColumn("pk", F.col("line").cast("string")), 20)


@_on_logs
def read_sequence(logs: Logs) -> DataFrame:
    return logs.reads.select("rid", F.col("seq").alias("event"), (F.row_number().over(Window.partitionBy("rid").orderBy("seq")) - 1).cast("long").alias("position"))


@_on_tables
def statement_read_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements, lines as rows: the parts each read, if all lines agree on the status (one snapshot)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    grouped = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("parts"), F.count_distinct("l_linestatus").alias("states"))
    return grouped.filter("states = 1").select("l_orderkey", "parts")


# Features


@_on_logs
def writer_identities(logs: Logs) -> DataFrame:
    return priority.with_identity(logs.writes.select("rid").distinct(), logs.contexts.filter(F.substring("rid", -1, 1) != "3"))


@_on_logs
def writer_diversity(logs: Logs) -> DataFrame:
    return priority.writer_diversity(versions(logs.writes, logs.deletes, "xid"), logs.contexts)


@_on_logs
def read_fanout(logs: Logs) -> DataFrame:
    return priority.read_fanout(logs.reads)


@_on_logs
def history_count(logs: Logs) -> DataFrame:
    return priority.history_count(versions(logs.writes, logs.deletes, "xid"))


@_on_logs
def child_breadth(logs: Logs) -> DataFrame:
    return priority.child_breadth(logs.reads, logs.writes)


def _tasks(logs: Logs) -> tuple[DataFrame, DataFrame]:
    resolved, history = resolve.resolve_with_history(logs.reads, logs.writes, logs.deletes)
    found = resolve.candidates_of(resolved)
    return found, priority.score_tasks(found, history, logs.reads, logs.writes, logs.contexts)


@_on_logs
def task_scores(logs: Logs) -> DataFrame:
    return _tasks(logs)[1].select("rid", *CELL, "read_seq", "fanout", "diversity", "history", "table_rows", "table_cells", _r6("priority"))


def _search(order: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = from_events(spark, sf_dir)
        found, tasks = _tasks(logs)
        root = logs.root.first()["rid"]
        taken = search.best_first(search.closure_tasks(found, tasks, logs.root), root, order=order, seed=1).taken
        return spark.createDataFrame([(i + 1, t["rid"], t["tbn"], t["pk"], t["col"], t["read_seq"]) for i, t in enumerate(taken)], "rank int, rid string, tbn string, pk string, col string, read_seq long")

    return run


QUERIES |= {"priority_trace": _search("priority"), "fifo_trace": _search("fifo"), "random_trace": _search("random")}


# Policies


def _learned(logs: Logs) -> tuple[DataFrame, DataFrame, DataFrame]:
    tables, rows = policy.table_metrics(logs.reads, _row_writes(logs), logs.requests), policy.row_metrics(logs.reads, _row_writes(logs), logs.requests)
    return tables, rows, policy.thresholds(tables, rows)


@_on_logs
def table_metrics(logs: Logs) -> DataFrame:
    return _learned(logs)[0].select("tbn", "request_count", "endpoint_count", "write_request_count", *map(_r6, ("request_coverage", "endpoint_coverage", "rw_balance", "write_request_coverage")))


@_on_logs
def row_metrics(logs: Logs) -> DataFrame:
    return _learned(logs)[1].select(*ROW, "request_count", "endpoint_count", "write_fanout", *map(_r6, ("request_coverage", "endpoint_coverage")))


@_on_logs
def thresholds(logs: Logs) -> DataFrame:
    return _learned(logs)[2].select(*map(_r6, ("tc", "te", "rc", "re", "am", "wf")))


def _classified(logs: Logs) -> tuple[DataFrame, DataFrame]:
    return policy.learn(logs.reads, _row_writes(logs), logs.requests)[:2]


@_on_logs
def classify_tables(logs: Logs) -> DataFrame:
    return _classified(logs)[0].select("tbn", "block", _r6("noise_score"))


@_on_logs
def classify_rows(logs: Logs) -> DataFrame:
    _, rows, limits = _learned(logs)
    return policy.classify_rows(rows, limits).select(*ROW, "verdict", _r6("noise_score"))


@_on_logs
def policy_decide(logs: Logs) -> DataFrame:
    tables, rows = _classified(logs)
    return policy.decide(logs.reads, tables, rows)


def _size_roots(logs: Logs) -> DataFrame:
    return logs.reads.select("rid").distinct()


@_on_logs
def trace_size_d4(logs: Logs) -> DataFrame:
    return policy.trace_sizes(policy.row_links(logs.reads, _row_writes(logs)), _size_roots(logs)).select("rid", F.col("size").cast("long").alias("size"))


@_on_logs
def amplification(logs: Logs) -> DataFrame:
    links = policy.row_links(logs.reads, _row_writes(logs))
    return policy.amplification(links, _size_roots(logs), logs.reads.select("tbn").distinct()).select("tbn", _r6("amplification"))


# Traces


def _trace(logs: Logs, **how) -> tuple[DataFrame, DataFrame]:
    return trace.trace(trace.links(_candidates(logs)), logs.root, **how)


def _link_columns(links: DataFrame) -> DataFrame:
    return links.select("child", *CELL, "parent", "latest", "certain", "read_seq")


@_on_logs
def basic_trace_links(logs: Logs) -> DataFrame:
    return _link_columns(_trace(logs)[1])


@_on_logs
def basic_trace_requests(logs: Logs) -> DataFrame:
    return _trace(logs)[0].select("rid")


def _gray(logs: Logs) -> DataFrame:
    return policy.write_fanout(_row_writes(logs), logs.requests).filter("write_fanout >= 7").select(*ROW, F.lit(True).alias("gray"))


@_on_logs
def pruned_trace_links(logs: Logs) -> DataFrame:
    return _link_columns(_trace(logs, policy=_gray(logs))[1])


@_on_logs
def taint_trace(logs: Logs) -> DataFrame:
    return _link_columns(_trace(logs, tainted=F.col("value") != "0")[1])


def _row_edges(logs: Logs) -> DataFrame:
    return policy.row_links(logs.reads, _row_writes(logs)).withColumn("certain", F.lit(True))


@_on_logs
def row_trace_links(logs: Logs) -> DataFrame:
    return trace.trace(_row_edges(logs), logs.root)[1].select("child", *ROW, "parent")


@_on_logs
def row_pruned_trace(logs: Logs) -> DataFrame:
    links = _row_edges(logs)
    bulk = selection.seed_writers(_row_writes(logs), 3).select(F.col("rid").alias("parent"))
    return trace.trace(links.join(bulk, "parent", "left_anti"), logs.root, policy=_gray(logs))[1].select("child", *ROW, "parent")


@_on_logs
def simple_paths_bounded(logs: Logs) -> DataFrame:
    edges = trace.links(_candidates(logs)).filter("certain")
    return trace.simple_paths(edges, logs.root, 4).select(F.array_join("path", ">").alias("path"))


@_on_logs
def cycle_paths(logs: Logs) -> DataFrame:
    """Paths of certain links with how each ends; those that return to a request show it."""
    found = trace.paths_with_ends(trace.links(_candidates(logs)).filter("certain"), logs.root, 3)
    return found.select(F.array_join("path", ">").alias("path"), "ended")


@_on_logs
def predecessor_requests(logs: Logs) -> DataFrame:
    return trace.predecessors(trace.links(_candidates(logs)).filter("certain").select("child", "parent"), logs.root)


@_on_logs
def image_trace_links(logs: Logs) -> DataFrame:
    """A trace over row images that follows rows without a zero; each image is judged once."""
    cells = F.create_map("col", "vtext")
    gone = logs.deletes.select("rid", *ROW, F.lit("delete").alias("event"), "time", "line", F.create_map().cast("map<string,string>").alias("cells"))
    rows = logs.writes.select("rid", *ROW, F.col("op").alias("event"), "time", "line", cells.alias("cells")).unionByName(gone)
    memo = f"{shared_dir(logs.reads.sparkSession)}/memo-{uuid.uuid4().hex}"
    _, found = images.image_trace(logs.reads, rows, logs.root, lambda batch: [": 0}" not in row for row in batch["row"]], memo)
    return found.select("child", *ROW, "parent", "event", "row", "tainted")


@_on_logs
def collapsed_dag(logs: Logs) -> DataFrame:
    return evaluate.collapsed_dag(_trace(logs)[1])


@_on_logs
def graph_counts(logs: Logs) -> DataFrame:
    return evaluate.graph_counts(_trace(logs)[1])


# Policies against each other


def _variant_policy(logs: Logs) -> tuple[DataFrame, DataFrame]:
    """Tables of high coverage are blocked, rows of many writers blocked or gray: a policy with all kinds of rules."""
    tables, rows, limits = _learned(logs)
    tables = tables.join(F.broadcast(limits.select("tc"))).withColumn("block", F.col("request_coverage") >= F.col("tc"))
    return tables, rows.withColumn("verdict", F.when(F.col("write_fanout") >= 9, "block").when(F.col("write_fanout") >= 6, "gray").otherwise("keep"))


def _variant_columns(scored: DataFrame) -> DataFrame:
    return scored.select("variant", "tp", "fp", "fn", *map(_r6, ("precision", "recall", "f1")), "links", "uncertain_no_recurse", "gray_no_recurse")


def _variants(logs: Logs, table_masks: DataFrame, row_masks: DataFrame, names: list[str]) -> DataFrame:
    found = variants.trace_variants(trace.links(_candidates(logs)), logs.root, table_masks, row_masks, len(names))
    return _variant_columns(variants.variant_scores(*found, logs.root, logs.gold, names))


@_on_logs
def ablation(logs: Logs) -> DataFrame:
    return _variants(logs, *variants.ablation_masks(*_variant_policy(logs)), list(variants.ABLATION))


@_on_logs
def sensitivity(logs: Logs) -> DataFrame:
    """All parameter variants of a policy, one at a time and in pairs, over the same metrics."""
    scan = variants.scan_parameters()
    tables, rows, _ = _learned(logs)
    grown = tables.join(policy.amplification(policy.row_links(logs.reads, _row_writes(logs)), _size_roots(logs), tables.select("tbn")), "tbn", "left").fillna(0.0, ["amplification"])
    tables, rows = materialise(grown, "table-metrics"), materialise(rows, "row-metrics")
    return _variants(logs, *variants.parameter_masks(tables, rows, list(scan.values())), list(scan))


def _raw_and_pruned(logs: Logs) -> tuple[DataFrame, DataFrame, DataFrame]:
    links = materialise(policy.row_links(logs.reads, _row_writes(logs)), "row-links")
    return variants.raw_against_pruned(links.select("child", *ROW, "parent"), logs.root, _gray(logs), selection.seed_writers(_row_writes(logs), 3))


@_on_logs
def raw_against_pruned(logs: Logs) -> DataFrame:
    sizes = _raw_and_pruned(logs)[0]
    return sizes.withColumn("graph_reduction", F.round("graph_reduction", 6))


@_on_logs
def raw_only_links(logs: Logs) -> DataFrame:
    return _raw_and_pruned(logs)[2]


@_on_logs
def suppressed_examples(logs: Logs) -> DataFrame:
    return variants.suppressed_examples(_raw_and_pruned(logs)[1])


@_on_logs
def suppression_ledger(logs: Logs) -> DataFrame:
    return variants.suppression_ledger(_trace(logs, policy=_gray(logs))[1], logs.root)


# Judgement and evaluation


@_on_tables
def taint_markers_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", taint.judge_cell_text(F.col("html")).alias("t"))
    return judged.select("page_id", "t.tainted", "t.confidence", F.array_join("t.evidence", ",").alias("evidence"))


@_on_tables
def taint_markers_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", taint.judge_row_text(F.col("text")).alias("t"))
    return judged.select("doc_id", "t.tainted", "t.confidence", F.array_join("t.evidence", ",").alias("evidence"))


@_on_tables
def llm_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"))
    return taint.judge_batches(pages, ["scheme"], lambda batch: [s == "http" for s in batch["scheme"]])


def _compared(logs: Logs) -> DataFrame:
    return evaluate.compare_sets(_trace(logs)[0], logs.gold)


@_on_logs
def precision_recall_f1(logs: Logs) -> DataFrame:
    return evaluate.scores(_compared(logs)).select("tp", "fp", "fn", *map(_r6, ("precision", "recall", "f1")))


@_on_logs
def missing_extra(logs: Logs) -> DataFrame:
    return _compared(logs)


@_on_tables
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good, clean = labels.filter("quality = 1"), labels.filter("toxic = 0")
    return evaluate.scores(evaluate.compare_sets(good, clean, "doc_id")).select("tp", "fp", "fn", *map(_r6, ("precision", "recall", "f1")))


def _curve(logs: Logs) -> DataFrame:
    ranked = logs.requests.select("rid", (F.substring("rid", 2, 20).cast("long") + 1).alias("rank"))
    return evaluate.budget_curve(ranked, logs.gold, evaluate.whole_budgets(ranked, logs.gold))


@_on_logs
def budget_curve(logs: Logs) -> DataFrame:
    return _curve(logs).select("budget", "predicted", "tp", *map(_r6, ("precision", "recall", "f1")))


@_on_logs
def budget_auc(logs: Logs) -> DataFrame:
    return evaluate.curve_area(_curve(logs), "budget", "recall").select(_r6("area"))


@_on_tables
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("score"), F.count("*").alias("n"))
    return evaluate.summarise_runs(runs, "score", "n").select(*[F.round(c, 3).alias(c) for c in ("macro", "median", "weighted", "deviation")])


@_on_tables
def strategy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs: how many orders until the last closed one, against that until the last open one."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(F.col("o_orderstatus").isin("F", "O"))
    placed = orders.withColumn("budget", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).withColumn("total", F.count("*").over(Window.partitionBy("o_custkey")))
    runs = placed.groupBy(F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("strategy")).agg(F.max("budget").alias("budget"), F.max("total").alias("total"))
    return evaluate.compare_strategies(runs, "F", "O").select("first_wins", "ties", "second_wins", _r6("macro_delta"), _r6("weighted_reduction"))


@_on_logs
def request_times(logs: Logs) -> DataFrame:
    return export.request_times(policy.row_links(logs.reads, _row_writes(logs))).select("rid", F.col("time").cast("string").alias("time"))


@_on_logs
def policy_profile(logs: Logs) -> DataFrame:
    return export.policy_profile(logs.reads, _row_writes(logs), logs.requests)


# Change streams

_TABLES = {"public.t0": "id", "public.t1": "id", "public.t2": "id"}


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events are a transaction: a message, then a change for each event, written as the replication stream would."""
    text = (
        "format_string('{\"kind\":\"%s\",\"schema\":\"public\",\"table\":\"t%d\",\"columnnames\":[\"id\",\"v\"],\"columnvalues\":[%d,%d],"
        "\"oldkeys\":{\"keynames\":[\"id\",\"v\"],\"keyvalues\":[%d,%d]}}', case event_type when 'signup' then 'insert' when 'error' then 'delete' else 'update' end, "
        "event_id % 4, user_id, cast(floor(value) as int) % 3, if(event_id % 11 = 0, user_id + 1, user_id), event_id % 3)"
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(text).alias("change"))
    grouped = events.groupBy(F.expr("event_id div 5").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "change"))), lambda e: e["change"]), ",").alias("changes"))
    message = F.expr("if(n % 7 = 0, '', format_string('{\"kind\":\"message\",\"prefix\":\"request\",\"content\":\"{\\\\\"request_id\\\\\":\\\\\"R%d\\\\\"}\"},', n))")
    return grouped.select(F.concat(F.lit('{"xid":'), F.col("n"), F.lit(',"timestamp":"2024-01-01 00:00:00+00","change":['), message, F.col("changes"), F.lit("]}")).alias("value"))


@_on_tables
def cdc_cell_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = cdc.cell_changes(cdc.parse(_transactions(spark, sf_dir)), _TABLES)
    return changes.select("rid", "xid", "seq", "event", "tbn", "pk", F.array_join(F.transform(F.array_sort(F.map_entries("cells")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("cells"))


@_on_tables
def cdc_row_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.row_changes(cdc.parse(_transactions(spark, sf_dir)), _TABLES).select("rid", "xid", "tbn", "event", F.array_join("pks", ",").alias("pks"))


@_on_tables
def cdc_row_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cdc.row_stream(cdc.parse(_transactions(spark, sf_dir)), _TABLES)
    moves = F.transform("pk_changes", lambda m: F.concat_ws(">", m["before"], m["after"]))
    return found.select("rid", "event", "tbn", F.array_join("pks", ",").alias("pks"), F.array_join(moves, ",").alias("pk_changes"))


@_on_tables
def cdc_table_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cdc.table_changes(cdc.parse(_transactions(spark, sf_dir)), "public.t1", "id")
    return found.select("xid", *[F.array_join(c, ",").alias(f"{c}_ids") for c in ("insert", "update", "delete")])
