"""Noise policies learned from benign traffic: coverage, balance, fan-out and amplification of tables and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtide.functions.normalize import path_template
from backtide.session import discard, materialise

from .selection import one_read_per_row, sample_evenly
from .versions import ROW, as_of, crowded

#: Fixed values of the policy: floors of the learned thresholds, constants, and the guard on writer spread.
FLOORS = {"tc": 0.2, "te": 0.3, "re": 0.3}
CONSTANTS = {"rc": 0.2, "am": 3.0, "wf": 3.0}
WRITE_GUARD = 0.1


def endpoints(requests: DataFrame) -> DataFrame:
    """(rid, endpoint): method and path template."""
    return requests.select("rid", F.concat_ws(" ", F.upper("method"), path_template(F.col("path"))).alias("endpoint"))


def _accesses(reads: DataFrame, writes: DataFrame, ends: DataFrame) -> DataFrame:
    """Reads and writes (one per row) of known requests, with their endpoint."""
    both = reads.select("rid", *ROW, F.lit(False).alias("is_write")).union(writes.select("rid", *ROW, F.lit(True).alias("is_write")))
    return both.join(ends, "rid")


def table_metrics(reads: DataFrame, writes: DataFrame, requests: DataFrame) -> DataFrame:
    ends = endpoints(requests)
    size = ends.agg(F.count_distinct("rid").alias("n"), F.count_distinct("endpoint").alias("m"))
    read, wrote = F.when(~F.col("is_write"), F.col("rid")), F.when(F.col("is_write"), F.col("rid"))
    grouped = _accesses(reads, writes, ends).groupBy("tbn").agg(
        F.count_distinct("rid").alias("request_count"), F.count_distinct("endpoint").alias("endpoint_count"), F.count_distinct(read).alias("nr"), F.count_distinct(wrote).alias("nw")
    )
    return grouped.join(F.broadcast(size)).select(
        "tbn", "request_count", "endpoint_count", F.col("nw").alias("write_request_count"),
        (F.col("request_count") / F.col("n")).alias("request_coverage"), (F.col("endpoint_count") / F.greatest("m", F.lit(1))).alias("endpoint_coverage"),
        (F.least("nr", "nw") / F.greatest("nr", "nw", F.lit(1))).alias("rw_balance"), (F.col("nw") / F.col("n")).alias("write_request_coverage"),
    )


def row_metrics(reads: DataFrame, writes: DataFrame, requests: DataFrame) -> DataFrame:
    ends = endpoints(requests)
    size = ends.agg(F.count_distinct("rid").alias("n"), F.count_distinct("endpoint").alias("m"))
    grouped = _accesses(reads, writes, ends).groupBy(*ROW).agg(
        F.count_distinct("rid").alias("request_count"), F.count_distinct("endpoint").alias("endpoint_count"), F.count_distinct(F.when(F.col("is_write"), F.col("rid"))).alias("write_fanout")
    )
    return grouped.join(F.broadcast(size)).select(
        *ROW, "request_count", "endpoint_count", "write_fanout",
        (F.col("request_count") / F.col("n")).alias("request_coverage"), (F.col("endpoint_count") / F.greatest("m", F.lit(1))).alias("endpoint_coverage"),
    )


def write_fanout(writes: DataFrame, requests: DataFrame) -> DataFrame:
    """(tbn, pk, write_fanout) as row_metrics() has it, of written rows: reads and endpoints are not looked at."""
    known = writes.select("rid", *ROW).join(requests.select("rid"), "rid", "left_semi")
    return known.groupBy(*ROW).agg(F.count_distinct("rid").alias("write_fanout"))


def thresholds(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """One row tc, te, rc, re, am, wf: exact 90th percentiles with floors, or constants. No tables or rows: the floors."""
    p90 = lambda c: F.coalesce(F.percentile(c, 0.9), F.lit(0.0))
    of_tables = tables.agg(F.greatest(p90("request_coverage"), F.lit(FLOORS["tc"])).alias("tc"), F.greatest(p90("endpoint_coverage"), F.lit(FLOORS["te"])).alias("te"))
    of_rows = rows.agg(F.greatest(p90("endpoint_coverage"), F.lit(FLOORS["re"])).alias("re"))
    return of_tables.join(F.broadcast(of_rows)).withColumns({k: F.lit(v) for k, v in CONSTANTS.items()})


def _capped(value: str, limit: str) -> Column:
    return F.least(F.col(value) / F.col(limit), F.lit(1.0))


def classify_tables(tables: DataFrame, limits: DataFrame) -> DataFrame:
    """tables (with amplification) with noise_score and block."""
    high = (F.col("request_coverage") >= F.col("tc")) & (F.col("endpoint_coverage") >= F.col("te")) & (F.col("amplification") >= F.col("am")) & (F.col("rw_balance") > 0)
    score = (_capped("request_coverage", "tc") + _capped("endpoint_coverage", "te") + _capped("amplification", "am") + F.least(F.col("rw_balance") * 2, F.lit(1.0))) / 4
    scored = tables.join(F.broadcast(limits))
    return scored.select(*tables.columns, score.alias("noise_score"), (high & (F.col("write_request_coverage") < WRITE_GUARD)).alias("block"))


def classify_rows(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with noise_score and verdict: block, gray or keep."""
    block = (F.col("request_coverage") >= F.col("rc")) & (F.col("endpoint_coverage") >= F.col("re"))
    score = (_capped("request_coverage", "rc") + _capped("endpoint_coverage", "re")) / 2
    verdict = F.when(block, "block").when(F.col("write_fanout") >= F.col("wf"), "gray").otherwise("keep")
    return rows.join(F.broadcast(limits)).select(*rows.columns, score.alias("noise_score"), verdict.alias("verdict"))


def decide(rows: DataFrame, tables: DataFrame, classified: DataFrame) -> DataFrame:
    """(tbn, pk, decision) of rows: gray if the row is blocked or gray or its table blocked, else keep."""
    noisy_rows = classified.filter("verdict <> 'keep'").select(*ROW, F.lit(True).alias("by_row")).distinct()
    noisy_tables = tables.filter("block").select("tbn", F.lit(True).alias("by_table")).distinct()
    both = rows.select(*ROW).distinct().join(noisy_rows, list(ROW), "left").join(noisy_tables, "tbn", "left")
    return both.select(*ROW, F.when(F.coalesce("by_row", "by_table", F.lit(False)), "gray").otherwise("keep").alias("decision"))


def row_links(reads: DataFrame, row_writes: DataFrame) -> DataFrame:
    """Row generation: each request's earliest read of a row, and the last write of that row not after it. Deletes are
    ordinary writes here; self links are left out. (child, tbn, pk, parent, read_time, write_time)."""
    history = row_writes.select(*ROW, "rid", "time", "line")
    found = as_of(one_read_per_row(reads).select("rid", *ROW, "time", "seq"), history, ROW, "time", "time", inclusive=True, tie=("line",), hot=crowded(ROW, reads, history))
    out = found.filter("found is not null").select(F.col("rid").alias("child"), *ROW, F.col("found.rid").alias("parent"), F.col("time").alias("read_time"), F.col("found.time").alias("write_time"))
    return out.filter("child <> parent")


#: Searches that one long tells apart, and blocked tables that one call may try.
BITS, MOST_TABLES = 62, 10_000


def trace_sizes(links: DataFrame, roots: DataFrame, depth: int = 4, tables: DataFrame | None = None) -> DataFrame:
    """(blocked, rid, size): nodes (other requests and rows) of bounded traces from each root, without a blocked table
    ('' for none).

    All are searched in one loop with one row for each root and request, whatever the number of tables: which of the
    searches have come to it is kept as bits of longs, and a link passes on all but that of its own table. More than
    MOST_TABLES tables are an error."""
    names = [""] + sorted(r["tbn"] for r in (tables.select("tbn").distinct().limit(MOST_TABLES + 1).collect() if tables is not None else []))
    if len(names) > MOST_TABLES + 1:
        raise ValueError(f"more than {MOST_TABLES} tables to block")
    words = range(-(-len(names) // BITS))
    bits, own = [f"bits{w}" for w in words], [f"own{w}" for w in words]
    start = materialise(roots.select(F.col("rid").alias("root")).distinct(), "size-roots")
    blocked = [(name, *[1 << i % BITS if w == i // BITS else 0 for w in words]) for i, name in enumerate(names)]
    known = links.sparkSession.createDataFrame(blocked, "tbn string, " + ", ".join(f"{o} long" for o in own))
    edges = links.select("child", "parent", *ROW).distinct().join(known, "tbn", "left").fillna(0, own)
    edges = materialise(edges, "size-edges")
    whole = [F.lit((1 << min(BITS, len(names) - w * BITS)) - 1).cast("long").alias(b) for w, b in zip(words, bits, strict=True)]
    frontier = materialise(start.select("root", F.col("root").alias("rid"), *whole), "size-frontier")
    some = F.greatest(F.lit(0), *[(F.col(b) != 0).cast("int") for b in bits]) > 0
    either = [F.bit_or(b).alias(b) for b in bits]
    visited, levels, used = frontier, [frontier], []
    for _ in range(depth):
        passed = [F.col(b).bitwiseAND(F.bitwise_not(F.col(o))).alias(b) for b, o in zip(bits, own, strict=True)]
        steps = frontier.join(edges, frontier["rid"] == edges["child"]).select("root", "parent", *ROW, *passed).filter(some)
        used.append(materialise(steps.groupBy("root", "parent", *ROW).agg(*either), "size-steps"))
        reached = used[-1].groupBy("root", F.col("parent").alias("rid")).agg(*either)
        seen = visited.groupBy("root", "rid").agg(*[F.bit_or(b).alias(f"seen_{b}") for b in bits])
        fresh = [F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(F.col(f"seen_{b}"), F.lit(0)))).alias(b) for b in bits]
        frontier = materialise(reached.join(seen, ["root", "rid"], "left").select("root", "rid", *fresh).filter(some), "size-frontier")
        levels.append(frontier)
        visited = visited.unionByName(frontier)
    all_used = used[0]
    for part in used[1:]:
        all_used = all_used.unionByName(part)
    named = [F.concat(F.lit("q:"), "parent"), F.concat_ws("\x00", F.lit("d"), *ROW)]
    nodes = all_used.select("root", F.explode(F.array(*named)).alias("node"), *bits).groupBy("root", "node").agg(*either)
    has = lambda i: F.shiftright(F.col(f"bits{i // BITS}"), i % BITS).bitwiseAND(F.lit(1)) == 1
    sizes = nodes.groupBy("root").agg(F.array(*[F.count_if(has(i)) for i in range(len(names))]).alias("sizes"))
    nothing = F.array(*[F.lit(0).cast("long")] * len(names))
    listed = F.arrays_zip(F.array(*map(F.lit, names)).alias("blocked"), F.coalesce("sizes", nothing).alias("size"))
    out = materialise(start.join(sizes, "root", "left").select(F.col("root").alias("rid"), F.explode(listed).alias("s")).select("s.blocked", "rid", "s.size"), "sizes")
    discard(start, edges, *levels, *used)
    return out


def amplification(links: DataFrame, roots: DataFrame, tables: DataFrame, depth: int = 4) -> DataFrame:
    """(tbn, amplification): mean trace size over that without the table, at least 1."""
    means = trace_sizes(links, roots, depth, tables).groupBy("blocked").agg(F.avg("size").alias("mean"))
    base = means.filter("blocked = ''").select(F.col("mean").alias("base"))
    return means.filter("blocked <> ''").join(F.broadcast(base)).select(F.col("blocked").alias("tbn"), (F.col("base") / F.greatest("mean", F.lit(1.0))).alias("amplification"))


def learn(reads: DataFrame, writes: DataFrame, requests: DataFrame, sample_size: int = 128, depth: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified tables, classified rows, thresholds). writes: one row per written row, deletes included. Amplification
    is over sample_size reading requests at even distances in order of time."""
    benign = reads.join(requests.select("rid"), "rid", "left_semi")
    reading = requests.join(benign.select("rid").distinct(), "rid", "left_semi").groupBy("rid").agg(F.min("time").alias("time"))
    roots = sample_evenly(reading.select("rid", F.struct("time", "rid").alias("at")), "at", sample_size).select("rid")
    tables, rows = table_metrics(benign, writes, requests), row_metrics(benign, writes, requests)
    limits = thresholds(tables, rows)
    grown = tables.join(amplification(row_links(benign, writes), roots, tables.select("tbn"), depth), "tbn", "left").fillna(0.0, ["amplification"])
    return classify_tables(grown, limits), classify_rows(rows, limits), limits

