"""Many policies in one search: which requests each of them reaches, for ablations and parameter scans.

Policies differ only in the rows they treat as gray, so a link carries the set of variants in which it is gray, and a
request the set of variants that reach it, as bits of longs. One loop of joins then does what a search for each variant
would: a level passes on the bits of its requests but those of gray links, and keeps the bits that are new.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtide.operators.policy import WRITE_GUARD
from backtide.session import discard, materialise

#: Variants of a long.
BITS = 62


@dataclass(frozen=True)
class Parameters:
    """What a policy's classes depend on. The defaults are fixed values."""

    q: float = 0.9
    table_request_floor: float = 0.2
    table_endpoint_floor: float = 0.3
    row_request_threshold: float = 0.2
    row_endpoint_floor: float = 0.3
    amplification_threshold: float = 3.0
    write_fanout_threshold: float = 3.0
    write_request_guard: float = WRITE_GUARD


#: Fixed values of the scan: each parameter on its own, then two pairs together.
ONE_AT_A_TIME = {
    "q": (0.8, 0.85, 0.9, 0.95, 0.99),
    "table_request_floor": (0.1, 0.2, 0.3, 0.5, 0.7),
    "table_endpoint_floor": (0.2, 0.3, 0.4, 0.5, 0.7),
    "row_request_threshold": (0.1, 0.15, 0.2, 0.25, 0.26, 0.28, 0.3),
    "row_endpoint_floor": (0.2, 0.3, 0.4, 0.5),
    "amplification_threshold": (2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0),
    "write_fanout_threshold": (2.0, 3.0, 4.0, 5.0, 10.0, 20.0, 50.0, 100.0),
    "write_request_guard": (0.05, 0.06, 0.07, 0.075, 0.1, 0.15, 0.2, 0.3, 0.34, 0.342, 0.4),
}
TOGETHER = {
    ("amplification_threshold", "write_request_guard"): ((2.0, 3.0, 4.0, 4.5, 5.0), (0.05, 0.075, 0.1, 0.2, 0.35)),
    ("row_request_threshold", "write_fanout_threshold"): ((0.15, 0.2, 0.25, 0.28, 0.3), (2.0, 3.0, 10.0, 50.0, 100.0)),
}

#: Variants of an ablation: which rules of the policy hold (blocked tables, blocked rows, gray rows).
ABLATION = {
    "basic": (False, False, False), "full": (True, True, True), "no_table_block": (False, True, True), "no_row_block": (True, False, True),
    "no_row_gray": (True, True, False), "no_rows": (True, False, False), "table_block_only": (True, False, False),
}


def scan_parameters() -> dict[str, Parameters]:
    """Name -> parameters of a whole scan; names are field=value, comma-joined."""
    single = {f"{name}={value:g}": replace(Parameters(), **{name: value}) for name, values in ONE_AT_A_TIME.items() for value in values}
    joint = {f"{a}={x:g},{b}={y:g}": replace(Parameters(), **{a: x, b: y}) for (a, b), (xs, ys) in TOGETHER.items() for x in xs for y in ys}
    return {"default": Parameters(), **single, **joint}


def masks(conditions: list[Column], name: str = "gray") -> list[Column]:
    """Columns name0, name1, ... with a bit for each condition that holds; null is false."""
    out = []
    for at in range(0, len(conditions), BITS):
        bits = F.lit(0).cast("long")
        for i, condition in enumerate(conditions[at : at + BITS]):
            bits = bits.bitwiseOR(F.when(condition, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        out.append(bits.alias(f"{name}{at // BITS}"))
    return out


def _words(variants: int) -> range:
    return range(-(-variants // BITS))


def ablation_masks(tables: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables tbn, gray...; rows tbn, pk, gray...) for the variants of ABLATION, of classified tables (block) and rows (verdict)."""
    kinds = list(ABLATION.values())
    return (
        tables.select("tbn", *masks([F.col("block") & F.lit(k[0]) for k in kinds])),
        rows.select("tbn", "pk", *masks([((F.col("verdict") == "block") & F.lit(k[1])) | ((F.col("verdict") == "gray") & F.lit(k[2])) for k in kinds])),
    )


def parameter_masks(tables: DataFrame, rows: DataFrame, variants: list[Parameters]) -> tuple[DataFrame, DataFrame]:
    """The same for parameters, of table metrics (with amplification) and row metrics. Percentiles of the metrics are found
    once for each q; no table or row is looked at twice."""
    shares = sorted({v.q for v in variants})
    p = lambda df, column: df.agg(*[F.coalesce(F.percentile(column, q), F.lit(0.0)) for q in shares]).first()
    request, endpoint, row = p(tables, "request_coverage"), p(tables, "endpoint_coverage"), p(rows, "endpoint_coverage")

    def blocked(v: Parameters) -> Column:
        at = shares.index(v.q)
        high = (F.col("request_coverage") >= max(request[at], v.table_request_floor)) & (F.col("endpoint_coverage") >= max(endpoint[at], v.table_endpoint_floor))
        return high & (F.col("amplification") >= v.amplification_threshold) & (F.col("rw_balance") > 0) & (F.col("write_request_coverage") < v.write_request_guard)

    def noisy(v: Parameters) -> Column:
        often = (F.col("request_coverage") >= v.row_request_threshold) & (F.col("endpoint_coverage") >= max(row[shares.index(v.q)], v.row_endpoint_floor))
        return often | (F.col("write_fanout") >= v.write_fanout_threshold)

    return tables.select("tbn", *masks([blocked(v) for v in variants])), rows.select("tbn", "pk", *masks([noisy(v) for v in variants]))


def trace_variants(all_links: DataFrame, root: DataFrame, table_masks: DataFrame, row_masks: DataFrame, variants: int) -> tuple[DataFrame, DataFrame]:
    """((rid, reached...) of the requests that some variant reaches, links with gray... and reached...).

    Uncertain links are shown but not followed, gray ones are followed from the root only. `reached` of a link is that of
    its child: the variants that show it."""
    words = _words(variants)
    grays, reached = [f"gray{i}" for i in words], [f"reached{i}" for i in words]
    links = all_links.join(row_masks, ["tbn", "pk"], "left").join(table_masks.withColumnsRenamed({g: f"table_{g}" for g in grays}), "tbn", "left")
    links = materialise(links.select(*all_links.columns, *[F.coalesce(F.col(g), F.lit(0)).bitwiseOR(F.coalesce(F.col(f"table_{g}"), F.lit(0))).alias(g) for g in grays]), "variant-links")
    edges = materialise(links.filter("certain").groupBy("child", "parent").agg(*[F.bit_and(g).alias(g) for g in grays]), "variant-edges")
    every = [F.lit((1 << min(BITS, variants - i * BITS)) - 1).cast("long").alias(f"reached{i}") for i in words]
    frontier = materialise(root.select("rid").distinct().select("rid", *every), "variant-frontier")
    levels, visited = [frontier], frontier
    while not frontier.isEmpty():
        passed = [F.bit_or(F.col(r).bitwiseAND(F.bitwise_not(F.col(g)) if len(levels) > 1 else F.lit(-1).cast("long"))).alias(f"new{i}") for i, (r, g) in enumerate(zip(reached, grays, strict=True))]
        steps = frontier.join(edges, frontier["rid"] == edges["child"]).groupBy(F.col("parent").alias("to")).agg(*passed)
        fresh = [F.col(f"new{i}").bitwiseAND(F.bitwise_not(F.coalesce(F.col(r), F.lit(0)))).alias(r) for i, r in enumerate(reached)]
        new = steps.join(visited, steps["to"] == visited["rid"], "left").select(F.col("to").alias("rid"), *fresh)
        frontier = materialise(new.filter(F.greatest(F.lit(0), *[(F.col(r) != 0).cast("int") for r in reached]) > 0), "variant-frontier")
        levels.append(frontier)
        after = materialise(visited.unionByName(frontier).groupBy("rid").agg(*[F.bit_or(r).alias(r) for r in reached]), "variant-visited")
        if visited is not levels[0]:
            discard(visited)
        visited = after
    shown = links.join(visited.withColumnRenamed("rid", "child"), "child")
    discard(edges, *levels)
    return visited, shown


def variant_scores(visited: DataFrame, shown: DataFrame, root: DataFrame, gold: DataFrame, names: list[str]) -> DataFrame:
    """(variant, tp, fp, fn, precision, recall, f1, links, uncertain_no_recurse, gray_no_recurse): a variant predicts the
    root and both ends of the certain links that it shows. A link may count under both reasons."""
    words = _words(len(names))
    has = lambda prefix, i: F.shiftright(F.col(f"{prefix}{i // BITS}"), i % BITS).bitwiseAND(F.lit(1)) == 1
    ends = [shown.filter("certain").select(F.col(end).alias("rid"), *[f"reached{i}" for i in words]) for end in ("child", "parent")]
    start = root.select("rid").distinct().join(visited, "rid")
    bits = ends[0].unionByName(ends[1]).unionByName(start).groupBy("rid").agg(*[F.bit_or(f"reached{i}").alias(f"reached{i}") for i in words])
    marked = bits.join(gold.select("rid").distinct().withColumn("hit", F.lit(True)), "rid", "left")
    # One pass adds up all variants; the sums are a row of some numbers for each variant.
    predicted, hits = [F.count_if(has("reached", i)) for i in range(len(names))], [F.count_if(has("reached", i) & F.col("hit")) for i in range(len(names))]
    found = marked.agg(F.array(*predicted).alias("predicted"), F.array(*hits).alias("tp"))
    shown = shown.join(root.select(F.col("rid").alias("child"), F.lit(True).alias("at_root")).distinct(), "child", "left")
    kinds = {"links": F.lit(True), "uncertain_no_recurse": ~F.col("certain")}
    sums = [F.array(*[F.count_if(has("reached", i) & c) for i in range(len(names))]).alias(k) for k, c in kinds.items()]
    gray = F.array(*[F.count_if(has("reached", i) & has("gray", i) & F.col("at_root").isNull()) for i in range(len(names))]).alias("gray_no_recurse")
    whole = found.join(F.broadcast(shown.agg(*sums, gray))).join(F.broadcast(gold.agg(F.count_distinct("rid").alias("gold"))))
    listed = F.arrays_zip(F.array(*map(F.lit, names)).alias("variant"), "predicted", "tp", *kinds, "gray_no_recurse")
    rows = whole.select(F.explode(listed).alias("v"), "gold").select("v.*", "gold")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("gold") - F.col("tp")).withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("gold")))
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return rows.select("variant", "tp", "fp", "fn", "precision", "recall", "f1", "links", "uncertain_no_recurse", "gray_no_recurse")


#: Examples of suppressed links for each reason. A fixed value.
EXAMPLES = 20
_RAW, _PRUNED = 0, 1


def raw_against_pruned(links: DataFrame, root: DataFrame, policy: DataFrame, bulk: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, suppressed, differences) of a row trace without and with a policy, both searched in one loop.

    links: (child, tbn, pk, parent); policy: (tbn, pk) of its gray rows, which are shown but followed from the root only;
    bulk: (rid) of writers whose links are left out of both, and counted. sizes: one row raw_requests, raw_links,
    pruned_requests, pruned_links, graph_reduction, context_only, bulk_suppressed, where requests are the root and both
    ends of links. suppressed: (child, tbn, pk, parent, reason) of the pruned trace, bulk-writer or gray-no-recurse.
    differences: the links that only the raw trace has.
    """
    kept = links.join(bulk.select(F.col("rid").alias("parent")).distinct(), "parent", "left_anti").withColumn("certain", F.lit(True))
    gray = policy.select("tbn", "pk").distinct().select("tbn", "pk", F.lit(1 << _PRUNED).cast("long").alias("gray0"))
    no_tables = links.sparkSession.createDataFrame([], "tbn string, gray0 long")
    visited, shown = trace_variants(kept, root, no_tables, gray, 2)
    in_raw, in_pruned, is_gray = (F.shiftright(F.col(c), i).bitwiseAND(F.lit(1)) == 1 for c, i in (("reached0", _RAW), ("reached0", _PRUNED), ("gray0", _PRUNED)))
    starts = root.select(F.col("rid").alias("child"), F.lit(True).alias("at_root")).distinct()
    shown = shown.join(starts, "child", "left").withColumn("context", is_gray & F.col("at_root").isNull())
    dropped = links.join(bulk.select(F.col("rid").alias("parent")).distinct(), "parent", "left_semi").join(visited.withColumnRenamed("rid", "child"), "child")
    dropped = dropped.filter(in_pruned).select("child", "tbn", "pk", "parent", F.lit("bulk-writer").alias("reason"))
    suppressed = dropped.unionByName(shown.filter(in_pruned & F.col("context")).select("child", "tbn", "pk", "parent", F.lit("gray-no-recurse").alias("reason")))
    ends = shown.select(F.explode(F.array("child", "parent")).alias("rid"), "reached0").unionByName(root.select("rid").distinct().withColumn("reached0", F.lit(3).cast("long")))
    requests = ends.groupBy("rid").agg(F.bit_or("reached0").alias("reached0")).agg(F.count_if(in_raw).alias("raw_requests"), F.count_if(in_pruned).alias("pruned_requests"))
    counted = shown.agg(F.count_if(in_raw).alias("raw_links"), F.count_if(in_pruned).alias("pruned_links"), F.count_if(in_pruned & F.col("context")).alias("context_only"))
    sizes = requests.join(F.broadcast(counted)).join(F.broadcast(dropped.agg(F.count("*").alias("bulk_suppressed"))))
    whole = F.col("raw_requests") + F.col("raw_links")
    sizes = sizes.select(
        "raw_requests", "raw_links", "pruned_requests", "pruned_links",
        F.when(whole > 0, 1 - (F.col("pruned_requests") + F.col("pruned_links")) / whole).otherwise(0.0).alias("graph_reduction"), "context_only", "bulk_suppressed",
    )
    return sizes, suppressed, shown.filter(in_raw & ~in_pruned).select("child", "tbn", "pk", "parent")


def suppressed_examples(suppressed: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """Up to `most` suppressed links for each reason, the first by child and row: a bounded top-k for each reason in turn,
    never a sort of them all."""
    reasons = [r["reason"] for r in suppressed.select("reason").distinct().collect()]
    parts = [suppressed.filter(F.col("reason") == reason).orderBy("child", "tbn", "pk", "parent").limit(most) for reason in sorted(reasons)]
    out = suppressed.limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out


def suppression_ledger(shown: DataFrame, root: DataFrame) -> DataFrame:
    """(child, tbn, pk, col, parent, uncertain_no_recurse, gray_no_recurse) of a trace's links (with `gray`) that lead no
    further: one row a link with a flag for each reason, as both may hold."""
    starts = root.select(F.col("rid").alias("child"), F.lit(True).alias("at_root")).distinct()
    flagged = shown.join(starts, "child", "left").withColumn("uncertain_no_recurse", ~F.col("certain")).withColumn("gray_no_recurse", F.col("gray") & F.col("at_root").isNull())
    return flagged.filter("uncertain_no_recurse or gray_no_recurse").select("child", "tbn", "pk", "col", "parent", "read_seq", "uncertain_no_recurse", "gray_no_recurse")
