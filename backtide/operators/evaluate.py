"""Scores of recovered chains: set metrics, budget curves, areas, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compare_sets(predicted: DataFrame, gold: DataFrame, key: str = "rid") -> DataFrame:
    """(key, status): hit, extra (only predicted) or missing (only gold)."""
    p, g = predicted.select(key).distinct().withColumn("p", F.lit(1)), gold.select(key).distinct().withColumn("g", F.lit(1))
    both = p.join(g, key, "full")
    return both.select(key, F.when(F.col("p").isNull(), "missing").when(F.col("g").isNull(), "extra").otherwise("hit").alias("status"))


def scores(compared: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., tp, fp, fn, precision, recall, f1); empty denominators give 0."""
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("hit", "tp"), ("extra", "fp"), ("missing", "fn"))]
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = compared.groupBy(*by).agg(*counts) if by else compared.agg(*counts)
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def budget_curve(ranked: DataFrame, gold: DataFrame, budgets: list[int]) -> DataFrame:
    """(budget, predicted, tp, precision, recall, f1): of requests (rid, rank), those found within each budget.

    Each request is counted once, at its rank; budgets add up the counts below them, so requests and budgets are never
    paired."""
    spark = ranked.sparkSession
    marked = ranked.join(gold.select("rid").distinct().withColumn("hit", F.lit(1)), "rid", "left").fillna(0, ["hit"])
    steps = sorted(set(budgets))
    slot = F.lit(None).cast("long")
    for b in reversed(steps):
        slot = F.when(F.col("rank") <= b, F.lit(b)).otherwise(slot)
    counted = marked.withColumn("budget", slot).filter("budget is not null").groupBy("budget").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    every = spark.createDataFrame([(b,) for b in steps], "budget long").join(counted, "budget", "left").fillna(0)
    up = Window.orderBy("budget").rowsBetween(Window.unboundedPreceding, 0)
    summed = every.select("budget", F.sum("n").over(up).alias("predicted"), F.sum("h").over(up).alias("tp"))
    total = gold.agg(F.count_distinct("rid").alias("gold"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = summed.join(F.broadcast(total)).withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("gold")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("gold")


def curve_area(curve: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Trapezoid area under y over x, by the span of x; 0 where the span is."""
    w = Window.partitionBy(*by).orderBy(x)
    pieces = curve.withColumn("_part", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    span = F.max(x) - F.min(x)
    out = pieces.groupBy(*by) if by else pieces
    return out.agg(F.when(span > 0, F.coalesce(F.sum("_part"), F.lit(0.0)) / span).otherwise(0.0).alias("area"))


def summarise_runs(runs: DataFrame, value: str, weight: str) -> DataFrame:
    """Mean, median, weighted mean and sample deviation (0 for one run) of a score over runs."""
    return runs.agg(
        F.avg(value).alias("macro"), F.percentile(value, 0.5).alias("median"),
        F.when(F.sum(weight) > 0, F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).otherwise(0.0).alias("weighted"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"),
    )


def mean_curve(curves: DataFrame, y: str) -> DataFrame:
    """Mean of y over seeds at each position of their curves."""
    return curves.groupBy("position").agg(F.avg(y).alias(y))


def first_ranks(links: DataFrame, root: str) -> DataFrame:
    """(rid, rank): the smallest task rank at which a request becomes known over certain links; the root has 0."""
    certain = links.filter("certain")
    ends = certain.select(F.col("parent").alias("rid"), "rank").union(certain.select(F.col("child").alias("rid"), "rank"))
    return ends.groupBy("rid").agg(F.min("rank").alias("rank")).withColumn("rank", F.when(F.col("rid") == root, 0).otherwise(F.col("rank")))


def checkpoints(total: int, percents: tuple[int, ...] = (1, 5, 10, 25, 50, 75, 100)) -> list[int]:
    """Ranks at shares of the whole budget, rounded half to even, at least 1."""
    return [max(1, round(total * p / 100)) for p in percents]


def whole_budgets(ranked: DataFrame, gold: DataFrame, absolute: tuple[int, ...] = (1, 2, 5, 10, 25, 50, 100, 200, 500, 1000)) -> list[int]:
    """Budgets from 0 to the last rank of (rid, rank): fixed ones up to it, shares of it, and the one that finds all gold
    requests that have a rank."""
    marked = ranked.join(gold.select("rid").distinct().withColumn("hit", F.lit(1)), "rid", "left")
    total, complete = marked.agg(F.max("rank"), F.max(F.when(F.col("hit") == 1, F.col("rank")))).first()
    total = total or 0
    return sorted({0, complete or 0, total, *[b for b in absolute if b <= total], *[min(total, b) for b in checkpoints(total)]})


def collapsed_dag(links: DataFrame) -> DataFrame:
    """(child, parent, cells, label, uncertain): one edge for each pair of requests."""
    cell = F.concat_ws(".", "tbn", "pk", "col")
    grouped = links.groupBy("child", "parent").agg(F.count_distinct("tbn", "pk", "col").alias("cells"), F.min(cell).alias("one"), F.max(~F.col("certain")).alias("uncertain"))
    return grouped.select("child", "parent", "cells", F.when(F.col("cells") == 1, F.col("one")).otherwise(F.concat(F.col("cells"), F.lit(" cells"))).alias("label"), "uncertain")


def graph_counts(links: DataFrame) -> DataFrame:
    """One row of distinct links, requests, cells, tables and rows."""
    ends = links.select("child").union(links.select("parent")).agg(F.count_distinct("child").alias("requests"))
    return links.agg(
        F.count("*").alias("links"), F.count_if("certain").alias("certain_links"), F.count_if(~F.col("certain")).alias("uncertain_links"),
        F.count_distinct("tbn", "pk", "col").alias("cells"), F.count_distinct("tbn").alias("tables"), F.count_distinct("tbn", "pk").alias("rows"),
    ).join(F.broadcast(ends))


def compare_strategies(runs: DataFrame, first: str, second: str) -> DataFrame:
    """One row first_wins, ties, second_wins, macro_delta, weighted_reduction over runs (run, strategy, budget, total): who
    needs the smaller budget in each run that both have. Reductions are of the first one's budget from the whole."""
    own = runs.groupBy("run", "strategy").agg(F.min("budget").alias("budget"), F.max("total").alias("total"))
    pair = own.filter(F.col("strategy") == first).select("run", F.col("budget").alias("a"), "total").join(own.filter(F.col("strategy") == second).select("run", F.col("budget").alias("b")), "run")
    return pair.agg(
        F.count_if(F.col("a") < F.col("b")).alias("first_wins"), F.count_if(F.col("a") == F.col("b")).alias("ties"), F.count_if(F.col("a") > F.col("b")).alias("second_wins"),
        F.coalesce(F.avg(F.col("a") - F.col("b")), F.lit(0.0)).alias("macro_delta"),
        F.when(F.sum("total") > 0, 1 - F.sum("a") / F.sum("total")).otherwise(0.0).alias("weighted_reduction"),
    )


def links_curve(links: DataFrame, root: str, gold: DataFrame, budgets: list[int]) -> DataFrame:
    """budget_curve() of the requests that links (child, parent, certain, rank) show within each budget: both ends of
    certain links of that rank at most."""
    return budget_curve(first_ranks(links, root), gold, budgets)
