"""Budgeted best-first exploration of the certain closure of a root.

The order in which tasks are taken depends on what was taken before, so the search itself is sequential. Spark scores
all tasks (operators.priority) and restricts them to the closure of the root; only those come to the driver, and their
number is checked against `most` first.
"""

from __future__ import annotations

import heapq
import itertools
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trace import reach


@dataclass
class Search:
    taken: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    pending: int = 0


def closure_tasks(candidates: DataFrame, tasks: DataFrame, root: DataFrame) -> DataFrame:
    """Scored tasks of the requests that certain links reach from the root, each with its attributions."""
    edges = candidates.filter("certain").select(F.col("rid").alias("child"), F.col("version.origin_rid").alias("parent"), F.lit(False).alias("root_only")).filter("child <> parent")
    inside = reach(edges, root).select("rid")
    key = ["rid", "tbn", "pk", "col", "read_seq", "read_time"]
    found = candidates.join(inside, "rid", "left_semi").groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("version.seq").alias("seq"), "certain", F.col("version.origin_rid").alias("parent"), F.col("version.xid").alias("xid")))).alias("attributions")
    )
    return found.join(tasks.select(*key, "priority"), key)


def best_first(tasks: DataFrame, root: str, *, budget: int | None = None, order: str = "priority", seed: int = 0, most: int = 1_000_000) -> Search:
    """Take tasks by priority (or "fifo", or "random" with a seed) until the budget is used up or none is left.

    Among equal ones, tasks that may still show something new come first, then those put in earlier. Every attribution of
    a taken task gives a link; certain ones put the parent's tasks in. Uncertain ones lead nowhere."""
    if budget is not None and budget < 0:
        raise ValueError("budget must not be negative")
    if (n := tasks.count()) > most:
        raise ValueError(f"{n} tasks are more than the driver is set to hold ({most})")
    by_child: dict[str, list[dict]] = {}
    for row in tasks.orderBy("read_time", "tbn", "pk", "col", "read_seq").toLocalIterator():
        by_child.setdefault(row["rid"], []).append(row.asDict(recursive=True))
    out, dice, counter, heap = Search(), random.Random(seed), itertools.count(), []
    known: set[str] = set()
    edges: set[tuple[str, str]] = set()

    def tier(task: dict) -> int:
        certain = [(a["parent"], task["rid"]) for a in task["attributions"] if a["certain"]]
        return int(bool(certain) and all(e in edges for e in certain))

    def enqueue(rid: str) -> None:
        if rid in known:
            return
        known.add(rid)
        for task in by_child.get(rid, ()):
            rank = -task["priority"] if order == "priority" else 0.0 if order == "fifo" else dice.random()
            heapq.heappush(heap, (rank, tier(task), next(counter), task))

    enqueue(root)
    while heap and (budget is None or len(out.taken) < budget):
        rank, queued, _, task = heapq.heappop(heap)
        if (now := tier(task)) > queued:
            heapq.heappush(heap, (rank, now, next(counter), task))
            continue
        out.taken.append(task)
        for a in task["attributions"]:
            out.links.append({"rank": len(out.taken), "child": task["rid"], "parent": a["parent"], "certain": a["certain"], "cell": (task["tbn"], task["pk"], task["col"])})
            if a["certain"]:
                edges.add((a["parent"], task["rid"]))
                enqueue(a["parent"])
    out.pending = len(heap)
    return out
