"""Backward reachability: which earlier requests could have influenced a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtide.session import discard, materialise


#: Levels after which all that were visited are written as one table, so that a level reads few of them.
TOGETHER = 8


def reach(edges: DataFrame, roots: DataFrame, *, depth: int | None = None, by: tuple[str, ...] = (), written: bool = False) -> DataFrame:
    """(by..., rid, level): all requests reachable from roots (by..., rid) over edges (child, parent, root_only).

    Level by level: a join of the frontier with the edges, then an anti-join with what was visited, so cycles end. Each
    level is written to the shared folder, which cuts the lineage. Edges with root_only lead on from roots alone;
    of `by` there may be any columns that separate searches, all run in one loop. Edges that come from a written table are
    read from it at each level, else their distinct ones are written first."""
    edges = edges.select("child", "parent", "root_only")
    own = [] if written else [materialise(edges.distinct(), "trace-edges")]
    edges = edges if written else own[0]
    keys = [*by, "rid"]
    frontier = materialise(roots.select(*keys).distinct().withColumn("level", F.lit(0)), "trace-frontier")
    visited, level, levels = frontier, 0, [frontier]
    while depth is None or level < depth:
        level += 1
        steps = frontier.join(edges, frontier["rid"] == edges["child"])
        if level > 1:
            steps = steps.filter(~F.col("root_only"))
        new = steps.select(*by, F.col("parent").alias("rid")).distinct().join(visited, keys, "left_anti")
        frontier = materialise(new.withColumn("level", F.lit(level)), "trace-frontier")
        if frontier.isEmpty():
            discard(frontier)
            break
        visited = visited.unionByName(frontier)
        levels.append(frontier)
        if level % TOGETHER == 0:
            visited = materialise(visited, "trace-visited")
            discard(*levels[:-1])
            levels = [visited, frontier]
    out = materialise(visited, "trace-visited")
    discard(*own, *levels)
    return out


def links(candidates: DataFrame, *, keep_self: bool = False) -> DataFrame:
    """(child, tbn, pk, col, parent, latest, certain, rule): the edges of the causal graph, parent being the request
    that began the run of values that was read."""
    out = candidates.select(F.col("rid").alias("child"), "tbn", "pk", "col", F.col("version.origin_rid").alias("parent"), F.col("version.rid").alias("latest"), F.col("version.vtext").alias("value"), "certain", "rule", "read_seq", "read_time")
    return out if keep_self else out.filter("child <> parent")


def trace(all_links: DataFrame, root: DataFrame, *, policy: DataFrame | None = None, tainted=None) -> tuple[DataFrame, DataFrame]:
    """(requests, links) of a trace from root (rid). Uncertain links are shown but not followed.

    policy (tbn, pk, gray): rows that are shown, but followed only from the root. tainted: a column expression on the
    links; others are dropped before anything else. Links are those of visited children, found once after the search.
    """
    used = all_links if tainted is None else all_links.filter(tainted)
    if policy is not None:
        used = used.join(policy.select("tbn", "pk", "gray"), ["tbn", "pk"], "left").withColumn("gray", F.coalesce("gray", F.lit(False)))
    else:
        used = used.withColumn("gray", F.lit(False))
    used = materialise(used, "links")
    # Of several links of a pair one that is not gray is enough to be followed, so they need not be brought together.
    visited = reach(used.filter("certain").select("child", "parent", F.col("gray").alias("root_only")), root, written=True)
    return visited, used.join(visited.select(F.col("rid").alias("child")), "child", "left_semi")


def simple_paths(edges: DataFrame, root: DataFrame, longest: int = 4) -> DataFrame:
    """(path) of all paths without a repeated request from root, up to `longest` edges; a path that would come back to a
    request ends there. Their number may grow exponentially, hence the bound."""
    edges = materialise(edges.select("child", "parent").distinct(), "path-edges")
    open_ = root.select(F.array("rid").alias("path"))
    done = None
    for _ in range(longest):
        grown = open_.join(edges, F.element_at("path", -1) == edges["child"]).filter(~F.array_contains("path", F.col("parent"))).select(F.concat("path", F.array("parent")).alias("path"))
        open_ = materialise(grown, "paths")
        done = open_ if done is None else done.union(open_)
        if open_.isEmpty():
            break
    return done


def paths_with_ends(edges: DataFrame, root: DataFrame, longest: int = 12) -> DataFrame:
    """(path, ended) of all paths from root over edges (child, parent), each until it can go no further: `leaf`, a request
    without parents; `cycle`, where the next request is on the path already and is added as "(cycle: rid)"; or `cut` after
    `longest` edges. Their number may grow exponentially with the length, hence the bound, which is told and not hidden.

    Paths grow level by level from a table of their distinct prefixes; those that have ended are not looked at again."""
    edges = materialise(edges.select("child", "parent").distinct(), "path-edges")
    open_, done = root.select(F.array("rid").alias("path")).distinct(), []
    for step in range(longest + 1):
        last = F.element_at("path", -1)
        grown = open_.join(edges, last == edges["child"], "left").withColumn("closes", F.array_contains("path", F.col("parent")))
        ended = F.when(F.col("parent").isNull(), "leaf").when(F.col("closes"), "cycle").when(F.lit(step == longest), "cut")
        path = F.when(F.col("closes"), F.concat("path", F.array(F.concat(F.lit("(cycle: "), "parent", F.lit(")"))))).when(F.col("parent").isNull() | F.lit(step == longest), F.col("path")).otherwise(F.concat("path", F.array("parent")))
        level = materialise(grown.select(path.alias("path"), ended.alias("ended")).distinct(), "paths")
        done.append(level.filter("ended is not null"))
        open_ = level.filter("ended is null").select("path")
        if open_.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    discard(edges)
    return out


def predecessors(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(rid, level, dependencies): the requests that lead to root over edges (child, parent), how far they are at least and
    how many edges each adds. Found by reaching, never by listing paths."""
    reached = reach(edges.withColumn("root_only", F.lit(False)), root)
    counts = edges.select("child", "parent").distinct().groupBy(F.col("child").alias("rid")).agg(F.count("*").alias("dependencies"))
    return reached.join(counts, "rid", "left").filter("level > 0").select("rid", "level", F.coalesce("dependencies", F.lit(0)).alias("dependencies"))
