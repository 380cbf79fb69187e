"""Hard negatives: for each anchor and each of its positives, rows of other labels that score nearly as high.

Rows lie in blocks and anchors in groups; every block meets every group, in a join on a grid, so both sides of a task are
of bounded size. Within a block all scores of an anchor are found in integers and sorted (score, then id). A first pass
takes the best rows of the anchor's own label; a second one looks up each positive's score by binary search and reads
on from there. Blocks return a few rows for each anchor, which a window puts together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stash, stash
from .vectors import ROWS, blocks, matrix

#: Anchors of a group; scores that are held at once.
GROUP, SCORES = 1024, 1 << 21


def score_matrix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x and y; the shorter vectors are filled up with 0."""
    dims = min(x.shape[1], y.shape[1])
    x, y = x[:, :dims], y[:, :dims]
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * dims < 2**52:
        return (x.astype("f8") @ y.T.astype("f8")).astype("i8")
    return x @ y.T


def best_of_label(scores: np.ndarray, ids: np.ndarray, same: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the `wanted` rows of the same label with the highest scores, of equal ones those of smaller ids."""
    places = np.flatnonzero(same)
    return places[np.lexsort((ids[places], -scores[places]))[:wanted]]


def below_limits(scores: np.ndarray, ids: np.ndarray, other: np.ndarray, limits: list[int], percent: int, wanted: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the limit, places): for each limit the first `wanted` rows of another label from that score down to
    `percent` of it. Only rows that some limit reaches are sorted."""
    ends = [(-percent * limit) // 100 for limit in limits]
    places = np.flatnonzero(other & (scores <= max(limits)) & (-scores <= max(ends)))
    order = places[np.lexsort((ids[places], -scores[places]))]
    falling = -scores[order]
    for n, limit in enumerate(limits):
        start, end = np.searchsorted(falling, -limit, "left"), np.searchsorted(falling, ends[n], "right")
        yield n, order[start : min(start + wanted, end)]


def _cells(rows: DataFrame, anchors: DataFrame, groups: int, use: Callable[[dict, dict, int, np.ndarray], Iterator[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """What `use` gives for every block and every anchor of every group. Tables of blocks and anchors are small as files and
    grow as they are dealt out, so their joins are sorted ones: Spark would take them for small and broadcast them."""
    parts = max(1, rows.count())
    left = rows.select(F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.struct("block", "dims", "data", "ids", "labels").alias("rows"))
    grid = left.join(anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))).hint("merge"), ["group", "part"]).select("rows", "anchors")

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block, some = (batch.column(i)[at].as_py() for i in (0, 1))
                x, out = matrix(block["data"], block["dims"]), []
                block |= {"ids": np.array(block["ids"], "i8"), "labels": np.array(block["labels"], "i8")}
                step = max(1, SCORES // max(1, len(x)))
                for first in range(0, len(some), step):
                    part = some[first : first + step]
                    wide = max(len(a["vector"]) for a in part) // 4
                    y = np.array([np.pad(v := np.frombuffer(a["vector"], "i4"), (0, wide - len(v))) for a in part], "i8").reshape(len(part), wide)
                    scores = score_matrix(y, x)
                    for i, anchor in enumerate(part):
                        out.extend(use(block, anchor, scores[i]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return grid.mapInArrow(cell, schema)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.to_pylist():
            at, size = np.flatnonzero(block["anchor"]), 4 * block["dims"]
            own = [pa.array(at + ROWS * block["block"]), *[pa.array(np.array(block[c], "i8")[at]) for c in ("ids", "labels")], pa.array([block["data"][size * i : size * i + size] for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(own, names=["row", "anchor_id", "label", "vector"])


def hard_negatives(
    vectors: DataFrame, anchor: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", factor: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are integers floor(factor * x), scores inner products. The rows for which `anchor` holds are anchors; a
    positive is one of the first `positives` other rows of the anchor's label, by falling score, then id. Each gets the
    first `negatives` rows of other labels whose score is `percent` of the positive's at least and no higher than it.
    Labels are integers. Rows with a null key, label or vector, or with a null or non-finite component take no part; an
    empty vector scores 0, shorter vectors count as filled up with 0. Rows that repeat a key are rows of their own, a
    copy of the anchor included. Other columns are left out; an empty table gives no rows.
    """
    usable = vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    rows = stash(blocks(usable, key, vector, factor, labels=F.col(label), anchor=F.coalesce(anchor, F.lit(False)).cast("int")), "rows")
    flat = stash(rows.mapInArrow(_anchors, "row long, anchor_id long, label long, vector binary"), "anchors")
    groups = -(-max(1, flat.count()) // GROUP)
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group")
    long_ = pa.int64()

    def first(block: dict, a: dict, scores: np.ndarray) -> Iterator[tuple]:
        same = block["labels"] == a["label"]
        if a["row"] // ROWS == block["block"]:
            same[a["row"] % ROWS] = False
        for i in best_of_label(scores, block["ids"], same, positives):
            yield a["row"], int(block["ids"][i]), int(scores[i])

    def second(block: dict, a: dict, scores: np.ndarray) -> Iterator[tuple]:
        for n, places in below_limits(scores, block["ids"], block["labels"] != a["label"], [p["positive_score"] for p in a["found"]], percent, negatives):
            for i in places:
                yield a["row"], n, int(block["ids"][i]), int(scores[i])

    whole = F.collect_list(F.struct("row", "label", "vector")).alias("anchors")
    near = _cells(rows, flat.groupBy(group).agg(whole), groups, first, "row long, positive_id long, positive_score long", pa.schema([("row", long_), ("positive_id", long_), ("positive_score", long_)]))
    best = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    chosen = near.withColumn("n", F.row_number().over(best) - 1).filter(F.col("n") < positives)
    found = F.array_sort(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("found")
    ready = stash(flat.join(chosen.groupBy("row").agg(found).hint("merge"), "row"), "positives")
    whole = F.collect_list(F.struct("row", "label", "vector", "found")).alias("anchors")
    schema = pa.schema([("row", long_), ("n", pa.int32()), ("negative_id", long_), ("negative_score", long_)])
    far = _cells(rows, ready.groupBy(group).agg(whole), groups, second, "row long, n int, negative_id long, negative_score long", schema)
    best = Window.partitionBy("row", "n").orderBy(F.desc("negative_score"), "negative_id")
    taken = stash(far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives), "negatives")
    out = taken.join(ready.select("row", "anchor_id", F.explode("found").alias("p")).select("row", "anchor_id", "p.*").hint("merge"), ["row", "n"])
    drop_stash(rows)
    drop_stash(flat)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
