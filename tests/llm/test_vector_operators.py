"""K-means and hard negatives against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtide.llm import hamerly, negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, data string, block long, anchor string, rank int"


def _rows(n, dims, seed, spread=2):
    """Vectors of few distinct components, so that there are ties, with copies, nulls and rows that take no part."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        vector = (rng.integers(-spread, spread + 1, dims) / 64).tolist()
        rows.append((i, vector, int(rng.integers(0, 10))))
    rows += [rows[3], rows[10], (n, rows[5][1], 4), (n + 1, None, 1), (n + 2, [None] * dims, 2), (n + 3, [float("nan")] * dims, 3), (n + 4, [float("inf")] + [0.0] * (dims - 1), 3), (n + 5, [], 1), (None, rows[7][1], 2)]
    return [(*row, "x", "y", 1, "z", 2) for row in rows]


def _usable(v, factor):
    ok = v is not None and all(x is not None and np.isfinite(x) for x in v)
    return [int(np.floor(factor * x)) for x in map(float, v)] if ok else None


def _kmeans(rows, dims, clusters, rounds):
    kept = [(r[0], v) for r in rows if (v := _usable(r[1], 64)) is not None and len(v) == dims]
    name = lambda i: ("~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centres = [list(v) for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in set(own):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in found if c == k) for k in range(len(centres))]
    return [(i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in found]


@pytest.mark.parametrize("n, clusters, rounds", [(300, 16, 3), (40, 5, 6), (11, 20, 2), (50, 1, 3)])
def test_kmeans_equals_brute_force(spark, n, clusters, rounds):
    rows = _rows(n, 64, n)
    got = hamerly.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), clusters=clusters, rounds=rounds)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, _kmeans(rows, 64, clusters, rounds)))


def test_bounds_spare_scans_and_never_change_a_result():
    rng = np.random.default_rng(3)
    middle = rng.integers(-4000, 4000, (8, 20))
    x = (middle[rng.integers(0, 8, 3000)] + rng.integers(-30, 30, (3000, 20))).astype("i8")
    before, centres = middle.astype("i8"), middle + rng.integers(-3, 4, (8, 20))
    own, upper, lower = hamerly.full_scan(x, before)
    got, high, low, scanned = hamerly.reassign(x, own, upper, lower, centres, before)
    assert scanned < 300
    want = hamerly.full_scan(x, centres)
    assert (got == want[0]).all() and (high >= want[1] * (1 - 1e-9)).all() and (low <= want[2] * (1 + 1e-9)).all()
    close = rng.integers(-2, 3, (500, 3)).astype("i8")
    before, centres = close[:6], close[6:12]
    got = hamerly.reassign(close, *hamerly.full_scan(close, before), centres, before)[0]
    assert (got == hamerly.full_scan(close, centres)[0]).all()


def test_kmeans_of_nothing(spark):
    empty = hamerly.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def _negatives(rows, anchor, positives=5, wanted=5, percent=80):
    kept = [(r[0], v, r[2]) for r in rows if r[0] is not None and r[2] is not None and (v := _usable(r[1], 256)) is not None]
    out = []
    for i, (a, v, label) in enumerate(kept):
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b, m) for j, (b, w, m) in enumerate(kept) if j != i)
        for p, b, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and percent * -p <= 100 * -s[0] <= 100 * -p]
            out += [(a, b, n + 1, m, -p, -s) for n, (s, m, _) in enumerate(fits[:wanted])]
    return out


@pytest.mark.parametrize("n, dims, spread", [(400, 6, 2), (250, 16, 5), (30, 64, 1)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, n, dims, spread):
    monkeypatch.setattr(negatives, "GROUP", 7)
    rows = _rows(n, dims, n, spread)
    rows[20] = (*rows[20][:2], None, *rows[20][3:])
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(_negatives(rows, lambda i: i % 10 == 0))
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_hard_negatives_of_nothing_of_one_label_and_of_long_vectors(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).collect() == []
    one = spark.createDataFrame([(i, [1.0, float(i)], 3) for i in range(9)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(one, F.lit(True)).collect() == []
    with pytest.raises(Exception, match="too long"):
        negatives.hard_negatives(spark.createDataFrame([(1, [1e20], 3)], "vec_id long, embedding array<double>, label int"), F.lit(True)).collect()


def test_blocks_and_anchors_are_not_broadcast(spark):
    """Anchors are a small file, but are dealt out to every block: more than may be broadcast here."""
    vector = F.expr("transform(sequence(0, 2047), i -> cast(pmod(hash(id, i), 5) / 256 as float))")
    table = spark.range(1000).select(F.col("id").alias("vec_id"), vector.alias("embedding"), (F.col("id") % 3).alias("label"))
    few = negatives.hard_negatives(table.coalesce(2), F.col("vec_id") % 10 == 0).collect()
    spark.conf.set("spark.sql.maxBroadcastTableSize", "100m")
    try:
        many = negatives.hard_negatives(table.repartition(150), F.col("vec_id") % 10 == 0).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(map(tuple, many)) == sorted(map(tuple, few)) and len(few) == 100 * 25


def test_scores_are_exact_beyond_doubles():
    x, y = np.array([[2**29 + 1, 2**28 + 3]], "i8"), np.array([[2**29 - 1, 2**28 + 1], [3, 5]], "i8")
    assert negatives.score_matrix(x, y).tolist() == [[sum(int(a) * int(b) for a, b in zip(x[0], r, strict=True)) for r in y]]


def _table(tmp_path, spark, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_queries_of_vectors(spark, tmp_path):
    rows = [r[:3] for r in _rows(230, 64, 9)]
    at = _table(tmp_path, spark, rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(str, map(tuple, queries.op12_hamerly(spark, at).collect()))) == sorted(map(str, _kmeans(rows, 64, 16, 3)))
    shifted = [(i, v, (m + 1) % 10 if i is not None and i % 7 == 0 else m) for i, v, m in rows]
    assert sorted(map(tuple, queries.op13_score_sort(spark, at).collect())) == sorted(_negatives(shifted, lambda i: i % 100 == 0))
