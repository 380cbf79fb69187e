"""The Pitman-Yor model: its bookkeeping against brute force, its sampler against exact probabilities, held-out perplexity."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from backtide.llm import packed, pitmanyor, queries

SCHEMA = "doc_id long, text string, train boolean, bucket long, block string, words string, score double"
#: Never seated again, every pair has one table, so that probabilities are known.
STILL = pitmanyor.Process(0.6, 2.0, 0.5, 3.0, samples=2, sweeps=0)


def _texts(n, seed):
    dice = random.Random(seed)
    words = ["a", "B", "cc", "Dé", "ÉÉ", "x\x1cy", "日本"] + [f"w{i}" for i in range(60)]
    return [" ".join(dice.choice(words) if dice.random() < 0.9 else f"rare{dice.randrange(500)}" for _ in range(dice.randrange(12))) for _ in range(n)]


def _words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def _brute(rows, how):
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), with one table for each pair and each word."""
    lines = [(key, train, [*_words(text), " "]) for key, text, train in rows]
    count, pairs = Counter(), Counter()
    for _, train, tokens in lines:
        if train:
            count.update(tokens)
            pairs.update(zip([" ", *tokens], tokens, strict=False))
    n, v = sum(count.values()), len(count)
    served, own = Counter(w for _, w in pairs), Counter(u for u, _ in pairs)
    assert max(pairs.values(), default=0) <= 16 and max(served.values(), default=0) <= 16

    def parent(w):
        return (served[w] - how.parent_discount * (w in served) + (how.parent_strength + how.parent_discount * len(served)) / (v + 1)) / (how.parent_strength + sum(served.values()))

    def score(u, w):
        return math.log10((pairs[u, w] - how.discount * ((u, w) in pairs) + (how.strength + how.discount * own[u]) * parent(w)) / (how.strength + count[u]))

    return [
        (key, not train, len(t), sum(w in count for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), sum(map(score, [" ", *t], t)))
        for key, train, t in lines
    ]


def _same(got, want):
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5, abs=1e-6)


@pytest.mark.parametrize("block_chars, bucket_bytes", [(1 << 20, 1 << 20), (40, 150)])
def test_scores_equal_brute_force(spark, block_chars, bucket_bytes):
    texts = [*_texts(17, 4), "", None, "  \t\n", "a a", "A\x0ba", "never seen", "rare1 rare2"]
    rows = [(i, t, i % 3 != 2) for i, t in enumerate(texts)] + [(None, "cc a", True), (4, "cc a", False), (4, texts[4], True)]
    docs = spark.createDataFrame([(*r, 1, "b", "w", 0.5) for r in rows], SCHEMA).repartition(3)
    got = pitmanyor.score_texts(docs, ~F.col("train"), how=STILL, block_chars=block_chars, bucket_bytes=bucket_bytes)
    _same(map(tuple, got.collect()), _brute(rows, STILL))


def test_nothing_to_learn_from(spark):
    empty = pitmanyor.score_texts(spark.createDataFrame([], SCHEMA), F.lit(False))
    assert empty.collect() == [] and [t for _, t in empty.dtypes] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    docs = spark.createDataFrame([(1, "a b", True, 1, "", "", 0.0)], SCHEMA)
    assert [tuple(r) for r in pitmanyor.score_texts(docs, F.lit(True)).collect()] == [(1, True, 3, 0, 0, 0.0, 0.0)]


@pytest.mark.parametrize("customers, fresh, discount", [(2, 0.4, 0.7), (3, 0.4, 0.7), (4, 2.5, 0.3)])
def test_moves_keep_the_exact_distribution_of_tables(customers, fresh, discount):
    """A seating has the weight fresh ** tables times (1 - d)(2 - d)... for each table; all set partitions are listed."""

    def partitions(n):
        if n == 0:
            yield []
            return
        for p in partitions(n - 1):
            yield [*p, 1]
            for i in range(len(p)):
                yield [*p[:i], p[i] + 1, *p[i + 1 :]]

    weight = Counter()
    for p in partitions(customers):
        weight[len(p)] += fresh ** len(p) * math.prod(k - discount for size in p for k in range(1, size))
    n, dice = 20000, np.random.default_rng(1)
    c, t, sizes = np.full(n, customers), np.ones(n, "i8"), np.full(n, customers)
    t, sizes = pitmanyor.reseat(c, t, sizes, np.full(n, fresh), discount, dice, 12)
    assert (np.add.reduceat(sizes, np.cumsum(t) - t) == c).all() and (sizes > 0).all()
    for tables, w in weight.items():
        assert (t == tables).mean() == pytest.approx(w / sum(weight.values()), abs=0.015)


@pytest.mark.parametrize("together", [1, 10**9])
def test_a_sweep_moves_every_customer_of_a_large_dish(monkeypatch, together):
    """Where nearly nobody opens a table, two sweeps leave few of 3,000 customers alone; dishes moved together or alone."""
    monkeypatch.setattr(pitmanyor, "TOGETHER", together)
    n, customers = 5, 3000
    t, sizes = pitmanyor.reseat(np.full(n, customers), np.full(n, customers), np.ones(n * customers, "i8"), np.full(n, 0.001), 0.0, np.random.default_rng(4), 2)
    assert (np.add.reduceat(sizes, np.cumsum(t) - t) == customers).all() and (sizes > 0).all()
    assert (t < customers / 2).all()


def test_moves_of_single_dishes_keep_the_exact_distribution(monkeypatch):
    monkeypatch.setattr(pitmanyor, "TOGETHER", 10**9)
    customers, fresh, discount, n = 4, 2.5, 0.3, 20000
    weight = np.array([0, fresh, 0, 0, 0])
    for c in range(1, customers):
        weight = np.concatenate([[0], weight[:-1]]) * fresh + weight * np.maximum(c - discount * np.arange(5), 0)
    t, _ = pitmanyor.reseat(np.full(n, customers), np.ones(n, "i8"), np.full(n, customers), np.full(n, fresh), discount, np.random.default_rng(1), 12)
    assert np.bincount(t, minlength=5) / n == pytest.approx(weight / weight.sum(), abs=0.015)


def test_moves_keep_customers_of_dishes_of_all_sizes():
    dice = np.random.default_rng(2)
    c = np.array([2, 3, 5000, 17, 2, 90000, 16, 40])
    fresh = dice.random(8) * 30
    t = pitmanyor.opening(c, fresh, 0.75, dice)
    sizes = pitmanyor._first_sizes(c, t)
    for _ in range(4):
        t, sizes = pitmanyor.reseat(c, t, sizes, fresh, 0.75, dice, 2)
        assert len(sizes) == t.sum() and (np.add.reduceat(sizes, np.cumsum(t) - t) == c).all() and (sizes > 0).all() and (t <= c).all()
    assert t[5] > t[3] >= 1


def test_query_beats_its_base_on_texts_that_it_did_not_see(spark, tmp_path):
    dice = random.Random(7)
    follow = {w: [f"n{w}{k}" for k in range(3)] for w in range(40)}
    texts = [" ".join(x for _ in range(20) for w in [dice.randrange(40)] for x in (f"v{w}", dice.choice(follow[w]))) for _ in range(300)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_pitman_yor(spark, str(tmp_path)).collect()
    again = {r["doc_id"]: r["score"] for r in queries.op11_pitman_yor(spark, str(tmp_path)).collect()}
    assert len(rows) == 300 and all(r["score"] == again[r["doc_id"]] for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2}
    perplexity = {c: 10 ** (-sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)) for c in ("score", "base_score")}
    # Of two words one is of 40, the other of 3: about the root of 120.
    assert perplexity["score"] < 15 < 60 < perplexity["base_score"]
    want = {b[0]: b[5] for b in _brute_base([(r["doc_id"], texts[r["doc_id"]], not r["held_out"]) for r in rows])}
    assert all(r["base_score"] == pytest.approx(want[r["doc_id"]]) for r in rows)


def _brute_base(rows):
    count = Counter(w for _, text, train in rows if train for w in [*_words(text), " "])
    n, v = sum(count.values()), len(count)
    return [(key, None, None, None, None, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*_words(text), " "])) for key, text, _ in rows]


def test_words_are_hashed_by_columns():
    dice = random.Random(5)
    texts = ["", None, " ", "Ab aB\x0bAB\tab", "x" * 200, ("y" * 64 + " ") * 3, "y" * 65, "\u00c9\u00c9 \u00e9\u00e9 \u65e5\u672c", "z", "z", " z ", " " * 300 + "w", *(" ".join(dice.choices("aAbBcC \n", k=dice.randrange(90))) for _ in range(300))]
    column = pa.array(["skipped words", *texts]).slice(1)
    hashes, counts = pitmanyor.word_hashes(column)
    words = [(t or "").encode().lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    known = dict(zip((w for own in words for w in own), hashes.tolist(), strict=True))
    assert [known[w] for own in words for w in own] == hashes.tolist() and len(set(known.values()) | {pitmanyor.END}) == len(known) + 1
    assert [len(x) for x in pitmanyor.word_hashes(column.slice(0, 0))] == [0, 0]


def test_sorted_places():
    dice = np.random.default_rng(3)
    for x in (dice.integers(0, 40, 500), dice.integers(0, 1 << 36, 500), dice.integers(0, 1 << 64, 500, "u8").repeat(2), np.empty(0, "i8"), np.array([(1 << 63) + 5, (1 << 63) + 1, (1 << 63) + 5], "u8")):
        values, inverse = packed.distinct(x)
        assert (values == np.unique(x)).all() and (values[inverse] == x).all() and values.dtype == x.dtype
        assert (packed.stable_order(x) == np.argsort(x, kind="stable")).all()
