"""Policy queries against a brute-force version on a small event table."""

import math
import random
from datetime import datetime, timedelta

import pytest

from backtide.operators import policy
from backtide.plans.catalog import QUERIES

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
N_REQUESTS = 160


@pytest.fixture(scope="module")
def events():
    """Few requests write t0, which almost all others read; the other tables are read and written now and then."""
    dice, rows = random.Random(11), []
    for i in range(N_REQUESTS * 5):
        early = i // 5 < 8
        k = 0 if early or dice.random() < 0.9 else dice.randrange(1, 4)
        kind = "signup" if early else dice.choice(["view", "click"]) if k == 0 else dice.choice(["view", "click", "purchase", "error"])
        rows.append((i, datetime(2026, 1, 1) + timedelta(seconds=i), dice.randrange(30), kind, dice.random() * 100, f'{{"k": {k}}}'))
    return rows


@pytest.fixture(scope="module")
def folder(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("policy"))
    spark.createDataFrame(events, SCHEMA).write.parquet(f"{path}/events.parquet")
    return path


def logs_of(events):
    reads, writes = [], []
    for i, _, user, kind, _, props in events:
        row = (i // 5, f"t{int(props[6:-1]) % 4}", str(user), i)
        if kind in ("view", "click"):
            reads.append(row)
        elif kind != "error" or i % 10 == 0:
            writes.append(row)
    return reads, writes


def sizes(events, blocked=None):
    """Nodes of the trace of at most four steps from each reading request."""
    reads, writes = logs_of(events)
    steps = {}
    for rid in {r[0] for r in reads}:
        first = {}
        for own, tbn, pk, at in reads:
            if own == rid:
                first.setdefault((tbn, pk), at)
        for row, at in first.items():
            before = [w for w in writes if w[1:3] == row and w[3] <= at]
            if row[0] != blocked and before and before[-1][0] != rid:
                steps.setdefault(rid, []).append((before[-1][0], row))
    out = {}
    for rid in {r[0] for r in reads}:
        nodes, seen, front = set(), {rid}, {rid}
        for _ in range(4):
            taken = {s for x in front for s in steps.get(x, [])}
            nodes |= {("q", p) for p, _ in taken} | {("d", row) for _, row in taken}
            front = {p for p, _ in taken} - seen
            seen |= front
        out[rid] = len(nodes)
    return out


def amplifications(events, roots):
    mean = lambda s: sum(s[r] for r in roots) / len(roots)
    return {t: mean(sizes(events)) / max(mean(sizes(events, t)), 1.0) for t in ("t0", "t1", "t2", "t3")}


def test_tables_are_classified_by_their_amplification(spark, events, folder):
    reading = sorted(sizes(events))
    assert len(reading) > 128
    roots = [reading[round(i * (len(reading) - 1) / 127)] for i in range(128)]
    factor = amplifications(events, roots)
    reads, writes = logs_of(events)
    first = {}
    for i, _, _, kind, _, _ in events:
        first.setdefault(i // 5, f"{'GET' if i % 2 == 0 else 'POST'} {kind}")

    def p90(values):
        values, at = sorted(values), 0.9 * (len(values) - 1)
        return values[math.floor(at)] + (values[math.ceil(at)] - values[math.floor(at)]) * (at % 1)

    found = {}
    for t in factor:
        r, w = {x[0] for x in reads if x[1] == t}, {x[0] for x in writes if x[1] == t}
        found[t] = len(r | w) / N_REQUESTS, len({first[x] for x in r | w}) / len(set(first.values())), min(len(r), len(w)) / max(len(r), len(w), 1), len(w) / N_REQUESTS
    tc, te = max(p90([x[0] for x in found.values()]), 0.2), max(p90([x[1] for x in found.values()]), 0.3)
    expected = {
        t: (c >= tc and e >= te and factor[t] >= 3 and b > 0 and w < 0.1, (min(c / tc, 1) + min(e / te, 1) + min(factor[t] / 3, 1) + min(2 * b, 1)) / 4)
        for t, (c, e, b, w) in found.items()
    }
    got = {r.tbn: r for r in QUERIES["classify_tables"](spark, folder).collect()}
    assert {t: r.block for t, r in got.items()} == {t: x[0] for t, x in expected.items()} and got["t0"].block
    assert all(got[t].noise_score == pytest.approx(x[1], abs=1e-6) for t, x in expected.items())
    decided = QUERIES["policy_decide"](spark, folder).collect()
    assert {r.decision for r in decided if r.tbn == "t0"} == {"gray"}


def test_every_reading_request_is_traced(spark, events, folder):
    expected = sizes(events)
    assert {r.rid: r.size for r in QUERIES["trace_size_d4"](spark, folder).collect()} == {f"r{i}": n for i, n in expected.items()}
    got = {r.tbn: r.amplification for r in QUERIES["amplification"](spark, folder).collect()}
    assert got == pytest.approx(amplifications(events, list(expected)), abs=1e-6)


def test_budgets_reach_the_last_request(spark, folder, tmp_path):
    rows = [(i, datetime(2026, 1, 1), 1, "view", 1.0, '{"k": 1}') for i in range(0, 10_000, 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    for path, n in ((folder, N_REQUESTS), (str(tmp_path), 2000)):
        gold = {i + 1 for i in range(n) if i % 7 < 3}
        budgets = {0, max(gold), *[b for b in (1, 2, 5, 10, 25, 50, 100, 200, 500, 1000) if b <= n], *[max(1, round(n * p / 100)) for p in (1, 5, 10, 25, 50, 75, 100)]}
        recall = {b: len([g for g in gold if g <= b]) / len(gold) for b in budgets}
        assert {r.budget: r.recall for r in QUERIES["budget_curve"](spark, path).collect()} == pytest.approx(recall, abs=1e-6)
        x = sorted(budgets)
        area = sum((b - a) * (recall[a] + recall[b]) / 2 for a, b in zip(x, x[1:])) / n
        assert QUERIES["budget_auc"](spark, path).first().area == pytest.approx(area, abs=1e-6)


def test_sizes_without_each_of_many_tables(spark):
    """More tables than bits of a long, against a search for each."""
    dice = random.Random(12)
    rows = sorted({(f"r{dice.randrange(14)}", f"r{dice.randrange(14)}", f"t{dice.randrange(70):02}", str(dice.randrange(3))) for _ in range(220)})
    rows = [r for r in rows if r[0] != r[1]]
    roots = ["r0", "r3", "r99"]

    def size(root, blocked):
        seen, level, nodes = {root}, {root}, set()
        for _ in range(4):
            after = set()
            for child, parent, table, key in rows:
                if child in level and table != blocked:
                    nodes |= {parent, (table, key)}
                    after.add(parent)
            level = after - seen
            seen |= after
        return len(nodes)

    names = [f"t{i:02}" for i in range(70)]
    links = spark.createDataFrame(rows, "child string, parent string, tbn string, pk string")
    got = policy.trace_sizes(links, spark.createDataFrame([(r,) for r in roots], "rid string"), 4, spark.createDataFrame([(n,) for n in names], "tbn string"))
    assert {(r.blocked, r.rid): r.size for r in got.collect()} == {(b, r): size(r, b) for b in ["", *names] for r in roots}
