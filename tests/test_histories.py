"""Histories and resolution on small cases, and against a brute-force version on random logs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from backtide.operators import resolve
from backtide.operators.resolve import dedupe_candidates, match_observed, request_candidates, unresolved
from backtide.operators.versions import CELL, as_of, crowded, versions
from backtide.plans.trace import links, trace
from backtide.sources import logs as sources
from backtide.session import materialise

START = datetime(2026, 1, 1)
READS = "rid string, tbn string, pk string, seq long, time timestamp_ntz, xmin long, xmax long"
WRITES = "rid string, tbn string, pk string, col string, op string, vtype string, vtext string, time timestamp_ntz, xid long, seq long, line long"
DELETES = "rid string, tbn string, pk string, time timestamp_ntz, xid long, seq long, line long"


def W(t, rid, col, text, op="update", xid=None, seq=0, kind="str", line=0):
    return (rid, "items", "1", col, op, kind, text, START + timedelta(seconds=t), xid, seq, line or t)


def R(t, rid, xmin=None, xmax=None, seq=0):
    return (rid, "items", "1", seq, START + timedelta(seconds=t), xmin, xmax)


def D(t, rid, xid=None, seq=0):
    return (rid, "items", "1", START + timedelta(seconds=t), xid, seq, t)


def found(spark, reads, writes, deletes=()):
    tables = spark.createDataFrame(list(reads), READS), spark.createDataFrame(list(writes), WRITES), spark.createDataFrame(list(deletes), DELETES)
    return tables, request_candidates(*tables)


def parents(candidates):
    return {(r.col, r.version.rid, r.version.origin_rid, r.certain, r.rule) for r in candidates.collect()}


def test_each_column_has_its_own_writer(spark):
    tables, c = found(spark, [R(3, "A")], [W(1, "B", "payload", "x", "insert"), W(1, "B", "title", "t", "insert"), W(2, "C", "status", "s")])
    assert {(x[0], x[2]) for x in parents(c)} == {("payload", "B"), ("title", "B"), ("status", "C")}
    root = spark.createDataFrame([("A",)], "rid string")
    assert {r.rid for r in trace(links(c), root)[0].collect()} == {"A", "B", "C"}


def test_origin_of_run_and_changed_value(spark):
    _, c = found(spark, [R(4, "A")], [W(1, "B", "p", "evil", "insert"), W(2, "C", "p", "evil")])
    assert parents(c) == {("p", "C", "B", True, "time")}
    _, c = found(spark, [R(4, "A")], [W(1, "B", "p", "evil", "insert"), W(2, "C", "p", "safe"), W(3, "D", "p", "evil")])
    assert parents(c) == {("p", "D", "D", True, "time")}


def test_delete_ends_a_life(spark):
    _, c = found(spark, [R(4, "A")], [W(1, "B", "p", "evil", "insert"), W(3, "D", "p", "evil")], [D(2, "C")])
    assert parents(c) == {("p", "D", "D", True, "time")}
    tables, c = found(spark, [R(4, "A")], [W(1, "B", "p", "evil", "insert")], [D(1, "C")])
    assert parents(c) == set()
    assert [r.col for r in unresolved(tables[0], tables[1], c).collect()] == ["p"]


def test_equal_time_is_seen(spark):
    _, c = found(spark, [R(1, "A")], [W(1, "B", "p", "x", "insert")])
    assert parents(c) == {("p", "B", "B", True, "time")}


def test_types_are_told_apart(spark):
    rows = [W(1, "B", "p", "1", "insert", kind="int"), W(2, "C", "p", "1", kind="str"), W(3, "D", "p", "1", kind="str")]
    _, c = found(spark, [R(4, "A")], rows)
    assert parents(c) == {("p", "D", "C", True, "time")}


@pytest.mark.parametrize(
    ("writes", "read", "expected"),
    [
        ([W(100, "B", "p", "x", "insert", 10), W(20, "C", "p", "y", xid=12)], R(50, "A", 11, 12), {("B", True, "2")}),
        ([W(1, "B", "p", "a", "insert", 90), W(2, "C", "p", "b", xid=102), W(3, "D", "p", "c", xid=104), W(4, "E", "p", "d", xid=105)], R(9, "A", 102, 106), {(x, False, "4") for x in "BCDE"}),
        ([W(1, "B", "p", "same", "insert", 90), W(2, "C", "p", "same", xid=120)], R(9, "A", 100, 150), {("B", True, "3")}),
        ([W(1, "C", "p", "x", "insert", 120)], R(9, "A", 100, 150), {("C", True, "1")}),
        ([W(1, "C", "p", "x", xid=102), W(2, "D", "p", "y", xid=104), W(3, "E", "p", "z", xid=105)], R(9, "A", 102, 106), {(x, False, "1w") for x in "CDE"}),
        ([W(1, "B", "p", "x", "insert", 90), W(2, "A", "p", "y", xid=120)], R(9, "A", 100, 150), {("A", True, "0")}),
    ],
)
def test_snapshot_rules(spark, writes, read, expected):
    _, c = found(spark, [read], writes)
    assert {(p, certain, rule) for _, _, p, certain, rule in parents(c)} == expected


def test_observed_value_settles_a_pair(spark):
    _, c = found(spark, [R(9, "A", 100, 150)], [W(1, "B", "p", "a", "insert", 90), W(2, "C", "p", "b", xid=120)])
    seen = match_observed(c.withColumn("seen_type", F.lit("str")).withColumn("seen_text", F.lit("b")))
    assert parents(seen) == {("p", "C", "C", True, "observed")}


def test_repeated_reads_count_once(spark):
    _, c = found(spark, [R(4, "A", seq=1), R(5, "A", seq=2)], [W(1, "B", "p", "x", "insert")])
    assert [r.read_seq for r in dedupe_candidates(c).collect()] == [1]


def test_empty_logs(spark):
    _, c = found(spark, [], [])
    assert c.count() == 0
    root = spark.createDataFrame([("A",)], "rid string")
    assert [r.rid for r in trace(links(c), root)[0].collect()] == ["A"]


def brute(reads, writes, deletes):
    out = set()
    for rid, _, pk, seq, time, _, _ in reads:
        for col in {w[3] for w in writes if w[2] == pk}:
            history = sorted((w for w in writes if w[2] == pk and w[3] == col), key=lambda w: (w[7], w[9], w[10]))
            latest = [i for i, w in enumerate(history) if w[7] <= time]
            if not latest or any(d[2] == pk and history[latest[-1]][7] <= d[3] <= time for d in deletes):
                continue
            i = latest[-1]
            while i and history[i][4] != "insert" and history[i][5:7] == history[i - 1][5:7] and not any(d[2] == pk and history[i - 1][7] <= d[3] < history[i][7] for d in deletes):
                i -= 1
            out.add((rid, pk, col, seq, history[latest[-1]][0], history[i][0]))
    return out


def test_random_logs(spark):
    dice = random.Random(4)
    writes, deletes, reads = [], [], []
    for i in range(400):
        t, pk = START + timedelta(seconds=dice.randrange(120)), str(dice.randrange(12))
        kind = dice.random()
        if kind < 0.5:
            writes.append((f"w{i}", "items", pk, dice.choice("pq"), dice.choice(["insert", "update", "update"]), "int", str(dice.randrange(2)), t, None, 0, i))
        elif kind < 0.6:
            deletes.append((f"d{i}", "items", pk, t, None, 0, i))
        else:
            reads.append((f"r{i}", "items", pk, i, t, None, None))
    _, c = found(spark, reads, writes, deletes)
    got = {(r.rid, r.pk, r.col, r.read_seq, r.version.rid, r.version.origin_rid) for r in c.collect()}
    assert got == brute(reads, writes, deletes)


def test_runs_number_raw_changes(spark):
    rows = spark.createDataFrame([W(1, "B", "p", "a", "insert", 1), W(2, "C", "p", "a", xid=2), W(3, "D", "p", "a", "insert", 3)], WRITES)
    none = spark.createDataFrame([], DELETES)
    assert [r.raw_run for r in versions(rows, none, "xid").orderBy("xid").collect()] == [1, 1, 2]


def brute_history(writes, deletes, key):
    """(rid, pos, raw_run, raw origin, origin, next delete, last in its transaction) of every write, one cell at a time."""
    out = {}
    for pk, col in {(w[2], w[3]) for w in writes}:
        mine = sorted((w for w in writes if (w[2], w[3]) == (pk, col)), key=lambda w: (w[key], w[9], w[10]))
        dead = sorted(d[key - 4] for d in deletes if d[2] == pk)
        run, raw, life = 0, None, None
        for i, w in enumerate(mine):
            before = mine[i - 1] if i else None
            begins = before is None or w[4] == "insert" or before[5:7] != w[5:7]
            run += begins
            raw = w[0] if begins else raw
            life = w[0] if begins or any(before[key] <= d < w[key] for d in dead) else life
            after = mine[i + 1][8] if i + 1 < len(mine) else None
            out[w[0], col] = (i + 1, run, raw, life, next((d for d in dead if d >= w[key]), None), i + 1 == len(mine) or after != w[8])
    return out


@pytest.mark.parametrize(("key", "segments"), [("time", 5), ("xid", 64), ("xid", 1)])
def test_segments_of_a_hot_cell(spark, key, segments):
    dice = random.Random(segments)
    writes, deletes = [], []
    for i in range(500):
        pk, at = "hot" if dice.random() < 0.8 else str(dice.randrange(5)), dice.randrange(160)
        if dice.random() < 0.85:
            writes.append((f"w{i}", "items", pk, "p" if dice.random() < 0.9 else "q", dice.choice(["insert"] + ["update"] * 9), dice.choice(["int", "str"]), str(dice.randrange(2)), START + timedelta(seconds=at), at, i % 3, i))
        else:
            deletes.append((f"d{i}", "items", pk, START + timedelta(seconds=at), at, i % 3, i))
    rows = versions(spark.createDataFrame(writes, WRITES), spark.createDataFrame(deletes, DELETES), key, segments=segments).collect()
    got = {(r.rid, r.col): (r.pos, r.raw_run, r.raw_origin.rid, r.origin.rid, r.next_delete, r.is_last_in_xid) for r in rows}
    assert got == brute_history(writes, deletes, 7 if key == "time" else 8)
    by_pos = {(r.pk, r.col, r.pos): r.rid for r in rows}
    assert all(by_pos[r.pk, r.col, r.origin.pos] == r.origin.rid and by_pos[r.pk, r.col, r.raw_origin.pos] == r.raw_origin.rid for r in rows)


def _random_log(seed):
    dice, writes, deletes = random.Random(seed), [], []
    for i in range(600):
        pk, at = "hot" if dice.random() < 0.7 else str(dice.randrange(5)), dice.randrange(160)
        if dice.random() < 0.85:
            writes.append((f"w{i}", "items", pk, "p" if dice.random() < 0.9 else "q", dice.choice(["insert"] + ["update"] * 9), dice.choice(["int", "str"]), str(dice.randrange(2)), START + timedelta(seconds=at), at, i % 3, i))
        else:
            deletes.append((f"d{i}", "items", pk, START + timedelta(seconds=at), at, i % 3, i))
    return writes, deletes


@pytest.mark.parametrize(("key", "most"), [("time", 0), ("xid", 0), ("xid", 100)])
def test_only_crowded_cells_are_cut(spark, key, most):
    writes, deletes = _random_log(most + len(key))
    w, d = spark.createDataFrame(writes, WRITES), spark.createDataFrame(deletes, DELETES)
    rows = versions(w, d, key, segments=7, most=most).collect()
    got = {(r.rid, r.col): (r.pos, r.raw_run, r.raw_origin.rid, r.origin.rid, r.next_delete, r.is_last_in_xid) for r in rows}
    assert got == brute_history(writes, deletes, 7 if key == "time" else 8) and len(rows) == len(writes)
    assert versions(w, d, key).dtypes == versions(w, d, key, most=most).dtypes


def test_cells_that_are_not_crowded_carry_nothing(spark):
    """One look at each history: no segments that are summed up and joined back."""
    writes, deletes = _random_log(3)
    plan = versions(spark.createDataFrame(writes, WRITES), spark.createDataFrame(deletes, DELETES), "xid")._jdf.queryExecution().optimizedPlan().toString()
    assert "segment" not in plan and "max_by" not in plan


@pytest.mark.parametrize("inclusive", [True, False])
def test_lookups_in_crowded_and_other_cells(spark, inclusive):
    writes, _ = _random_log(9)
    dice = random.Random(4)
    history = spark.createDataFrame(writes, WRITES).withColumn("pos", F.col("line"))
    asked = [(i, "items", dice.choice(["hot", "0", "1", "4", "none"]), dice.choice("pq"), dice.choice([None, -5, 500] + list(range(160)))) for i in range(300)]
    probes = spark.createDataFrame(asked, "n long, tbn string, pk string, col string, at long")
    for most in (0, 100, 10**6):
        hot = crowded(CELL, probes, history, most=most)
        assert hot is None if most == 10**6 else hot.count() > 0
        found = {r.n: r.found and r.found.rid for r in as_of(probes, history, CELL, "at", "xid", inclusive=inclusive, hot=hot).collect()}
        assert len(found) == len(asked)
        for n, _, pk, col, at in asked:
            fits = [w for w in writes if (w[2], w[3]) == (pk, col) and at is not None and (w[8] <= at if inclusive else w[8] < at)]
            assert found[n] == (max(fits, key=lambda w: (w[8], w[10]))[0] if fits else None)


def test_windows_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(resolve, "WINDOW", 4)
    writes = [W(i, f"w{i}", "p", str(i % 3), "update", xid=i // 2, seq=i % 2) for i in range(120)]
    reads = [R(500 + i, f"r{i}", lower, lower + wide, seq=i) for i, (lower, wide) in enumerate([(1, 7), (0, 60), (10, 11), (59, 90), (30, 0), (7, 25)])]
    _, c = found(spark, reads, writes, [D(31, "d", xid=15)])
    got = {(r.rid, r.version.rid) for r in c.collect() if r.rule in ("4", "1w") and r.version.rid == r.version.origin_rid and reads[int(r.rid[1:])][5] <= r.version.xid}
    assert got == {(r[0], f"w{2 * x + 1}") for r in reads for x in range(60) if r[5] <= x < r[6] and r[6] - r[5] > 1}


SEEN = READS + ", seen map<string,struct<vtype:string,vtext:string>>"


def test_reads_that_tell_what_they_saw(spark):
    writes = [W(1, "B", "p", "a", "insert", 90), W(2, "C", "p", "b", xid=120), W(3, "D", "p", "b", xid=130, kind="int"), W(2, "C", "q", "z", xid=121)]
    see = lambda text, col="p", kind="str": {col: (kind, text)}
    reads = [
        (*R(9, "one", 100, 150), see("b")), (*R(9, "typed", 100, 150), see("b", kind="int")), (*R(9, "low", 100, 150), see("a")), (*R(9, "none", 100, 150), see("x")),
        (*R(9, "unknown", 100, 150), see("x", "elsewhere")), (*R(0, "early"), see("a")), (*R(9, "timed"), see("b", kind="int")), (*R(9, "timed_no"), see("a")), (*R(9, "blind", 100, 150), None),
        ("lost", "other", "7", 0, START, None, None, None), (*R(9, "empty", 100, 150), {}),
    ]
    resolved = resolve.resolve_reads(spark.createDataFrame(reads, SEEN), spark.createDataFrame(writes, WRITES), spark.createDataFrame([], DELETES))
    got = {(r.rid, r.col, r.version.rid, r.certain, r.rule) for r in resolve.candidates_of(resolved).collect()}
    assert got == {
        ("one", "p", "C", True, "observed"), ("typed", "p", "D", True, "observed"), ("low", "p", "B", True, "observed"), ("timed", "p", "D", True, "time"),
        *[("blind", "p", w, False, "4") for w in "BCD"], ("blind", "q", "C", False, "1w"),
    }
    assert {(r.rid, r.col, r.reason) for r in resolve.unresolved_reads(resolved).collect()} == {
        ("none", "p", resolve.NO_MATCH), ("unknown", "elsewhere", resolve.NOT_BEFORE_SNAPSHOT), ("early", "p", resolve.NOT_BEFORE_READ), ("timed_no", "p", resolve.NO_MATCH), ("lost", None, resolve.NO_HISTORY),
    }


def test_a_read_repeated_with_another_value_is_another_read(spark):
    writes = [W(1, "B", "p", "a", "insert", 90), W(2, "C", "p", "b", xid=120)]
    reads = [(*R(9, "A", 100, 150), {"p": ("str", t)}) for t in "abb"]
    c = request_candidates(spark.createDataFrame(reads, SEEN), spark.createDataFrame(writes, WRITES), spark.createDataFrame([], DELETES))
    assert {(r.version.rid, r.certain) for r in c.collect()} == {("B", True), ("C", True)} and c.count() == 2


def test_both_bounds_take_one_shuffle(spark):
    """And give the same versions whether cells count as crowded or not."""
    writes, deletes = _random_log(5)
    dice = random.Random(6)
    bound = lambda: dice.choice([None, *range(-5, 170)])
    reads = [(f"r{i}", "items", dice.choice(["hot", "0", "1", "none"]), i, START, bound(), bound()) for i in range(200)]
    w = spark.createDataFrame(writes, WRITES)
    history = materialise(versions(w, spark.createDataFrame(deletes, DELETES), "xid"), "history")
    cells = materialise(resolve.read_cells(spark.createDataFrame(reads, READS), w).filter("col is not null"), "read-cells")
    assert resolve.snapshot_bounds(cells, history)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    shown = ["rid", *CELL, "window_start", "window_end", "low", "high"]
    found = {most: sorted(map(str, resolve.snapshot_bounds(cells, history, most).select(shown).collect())) for most in (0, 100, 10**6)}
    assert found[0] == found[100] == found[10**6] and len(found[0]) == cells.count()


def test_only_rows_read_again_are_compared(spark):
    reads = spark.createDataFrame([R(4, "A", seq=1), R(5, "A", seq=2), R(4, "B", seq=3)], READS)
    writes = spark.createDataFrame([W(1, "C", "p", "x", "insert")], WRITES)
    resolved = resolve.resolve_reads(reads, writes, spark.createDataFrame([], DELETES))
    assert {(r.read_seq, r.again) for r in resolved.collect()} == {(1, True), (2, True), (3, False)}
    assert sorted((r.rid, r.read_seq) for r in resolve.candidates_of(resolved).collect()) == [("A", 1), ("B", 3)]


def test_a_pair_with_a_link_that_is_not_gray_is_followed(spark):
    """Links of a pair are read as they are written, not brought together first."""
    shape = "child string, tbn string, pk string, col string, parent string, certain boolean"
    made = [("A", "t", "1", "p", "B", True), ("B", "t", "2", "p", "C", True), ("B", "t", "3", "p", "C", True), ("C", "t", "2", "p", "D", True), ("C", "t", "3", "p", "E", False)]
    policy, root = spark.createDataFrame([("t", "2", True)], "tbn string, pk string, gray boolean"), spark.createDataFrame([("A",)], "rid string")
    visited, shown = trace(spark.createDataFrame(made, shape), root, policy=policy)
    assert {(r.rid, r.level) for r in visited.collect()} == {("A", 0), ("B", 1), ("C", 2)} and shown.count() == 5


def test_rows_side_by_side_find_what_histories_find(spark):
    """In one shuffle of whole rows; crowded rows are looked up in written histories, with the same result."""
    writes, deletes = _random_log(7)
    dice = random.Random(8)
    bound = lambda: dice.choice([None, *range(-5, 170)])
    reads = [(f"r{i % 90}", "items", dice.choice(["hot", "0", "1", "none"]), i, START, bound(), bound()) for i in range(200)]
    logs = spark.createDataFrame(reads, READS), spark.createDataFrame(writes, WRITES), spark.createDataFrame(deletes, DELETES)
    whole = resolve.found_rows(*logs)[0]
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    shown = lambda df: sorted(map(str, df.drop("window_start", "window_end").collect()))
    found = {most: shown(resolve.found_rows(*logs, most)[0]) for most in (0, 100)}
    assert shown(whole) == found[0] == found[100]


def test_lines_of_a_read_log_are_parsed_once(spark):
    lines = spark.createDataFrame([(0, '{"rid":"a","tbn":"t","time":"2024-01-01 00:00:00","pk":1,"cells":{"c":2}}'), (1, '{"rid":"b"}')], "line long, value string")
    good, bad = sources.read_log(lines, mode="quarantine")
    assert [(r.rid, r.pk, r.seq, r.seen["c"].vtext) for r in good.collect()] == [("a", "1", 0, "2")] and [(r.line, r.value, r.error) for r in bad.collect()] == [(1, '{"rid":"b"}', "no table name")]
    assert not any("from_json" in df._jdf.queryExecution().executedPlan().toString() for df in (good, bad))
