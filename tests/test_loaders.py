"""Line numbers and sequence numbers of logs that lie in many splits."""

import json

import pytest

from backtide.sources import logs


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    texts = [[f"{name}-{i} {'x' * (i * 37 % 90)}" if i % 10 else "" for i in range(n)] for name, n in (("a", 300), ("b", 5), ("c", 700), ("d", 0))]
    for name, lines in zip("abcd", texts, strict=True):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{x}\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = sorted((r.line, r.value) for r in logs.numbered_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, x) for i, x in enumerate([x for lines in texts for x in lines]) if x]


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_missing_numbers_count_the_events_before(spark, monkeypatch, size):
    monkeypatch.setattr(logs, "RANGE", size)
    records = [{"rid": f"r{i}", "tbn": "t", "time": "2024-01-01 00:00:00", "pks": list(range(i % 4 + 1)), **({"seq": 1000 + i} if i % 3 == 0 else {})} for i in range(40)]
    lines = spark.createDataFrame([(i * 2, json.dumps(r)) for i, r in enumerate(records)], "line long, value string").repartition(3)
    reads, _ = logs.read_log(lines)
    want, events = {}, 0
    for r in records:
        want[r["rid"]] = r.get("seq", events)
        events += len(r["pks"])
    assert {(r.rid, r.pk): r.seq for r in reads.collect()} == {(r["rid"], str(k)): want[r["rid"]] for r in records for k in r["pks"]}


def test_row_accesses_tell_their_bad_lines(spark):
    good = {"rid": "a", "tbn": "S.T", "time": "2024-01-01 00:00:00"}
    texts = [json.dumps(good | {"pk": 5}), json.dumps(good | {"pks": [1, "x"], "op": "DELETE"}), json.dumps(good), "no json"]
    lines = spark.createDataFrame(list(enumerate(texts)), "line long, value string")
    rows, bad = logs.row_accesses(lines, mode="quarantine")
    assert {(r.tbn, r.pk, r.event) for r in rows.collect()} == {("t", "5", "select"), ("t", "1", "delete"), ("t", "x", "delete")}
    assert [(r.line, r.error) for r in bad.orderBy("line").collect()] == [(2, "no primary key"), (3, "no request id")]
    rows, bad = logs.row_accesses(lines, arrays_only=True, mode="quarantine")
    assert rows.count() == 2 and [r.error for r in bad.orderBy("line").collect()] == ["pks is no array"] * 3
    with pytest.raises(ValueError, match="line 3: no primary key"):
        logs.row_accesses(lines)
