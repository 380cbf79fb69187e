"""Ids in text, and what is written."""

import json

import pytest
from pyspark.sql import functions as F

from backtide.operators import evaluate, export
from backtide.sources import labels, logs, tables


def numbered(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "line long, value string")


def test_ids_in_output(spark):
    rows = labels.ids_in_output(numbered(spark, "X-Request-Id: abc-1, then GET -> 200 def_2", "request id = abc-1", "-> 302 none", "Request-Id 123", "-> 200 last.9;")).orderBy("line", "rid").collect()
    assert [(r.rid, r.line, r.is_root) for r in rows] == [("abc-1", 0, False), ("def_2", 0, False), ("last.9", 4, True)]


def test_graph_round_trip(spark):
    links = spark.createDataFrame([("A", "B", "t", "1", "c", True), ("A", "B", "t", "1", "d", False), ("B", "C", "t", "2", "c", True)], "child string, parent string, tbn string, pk string, col string, certain boolean")
    dag = evaluate.collapsed_dag(links)
    assert {(r.child, r.label, r.uncertain) for r in dag.collect()} == {("A", "2 cells", True), ("B", "t.2.c", False)}
    drawn = export.graph_lines(dag).select(F.lit(0).alias("line"), F.col("line").alias("value"))
    assert {r.rid for r in labels.ids_in_graph(drawn).collect()} == {"A", "B", "C"}


def test_policy_document(spark):
    own = spark.createDataFrame([("s", True), ("t", False)], "tbn string, block boolean")
    rows = spark.createDataFrame([("a", "1", "block"), ("a", "2", "gray"), ("a", "3", "keep")], "tbn string, pk string, verdict string")
    document = export.policy_document(own, rows, spark.createDataFrame([(0.2, 0.3)], "tc double, te double"))
    assert json.loads(document.first().value)["gray_rows"] == ["a[2]"]
    back_tables, back_rows = logs.policy_file(document.withColumn("line", F.lit(0)))
    assert [r.tbn for r in back_tables.collect()] == ["s"] and {tuple(r) for r in back_rows.collect()} == {("a", "1", "block"), ("a", "2", "gray")}


def test_merge_and_write(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text('{"rid":"1","time":"t","method":"GET","path":"/"}\n{"rid":null}\n')
    merged = labels.merge_requests(spark, str(tmp_path / "logs"))
    assert [r.rid for r in merged.collect()] == ["1"]
    export.write_trace(str(tmp_path / "out"), kind="json", requests=merged)
    assert spark.read.json(str(tmp_path / "out" / "requests")).count() == 1
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.jsonl").write_text("")
    with pytest.raises(ValueError, match="no requests"):
        labels.merge_requests(spark, str(tmp_path / "empty"))


def test_row_graph(spark):
    links = spark.createDataFrame([("C", "t", '1"', "B", "2024-01-01 00:00:09", "2024-01-01 00:00:05"), ("B", "u", "2", "A", "2024-01-01 00:00:04", "2024-01-01 00:00:01")], "child string, tbn string, pk string, parent string, read_time string, write_time string")
    root = spark.createDataFrame([("C",)], "rid string")
    assert {tuple(r) for r in export.request_times(links).collect()} == {("C", "2024-01-01 00:00:09"), ("B", "2024-01-01 00:00:04"), ("A", "2024-01-01 00:00:01")}
    drawn = {r.line for r in export.row_graph_lines(links, root).collect()}
    assert len(drawn) == 3 + 2 * 3
    assert '"R:C" [label="R:C\\n2024-01-01 00:00:09", shape=doubleoctagon];' in drawn and '"R:B" -> "D:t[1\\"]#C" [label="WRITE"];' in drawn and '"D:t[1\\"]#C" -> "R:C" [label="READ"];' in drawn
    alone = export.row_graph_lines(links.limit(0), root).collect()
    assert [r.line for r in alone] == ['"R:C" [label="R:C", shape=doubleoctagon];']


def test_policy_files(spark, tmp_path):
    reads = spark.createDataFrame([("a", "t", "1"), ("a", "t", "2"), ("x", "t", "1")], "rid string, tbn string, pk string")
    requests = spark.createDataFrame([("a", "get", "/p/1"), ("b", "GET", "/p/2")], "rid string, method string, path string")
    profile = export.policy_profile(reads, reads.limit(1), requests)
    assert profile.first().asDict() == {"request_count": 2, "endpoint_template_count": 1, "read_event_count": 2, "sampled_root_count": 1, "write_event_count": 1, "trace_depth": 4}
    own, rows = spark.createDataFrame([("t", True)], "tbn string, block boolean"), spark.createDataFrame([("t", "1", "gray")], "tbn string, pk string, verdict string")
    export.write_policy(str(tmp_path / "p"), own, rows, spark.createDataFrame([(0.2,)], "tc double"), profile)
    document = json.loads(spark.read.text(str(tmp_path / "p" / "policy")).first().value)
    assert (document["block_tables"], document["gray_rows"], document["thresholds"]) == (["t"], ["t[1]"], {"tc": 0.2})
    assert spark.read.json(str(tmp_path / "p" / "row_metrics")).count() == 1 and spark.read.json(str(tmp_path / "p" / "profile")).first().request_count == 2


def test_monitored_tables(spark):
    keys = spark.createDataFrame([("public", "a", "second", 2), ("public", "a", "first", 1), ("s", "b", "id", 1)], "schema string, table string, column string, position int")
    assert tables.as_dict(tables.first_key_columns(keys)) == {"public.a": "first", "s.b": "id"}
    lines = spark.createDataFrame([('{"public.a": "id", "public.b": "", "c": null}',), ("no json",)], "value string")
    assert tables.as_dict(tables.tables_file(lines)) == {"public.a": "id"}
    with pytest.raises(ValueError, match="more than 1"):
        tables.as_dict(tables.first_key_columns(keys), most=1)


def test_strategies_of_runs(spark):
    rows = [("x", "p", 2, 10), ("x", "f", 5, 10), ("y", "p", 4, 8), ("y", "f", 4, 8), ("z", "p", 9, 9), ("z", "f", 3, 9), ("only", "p", 1, 2)]
    got = evaluate.compare_strategies(spark.createDataFrame(rows, "run string, strategy string, budget long, total long"), "p", "f").first()
    assert (got.first_wins, got.ties, got.second_wins, got.macro_delta) == (1, 1, 1, 1.0) and got.weighted_reduction == pytest.approx(1 - 15 / 27)
    links = spark.createDataFrame([("A", "B", True, 1), ("B", "C", True, 3), ("B", "D", False, 2)], "child string, parent string, certain boolean, rank long")
    gold = spark.createDataFrame([("A",), ("C",)], "rid string")
    assert [(r.budget, r.predicted, r.tp) for r in evaluate.links_curve(links, "A", gold, [0, 1, 2, 3]).orderBy("budget").collect()] == [(0, 1, 1), (1, 2, 1), (2, 2, 1), (3, 3, 2)]
