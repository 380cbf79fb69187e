"""Names, logs, policies, search, scores and change streams."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from backtide.functions.normalize import column_name, identity, path_template, same_value, table_name, value_text, value_type
from backtide.operators import evaluate, selection, taint
from backtide.plans import search, trace
from backtide.sources import logs
from backtide.streaming import cdc


def lines(spark, *records):
    return spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "line long, value string")


def test_names_and_templates(spark):
    rows = spark.createDataFrame([(" public.App.Users ", " Col.A ", "/project/123/item/550e8400-e29b-41d4-a716-446655440000?q=x")], "t string, c string, p string")
    got = rows.select(table_name(F.col("t")), table_name(F.col("t"), True), column_name(F.col("c")), path_template(F.col("p"))).first()
    assert tuple(got) == ("users", "Users", "col.a", "/project/{id}/item/{uuid}")
    paths = spark.createDataFrame([("/a/",), ("",), (None,), ("/x/0123456789abcdef",), ("/x/" + "z" * 24,)], "p string")
    assert [r[0] for r in paths.select(path_template(F.col("p"))).collect()] == ["/a", "/", "/", "/x/{token}", "/x/{token}"]


def test_values_of_different_types_differ(spark):
    texts = ["1", "1.0", '"1"', "true", "null", "[1]", '{"b":1,"a":2}', '{"a":2,"b":1}']
    v = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.parse_json("t").alias("v")).select("i", value_type(F.col("v")).alias("k"), value_text(F.col("v")).alias("x"))
    pairs = v.alias("a").join(v.alias("b"), F.col("a.i") < F.col("b.i")).filter(same_value(F.col("a.k"), F.col("a.x"), F.col("b.k"), F.col("b.x")))
    assert [(r[0], r[3]) for r in pairs.collect()] == [(6, 7)]


def test_identity_ladder(spark):
    rows = spark.createDataFrame([("u", "a", "c", "1"), (None, "a", "c", "2"), ("", None, "c", "3"), (None, None, None, "4")], "l string, a string, c string, r string")
    got = [r[0] for r in rows.select(identity(F.col("l"), F.col("a"), F.col("c"), F.col("r"))).collect()]
    assert got[:2] == ["u", "a"] and got[2].startswith("session:") and len(got[2]) == 32 and got[3] == "request:4"


def test_read_log(spark):
    good, bad = logs.read_log(lines(spark, {"time": "2026-01-01T00:00:03Z", "rid": " A ", "tbn": "public.Items", "pks": [1, "2"]}, {"timestamp": "2026-07-29 12:32:03.144956+00", "request_id": "B", "table_name": "t", "pk": 7, "xmin": 1, "xmax": 2, "cells": {"C": 1}}))
    got = [(r.rid, r.tbn, r.pk, r.seq, r.xmin) for r in good.orderBy("line", "pk").collect()]
    assert got == [("A", "items", "1", 0, None), ("A", "items", "2", 0, None), ("B", "t", "7", 2, 1)]
    assert bad.count() == 0
    for broken in ({"rid": "A", "tbn": "t", "pk": 1}, {"time": "2026-01-01", "rid": "A", "tbn": "t", "pk": 1, "xmin": 3}, {"time": "2026-01-01", "rid": "A", "tbn": "t", "pk": 1, "xmin": 3, "xmax": 2}, "no json"):
        assert logs.read_log(lines(spark, broken), mode="quarantine")[1].count() == 1
        with pytest.raises(ValueError, match="line 1"):
            logs.read_log(lines(spark, broken))


def test_write_log(spark):
    base = {"time": "2026-01-01", "rid": "A", "tbn": "t"}
    writes, deletes, _ = logs.write_log(lines(spark, base | {"pk": 1, "cells": [{"col": "a", "new": 1}, {"col": "A", "value": 2}, {"col": "b", "new": None}]}, base | {"pks": [1, 2], "op": "DELETE"}, base | {"pk": 3, "cells": {"c": "x"}, "xid": 9}))
    assert sorted((r.pk, r.col, r.vtype, r.vtext, r.seq) for r in writes.collect()) == [("1", "a", "int", "2", 0), ("1", "b", "null", "null", 0), ("3", "c", "str", '"x"', 4)]
    assert sorted(r.pk for r in deletes.collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="legacy row-level log"):
        logs.write_log(lines(spark, base | {"pk": 1}))


def test_contexts_that_differ(spark):
    a = {"rid": "A", "user_id": "u", "method": "get", "route": "/x"}
    good, _ = logs.context_log(lines(spark, a, a))
    assert [tuple(r) for r in good.collect()] == [("A", "u", "GET /x")]
    with pytest.raises(ValueError, match="same RID"):
        logs.context_log(lines(spark, a, a | {"route": "/y"}))


def test_gold_and_policy_files(spark):
    gold = logs.gold_labels(lines(spark, {"scene": "s", "root_rid": None, "rids": [{"rid": "A"}, "B"]}))
    assert {(r.rid, r.is_root) for r in gold.collect()} == {("A", False), ("B", True)}
    tables, rows = logs.policy_file(lines(spark, {"block_tables": ["t"], "block_rows": ["a[b[1]]"], "gray_rows": []}))
    assert [r.tbn for r in tables.collect()] == ["t"] and [tuple(r) for r in rows.collect()] == [("a", "b[1]", "block")]


def test_cycles_end_and_gray_rows_stop(spark):
    edges = spark.createDataFrame([("A", "B", False), ("B", "C", False), ("C", "A", False), ("C", "D", True)], "child string, parent string, root_only boolean")
    root = spark.createDataFrame([("A",)], "rid string")
    assert {(r.rid, r.level) for r in trace.reach(edges, root).collect()} == {("A", 0), ("B", 1), ("C", 2)}


def test_a_long_search_reads_few_tables(spark, monkeypatch):
    kept, sizes = trace.materialise, []
    monkeypatch.setattr(trace, "materialise", lambda df, name: sizes.append(len({f.rsplit("/", 1)[0] for f in df.inputFiles()})) or kept(df, name))
    edges = spark.range(30).select(F.col("id").cast("string").alias("child"), F.col("id").alias("n")).select("child", F.explode(F.array(F.col("n") + 1, F.col("n") + 2, F.col("n") - 1).cast("array<string>")).alias("parent"), F.lit(False).alias("root_only"))
    found = trace.reach(edges, spark.createDataFrame([("29",)], "rid string"))
    assert {(r.rid, r.level) for r in found.collect()} == {("29", 0), ("30", 1), ("31", 1), *((str(29 - n), n) for n in range(1, 31))}
    assert max(sizes) <= trace.TOGETHER + 3


def test_even_sample(spark):
    rows = spark.range(10).withColumnRenamed("id", "n")
    for k, expected in ((1, [9]), (4, [0, 3, 6, 9]), (20, list(range(10)))):
        assert sorted(r.n for r in selection.sample_evenly(rows, "n", k).collect()) == expected


def test_best_first_budget(spark):
    schema = "rid string, tbn string, pk string, col string, read_seq long, read_time string, attributions array<struct<seq:long,certain:boolean,parent:string,xid:long>>, priority double"
    tasks = spark.createDataFrame([("ROOT", "t", "1", "hot", 0, "1", [(0, True, "H", 1)], 0.1), ("ROOT", "t", "2", "payload", 1, "2", [(0, True, "ATTACK", 1)], 0.9), ("ATTACK", "t", "3", "x", 0, "1", [(0, False, "Z", 1)], 0.5)], schema)
    one = search.best_first(tasks, "ROOT", budget=1)
    assert [x["parent"] for x in one.links] == ["ATTACK"] and one.pending == 2
    whole = search.best_first(tasks, "ROOT")
    assert len(whole.taken) == 3 and whole.links[: len(one.links)] == one.links
    assert [t["col"] for t in search.best_first(tasks, "ROOT", order="fifo").taken] == ["hot", "payload", "x"]
    with pytest.raises(ValueError, match="budget"):
        search.best_first(tasks, "ROOT", budget=-1)


def test_scores_and_areas(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "rid string")
    s = evaluate.scores(evaluate.compare_sets(ids("a", "b", "c"), ids("b", "c", "d"))).first()
    assert (s.tp, s.fp, s.fn, round(s.f1, 4)) == (2, 1, 1, 0.6667)
    curve = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 1.0)], "x int, y double")
    assert evaluate.curve_area(curve, "x", "y").first().area == 0.75
    assert evaluate.checkpoints(250) == [2, 12, 25, 62, 125, 188, 250]


def test_markers_and_judges(spark):
    rows = spark.createDataFrame([(1, "<SCRIPT>x"), (2, "plain"), (3, None)], "i int, t string")
    got = rows.select(taint.judge_cell_text(F.col("t")).alias("c"), taint.judge_row_text(F.col("t")).alias("r")).collect()
    assert [(g.c.tainted, g.c.confidence, g.r.confidence) for g in got] == [(True, "high", "medium"), (False, "medium", "high"), (False, "medium", "high")]
    with pytest.raises(Exception, match="decisions"):
        taint.judge_batches(rows, ["t"], lambda batch: []).collect()
    replies = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("none",)], "r string")
    assert [r[0] for r in replies.select(taint.fenced_json(F.col("r"))).collect()] == ['{"a": 1}', None]


CHANGE = [
    {"kind": "message", "prefix": "request", "content": '{"request_id":"R1"}'},
    {"kind": "insert", "schema": "public", "table": "Items", "columnnames": ["id", "a"], "columnvalues": [1, "x"]},
    {"kind": "update", "schema": "public", "table": "Items", "columnnames": ["id", "a", "b"], "columnvalues": [1, "y", None], "oldkeys": {"keynames": ["id", "a"], "keyvalues": [1, "x"]}},
    {"kind": "update", "schema": "public", "table": "Items", "columnnames": ["id", "a"], "columnvalues": [2, "y"], "oldkeys": {"keynames": ["id", "a"], "keyvalues": [1, "y"]}},
    {"kind": "delete", "schema": "public", "table": "Items", "oldkeys": {"keynames": ["id"], "keyvalues": [2]}},
    {"kind": "insert", "schema": "public", "table": "other", "columnnames": ["id"], "columnvalues": [1]},
]
EXPECTED = [(0, "insert", "1", {"id": "1", "a": '"x"'}), (1, "update", "1", {"a": '"y"'}), (2, "delete", "1", {}), (2, "insert", "2", {"id": "2", "a": '"y"'}), (3, "delete", "2", {})]


def test_cell_changes(spark):
    txns = [{"xid": 5, "timestamp": "2026-01-01 00:00:00+00", "change": CHANGE}, {"xid": "bad", "change": CHANGE[:2]}, {"xid": 6, "change": CHANGE[1:]}]
    got = cdc.cell_changes(cdc.parse(lines(spark, *txns)), {"public.Items": "id"})
    assert sorted((r.seq, r.event, r.pk, r.cells) for r in got.filter("xid = 5").collect()) == sorted(EXPECTED, key=lambda x: x[:3])
    assert [(r.rid, r.pk) for r in got.filter("xid is null").collect()] == [("R1", "1")]
    batches = {(r.event, tuple(r.pks)) for r in cdc.row_changes(cdc.parse(lines(spark, txns[0])), {"public.Items": "id"}).collect()}
    assert batches == {("insert", ("1", "2")), ("update", ("1",)), ("delete", ("1", "2"))}


def test_change_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"xid": 5, "change": CHANGE}) + "\n")
    cdc.start_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), {"public.Items": "id"}).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == len(EXPECTED)


def test_even_sample_over_many_ranges(spark):
    items = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("at"), "id")
    wanted = sorted(r["at"] for r in items.collect())
    got = sorted(r["at"] for r in selection.sample_evenly(items, "at", 16).collect())
    assert got == [wanted[round(i * 4999 / 15)] for i in range(16)]


def test_judge_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "k string, n int")
    got = taint.judge_batches(rows, ["k"], lambda batch: [k == "a" for k in batch["k"]])
    assert sorted((r.n, r.tainted) for r in got.collect()) == [(1, False), (2, True), (3, False)]


def test_repeated_columns_and_escaped_keys_of_a_change(spark):
    change = {"kind": "insert", "schema": "public", "table": "t", "columnnames": ["ID", "v", " V"], "columnvalues": ['a"b', 1, 2]}
    message = {"kind": "message", "prefix": "request", "content": json.dumps({"request_id": "R"})}
    row = cdc.cell_changes(cdc.parse(lines(spark, {"xid": 1, "timestamp": "2026-01-01 00:00:00+00", "change": [message, change]})), {"public.t": "id"}).first()
    assert row.pk == 'a"b' and row.cells == {"id": json.dumps('a"b'), "v": "2"}


def test_judge_keeps_large_keys_beside_nulls(spark):
    rows = spark.createDataFrame([(9007199254740993, 1), (None, 2), (5, 3), (9007199254740993, 4)], "k long, n int")
    got = taint.judge_batches(rows, ["k"], lambda batch: [k is not pd.NA and k > 5 for k in batch["k"]])
    assert sorted((r.n, r.k, r.tainted) for r in got.collect()) == [(1, 9007199254740993, True), (2, None, False), (3, 5, False), (4, 9007199254740993, True)]


def test_row_stream(spark, tmp_path):
    extra = [
        {"kind": "update", "schema": "public", "table": "Items", "columnnames": ["a"], "columnvalues": ["z"], "oldkeys": {"keynames": ["a", "id"], "keyvalues": ["y", 7]}},
        {"kind": "delete", "schema": "public", "table": "Items", "oldkeys": {"keynames": ["a", "id"], "keyvalues": ["first", 7]}},
        {"kind": "delete", "schema": "public", "table": "Items", "oldkeys": {"keynames": ["a"], "keyvalues": ["no key"]}},
        {"kind": "truncate", "schema": "public", "table": "Items"},
    ]
    txns = [{"xid": 5, "change": CHANGE + extra}, {"xid": 6, "change": CHANGE[1:]}, {"xid": 7, "change": CHANGE[:1]}]
    want = {("insert", ("1",), ()), ("update", ("1", "2", "7"), (("1", "2"),)), ("delete", ("2", "first"), ())}
    got = cdc.row_stream(cdc.parse(lines(spark, *txns)), {"public.Items": "id"})
    assert {(r.event, tuple(r.pks), tuple(map(tuple, r.pk_changes))) for r in got.collect()} == want and {(r.rid, r.tbn) for r in got.collect()} == {("R1", "Items")}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, txns)) + "\n")
    stream = cdc.row_stream(cdc.parse(spark.readStream.format("text").load(str(tmp_path / "in"))), {"public.Items": "id"})
    stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.event, tuple(r.pks)) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {w[:2] for w in want}


def test_changes_of_wide_tables_take_linear_time(spark):
    names = ["id", *[f"c{i}" for i in range(500)]]
    message = {"kind": "message", "prefix": "request", "content": '{"request_id":"R"}'}
    change = {"kind": "update", "schema": "public", "table": "t", "columnnames": names, "columnvalues": [1, *range(500)], "oldkeys": {"keynames": names, "keyvalues": [1, *range(499), -1]}}
    twice = change | {"columnnames": [*names, " C0"], "columnvalues": [1, *range(500), "last"]}
    txns = [{"xid": i, "timestamp": "2026-01-01 00:00:00+00", "change": [message, change, twice]} for i in range(200)]
    began = time.monotonic()
    rows = cdc.cell_changes(cdc.parse(lines(spark, *txns)), {"public.t": "id"}).collect()
    assert time.monotonic() - began < 60
    assert len(rows) == 400 and {(r.seq, tuple(sorted(r.cells.items()))) for r in rows} == {(0, (("c499", "499"),)), (1, (("c0", '"last"'), ("c499", "499")))}


def test_replies_of_a_model(spark):
    good = json.dumps({"results": [{"index": 1, "tainted": False}, {"index": 0, "tainted": True}]})
    assert taint.strict_decisions(f"```json\n{good}\n```", 2) == [True, False]
    for bad in ("none", "{}", '{"results": [{"index": 0, "tainted": 1}, {"index": 1, "tainted": true}]}', '{"results": [{"index": 0, "tainted": true}, {"index": 0, "tainted": true}]}', '{"results": [{"index": true, "tainted": true}, {"index": 0, "tainted": true}]}'):
        with pytest.raises(ValueError):
            taint.strict_decisions(bad, 2)
    assert taint.lenient_decisions('{"results": [{"tainted": true}, 5]}', 3) == [True, False, False] and taint.lenient_decisions("{}", 1) == [False]
    calls = []

    def ask(batch):
        calls.append(len(batch))
        return "garbled" if len(calls) < 3 else good

    assert taint.asking(ask)(pd.DataFrame({"k": [1, 2]})) == [True, False] and len(calls) == 3
    with pytest.raises(RuntimeError, match="2 attempts"):
        taint.asking(lambda batch: "garbled", retries=1)(pd.DataFrame({"k": [1]}))
    rows = spark.createDataFrame([(i,) for i in range(5)], "k long")

    def model(batch):
        return json.dumps({"results": [{"index": n, "tainted": bool(k % 2)} for n, k in enumerate(batch["k"])]})

    assert {(r.k, r.tainted) for r in taint.judge_batches(rows, ["k"], taint.asking(model), 2).collect()} == {(k, k % 2 == 1) for k in range(5)}
