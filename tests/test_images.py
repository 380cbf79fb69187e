"""Judged row images with a memo, and paths with their ends."""

import json

from pyspark.sql import functions as F

from backtide.operators.taint import fenced_json
from backtide.plans import images, trace

READS = "rid string, tbn string, pk string, seq long, time timestamp_ntz"
IMAGES = "rid string, tbn string, pk string, event string, time timestamp_ntz, line long, cells map<string,string>"


def at(spark, rows, schema):
    plain = schema.replace("timestamp_ntz", "string")
    return spark.createDataFrame(rows, plain).withColumn("time", F.expr("cast(concat('2024-01-01 00:00:', time) as timestamp_ntz)"))


def counted(folder):
    """A judge that notes the payloads it sees; evil rows are tainted."""

    def judge(batch):
        with open(f"{folder}/seen", "a") as log:
            log.write("".join(f"{row}\n" for row in batch["row"]))
        return ["evil" in row for row in batch["row"]]

    return judge


def test_a_judge_sees_each_payload_once(spark, tmp_path):
    reads = at(spark, [("C", "t", "1", 1, "09"), ("C", "t", "2", 2, "09"), ("B", "t", "3", 3, "05"), ("C", "t", "1", 4, "10"), ("A", "t", "3", 5, "01")], READS)
    writes = at(spark, [
        ("B", "t", "1", "update", "06", 1, {"b": '"evil"', "a": "1"}), ("X", "t", "2", "insert", "06", 2, {"a": '"fine"'}), ("A", "t", "3", "insert", "02", 3, {'q"': '"evil"'}), ("Z", "t", "1", "update", "20", 4, {"a": '"evil"'}),
    ], IMAGES)
    root, memo = spark.createDataFrame([("C",)], "rid string"), str(tmp_path / "memo")
    for _ in range(2):
        reached, links = images.image_trace(reads, writes, root, counted(tmp_path), memo)
        assert {(r.rid, r.level) for r in reached.collect()} == {("C", 0), ("B", 1), ("A", 2)}
        assert {(r.child, r.parent, r.row, r.tainted) for r in links.collect()} == {
            ("C", "B", '{"a": 1, "b": "evil"}', True), ("C", "X", '{"a": "fine"}', False), ("B", "A", '{"q\\"": "evil"}', True)
        }
    assert sorted((tmp_path / "seen").read_text().splitlines()) == sorted(['{"a": 1, "b": "evil"}', '{"a": "fine"}', '{"q\\"": "evil"}'])
    assert json.loads('{"q\\"": "evil"}') == {'q"': "evil"}
    images.image_trace(reads, writes, root, counted(tmp_path), memo, name="another judge")
    assert len((tmp_path / "seen").read_text().splitlines()) == 6


def test_images_of_nothing(spark, tmp_path):
    none = at(spark, [], IMAGES)
    root = spark.createDataFrame([("C",)], "rid string")
    reached, links = images.image_trace(at(spark, [("C", "t", "1", 1, "09")], READS), none, root, counted(tmp_path), str(tmp_path / "memo"))
    assert [r.rid for r in reached.collect()] == ["C"] and links.count() == 0
    assert fenced_json(F.lit("x")) is not None


def brute_paths(edges, rid, path, longest):
    parents = sorted({p for c, p in edges if c == rid})
    if not parents:
        return [(tuple(path), "leaf")]
    out = []
    for p in parents:
        if p in path:
            out.append(((*path, f"(cycle: {p})"), "cycle"))
        elif len(path) > longest:
            out.append((tuple(path), "cut"))
        else:
            out += brute_paths(edges, p, [*path, p], longest)
    return out


def test_paths_tell_how_they_end(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("b", "b"), ("f", "g")]
    table, root = spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame([("a",)], "rid string")
    for longest in (1, 3, 12):
        got = {(tuple(r.path), r.ended) for r in trace.paths_with_ends(table, root, longest).collect()}
        assert got == set(brute_paths(edges, "a", ["a"], longest))
    alone = trace.paths_with_ends(table, spark.createDataFrame([("z",)], "rid string")).collect()
    assert [(r.path, r.ended) for r in alone] == [(["z"], "leaf")]
    assert {(r.rid, r.level, r.dependencies) for r in trace.predecessors(table, root).collect()} == {("b", 1, 2), ("c", 1, 2), ("d", 2, 1), ("e", 3, 1), ("f", 4, 1), ("g", 5, 0)}
