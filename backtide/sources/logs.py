"""JSON-line logs as tables, with the errors of each line as a column.

Readers come in two modes: `quarantine` returns (good rows, bad lines with their reason), `strict` raises ValueError
with the first bad line. Lines are numbered in file order, and records without a sequence number get the number of
events before them, both by sums over splits and ranges of lines: no task sees a whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from backtide.functions.normalize import column_name, table_name, value_text, value_type
from backtide.session import materialise

#: Lines of a range whose events one task adds up.
RANGE = 1 << 16

_READ = "time string, timestamp string, rid string, request_id string, tbn string, table_name string, `table` string, event string, op string, pk variant, pks variant, seq bigint, xmin bigint, xmax bigint, xid bigint, cells variant"


def _before(totals: DataFrame, order: list[str], total: str) -> Column:
    """Sum of `total` over the rows before, of a table with one row for each split or range."""
    return F.coalesce(F.sum(total).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the lines that are not blank, numbered in file order: a line's number is its place in its split and
    the lines of the splits before it, by file name and offset. The lines are written to the shared folder."""
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = materialise(spark.read.text(path).select(*split, F.monotonically_increasing_id().alias("at"), "value"), "lines")
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    shift = splits.select("file", "start", (_before(splits, ["file", "start"], "n") - F.col("first")).alias("shift"))
    return lines.join(shift, ["file", "start"]).select((F.col("at") + F.col("shift")).alias("line"), "value").filter(F.trim("value") != "")


def _first(*names: str) -> Column:
    return F.coalesce(*[F.when(F.trim(F.col(f"j.{n}")) != "", F.trim(F.col(f"j.{n}"))) for n in names])


def _keys() -> Column:
    """Keys as strings: the array pks, or the single pk; as Python shows them for booleans."""
    text = lambda v: F.when(value_type(v) == "bool", F.initcap(F.to_json(v))).when(value_type(v) == "null", "None").otherwise(F.call_function("try_variant_get", v, F.lit("$"), F.lit("string")))
    many = F.call_function("try_variant_get", F.col("j.pks"), F.lit("$"), F.lit("array<variant>"))
    one = F.call_function("try_variant_get", F.col("j.pk"), F.lit("$"), F.lit("array<variant>"))
    return F.when(many.isNotNull(), F.transform(many, text)).when(one.isNotNull(), F.transform(one, text)).when(F.coalesce("j.pk", "j.pks").isNotNull(), F.array(text(F.coalesce("j.pk", "j.pks"))))


def _parsed(lines: DataFrame, case_sensitive: bool) -> DataFrame:
    table = F.coalesce(_first("tbn"), _first("table_name"), _first("table"))
    return lines.withColumn("j", F.from_json("value", _READ)).select(
        "line", "value", "j", _first("rid", "request_id").alias("rid"), table_name(table, case_sensitive).alias("tbn"),
        F.expr("try_to_timestamp(coalesce(j.time, j.timestamp))").alias("time"), F.lower(F.coalesce(_first("event"), _first("op"))).alias("event"), _keys().alias("keys"),
    )


def _missing() -> Column:
    return (
        F.when(F.col("rid").isNull(), "no request id").when(F.col("tbn").isNull() | (F.col("tbn") == ""), "no table name")
        .when(F.col("time").isNull(), "no readable time").when(F.col("keys").isNull() | (F.size("keys") == 0), "no primary key")
    )


def _split(checked: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    bad = checked.filter("error is not null").select("line", "value", "error")
    if mode == "strict" and (first := bad.orderBy("line").first()):
        raise ValueError(f"line {first['line'] + 1}: {first['error']}")
    return checked.filter("error is null"), bad


def _with_seq(records: DataFrame, events: Column, own: str = "j.seq") -> DataFrame:
    """records with `seq`: their own (column `own`), or the number of events that the records before them make. Events are added up in
    ranges of RANGE lines; what comes before a range is a sum over ranges."""
    marked = records.withColumn("range", F.floor(F.col("line") / RANGE)).withColumn("events", events)
    totals = marked.groupBy("range").agg(F.sum("events").alias("total"))
    before = totals.select("range", _before(totals, ["range"], "total").alias("before"))
    inside = F.coalesce(F.sum("events").over(Window.partitionBy("range").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("inside", inside).join(before, "range").withColumn("seq", F.coalesce(own, F.col("before") + F.col("inside"))).drop("range", "events", "inside", "before")


def read_log(lines: DataFrame, *, case_sensitive: bool = False, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Reads (rid, tbn, pk, seq, time, xmin, xmax, seen), one for each key, and the bad lines. seen: map of column to
    (vtype, vtext) of observed values, which need exactly one key."""
    parsed = _parsed(lines, case_sensitive)
    error = F.coalesce(
        _missing(), F.when(F.col("j.xmin").isNull() != F.col("j.xmax").isNull(), "xmin and xmax go together"),
        F.when(F.col("j.xmin") > F.col("j.xmax"), "xmin above xmax"), F.when(F.col("j.cells").isNotNull() & (F.size("keys") != 1), "observed cells need one key"),
    )
    # A filter on the error would parse a line again for each field that it looks at, so lines are parsed once and written.
    seen = F.when(F.col("error").isNull() & F.col("j.cells").isNotNull(), F.map_from_entries(_cells(case_sensitive)))
    checked = parsed.withColumn("error", error).select("line", F.when(F.col("error").isNotNull(), F.col("value")).alias("value"), "rid", "tbn", "time", "keys", F.col("j.seq").alias("own_seq"), "j.xmin", "j.xmax", seen.alias("seen"), "error")
    good, bad = _split(materialise(checked, "parsed-reads"), mode)
    rows = _with_seq(good, F.size("keys"), "own_seq").select("rid", "tbn", F.explode("keys").alias("pk"), "seq", "time", "xmin", "xmax", "seen", "line")
    return rows, bad


def _cells(case_sensitive: bool) -> Column:
    """Entries (col, (vtype, vtext)) of `cells`, an array of {col, new|value} or an object; the last of equal columns."""
    listed = F.call_function("try_variant_get", F.col("j.cells"), F.lit("$"), F.lit("array<struct<col:string,new:variant,value:variant>>"))
    mapped = F.map_entries(F.call_function("try_variant_get", F.col("j.cells"), F.lit("$"), F.lit("map<string,variant>")))

    def entry(name: Column, value: Column) -> Column:
        typed = F.named_struct(F.lit("vtype"), value_type(value), F.lit("vtext"), value_text(value))
        return F.named_struct(F.lit("key"), column_name(name, case_sensitive), F.lit("value"), typed)

    entries = F.coalesce(F.transform(listed, lambda e: entry(e["col"], F.coalesce(e["new"], e["value"]))), F.transform(mapped, lambda e: entry(e["key"], e["value"])))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.transform(names, lambda name: F.element_at(F.filter(entries, lambda e: e["key"] == name), -1))


def write_log(lines: DataFrame, *, case_sensitive: bool = False, mode: str = "strict") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cell writes, row deletes, bad lines). The operation defaults to update; a write without cells is a
    "legacy row-level log" and an error."""
    parsed = _parsed(lines, case_sensitive).withColumn("op", F.coalesce("event", F.lit("update")))
    written = F.col("op") != "delete"
    error = F.coalesce(
        _missing(), F.when(~F.col("op").isin("insert", "update", "delete"), "unknown operation"), F.when(written & F.col("j.cells").isNull(), "legacy row-level log: no cells"),
        F.when(written & (F.size("keys") != 1), "a cell write needs one key"),
    )
    good, bad = _split(parsed.withColumn("error", error), mode)
    cells = _cells(case_sensitive)
    sized = _with_seq(good.withColumn("entries", F.when(written, cells)), F.when(written, F.size("entries")).otherwise(F.size("keys")))
    head = ["rid", "tbn", "time", F.col("j.xid").alias("xid"), "seq", "line"]
    writes = sized.filter(written).select(*head, F.get("keys", 0).alias("pk"), "op", F.explode("entries").alias("e")).select("rid", "tbn", "pk", F.col("e.key").alias("col"), "op", "e.value.vtype", "e.value.vtext", "time", "xid", "seq", "line")
    deletes = sized.filter(~written).select(*head, F.explode("keys").alias("pk")).select("rid", "tbn", "pk", "time", "xid", "seq", "line")
    return writes, deletes, bad


def context_log(lines: DataFrame, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(contexts rid, user_id, api_id; bad lines). api_id is given or METHOD and route or path. Equal repeats count once; the
    same RID with another identity is an error of all its lines."""
    j = F.from_json("value", "rid string, request_id string, api_id string, method string, route string, path string, user_id string")
    parsed = lines.withColumn("j", j).select(
        "line", "value", _first("rid", "request_id").alias("rid"), _first("user_id").alias("user_id"),
        F.coalesce(_first("api_id"), F.concat_ws(" ", F.upper(_first("method")), _first("route", "path"))).alias("api_id"),
    )
    counts = parsed.groupBy("rid").agg(F.count_distinct(F.struct("user_id", "api_id")).alias("kinds"))
    checked = parsed.join(counts, "rid", "left").withColumn("error", F.coalesce(
        F.when(F.col("rid").isNull() | F.col("user_id").isNull() | (F.col("api_id") == ""), "incomplete request context"), F.when(F.col("kinds") > 1, "same RID with different contexts")
    ))
    good, bad = _split(checked, mode)
    return good.groupBy("rid").agg(F.max_by(F.struct("user_id", "api_id"), "line").alias("c")).select("rid", "c.user_id", "c.api_id"), bad


def row_accesses(lines: DataFrame, default_event: str = "select", *, arrays_only: bool = False, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Row accesses (rid, tbn, pk, event, time, line), one for each key, and the bad lines. arrays_only: keys must come as
    the array pks, as older logs have them."""
    parsed = _parsed(lines, False)
    error = _missing()
    if arrays_only:
        error = F.coalesce(F.when(F.call_function("try_variant_get", F.col("j.pks"), F.lit("$"), F.lit("array<variant>")).isNull(), "pks is no array"), error)
    good, bad = _split(parsed.withColumn("error", error), mode)
    return good.select("rid", "tbn", F.explode("keys").alias("pk"), F.coalesce("event", F.lit(default_event)).alias("event"), "time", "line"), bad


def row_log(lines: DataFrame, default_event: str = "select") -> DataFrame:
    """The row accesses of row_accesses() without its bad lines."""
    return row_accesses(lines, default_event, mode="quarantine")[0]


def request_log(lines: DataFrame) -> DataFrame:
    """HTTP requests (rid, time, method, path) that have an id."""
    j = F.from_json("value", "rid string, time string, method string, path string")
    return lines.withColumn("j", j).filter(F.trim("j.rid") != "").select("j.rid", F.expr("try_to_timestamp(j.time)").alias("time"), "j.method", "j.path")


def gold_labels(lines: DataFrame) -> DataFrame:
    """(rid, is_root) of {root_rid, rids: [{rid} | string]}; without a root the last one is it."""
    j = F.from_json("value", "root_rid string, rids array<variant>")
    rid = lambda v: F.coalesce(F.call_function("try_variant_get", v, F.lit("$.rid"), F.lit("string")), F.call_function("try_variant_get", v, F.lit("$"), F.lit("string")))
    rows = lines.withColumn("j", j).select(F.transform("j.rids", rid).alias("rids"), F.col("j.root_rid").alias("root"))
    rows = rows.select("rids", F.coalesce("root", F.try_element_at("rids", F.lit(-1))).alias("root"))
    return rows.select(F.explode(F.array_distinct(F.concat("rids", F.array("root")))).alias("rid"), "root").select("rid", (F.col("rid") == F.col("root")).alias("is_root"))


def row_keys(names: Column) -> Column:
    """struct(tbn, pk) of "table[pk]", split at the first bracket."""
    return F.struct(F.regexp_extract(names, r"^([^\[]*)\[", 1).alias("tbn"), F.regexp_extract(names, r"(?s)^[^\[]*\[(.*).$", 1).alias("pk"))


def policy_file(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables: tbn, rows: tbn, pk, verdict) of a policy document; the gray and blocked rows."""
    j = lines.withColumn("j", F.from_json("value", "block_tables array<string>, block_rows array<string>, gray_rows array<string>"))
    tables = j.select(F.explode("j.block_tables").alias("tbn"))
    rows = [j.select(F.explode(f"j.{kind}_rows").alias("n")).select(row_keys(F.col("n")).alias("k")).select("k.tbn", "k.pk", F.lit(kind).alias("verdict")) for kind in ("block", "gray")]
    return tables, rows[0].union(rows[1])
