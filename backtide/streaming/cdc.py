"""Change-stream transactions (one JSON object for each commit) as write logs.

Every rule of cell_changes looks at one transaction at a time, so the same transform serves batch tables and streams
(append mode, no state). row_stream does so too, within each record; row_changes and table_changes group and are for batch
tables. A transaction: {xid, timestamp, change: [{kind, schema, table, columnnames, columnvalues, oldkeys:{keynames,
keyvalues}} | {kind: "message", prefix, content}]}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "xid string, timestamp string, change array<struct<kind:string, schema:string, `table`:string, prefix:string, content:string, "
    "columnnames:array<string>, columnvalues:array<variant>, oldkeys:struct<keynames:array<string>, keyvalues:array<variant>>>>"
)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with `txn`; lines that are no JSON object are dropped."""
    return lines.withColumn("txn", F.from_json(column, SCHEMA)).filter(F.col("txn.change").isNotNull())


def request_id(changes: Column) -> Column:
    """request_id of the first message of prefix `request` whose content parses; null if that lacks it."""
    messages = F.filter(changes, lambda c: (c["kind"] == "message") & (c["prefix"] == "request") & F.call_function("try_parse_json", c["content"]).isNotNull())
    return F.nullif(F.get_json_object(F.get(messages, 0)["content"], "$.request_id"), F.lit(""))


def _values(names: Column, values: Column) -> Column:
    """Folded column name -> JSON text; of names that are equal once folded the last one counts. The names are only looked
    through one by one where some are equal."""
    entries = F.zip_with(F.transform(names, lambda n: F.lower(F.trim(n))), F.transform(values, lambda v: F.to_json(v)), lambda n, v: F.struct(n.alias("key"), v.alias("value")))

    def mapped(named: Column) -> Column:
        keys = F.transform(named, lambda e: e["key"])
        last = F.transform(F.array_distinct(keys), lambda n: F.element_at(F.filter(named, lambda e: e["key"] == n), -1))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(named), named).otherwise(last))

    return _bound(F.filter(entries, lambda e: e["key"].isNotNull()), mapped)


def _bound(value: Column, use) -> Column:
    """use(value), with the value found once however often it is used: it becomes a lambda's argument."""
    return F.get(F.transform(F.array(F.struct(value.alias("v"))), lambda s: use(s["v"])), 0)


def _plain(json: Column) -> Column:
    """A key's JSON text as a bare string, without escapes; null for JSON null."""
    return F.call_function("try_variant_get", F.call_function("try_parse_json", json), F.lit("$"), F.lit("string"))


def cell_changes(transactions: DataFrame, tables: dict[str, str], now: Column | None = None) -> DataFrame:
    """(rid, xid, time, seq, event, tbn, pk, cells map<col, json>): what each transaction wrote, in order.

    tables: `schema.table` -> primary key column; others, messages and truncations are skipped. Transactions without a
    request id are dropped; an xid that is no number is null; a missing time is `now`. Inserts have all columns, updates
    those whose value differs from the old one, a missing old one being null; an update that changes the key is a
    delete and an insert under one seq; a delete has no cells. Changes without a key value are dropped before seq counts.
    """
    keys = F.create_map(*[F.lit(x) for pair in tables.items() for x in pair]) if tables else F.lit(None).cast("map<string,string>")

    def read(c: Column) -> Column:
        new = F.when(c["columnnames"].isNotNull(), _values(c["columnnames"], c["columnvalues"]))
        old = F.when(c["oldkeys"].isNotNull(), _values(c["oldkeys"]["keynames"], c["oldkeys"]["keyvalues"]))
        return F.struct(c["kind"].alias("kind"), c["table"].alias("table"), F.lower(F.element_at(keys, F.concat_ws(".", c["schema"], c["table"]))).alias("key"), new.alias("new"), old.alias("old"))

    def shaped(c: Column) -> Column:
        pk, new, old = c["key"], c["new"], c["old"]
        old_pk = _plain(F.element_at(old, pk))
        new_pk = F.when(F.map_contains_key(new, pk), _plain(F.element_at(new, pk))).when(c["kind"] == "update", old_pk)
        moved = (c["kind"] == "update") & old_pk.isNotNull() & (old_pk != new_pk)
        known = F.coalesce(old, F.create_map().cast("map<string,string>"))
        changed = F.map_filter(F.map_zip_with(new, known, lambda k, v, o: F.when(F.coalesce(o, F.lit("null")) != v, v)), lambda k, v: v.isNotNull())
        return F.struct(
            F.when(moved, "move").otherwise(c["kind"]).alias("event"), c["table"].alias("tbn"), F.when(c["kind"] == "delete", old_pk).otherwise(new_pk).alias("pk"), old_pk.alias("old_pk"),
            F.when(c["kind"] == "delete", F.create_map().cast("map<string,string>")).when((c["kind"] == "insert") | moved, new).otherwise(changed).alias("cells"),
        )

    wanted = F.filter(F.col("txn.change"), lambda c: c["kind"].isin("insert", "update", "delete") & F.map_contains_key(keys, F.concat_ws(".", c["schema"], c["table"])))
    found = transactions.select(
        request_id(F.col("txn.change")).alias("rid"), F.expr("try_cast(txn.xid as bigint)").alias("xid"),
        F.coalesce(F.expr("try_to_timestamp(txn.timestamp)"), now if now is not None else F.current_timestamp()).alias("time"),
        F.filter(F.transform(F.transform(wanted, read), shaped), lambda c: c["pk"].isNotNull()).alias("changes"),
    ).filter("rid is not null")
    rows = found.select("rid", "xid", "time", F.posexplode("changes").alias("seq", "c"))
    parts = F.when(F.col("c.event") == "move", F.array(
        F.struct(F.lit("delete").alias("event"), F.col("c.old_pk").alias("pk"), F.create_map().cast("map<string,string>").alias("cells")),
        F.struct(F.lit("insert").alias("event"), F.col("c.pk").alias("pk"), F.col("c.cells").alias("cells")),
    )).otherwise(F.array(F.struct(F.col("c.event").alias("event"), F.col("c.pk").alias("pk"), F.col("c.cells").alias("cells"))))
    return rows.select("rid", "xid", "time", "seq", F.lower("c.tbn").alias("tbn"), F.explode(parts).alias("p")).select("rid", "xid", "time", "seq", "p.event", "tbn", "p.pk", "p.cells")


def row_changes(transactions: DataFrame, tables: dict[str, str]) -> DataFrame:
    """(rid, xid, tbn, event, pks): the row log groups a transaction's keys by table and event."""
    cells = cell_changes(transactions, tables)
    grouped = cells.groupBy("rid", "xid", "tbn", "event").agg(F.array_sort(F.collect_list(F.struct("seq", "pk"))).alias("keys"))
    return grouped.select("rid", "xid", "tbn", "event", F.transform("keys", lambda k: k["pk"]).alias("pks"))


def row_stream(transactions: DataFrame, tables: dict[str, str], now: Column | None = None) -> DataFrame:
    """(rid, time, event, tbn, pks, pk_changes array<struct<before, after>>): the keys that each transaction wrote, grouped by
    table and event in order of appearance, within the record, so a stream appends them without state.

    An update counts under its new key, or the old one if it has none; if both are there and differ, the pair is a key
    change. A delete's key is the first of its old values. Changes without a key, messages, truncations, other tables and
    transactions without a request id are left out; names and keys are matched as they are written.
    """
    keys = F.create_map(*[F.lit(x) for pair in tables.items() for x in pair]) if tables else F.lit(None).cast("map<string,string>")

    def entry(c: Column) -> Column:
        pk = F.element_at(keys, F.concat_ws(".", c["schema"], c["table"]))
        text = lambda v: _plain(F.to_json(v))
        place = lambda names: F.nullif(F.coalesce(F.array_position(names, pk), F.lit(0)), F.lit(0)).cast("int")
        new = text(F.get(c["columnvalues"], place(c["columnnames"]) - 1))
        old = text(F.get(c["oldkeys"]["keyvalues"], place(c["oldkeys"]["keynames"]) - 1))
        first = F.when(place(c["oldkeys"]["keynames"]).isNotNull(), text(F.get(c["oldkeys"]["keyvalues"], 0)))
        key = F.when(c["kind"] == "insert", new).when(c["kind"] == "update", F.coalesce(new, old)).otherwise(first)
        return F.struct(c["table"].alias("tbn"), c["kind"].alias("event"), key.alias("pk"), F.when((c["kind"] == "update") & (old != new), F.struct(old.alias("before"), new.alias("after"))).alias("moved"))

    def grouped(entries: Column) -> Column:
        kinds = F.array_distinct(F.transform(entries, lambda e: F.struct(e["tbn"].alias("tbn"), e["event"].alias("event"))))

        def group(k: Column) -> Column:
            mine = F.filter(entries, lambda e: (e["tbn"] == k["tbn"]) & (e["event"] == k["event"]))
            moves = F.filter(F.transform(mine, lambda e: e["moved"]), lambda m: m.isNotNull())
            return F.struct(k["tbn"].alias("tbn"), k["event"].alias("event"), F.transform(mine, lambda e: e["pk"]).alias("pks"), moves.alias("pk_changes"))

        return F.transform(kinds, group)

    wanted = F.filter(F.col("txn.change"), lambda c: c["kind"].isin("insert", "update", "delete") & F.map_contains_key(keys, F.concat_ws(".", c["schema"], c["table"])))
    entries = F.filter(F.transform(wanted, entry), lambda e: e["pk"].isNotNull())
    found = transactions.select(request_id(F.col("txn.change")).alias("rid"), (now if now is not None else F.current_timestamp()).alias("time"), _bound(entries, grouped).alias("groups"))
    return found.filter("rid is not null").select("rid", "time", F.explode("groups").alias("g")).select("rid", "time", "g.event", "g.tbn", "g.pks", "g.pk_changes")


def table_changes(transactions: DataFrame, table: str, key: str) -> DataFrame:
    """(xid, inserted, updated, deleted): per transaction the sets of keys of one table."""
    cells = cell_changes(transactions, {table: key})
    ids = lambda event: F.array_sort(F.collect_set(F.when(F.col("event") == event, F.col("pk")))).alias(event)
    return cells.groupBy("xid").agg(ids("insert"), ids("update"), ids("delete"))


def start_stream(spark, folder: str, out: str, checkpoint: str, tables: dict[str, str]):
    """Read transaction files as they come, write cell changes as JSON lines, exactly once; returns the query."""
    lines = spark.readStream.format("text").load(folder)
    changes = cell_changes(parse(lines), tables)
    return changes.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
