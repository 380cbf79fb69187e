"""Reads, writes and deletes of a row side by side: the versions below both snapshot bounds of all reads in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from backtide.session import discard, materialise

from .versions import CELL, CROWDED, HASHES, ROW, begins, hashed

#: Kinds of log rows, in the order in which they come where keys are equal: a bound is below what is written at it.
READ, WRITE, DELETE = -1, 0, 1
_WRITE = ("rid", "op", "vtype", "vtext", "time", "xid", "seq")
_VERSION = ("rid", "time", "op", "xid", "seq", "pos", "raw_run", "vtype", "vtext", "origin", "gone")


def log_rows(reads: DataFrame, writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """(kind, tbn, pk, col, line, read, write) of reads (with `seen`), writes and deletes, written, as they are looked at
    more than once. Of reads and deletes col is null."""
    gone = deletes.select("rid", *ROW, F.lit("delete").alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("col", "vtype", "vtext")], "time", "xid", "seq", "line")
    changes = writes.select(F.lit(WRITE).alias("kind"), *ROW, "col", "line", *_WRITE).unionByName(gone.select(F.lit(DELETE).alias("kind"), *ROW, "col", "line", *_WRITE))
    changes = changes.select("kind", *ROW, "col", F.col("line").cast("long").alias("line"), F.struct(*_WRITE).alias("write"))
    probes = reads.select(F.lit(READ).alias("kind"), *ROW, F.struct("rid", "seq", "time", "xmin", "xmax", "seen").alias("read"))
    return materialise(changes.unionByName(probes, allowMissingColumns=True), "log-rows")


def of_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The reads, writes and deletes of log_rows()."""
    part = lambda kind: rows.filter(F.col("kind") == kind)
    return part(READ).select(*ROW, "read.*"), part(WRITE).select(*ROW, "col", "line", "write.*"), part(DELETE).select("write.rid", *ROW, "write.time", "write.xid", "write.seq", "line")


def crowded_rows(rows: DataFrame, most: int = CROWDED) -> DataFrame | None:
    """(tbn, pk) of the rows whose cells have more than `most` reads, writes and deletes together, None if there is none."""

    def sized(*by: Column) -> DataFrame:
        counted = rows.groupBy(*by, "col").agg(F.count("*").alias("n"))
        shared, own = (F.sum(F.when(c, F.col("n")).otherwise(0)) for c in (F.col("col").isNull(), F.col("col").isNotNull()))
        return counted.groupBy(*[c for c in counted.columns if c not in ("col", "n")]).agg((own + shared * F.greatest(F.count("col"), F.lit(1))).alias("n"))

    if (sized(F.pmod(F.xxhash64(*ROW), F.lit(HASHES)).alias("h")).agg(F.max("n")).first()[0] or 0) <= most:
        return None
    found = materialise(sized(*map(F.col, ROW)).filter(F.col("n") > most).select(*ROW), "crowded")
    if found.isEmpty():
        discard(found)
        return None
    return found


def cells_of_rows(rows: DataFrame) -> DataFrame:
    """log_rows() with one row for each cell: deletes are of all known cells of their row, reads of those too, or of those
    that they saw (`read.seen`; the value in seen_type, seen_text); col is null where there is none. Added: `again`,
    whether the request has more reads of the row, and by_xid, whether the read has bounds and all writes of the cell and
    all deletes of the row have a transaction. Windows over cells need no other shuffle afterwards."""
    rows = rows.withColumn("_row", F.xxhash64(*ROW)).repartition("_row", *ROW)
    whole, is_write = Window.partitionBy("_row", *ROW), F.col("kind") == WRITE
    rows = rows.withColumn("again", F.count("read").over(Window.partitionBy("_row", *ROW, "read.rid")) > 1)
    named = is_write & F.col("tbn").isNotNull() & F.col("pk").isNotNull()
    late = F.struct("col", F.col("write.xid").isNull().alias("late"))
    rows = rows.withColumns({"_known": F.collect_set(F.when(named, late)).over(whole), "_late": F.max((F.col("kind") == DELETE) & F.col("write.xid").isNull()).over(whole)})
    text = F.lit(None).cast("string")
    bounded = F.col("read.xmin").isNotNull() & F.col("read.xmax").isNotNull() & ~F.col("_late")

    def cell(name: Column, vtype: Column = text, vtext: Column = text) -> Column:
        eligible = F.exists("_known", lambda k: k["col"] == name) & ~F.exists("_known", lambda k: (k["col"] == name) & k["late"])
        by_xid = F.when(F.col("kind") == READ, F.coalesce(bounded & eligible, F.lit(False)))
        return F.struct(name.alias("col"), vtype.alias("seen_type"), vtext.alias("seen_text"), by_xid.alias("by_xid"))

    known = F.transform(F.array_distinct(F.transform("_known", lambda k: k["col"])), lambda c: cell(c))
    told = F.transform(F.map_entries("read.seen"), lambda e: cell(e["key"], e["value"]["vtype"], e["value"]["vtext"]))
    of = (
        F.when(is_write, F.array(cell(F.col("col")))).when(F.col("read.seen").isNotNull(), told)
        .when((F.col("kind") == READ) & (F.size("_known") == 0), F.array(cell(text))).otherwise(known)
    )
    out = rows.withColumn("_cell", F.explode(of)).select("_row", "kind", *ROW, "line", "write", "read", "again", "_cell.*")
    read = F.when(F.col("kind") == READ, F.struct(*[f"read.{c}" for c in ("rid", "seq", "time", "xmin", "xmax")], "seen_type", "seen_text", "again"))
    return out.select("_row", "kind", *CELL, "line", "write", read.alias("read"), "by_xid")


def both_bounds(cells: DataFrame) -> DataFrame:
    """cells_of_rows() in order of the transaction: (kind, cell, read, by_xid, low, high, low_alive, high_alive, own,
    raw_rid, is_last_in_xid).

    Reads lie in the histories at their upper bound, so that one order tells what is written and what is read; for the lower
    one rows are sorted once more. low and high are the last versions below the bounds, alive where no delete lies
    between. Writes have `own`, the version they are, the request that began their run and is_last_in_xid, as versions()
    has them. Changes without a transaction are left out."""
    is_write, is_delete, start = F.col("kind") == WRITE, F.col("kind") == DELETE, Window.unboundedPreceding
    rows = hashed(cells.filter((F.col("kind") == READ) | F.col("write.xid").isNotNull()), *CELL)
    rows = rows.withColumn("key", F.coalesce("write.xid", "read.xmax").cast("long")).withColumn("seq", F.col("write.seq"))
    by = Window.partitionBy("_row", "_hash", *CELL).orderBy("key", "kind", "seq", "line")
    to, before = by.rowsBetween(start, 0), by.rowsBetween(start, -1)
    # Columns of one window are added together, so that rows pass through it once.
    rows = rows.withColumns({
        "pos": F.sum(is_write.cast("long")).over(to), "gone": F.sum(is_delete.cast("long")).over(to),
        "before": F.last(F.when(is_write, F.struct("write.vtype", "write.vtext")), ignorenulls=True).over(before),
        "deleted": F.last(F.when(F.col("kind") != READ, is_delete), ignorenulls=True).over(before),
        "after": F.expr("lead(if(kind = 0, write.xid, null)) ignore nulls over (partition by _row, _hash, tbn, pk, col order by key, kind, seq, line)"),
    })
    raw_new = is_write & (F.col("before").isNull() | begins("before", "write."))
    event = F.struct("write.rid", "write.time")
    rows = rows.withColumns({"raw_new": raw_new, "life_new": raw_new | (is_write & F.col("deleted"))})
    rows = rows.withColumns({
        "raw_run": F.sum(F.col("raw_new").cast("long")).over(to), "raw_rid": F.last(F.when(F.col("raw_new"), F.struct("write.rid")), ignorenulls=True).over(to),
        "origin": F.last(F.when(F.col("life_new"), event), ignorenulls=True).over(to),
    })
    own = F.struct(*[F.col(f"write.{c}").alias(c) if c in _WRITE else F.col(c) for c in _VERSION])
    last = F.when(is_write, F.col("after").isNull() | (F.col("after") != F.col("write.xid")))
    rows = rows.withColumn("own", F.when(is_write, own)).withColumn("high", F.last("own", ignorenulls=True).over(to))
    rows = rows.select("_row", "_hash", "kind", *CELL, "seq", "line", "read", "by_xid", "own", F.when(~is_write, F.col("high")).alias("high"), "gone", F.when(is_write, F.col("raw_rid.rid")).alias("raw_rid"), last.alias("is_last_in_xid"), F.coalesce("read.xmin", "key").alias("key"))
    rows = rows.withColumns({"low": F.last("own", ignorenulls=True).over(to), "low_gone": F.sum(is_delete.cast("long")).over(to)})
    alive = lambda side, gone: (F.col(gone) == F.col(f"{side}.gone")).alias(f"{side}_alive")
    return rows.filter(~is_delete).select("kind", *CELL, "read", "by_xid", "own", "low", "high", alive("low", "low_gone"), alive("high", "gone"), "raw_rid", "is_last_in_xid")
