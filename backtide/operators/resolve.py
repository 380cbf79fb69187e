"""Which writes each read could have seen: by time, or by the bounds of a database snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from backtide.session import discard, materialise

from .rows import READ, WRITE, both_bounds, cells_of_rows, crowded_rows, log_rows, of_rows
from .versions import CELL, CROWDED, ROW, as_of, crowded, hashed, known_cells, sized_cells, versions

_PICK = ("rid", "time", "op", "xid", "seq", "pos", "raw_run", "vtype", "vtext", "origin", "next_delete")


#: Positions of a history that lie in one bucket of the window join.
WINDOW = 256
_SEEN = "map<string,struct<vtype:string,vtext:string>>"


def read_cells(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Each read with each known cell of its row; col is null if the row has none."""
    return reads.join(known_cells(writes), list(ROW), "left")


def observed_cells(reads: DataFrame, known: DataFrame) -> DataFrame:
    """As read_cells() with `eligible` of known cells (see sized_cells), but a read that tells what it saw (`seen`, a map
    of column to typed value) has the cells of that map, whether anything is known of them or not, with the value in
    seen_type and seen_text."""
    nothing = [F.lit(None).cast("string").alias(c) for c in ("seen_type", "seen_text")]
    known = known.select(*CELL, "eligible")
    blind = reads.filter("seen is null").drop("seen").join(known, list(ROW), "left").select("*", *nothing)
    told = reads.filter("seen is not null").select("*", F.explode("seen").alias("col", "value")).select("*", F.col("value.vtype").alias("seen_type"), F.col("value.vtext").alias("seen_text"))
    return blind.unionByName(told.drop("seen", "value").join(known, list(CELL), "left"))


def resolve_by_time(read_cells_: DataFrame, history: DataFrame) -> DataFrame:
    """The latest version written not after the read, unless a delete not before it and not after the read killed it."""
    found = as_of(read_cells_, history.select(*CELL, *_PICK), CELL, "time", "time", inclusive=True, hot=crowded(CELL, read_cells_, history))
    dead = F.col("found.next_delete") <= F.col("time")
    return found.withColumn("found", F.when(~F.coalesce(dead, F.lit(False)), F.col("found")))


def resolve_before_xid(read_cells_: DataFrame, history: DataFrame, bound: str) -> DataFrame:
    """The latest version of a smaller transaction than bound, unless a delete below the bound killed it."""
    found = as_of(read_cells_, history.select(*CELL, *_PICK), CELL, bound, "xid", inclusive=False, hot=crowded(CELL, read_cells_, history))
    dead = F.col("found.next_delete") < F.col(bound)
    return found.withColumn("found", F.when(~F.coalesce(dead, F.lit(False)), F.col("found")))


def snapshot_bounds(read_cells_: DataFrame, history: DataFrame, most: int = CROWDED) -> DataFrame:
    """Reads of cells with `low` and `high`, the versions before xmin and before xmax (null where there is none), and
    `window_start` and `window_end`, the positions of the writes between the bounds, which deletes do not change."""
    slim = F.struct("origin.rid", "origin.time").alias("origin")
    history = history.select(*CELL, *[slim if c == "origin" else F.col(c) for c in _PICK])
    hot = crowded(CELL, read_cells_, history, most=most)
    if hot is None:
        out = _both_bounds(read_cells_, history)
    else:
        hot = F.broadcast(hot)
        out = _both_bounds(read_cells_.join(hot, list(CELL), "left_anti"), history.join(hot, list(CELL), "left_anti"))
        cut, versions_of = read_cells_.join(hot, list(CELL), "left_semi"), history.join(hot, list(CELL), "left_semi")
        for side, bound in _BOUNDS.items():
            cut = as_of(cut, versions_of, CELL, bound, "xid", inclusive=False, hot=hot)
            own = F.struct(*[F.col(f"found.{c}").alias(c) for c in _PICK])
            cut = cut.withColumn(side, F.when(F.col("found").isNotNull(), own)).drop("found")
        out = out.unionByName(cut)
    ends = {"window_start": F.coalesce("low.pos", F.lit(0)) + 1, "window_end": F.coalesce("high.pos", F.lit(0))}
    alive = {side: F.when(~F.coalesce(F.col(f"{side}.next_delete") < F.col(bound), F.lit(False)), F.col(side)) for side, bound in _BOUNDS.items()}
    return out.withColumns(ends).withColumns(alive)


_BOUNDS = {"low": "xmin", "high": "xmax"}


def _both_bounds(probes: DataFrame, history: DataFrame) -> DataFrame:
    """probes with the last history row below each bound. As as_of(), but both lookups share one shuffle."""
    own = [c for c in probes.columns if c not in CELL]
    row, probe = F.struct(*_PICK), F.struct(*own)
    empty = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    keys = lambda low, high: [F.col(c).cast("long").alias(f"_{side}") for side, c in zip(_BOUNDS, (low, high), strict=True)]
    left = history.select(*CELL, *keys("xid", "xid"), F.lit(1).alias("_side"), F.col("pos").alias("_pos"), row.alias("_row"), empty(probes, probe).alias("_probe"))
    right = probes.select(*CELL, *keys(*_BOUNDS.values()), F.lit(0).alias("_side"), empty(history, F.col("pos")).alias("_pos"), empty(history, row).alias("_row"), probe.alias("_probe"))
    both = hashed(left.unionByName(right), *CELL)
    for side in _BOUNDS:
        before = Window.partitionBy("_hash", *CELL).orderBy(f"_{side}", "_side", "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn(side, F.last("_row", ignorenulls=True).over(before))
    return both.filter("_probe is not null").select(*CELL, "_probe.*", *_BOUNDS)


def snapshot_rules(bounds: DataFrame) -> DataFrame:
    """bounds with `rule`, the first that applies: none, 0, 1, 1w, 2, 3 or 4. 1w and 4 take all writers in the window."""
    low, high = F.col("low"), F.col("high")
    rule = (
        F.when(high.isNull(), "none").when(high["rid"] == F.col("rid"), "0")
        .when(low.isNull() & (high["op"] == "insert"), "1").when(low.isNull(), "1w")
        .when(low["pos"] == high["pos"], "2").when(low["raw_run"] == high["raw_run"], "3").otherwise("4")
    )
    return bounds.withColumn("rule", rule)


REASONS = {
    "0": "snapshot-rule-0-self-write", "1": "snapshot-rule-1-row-exists", "1w": "snapshot-incomplete-history-no-lower-bound",
    "2": "snapshot-rule-2-no-window-write", "3": "snapshot-rule-3-same-value-origin", "4": "snapshot-rule-4-concurrent-window",
    "time": "legacy-time-fallback",
}

_VERSION = "struct<rid:string,time:timestamp_ntz,op:string,xid:bigint,seq:bigint,pos:bigint,vtype:string,vtext:string,origin_rid:string,origin_time:timestamp_ntz>"


def _shape(v: str):
    """A candidate version from a version struct (or prefix) v."""
    own = lambda name: F.col(f"{v}.{name}" if v else name)
    return F.struct(
        *[own(n).alias(n) for n in ("rid", "time", "op", "xid", "seq", "pos", "vtype", "vtext")],
        own("origin.rid").alias("origin_rid"), own("origin.time").alias("origin_time"),
    )


def window_writers(ruled: DataFrame, history: DataFrame) -> DataFrame:
    """For reads under rules 1w and 4, the last version of each transaction with xmin <= xid < xmax.

    A window is a range of positions in the cell's history. It is cut into buckets of WINDOW positions and joined by cell
    and bucket, so a window meets no more writes than it has, but for two buckets, and a hot cell is spread over all of
    its buckets. history: writes with `version`, as found_rows() has them."""
    itself = {"origin_rid": F.col("version.rid"), "origin_time": F.col("version.time")}
    version = F.struct(*[itself.get(c, F.col(f"version.{c}")).alias(c) for c in history.schema["version"].dataType.names])
    own = history.filter("is_last_in_xid").select(*CELL, F.floor(F.col("version.pos") / WINDOW).alias("bucket"), F.col("version.pos").alias("at"), version.alias("version"))
    ends = [F.floor(F.col(c) / WINDOW) for c in ("window_start", "window_end")]
    open_ = ruled.filter(F.col("rule").isin("1w", "4") & (F.col("window_start") <= F.col("window_end"))).withColumn("bucket", F.explode(F.sequence(*ends)))
    return open_.join(own, [*CELL, "bucket"]).filter(F.col("at").between(F.col("window_start"), F.col("window_end"))).drop("bucket", "at")


#: The values of reasons are fixed.
NO_HISTORY = "row has no available cell write history"
NOT_BEFORE_SNAPSHOT = "no traceable version for this cell before the snapshot upper bound"
NOT_BEFORE_READ = "no traceable version for this cell before the read time"
NO_MATCH = "cell value in the read log does not match any snapshot candidate"

_READ = ("rid", *CELL, "read_seq", "read_time", "xmin", "xmax", "seen_type", "seen_text", "again")


def _head() -> list:
    """The columns of _READ, of a read as it is logged."""
    return ["rid", *CELL, F.col("seq").alias("read_seq"), F.col("time").alias("read_time"), "xmin", "xmax", "seen_type", "seen_text", "again"]


def snapshot_attempts(ruled: DataFrame, history: DataFrame) -> DataFrame:
    """(read, version, certain, rule): one row for each version a read may have seen; one without a version if there is none.
    ruled and history: from found_rows(), written, as they are looked at twice."""
    one = ruled.filter(F.col("rule") != "1w").select(*_READ, "version", (F.col("rule") != "4").alias("certain"), "rule")
    many = window_writers(ruled.drop("version"), history).select(*_READ, "version", F.lit(False).alias("certain"), "rule")
    return one.unionByName(many)


def match_read(attempts: DataFrame) -> DataFrame:
    """Attempts of reads that tell what they saw (seen_type): those whose version has that typed value. If one uncertain
    version is left, it is certain and its rule "observed"; if none is, one row without a version and the reason NO_MATCH."""
    own = Window.partitionBy(*_READ)
    fits = F.col("version").isNotNull() & F.col("version.vtype").eqNullSafe(F.col("seen_type")) & F.col("version.vtext").eqNullSafe(F.col("seen_text"))
    at = F.when(F.col("fits"), F.col("version.pos"))
    counted = attempts.withColumn("fits", fits).withColumn("low_at", F.min(at).over(own)).withColumn("high_at", F.max(at).over(own))
    some = F.col("low_at").isNotNull()
    settled = ~F.col("certain") & (F.col("low_at") == F.col("high_at"))
    kept = counted.filter(F.col("fits") | ~some | F.col("version").isNull())
    return kept.select(
        *_READ,
        F.when(F.col("fits"), F.col("version")).alias("version"),
        (F.col("certain") | F.coalesce(settled, F.lit(False))).alias("certain"),
        F.when(settled, "observed").otherwise(F.col("rule")).alias("rule"),
        F.when(F.col("version").isNotNull() & ~some, NO_MATCH).alias("reason"),
    )


def match_observed(candidates: DataFrame) -> DataFrame:
    """Keep versions that equal an observed value (columns seen_type, seen_text; null: nothing observed); if a read is
    left with one uncertain version, that one is certain."""
    kept = candidates.filter(F.col("seen_type").isNull() | (F.col("version.vtype").eqNullSafe(F.col("seen_type")) & F.col("version.vtext").eqNullSafe(F.col("seen_text"))))
    left = F.count("*").over(Window.partitionBy("rid", *CELL, "read_seq", "read_time"))
    settled = F.col("seen_type").isNotNull() & ~F.col("certain") & (left == 1)
    return kept.withColumn("rule", F.when(settled, "observed").otherwise(F.col("rule"))).withColumn("certain", F.col("certain") | settled)


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """Of equal attributions of a request (cell, version, certainty) the one with the smallest read. A read gives no version
    twice, so where `again` tells that a request has read a row once only, there is nothing to compare."""
    same = Window.partitionBy("rid", *CELL, "version.xid", "version.seq", "version.time", "certain").orderBy("read_seq", "read_time", "rule")
    if "again" not in candidates.columns:
        return candidates.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    once, more = (candidates.filter(c).drop("again") for c in ("not again", "again"))
    return once.unionByName(dedupe_candidates(more))


_FOUND = ("kind", *CELL, "rid", "seq", "time", "xmin", "xmax", "seen_type", "seen_text", "again", "by_xid", "rule", "window_start", "window_end", "version", "raw_rid", "is_last_in_xid")


def found_rows(reads: DataFrame, writes: DataFrame, deletes: DataFrame, most: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """(found, rows): log_rows() and, of each cell of each read (kind READ), the rule, the window of positions and, but for
    rule 1w, the version that the rule gives, where by_xid holds; of each write (kind WRITE) the version it is.

    Rows whose cells have over `most` log rows are looked up in written histories, which are cut, all others side by side."""
    if "seen" not in reads.columns:
        reads = reads.withColumn("seen", F.lit(None).cast(_SEEN))
    rows = log_rows(reads, writes, deletes)
    hot = crowded_rows(rows, most)
    if hot is None:
        return _side_by_side(rows), rows
    hot = F.broadcast(hot)
    return _side_by_side(rows.join(hot, list(ROW), "left_anti")).unionByName(_in_histories(rows.join(hot, list(ROW), "left_semi"), most)), rows


def _side_by_side(rows: DataFrame) -> DataFrame:
    both = both_bounds(cells_of_rows(rows)).select("kind", *CELL, "read.*", "by_xid", "own", "low", "high", "low_alive", "high_alive", "raw_rid", "is_last_in_xid")
    ends = {"window_start": F.coalesce("low.pos", F.lit(0)) + 1, "window_end": F.coalesce("high.pos", F.lit(0))}
    alive = {side: F.when(F.col("by_xid") & F.col(f"{side}_alive"), F.col(side)) for side in _BOUNDS}
    ruled = snapshot_rules(both.withColumns(ends).withColumns(alive)).withColumn("rule", F.when(F.col("by_xid"), F.col("rule")))
    version = F.when(F.col("kind") == WRITE, _shape("own")).when(F.col("rule").isin("2", "4"), _shape("low")).when(~F.col("rule").isin("none", "1w"), _shape("high"))
    return ruled.withColumn("version", version).select(*_FOUND)


def _in_histories(rows: DataFrame, most: int) -> DataFrame:
    reads, writes, deletes = of_rows(rows)
    reads = hashed(reads, "rid", *ROW).withColumn("again", F.count("*").over(Window.partitionBy("_hash", "rid", *ROW)) > 1).drop("_hash")
    known = sized_cells(writes, deletes)
    both = F.col("xmin").isNotNull() & F.col("xmax").isNotNull()
    cells = materialise(observed_cells(reads, known).withColumn("by_xid", both & F.coalesce("eligible", F.lit(False))).drop("eligible"), "read-cells")
    cut = versions(writes.filter("xid is not null"), deletes.filter("xid is not null"), "xid", most=most, known=known)
    history = materialise(cut.select(*CELL, *_PICK, F.col("raw_origin.rid").alias("raw_rid"), "is_last_in_xid"), "history")
    discard(known)
    ruled = snapshot_rules(snapshot_bounds(cells.filter("col is not null and by_xid"), history, most))
    version = F.when(F.col("rule").isin("2", "4"), _shape("low")).when(~F.col("rule").isin("none", "1w"), _shape("high"))
    parts = [
        ruled.withColumns({"kind": F.lit(READ), "version": version}), cells.filter("col is null or not by_xid").withColumn("kind", F.lit(READ)),
        history.select(*CELL, F.lit(WRITE).alias("kind"), _shape("").alias("version"), "raw_rid", "is_last_in_xid"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumns({c: F.lit(None).cast(t) for c, t in (("raw_rid", "string"), ("is_last_in_xid", "boolean")) if c not in out.columns}).select(*_FOUND)


def snapshot_reads(reads: DataFrame, writes: DataFrame, deletes: DataFrame, *, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reads of known cells by their snapshot, with their rule; history of writes), from found_rows(), written if both are
    looked at."""
    found, _ = found_rows(reads, writes, deletes)
    found = materialise(found, "found") if written else found
    return found.filter((F.col("kind") == READ) & F.col("by_xid") & F.col("col").isNotNull()), found.filter(F.col("kind") == WRITE)


def resolve_reads(reads: DataFrame, writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """(read, version, certain, rule, reason) for every cell of every read, all requests at once: the versions it may have
    seen, or a row without a version and the reason for it; `again` tells whether the request has more reads of the row.

    Snapshot rules hold where a read has bounds and its cell is eligible, else the time. `seen`, an optional column of
    reads (a map of column to (vtype, vtext)), names the cells and the values that a read saw itself: only versions with
    an equal typed value are left of those. What was found by transaction is written once, and the result is read from it;
    histories by time only if a read needs them.
    """
    return resolve_with_history(reads, writes, deletes)[0]


def resolve_with_history(reads: DataFrame, writes: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """resolve_reads() and (tbn, pk, col, raw_origin) of all writes that have a transaction."""
    found, rows = found_rows(reads, writes, deletes)
    found = materialise(found, "found")
    history, cells = found.filter(F.col("kind") == WRITE), found.filter(F.col("kind") == READ)
    attempts = snapshot_attempts(cells.filter("col is not null and by_xid").select(*_head(), "rule", "window_start", "window_end", "version"), history)
    timed = cells.filter("col is not null and not by_xid").select(*CELL, "rid", "seq", "time", "xmin", "xmax", "seen_type", "seen_text", "again")
    if not timed.isEmpty():
        _, writes, deletes = of_rows(rows)
        by_time = materialise(versions(writes, deletes, "time").select(*CELL, *_PICK), "history")
        at_time = resolve_by_time(timed, by_time)
        at_time = materialise(at_time.select(*_head(), F.when(F.col("found").isNotNull(), _shape("found")).alias("version"), F.lit(True).alias("certain"), F.lit("time").alias("rule")), "timed-reads")
        attempts = attempts.unionByName(at_time)
        discard(by_time)
    discard(rows)
    told = F.col("seen_type").isNotNull()
    tried = attempts.filter(~told).withColumn("reason", F.lit(None).cast("string")).unionByName(match_read(attempts.filter(told)))
    late = F.when(F.col("xmin").isNotNull() & F.col("xmax").isNotNull(), NOT_BEFORE_SNAPSHOT).otherwise(NOT_BEFORE_READ)
    tried = tried.withColumn("reason", F.coalesce("reason", F.when(F.col("version").isNull(), late)))
    unknown = cells.filter("col is null").select(*_head(), F.lit(None).cast(attempts.schema["version"].dataType).alias("version"), F.lit(None).cast("boolean").alias("certain"), F.lit(None).cast("string").alias("rule"), F.lit(NO_HISTORY).alias("reason"))
    return tried.unionByName(unknown), history.select(*CELL, F.struct(F.col("raw_rid").alias("rid")).alias("raw_origin"))


def candidates_of(resolved: DataFrame) -> DataFrame:
    """The attributions of resolved reads, each once for a request."""
    return dedupe_candidates(resolved.filter("version is not null").drop("reason", "xmin", "xmax"))


def numbered_candidates(candidates: DataFrame) -> DataFrame:
    """candidates with `place`, from 0 in each request: by read time, cell, sequence of the version, certain ones first."""
    order = Window.partitionBy("rid").orderBy("read_time", *CELL, "version.seq", F.desc("certain"), "version.xid", "version.time")
    return candidates.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def unresolved_reads(resolved: DataFrame) -> DataFrame:
    """(rid, tbn, pk, col, read_time, reason) of the cells of reads that have no version."""
    return resolved.filter("version is null").select("rid", *CELL, "read_time", "reason").distinct()


def request_candidates(reads: DataFrame, writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """candidates_of() what resolve_reads() finds."""
    return candidates_of(resolve_reads(reads, writes, deletes))


def unresolved(reads: DataFrame, writes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rid, tbn, pk, col) that no version answers; col is null where the row has no known cell."""
    pairs = read_cells(reads, writes).select("rid", *CELL).distinct()
    return pairs.join(candidates.select("rid", *CELL).distinct(), ["rid", *CELL], "left_anti")
