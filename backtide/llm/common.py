"""What the operators of this subpackage share: the shared folder, written tables, a bounded word memo."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from backtide.session import discard, materialise, shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and lost executors cost nothing that was done."""
    return materialise(df, name)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stash that nothing reads any more."""
    discard(df)


def run_length_prefix(totals: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Exclusive prefix sums over a table with one row per partition (never one per document)."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({out: F.coalesce(F.sum(column).over(before), F.lit(0)) for out, column in sums.items()})


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The rows with the smallest hashes of key, `limit` at most: the same ones at every partitioning."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(limit)


def within_bytes(sample: DataFrame, text: str, limit_bytes: int, *order: str) -> list[Row]:
    """Rows of a sample whose row number is bounded, in order, as long as their texts come to limit_bytes together; one
    that does not fit is passed over. The driver sees lengths first, and then only texts that fit."""
    kept = stash(sample.withColumn("_row", F.monotonically_increasing_id()), "sample")
    chosen, left = [], limit_bytes
    for row in kept.select("_row", F.coalesce(F.octet_length(text), F.lit(0)).alias("size"), *order).orderBy(*order, "_row").collect():
        if row["size"] <= left:
            chosen.append((row["_row"],))
            left -= row["size"]
    if not chosen:
        return []
    rows = kept.join(F.broadcast(sample.sparkSession.createDataFrame(chosen, "_row long")), "_row").orderBy(*order, "_row").drop("_row").collect()
    drop_stash(kept)
    return rows


class Memo(dict):
    """A dict that makes what it lacks and holds about `budget` bytes at most: when the young half of them is full it
    becomes the old one, whose hits move back. Keys are strings or bytes, values no longer than a few bytes for each
    character of the key, so an entry counts as 250 bytes and five a character; keys beyond a tenth of the budget are
    made each time."""

    def __init__(self, make, budget: int = 32 << 20):
        super().__init__()
        self.make, self.half, self.held, self.old = make, budget // 2, 0, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        size = 250 + 5 * len(key)
        if (held := self.held + size) > self.half:
            if size > self.half // 5:
                return value
            self.old, held = dict(self), size
            self.clear()
        self[key], self.held = value, held
        return value

    def forget(self) -> None:
        self.clear()
        self.old, self.held = {}, 0
