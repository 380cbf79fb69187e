"""Which tables a change stream is read for, and by which key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Monitored tables that may become a dict, as stream transforms take them.
MOST = 10_000


def first_key_columns(keys: DataFrame) -> DataFrame:
    """(name, key) of primary key columns (schema, table, column, position): of each table the first column."""
    return keys.groupBy(F.concat_ws(".", "schema", "table").alias("name")).agg(F.min_by("column", "position").alias("key"))


def tables_file(lines: DataFrame) -> DataFrame:
    """(name, key) of a JSON object of `schema.table` to key column, in rows (value); a name in several
    rows has its smallest key. Entries without a name or key are left out."""
    parsed = lines.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "key"))
    return parsed.filter((F.trim("name") != "") & (F.trim("key") != "")).groupBy("name").agg(F.min("key").alias("key"))


def as_dict(tables: DataFrame, most: int = MOST) -> dict[str, str]:
    """The tables as the dict that stream transforms take; more than `most` are an error, not a cut."""
    rows = tables.select("name", "key").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} monitored tables")
    return {r["name"]: r["key"] for r in rows}
