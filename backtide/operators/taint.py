"""Taint judgement of values: markers as column expressions, or any judge of batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marker lists of the two offline rules, in the order in which evidence is reported.
CELL_MARKERS = ("<script", "javascript:", "${", "{{", "runtime.exec", "wget ", "curl ", "/bin/sh", "bash -c", "select ", "union ", "../")
ROW_MARKERS = (
    "runtime.getruntime().exec", "processbuilder(", "cat /etc/passwd", "curl ", "wget ", "bash -c", "sh -c", "powershell", "nc -e",
    "rm -rf", "select * from", "union select", "<script", "javascript:", "cmd.exe", "/tmp/attack", "payload", "attack",
)


def evidence(text: Column, markers: tuple[str, ...], most: int) -> Column:
    """The first `most` markers that the text holds, whatever its case; null counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.slice(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m)), 1, most)


def judge_cell_text(text: Column) -> Column:
    """struct(tainted, confidence, evidence) of a cell's JSON text."""
    found = evidence(text, CELL_MARKERS, 3)
    return F.struct((F.size(found) > 0).alias("tainted"), F.when(F.size(found) > 0, "high").otherwise("medium").alias("confidence"), found.alias("evidence"))


def judge_row_text(text: Column) -> Column:
    """The same of a whole row's JSON text; without markers it is sure, with some it is not."""
    found = evidence(text, ROW_MARKERS, 5)
    return F.struct((F.size(found) > 0).alias("tainted"), F.when(F.size(found) > 0, "medium").otherwise("high").alias("confidence"), found.alias("evidence"))


class Judge(Protocol):
    """Decides on batches: one decision for each row, in order."""

    def __call__(self, batch: pd.DataFrame) -> list[bool]: ...


def judge_batches(candidates: DataFrame, key_columns: list[str], judge: Callable[[pd.DataFrame], list[bool]], batch_size: int = 40) -> DataFrame:
    """candidates with tainted, by a judge that sees each distinct combination of key_columns once (a remote model, say).
    Null is a key like any other. A judge that returns another number of decisions than rows is an error."""
    distinct = candidates.select(*key_columns).distinct()
    whole = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrow in batches:
            for at in range(0, arrow.num_rows, batch_size):
                batch = arrow.slice(at, batch_size)
                decisions = judge(batch.to_pandas(types_mapper=whole.get))
                if len(decisions) != batch.num_rows:
                    raise ValueError(f"{len(decisions)} decisions for {batch.num_rows} candidates")
                # The keys go back as they came: a data frame of the judge's may have changed them.
                tainted = pa.array([None if d is None or d is pd.NA else bool(d) for d in decisions], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns, tainted], names=[*key_columns, "tainted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema) + ", tainted boolean"
    judged = distinct.mapInArrow(run, schema).withColumnsRenamed({c: f"_judged_{c}" for c in key_columns})
    same = [F.col(c).eqNullSafe(F.col(f"_judged_{c}")) for c in key_columns]
    return candidates.join(judged, same).drop(*[f"_judged_{c}" for c in key_columns])


def _results(reply: str) -> list:
    """The list `results` of the JSON object in a model's reply, with or without a code fence."""
    start, end = reply.find("{"), reply.rfind("}")
    if start < 0 or end < start:
        raise ValueError("the reply holds no JSON object")
    return json.loads(reply[start : end + 1]).get("results")


def strict_decisions(reply: str, count: int) -> list[bool]:
    """Decisions of a reply whose results name each index from 0 to count - 1 once, each with a JSON boolean `tainted`, in
    any order. Anything else is a ValueError."""
    results = _results(reply)
    if not isinstance(results, list) or not all(isinstance(r, dict) for r in results):
        raise ValueError("results is no list of objects")
    by_index = {r.get("index"): r.get("tainted") for r in results if type(r.get("index")) is int}
    if len(results) != count or set(by_index) != set(range(count)):
        raise ValueError(f"results do not name each index below {count} once")
    if not all(isinstance(v, bool) for v in by_index.values()):
        raise ValueError("tainted is no JSON boolean")
    return [by_index[i] for i in range(count)]


def lenient_decisions(reply: str, count: int) -> list[bool]:
    """Decisions of a reply by place; what is missing is not tainted."""
    results = _results(reply)
    given = results if isinstance(results, list) else []
    return [bool(r.get("tainted")) if isinstance(r, dict) else False for r in (given + [None] * count)[:count]]


def asking(ask: Callable[[pd.DataFrame], str], parse: Callable[[str, int], list[bool]] = strict_decisions, retries: int = 2) -> Callable[[pd.DataFrame], list[bool]]:
    """A judge for judge_batches() that asks a model for a reply and parses it; what fails is asked again, `retries` times."""

    def judge(batch: pd.DataFrame) -> list[bool]:
        failed: Exception | None = None
        for _ in range(retries + 1):
            try:
                return parse(ask(batch), len(batch))
            except (KeyError, TypeError, ValueError, RuntimeError) as error:
                failed = error
        raise RuntimeError(f"no usable reply after {retries + 1} attempts: {failed}")

    return judge


def fenced_json(reply: Column) -> Column:
    """The JSON object in a model's reply, with or without a code fence; null if there is none."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when(F.call_function("try_parse_json", body).isNotNull() & (body != ""), body)
