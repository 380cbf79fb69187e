"""Vectors as exact integers, packed into blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block: with its position in the block added to 4096 times the block's number, each row has a number.
ROWS = 4096
#: Squared lengths up to here keep all distances and inner products of two vectors within 64 bits.
LONGEST = 2.0**60


def integers(column: pa.ListArray, factor: int, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix): floor(factor * x) of the vectors that are not null, have no null or non-finite component and, if
    dims is given, exactly that many. Without dims shorter vectors are filled up with 0."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
    values = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), "f8")
    of = np.repeat(np.arange(len(lengths)), lengths)
    usable = np.asarray(column.is_valid().to_numpy(zero_copy_only=False)) & (np.bincount(of, ~np.isfinite(values), len(lengths)) == 0)
    if dims is not None:
        usable &= lengths == dims
    scaled = np.floor(values * factor)
    if (np.bincount(of, np.where(usable[of], scaled, 0.0) ** 2, len(lengths)) > LONGEST).any():
        raise ValueError("a vector is too long for exact scores of 64 bits")
    wide = int(lengths[usable].max(initial=0)) if dims is None else dims
    matrix, first = np.zeros((len(lengths), wide), "i4"), np.cumsum(lengths) - lengths
    inside = usable[of]
    matrix[of[inside], (np.arange(len(of)) - first[of])[inside]] = scaled[inside]
    places = np.flatnonzero(usable)
    return places, matrix[places]


def blocks(vectors: DataFrame, key: str, vector: str, factor: int, *, dims: int | None = None, **also: Column) -> DataFrame:
    """(block, dims, data, ids, also...): up to ROWS usable rows each, in the order of the partitions; no shuffle. data
    holds 32-bit integers row by row; ids and what is given besides (long columns) are arrays of the same order."""

    names = ["block", "dims", "data", "ids", *also]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                places, matrix = integers(some.column(0), factor, dims)
                if len(places):
                    arrays = [pa.array([some.column(i).take(pa.array(places)).to_pylist()], pa.list_(pa.int64())) for i in range(1, some.num_columns)]
                    own = [pa.array([number], pa.int64()), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*own, *arrays], names=names)
                    number += 1

    more = "".join(f", {name} array<long>" for name in also)
    columns = [F.col(key).cast("long").alias("ids"), *[c.cast("long").alias(name) for name, c in also.items()]]
    return vectors.select(F.col(vector).cast("array<double>").alias("vector"), *columns).mapInArrow(pack, f"block long, dims int, data binary, ids array<long>{more}")


def matrix(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, "i4").reshape(-1, dims).astype("i8")
