"""The rarest members of sets, for joins of similar sets.

Two sets of similarity s share one of the n - ceil(s n) + 1 members that come first in any one order. In order of how
many sets hold a member, rarest first, what many sets share comes last and pairs nothing. The counts are exact: blocks of
sets ask the ranges of hashes that members lie in how many sets hold each, and get the answers in the order they asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash
from .packed import hash_range, loosen, squeeze

#: Members of the sets of a block, unless one set has more, and of a range.
MEMBERS = 1 << 20
#: First members of a set that are sent along with each, to tell the first one that two sets share.
LISTED = 64

_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("groups", pa.list_(pa.int64())), ("bits", pa.list_(pa.list_(pa.int64()))), ("sizes", pa.list_(pa.int64())), ("members", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False).astype("i8")
        cuts, held = [0], 0
        for i, size in enumerate(sizes):
            if held and held + size > MEMBERS:
                cuts.append(i)
                held = 0
            held += size
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            some = batch.slice(a, b - a)
            members = some.column(3).flatten().to_numpy(zero_copy_only=False).view("u8")
            row = {"block": number, "ids": some.column(0).to_pylist(), "groups": some.column(1).to_pylist(), "bits": some.column(2).to_pylist(), "sizes": sizes[a:b].tolist(), "members": members.tobytes()}
            yield pa.RecordBatch.from_pylist([row], _BLOCK)
            number += 1


def _asks(ranges: int):
    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                members, holders = np.unique(np.frombuffer(row["members"], "u8"), return_counts=True)
                cuts = np.searchsorted(hash_range(members, ranges), np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[r], cuts[r + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (row["block"], int(r), members[part].tobytes(), squeeze(holders[part]))], names=["block", "range", "members", "holders"])

    return asks


def _count(key: tuple, table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    own = [np.frombuffer(r["members"], "u8") for r in rows]
    _, at = np.unique(np.concatenate(own), return_inverse=True)
    holders = np.bincount(at, np.concatenate([loosen(r["holders"]) for r in rows])).astype("i8")
    cuts = np.cumsum([0, *map(len, own)])
    answers = [squeeze(holders[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([pa.array([r["block"] for r in rows], pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int64()), pa.array(answers, pa.binary())], names=["block", "range", "holders"])


def first_members(members: np.ndarray, sizes: np.ndarray, holders: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, place, member) of the first members of each set that another set holds too: by set, then place, which counts
    those before it in the set's order, rarest first."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((members, holders, of))
    place = np.arange(len(members)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wanted = sizes + (-sizes * percent) // 100 + 1
    kept = (place < wanted[of]) & (holders[order] > 1)
    return of[kept], place[kept], members[order][kept]


def _placed(percent: int):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                members, sizes = np.frombuffer(row["members"], "u8"), np.array(row["sizes"], "i8")
                _, at = np.unique(members, return_inverse=True)
                holders = np.concatenate([loosen(a["holders"]) for a in sorted(row["answers"], key=lambda a: a["range"])])[at]
                of, place, member = first_members(members, sizes, holders, percent)
                starts = np.searchsorted(of, np.arange(len(sizes) + 1))
                for a in range(0, len(of), 10000):
                    some = of[a : a + 10000]
                    lists = [member[starts[s] : starts[s + 1]].view("i8") if starts[s + 1] - starts[s] <= LISTED else None for s in some]
                    arrays = [
                        pa.array(member[a : a + 10000].view("i8")), pa.array(np.array(row["ids"], "i8")[some]), pa.array(np.array(row["groups"], "i8")[some]), pa.array(sizes[some]),
                        pa.array([row["bits"][s] for s in some], pa.list_(pa.int64())), pa.array(place[a : a + 10000]), pa.array(lists, pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["shingle", "id", "component", "n", "bits", "before", "prefix"])

    return placed


def rarest_members(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, id, component, n, bits, before, prefix): for each set (id, component, bits, hashes) those of its first
    members that another set holds too; before: how many members of the set come first; prefix: all these members, if
    they are no more than LISTED."""
    blocks = stash(sets.select("id", "component", "bits", "hashes").mapInArrow(_blocks, "block long, ids array<long>, groups array<long>, bits array<array<long>>, sizes array<long>, members binary"), "sets")
    total = blocks.agg(F.sum(F.octet_length("members"))).first()[0] or 0
    asked = blocks.select("block", "members").mapInArrow(_asks(-(-max(1, total // 8) // MEMBERS)), "block long, range long, members binary, holders binary")
    answers = asked.groupBy("range").applyInArrow(_count, "block long, range long, holders binary").groupBy("block").agg(F.collect_list(F.struct("range", "holders")).alias("answers"))
    out = stash(blocks.join(answers, "block").mapInArrow(_placed(percent), "shingle long, id long, component long, n long, bits array<long>, before long, prefix array<long>"), "rarest")
    drop_stash(blocks)
    return out
