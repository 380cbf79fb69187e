"""A hierarchical Pitman-Yor bigram model of whole corpora, sampled in buckets.

Every word that precedes another is a context with a restaurant of its own; all of them share one parent, the restaurant
of single words, whose base is uniform over the V words of the training rows and one more. A table of a context's
restaurant is a customer of the parent's. Seatings are sampled by Gibbs moves: a customer drawn at random leaves its
table and is seated again, at a table with its customers less the discount, or at a new one with
(strength + discount * tables) * parent's probability. Seatings of distinct word pairs meet only in the number of tables
of their context and in the parent's probability of their word. So pairs are dealt to buckets by a hash of both words,
which no frequent word makes larger, and in each round buckets seat their pairs with these two held, then exchange them:
each sends its words' counts and tables to the words' buckets, which add them up, seat the parent's customers, and answer
in the order they were asked. The probability of a pair is the mean over the sampled seatings but the first.

Texts are read once, into blocks of word numbers, which ranges of the words' hashes give out. A block asks the buckets for
its distinct pairs only, and gets their probabilities back in its own order. Between steps everything lies in the shared folder, a row a block or a bucket.
"""

from __future__ import annotations

import gc
import random
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stash, scratch_path
from .packed import distinct, hash_range, loosen, squeeze, stable_order, steps

#: Characters of text of a block, and bytes of text for which there is one bucket of pairs and one of words.
BLOCK_CHARS, BUCKET_BYTES = 8 << 20, 16 << 20
SEED = 11
#: The end of a text, as no word has a space.
END = xxhash.xxh64_intdigest(b" ")


def _deal(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of pairs of word numbers."""
    mixed = (first.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + second.astype("u8")) * np.uint64(0xBF58476D1CE4E5B9)
    return hash_range((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB), buckets)


class Process(NamedTuple):
    """Discount and strength of the contexts' restaurants and of the parent's; sampled seatings that are averaged; sweeps
    of Gibbs moves between two of them."""

    discount: float = 0.75
    strength: float = 5.0
    parent_discount: float = 0.7
    parent_strength: float = 10.0
    samples: int = 2
    sweeps: int = 2


#: Bytes of a word that are hashed by table, by their place and value; the sum of random numbers over all places is as
#: likely to be that of another word as any number. Bytes between words add nothing.
PLACES = 64
_BETWEEN = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where(np.isin(np.arange(256), np.arange(0x41, 0x5B)), np.arange(256) + 32, np.arange(256)).astype("u1")
_TABLE = np.where(_BETWEEN, np.uint64(0), np.random.default_rng(SEED).integers(0, 1 << 64, (PLACES, 256), "u8"))[:, _LOWER].ravel()
#: Characters of texts and words that are hashed together; a longer text is taken whole.
PIECE, _AT_ONCE = 1 << 20, 1 << 13


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of texts, one after the other; words of each text). Words are runs of anything but the space and
    0x09-0x0D, with A-Z in lower case; null texts have none."""
    held = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(held.buffers()[1], "i8")[held.offset : held.offset + len(held) + 1]
    if not len(held) or offsets[0] == offsets[-1]:
        return np.empty(0, "u8"), np.zeros(len(held), "i8")
    raw = np.frombuffer(held.buffers()[2], "u1")[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_BETWEEN[raw]
    fresh, last = np.ones(len(raw) + 1, "?"), np.ones(len(raw), "?")
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets] = True
    last[:-1] = ~inside[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(inside & fresh[:-1]), np.flatnonzero(inside & last) + 1
    hashes = np.empty(len(starts), "u8")
    for i in range(0, len(starts), _AT_ONCE):
        own = starts[i : i + _AT_ONCE]
        first, until = own[0], ends[min(i + _AT_ONCE, len(starts)) - 1]
        place = np.arange(first, until) - np.repeat(own, np.diff(own, append=until))
        np.minimum(place, PLACES - 1, out=place)
        place <<= 8
        place += raw[first:until]
        hashes[i : i + _AT_ONCE] = np.add.reduceat(_TABLE[place], own - first)
    for i in np.flatnonzero(ends - starts > PLACES):
        hashes[i] = xxhash.xxh64_intdigest(_LOWER[raw[starts[i] : ends[i]]].tobytes())
    return hashes, np.diff(np.searchsorted(starts, offsets))


def _blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """(block, keys, train, sizes, end, words, tokens): words are sorted hashes, tokens and end their places."""
    block, names = TaskContext.get().partitionId() << 24, ["block", "keys", "train", "sizes", "end", "words", "tokens"]
    keys, train, parts, counts, held = [], [], [], [], 0

    def row() -> pa.RecordBatch:
        sizes = np.concatenate(counts) + 1
        hashes, is_end = np.full(sizes.sum(), END, "u8"), np.zeros(sizes.sum(), "?")
        is_end[np.cumsum(sizes) - 1] = True
        hashes[~is_end] = np.concatenate(parts)
        words, tokens = distinct(hashes)
        values = [[block], [keys], [train], [squeeze(sizes)], [int(np.searchsorted(words, np.uint64(END)))], [words.tobytes()], [squeeze(tokens)]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    for batch in batches:
        # A block ends with the text that brings it to `chars`; a batch is taken in pieces that end where a block does.
        reach, at = np.cumsum(64 + pc.utf8_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype("i8")), 0
        while at < batch.num_rows:
            before = int(reach[at - 1]) if at else 0
            full, piece = (int(np.searchsorted(reach, before + most, "left")) + 1 for most in (max(1, chars - held), PIECE))
            until = min(full, piece, batch.num_rows)
            own = batch.slice(at, until - at)
            hashes, count = word_hashes(own.column(2))
            keys += own.column(0).to_pylist()
            train += own.column(1).to_pylist()
            parts.append(hashes), counts.append(count)
            held, at = held + int(reach[until - 1]) - before, until
            if held >= chars:
                yield row()
                block, held = block + 1, 0
                for x in (keys, train, parts, counts):
                    x.clear()
    if keys:
        yield row()


def _asks(ranges: int):
    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, to, words, seen): the words of a block that lie in each range of hashes, and how often its training rows
        have them."""
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], "u8")
                seen = np.bincount(loosen(row["tokens"]), np.repeat(np.array(row["train"], "f8"), loosen(row["sizes"])), len(words)).astype("i8")
                cuts = np.searchsorted(hash_range(words, ranges), np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[r], cuts[r + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (row["block"], int(r), words[part].tobytes(), squeeze(seen[part]))], names=["block", "to", "words", "seen"])

    return asks


def _ranks(key: tuple, table: pa.Table) -> pa.Table:
    """(block, to, ranks, often, distinct): the places of a block's words among all words of a range, and how often all
    training rows have them."""
    own = [np.frombuffer(x.as_py(), "u8") for x in table.column("words")]
    words, at = distinct(np.concatenate(own))
    often = np.bincount(at, np.concatenate([loosen(x.as_py()) for x in table.column("seen")]), len(words)).astype("i8")
    cuts = np.cumsum([0, *map(len, own)])
    parts = [at[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    values = [table.column("block").cast(pa.int64()), pa.array([key[0].as_py()] * len(own), pa.int64()), pa.array([steps(x) for x in parts], pa.binary()), pa.array([squeeze(often[x]) for x in parts], pa.binary())]
    return pa.table([*values, pa.array([len(words)] * len(own), pa.int64())], names=["block", "to", "ranks", "often", "distinct"])


def _numbered(blocks: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """(blocks whose words are numbers, rising with the hashes, with `often`, the count of each; how many numbers there are)."""
    asked = blocks.select("block", "train", "sizes", "words", "tokens").mapInArrow(_asks(ranges), "block long, to long, words binary, seen binary")
    ranks = _keep(asked.groupBy("to").applyInArrow(_ranks, "block long, to long, ranks binary, often binary, distinct long"), "ranks")
    sizes = {r["to"]: r["n"] for r in ranks.groupBy("to").agg(F.max("distinct").alias("n")).collect()}
    first, total = {}, 0
    for r in sorted(sizes):
        first[r], total = total, total + sizes[r]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = sorted(row["answers"], key=lambda a: a["to"])
                numbers = np.concatenate([first[a["to"]] + np.cumsum(loosen(a["ranks"])) for a in found])
                often = np.concatenate([loosen(a["often"]) for a in found])
                yield pa.RecordBatch.from_pylist([row | {"words": steps(numbers), "often": squeeze(often)}], schema)

    schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("end", pa.int64()), *[(c, pa.binary()) for c in ("words", "tokens", "often")]])
    answers = ranks.groupBy("block").agg(F.collect_list(F.struct("to", "ranks", "often")).alias("answers"))
    out = _keep(blocks.join(answers, "block").mapInArrow(number, _BLOCK_SQL + ", often binary"), "blocks")
    drop_stash(blocks)
    drop_stash(ranks)
    return out, total


def _pairs(row: dict, buckets: int) -> tuple[np.ndarray, ...]:
    """Of a block: numbers of its words, first and second place of its distinct pairs, how often each is in training rows,
    the bucket of each (rising), and the pair of every token."""
    words, tokens, sizes = np.cumsum(loosen(row["words"])), loosen(row["tokens"]), loosen(row["sizes"])
    before = np.concatenate([[row["end"]], tokens[:-1]])
    pairs, of = distinct(before * len(words) + tokens)
    del before, tokens
    first, second = np.divmod(pairs, len(words))
    seen = np.bincount(of, np.repeat(np.array(row["train"], "f8"), sizes), len(pairs)).astype("i8")
    bucket = _deal(words[first], words[second], buckets)
    order = stable_order(bucket)
    back = np.empty(len(order), "i8")
    back[order] = np.arange(len(order))
    return words, first[order], second[order], seen[order], bucket[order], back[of]


def opening(customers: np.ndarray, fresh: np.ndarray, discount: float, dice: np.random.Generator) -> np.ndarray:
    """Tables to begin with: dishes of up to 16 customers have one; larger ones are seated in batches that grow by a tenth."""
    tables, seated = np.ones(len(customers), "i8"), 16
    open_ = np.flatnonzero(customers > seated)
    while len(open_):
        until = np.minimum(customers[open_], seated + max(1, seated // 10))
        new = fresh[open_] / (fresh[open_] + np.maximum(seated - discount * tables[open_], 1e-9))
        tables[open_] += dice.binomial(until - seated, new)
        seated += max(1, seated // 10)
        open_ = open_[customers[open_] > seated]
    return tables


#: With fewer dishes than this left to move, each is moved on its own.
TOGETHER = 80


def reseat(customers: np.ndarray, tables: np.ndarray, sizes: np.ndarray, fresh: np.ndarray, discount: float, dice: np.random.Generator, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables, sizes) of dishes after Gibbs moves. Dishes have two customers or more each; `sizes` holds the customers at
    their tables, dish after dish; `fresh` is the weight of a new table. A sweep makes a move for each customer of a dish,
    whatever their number; a step takes one customer of every dish that has moves left.

    A customer that has left draws one of the others, whose table it joins with probability 1 - discount / its customers,
    or a new table by its weight, and draws again if it does not join: the chance of a table is its customers less the
    discount, and a move takes the same time in a dish of any size."""
    if not len(customers) or not sweeps:
        return tables, sizes
    order = stable_order(int(customers.max()) - customers)
    c, t, new = customers[order], tables[order], fresh[order]
    start, moves = np.cumsum(c) - c, c * sweeps
    within = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
    slot, filled = np.repeat(start, t) + within, sizes[np.repeat((np.cumsum(tables) - tables)[order], t) + within]
    # A dish has a slot for each customer: `held` are the customers at a table, `at` the table of a customer; the tables
    # without customers are a stack, `free` from the dish's start up to `top`.
    held, at = np.zeros(int(c.sum()), "i8"), np.repeat(slot, filled)
    held[slot] = filled
    free, top = np.repeat(2 * start + c - 1, c) - np.arange(len(held)), start + c - t
    steps_ = int(moves[TOGETHER - 1]) if len(c) >= TOGETHER else 0
    alive = np.searchsorted(-moves, -np.arange(steps_), "left")
    for n in alive.tolist():
        base, others, weight = start[:n], c[:n] - 1, new[:n]
        leaver = base + (dice.random(n) * c[:n]).astype("i8")
        left = at[leaver]
        rest = held[left] - 1
        held[left] = rest
        draw = dice.random(n) * (weight + others) - weight
        opens = draw < 0
        near = base + np.minimum(np.maximum(draw, 0).astype("i8"), others - 1)
        to = at[near + (near >= leaver)]
        again = np.flatnonzero(~opens & (dice.random(n) * held[to] < discount))
        while len(again):
            draw = dice.random(len(again)) * (weight[again] + others[again]) - weight[again]
            opened = draw < 0
            near = base[again] + np.minimum(np.maximum(draw, 0).astype("i8"), others[again] - 1)
            joined = at[near + (near >= leaver[again])]
            opens[again], to[again] = opened, joined
            again = again[~opened & (dice.random(len(again)) * held[joined] < discount)]
        gone = rest == 0
        both = opens & gone
        to[both] = left[both]
        push, pop = np.flatnonzero(gone & ~opens), np.flatnonzero(opens & ~gone)
        free[top[push]] = left[push]
        top[push] += 1
        top[pop] -= 1
        to[pop] = free[top[pop]]
        at[leaver] = to
        held[to] += 1
    for dish in np.flatnonzero(moves > steps_):
        part = slice(start[dish], start[dish] + c[dish])
        spare = free[start[dish] : top[dish]] - start[dish]
        held[part] = _move_alone(at[part] - start[dish], held[part], spare, float(new[dish]), discount, random.Random(int(dice.integers(1 << 62))), int(moves[dish]) - steps_)
    filled = held > 0
    after, owner = np.empty(len(c), "i8"), np.repeat(order, c)[filled]
    after[order] = np.add.reduceat(filled.astype("i8"), start)
    return after, held[filled][stable_order(owner)]


def _move_alone(at: np.ndarray, held: np.ndarray, free: np.ndarray, weight: float, discount: float, dice: random.Random, moves: int) -> array:
    """The moves of a single dish: customers at its tables afterwards."""
    at, held, free, draw = array("q", at.tobytes()), array("q", held.tobytes()), free.tolist(), dice.random
    customers = len(at)
    whole = weight + customers - 1
    for _ in range(moves):
        leaver = int(draw() * customers)
        left = at[leaver]
        held[left] -= 1
        if not held[left]:
            free.append(left)
        while True:
            x = draw() * whole - weight
            if x < 0:
                to = free.pop()
                break
            near = int(x)
            if near >= customers - 1:
                near = customers - 2
            to = at[near + (near >= leaver)]
            if draw() * held[to] >= discount:
                break
        at[leaver] = to
        held[to] += 1
    return held


def _sends(words: np.ndarray, first: np.ndarray, second: np.ndarray, seen: np.ndarray, tables: np.ndarray, buckets: int, numbers: int) -> list[dict]:
    """For each bucket of words, an equal range of their numbers: which, how often they are, tables that serve them, tables of their own restaurant."""
    sums = [np.bincount(of, x, len(words)).astype("i8") for of, x in ((second, seen), (second, tables), (first, tables))]
    cuts = np.searchsorted(words * buckets // numbers, np.arange(buckets + 1))
    return [
        {"to": v, "words": steps(words[a:b]), **{name: squeeze(x[a:b]) for name, x in zip(("seen", "served", "own"), sums, strict=True)}}
        for v, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a
    ]


_SENT = pa.list_(pa.struct([("to", pa.int64()), *[(c, pa.binary()) for c in ("words", "seen", "served", "own")]]))
_STATE = pa.schema([
    ("bucket", pa.int64()), *[(c, pa.binary()) for c in ("words", "first", "second", "seen", "tables", "sizes")],
    ("past", pa.list_(pa.struct([(c, pa.binary()) for c in ("tables", "parent", "own")]))), ("sends", _SENT),
])
_BLOCK_SQL = "block long, keys array<long>, train array<boolean>, sizes binary, end long, words binary, tokens binary"
_MERGED = _STATE.append(pa.field("asked", pa.list_(pa.struct([("block", pa.int64()), ("at", pa.binary())]))))
_STATE_SQL = (
    "bucket long, words binary, first binary, second binary, seen binary, tables binary, sizes binary, past array<struct<tables:binary,parent:binary,own:binary>>, "
    "sends array<struct<to:long,words:binary,seen:binary,served:binary,own:binary>>"
)
_MERGED_SQL = _STATE_SQL + ", asked array<struct<block:long,at:binary>>"


def _release(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver collects its garbage, which may take long otherwise."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _keep(df: DataFrame, name: str) -> DataFrame:
    """As stash(), with compressed pages, and without what finished steps have left."""
    path = scratch_path(df.sparkSession, name)
    _release(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    _release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _slices(blocks: DataFrame, buckets: int) -> DataFrame:
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, first, second, seen, bucket, _ = _pairs(row, buckets)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[b], cuts[b + 1])
                    own, place = distinct(np.concatenate([first[part], second[part]]))
                    n = part.stop - part.start
                    values = (int(b), row["block"], steps(words[own]), steps(place[:n]), squeeze(place[n:]), squeeze(seen[part]))
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["bucket", "block", "words", "first", "second", "seen"])

    return blocks.select("block", "train", "sizes", "end", "words", "tokens").mapInArrow(slices, "bucket long, block long, words binary, first binary, second binary, seen binary")


def _merge(buckets: int, numbers: int):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """All slices of a bucket as one row: distinct pairs, each with one table as far as it is known."""
        rows = table.to_pylist()
        own = [np.cumsum(loosen(r["words"])) for r in rows]
        words = np.unique(np.concatenate(own))
        keys = []
        for r, mine in zip(rows, own, strict=True):
            place = np.searchsorted(words, mine)
            keys.append(place[np.cumsum(loosen(r["first"]))] * len(words) + place[loosen(r["second"])])
        pairs, at = distinct(np.concatenate(keys))
        first, second = np.divmod(pairs, len(words))
        seen = np.bincount(at, np.concatenate([loosen(r["seen"]) for r in rows]), len(pairs)).astype("i8")
        cuts = np.cumsum([0, *map(len, keys)])
        asked = [{"block": r["block"], "at": steps(at[a:b])} for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)]
        tables = np.minimum(seen, 1)
        row = {
            "bucket": key[0].as_py(), "words": steps(words), "first": steps(first), "second": squeeze(second), "seen": squeeze(seen), "tables": squeeze(tables),
            "sizes": None, "past": [], "asked": asked, "sends": _sends(words, first, second, seen, tables, buckets, numbers),
        }
        return pa.Table.from_pylist([row], _MERGED)

    return merge


def _parent(buckets: int, turn: int, how: Process):
    """What word buckets answer: how often each word is in training rows, customers and tables it has at the parent's, and
    tables of its own restaurant."""

    def parent(key: tuple, table: pa.Table) -> pa.Table:
        rows, dice = table.to_pylist(), np.random.default_rng([SEED, turn, 1, key[0].as_py()])
        own = [np.cumsum(loosen(r["words"])) for r in rows]
        words, at = distinct(np.concatenate(own))
        seen, served, mine = (np.bincount(at, np.concatenate([loosen(r[c]) for r in rows]), len(words)).astype("i8") for c in ("seen", "served", "own"))
        # Numbers follow the hashes, which are even, so this bucket tells how many words and tables there are in all.
        known, tables = int((seen > 0).sum()), np.minimum(served, 1)
        many = np.flatnonzero(served > 1)
        fresh = np.full(len(many), (how.parent_strength + how.parent_discount * known * buckets) / (known * buckets + 1))
        some = opening(served[many], fresh, how.parent_discount, dice)
        tables[many], _ = reseat(served[many], some, _first_sizes(served[many], some), fresh, how.parent_discount, dice, how.sweeps)
        totals = [known, int(seen.sum()), int(served.sum()), int(tables.sum())]
        out, cuts = [{"bucket": -1, "to": key[0].as_py(), "totals": totals}], np.cumsum([0, *map(len, own)])
        for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True):
            out.append({"bucket": r["bucket"], "to": key[0].as_py(), **{c: squeeze(x[at[a:b]]) for c, x in (("seen", seen), ("served", served), ("tables", tables), ("own", mine))}})
        return pa.Table.from_pylist(out, schema)

    schema = pa.schema([("bucket", pa.int64()), ("to", pa.int64()), *[(c, pa.binary()) for c in ("seen", "served", "tables", "own")], ("totals", pa.list_(pa.int64()))])
    return parent, "bucket long, to long, seen binary, served binary, tables binary, own binary, totals array<long>"


def _first_sizes(customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """All tables but the first of each dish have one customer."""
    sizes = np.ones(tables.sum(), "i8")
    sizes[np.cumsum(tables) - tables] = customers - tables + 1
    return sizes


def _answered(row: dict, totals: tuple[int, int, int, int], how: Process) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a bucket: how often they are in training rows, the parent's probability, tables of their own."""
    known, _, customers, all_tables = totals
    seen, served, tables, own = (np.concatenate([loosen(a[c]) for a in sorted(row["answers"], key=lambda a: a["to"])]) for c in ("seen", "served", "tables", "own"))
    base = (how.parent_strength + how.parent_discount * all_tables) / (known + 1)
    return seen, (served - how.parent_discount * tables + base) / (how.parent_strength + customers), own


def _seat(turn: int, totals: tuple[int, int, int, int], buckets: int, numbers: int, how: Process):
    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A round of a bucket; the seating that the answers belong to becomes a sample, but for the first."""
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                dice = np.random.default_rng([SEED, turn, 0, row["bucket"]])
                words, first, second = np.cumsum(loosen(row["words"])), np.cumsum(loosen(row["first"])), loosen(row["second"])
                seen, tables = loosen(row["seen"]), loosen(row["tables"])
                _, parent, own = _answered(row, totals, how)
                if turn:
                    row["past"].append({"tables": row["tables"], "parent": parent.astype("f4").tobytes(), "own": squeeze(own)})
                many = np.flatnonzero(seen > 1)
                fresh = (how.strength + how.discount * own[first[many]]) * parent[second[many]]
                if turn:
                    some, sizes = tables[many], loosen(row["sizes"])
                else:
                    some = opening(seen[many], fresh, how.discount, dice)
                    sizes = _first_sizes(seen[many], some)
                tables[many], sizes = reseat(seen[many], some, sizes, fresh, how.discount, dice, how.sweeps)
                row |= {"tables": squeeze(tables), "sizes": squeeze(sizes), "sends": _sends(words, first, second, seen, tables, buckets, numbers)}
                yield pa.RecordBatch.from_pylist([row], _STATE)

    return seat


def _answer(totals: tuple[int, int, int, int], how: Process):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, bucket, score): log10 probabilities of the pairs a block asked for."""
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                first, second, seen = np.cumsum(loosen(row["first"])), loosen(row["second"]), loosen(row["seen"])
                often, parent, own = _answered(row, totals, how)
                samples = [(loosen(row["tables"]), parent, own)] + [(loosen(p["tables"]), np.frombuffer(p["parent"], "f4"), loosen(p["own"])) for p in row["past"]]
                total = sum((seen - how.discount * t + (how.strength + how.discount * o[first]) * p[second]) / (how.strength + often[first]) for t, p, o in samples)
                score = np.log10(total / len(samples)).astype("f4")
                for a in row["asked"]:
                    places = np.cumsum(loosen(a["at"]))
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (a["block"], row["bucket"], score[places].tobytes())], names=["block", "bucket", "score"])

    return answer


def _score(key: str, totals: tuple[int, int, int, int], buckets: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tokens = totals[:2]
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                of, sizes = _pairs(row, buckets)[-1], loosen(row["sizes"])
                model = np.concatenate([np.frombuffer(p["score"], "f4") for p in sorted(row["found"], key=lambda p: p["bucket"])])[of]
                seen = loosen(row["often"])[loosen(row["tokens"])]
                base, from_ = np.log10((seen + 1) / (tokens + known + 1)), np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(x, from_) for x in ((seen > 0).astype("i8"), base, model.astype("f8"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array([not x for x in row["train"]]), pa.array(sizes), pa.array(sums[0]), pa.array(np.full(len(sizes), tokens)), pa.array(sums[1]), pa.array(sums[2])],
                    names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", how: Process = Process(), block_chars: int = BLOCK_CHARS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row (key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    The model is learned from the rows that are not held out (a null counts as not held out). Tokens are the words of the
    whole text and one end; a null text is an empty one and has the end alone. n_known counts tokens that training rows
    have, train_tokens those of all training rows. base_score is the sum over tokens of log10((count + 1) / (train_tokens
    + distinct + 1)); score is the log10 probability of the text under the model, of which 10 ** (-score / n_tokens) is
    the perplexity. Without training rows both are 0. Rows that repeat a key are texts of their own, equal texts have equal
    scores, null keys are kept and other columns are left out; an empty table gives an empty one. A text is in one block,
    so a task holds its words. Words are told apart by 64-bit hashes.
    """
    train = ~F.coalesce(held_out, F.lit(False))
    own = docs.select(F.col(key).cast("long").alias("key"), train.alias("train"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = -(-max(1, size) // bucket_bytes)
    blocks, numbers = _numbered(_keep(own.mapInArrow(lambda batches: _blocks(batches, block_chars), _BLOCK_SQL), "blocks"), buckets)
    state = _keep(_slices(blocks, buckets).groupBy("bucket").applyInArrow(_merge(buckets, max(1, numbers)), _MERGED_SQL), "pairs")
    asked = _keep(state.select("bucket", "asked"), "asked")
    for turn in range(how.samples + 1):
        parent, schema = _parent(buckets, turn, how)
        sent = state.select("bucket", F.explode("sends").alias("s")).select("bucket", "s.*")
        answers = _keep(sent.groupBy("to").applyInArrow(parent, schema), "words")
        sums = answers.filter("bucket = -1").select(*[F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(4)]).first()
        totals = tuple(int(x) for x in sums)
        back = answers.filter("bucket >= 0").groupBy("bucket").agg(F.collect_list(F.struct("to", "seen", "served", "tables", "own")).alias("answers"))
        ready = state.drop("sends", "asked").join(back, "bucket")
        if turn == how.samples:
            break
        after = _keep(ready.mapInArrow(_seat(turn, totals, buckets, numbers, how), _STATE_SQL), "pairs")
        drop_stash(state)
        drop_stash(answers)
        state = after
    scores = _keep(ready.join(asked, "bucket").mapInArrow(_answer(totals, how), "block long, bucket long, score binary"), "scores")
    for done in (state, answers, asked):
        drop_stash(done)
    _release(docs.sparkSession)
    found = scores.groupBy("block").agg(F.collect_list(F.struct("bucket", "score")).alias("found"))
    score, schema = _score(key, totals, buckets)
    return blocks.join(found, "block").mapInArrow(score, schema)
