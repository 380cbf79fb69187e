"""Near-duplicate documents by a multi-index Hamming join over MinHash signatures.

A document's set holds the 64-bit hashes of its distinct word shingles; its signature has CHUNKS chunks of six MinHash
values of 9 bits, each chunk packed into a long with a spare bit to each value. Two sets of similarity s differ in about
(1 - s) * 66 places. All pairs that differ in MAX_DISTANCE places at most are found: by the pigeonhole principle some
chunk has MAX_DISTANCE // CHUNKS errors at most, which is one; so every chunk gives one key for each place that may be
wrong, and near signatures share a key. (At the link threshold of 0.85 a pair has two errors or more in every chunk about
once in ten million times; for a lower threshold `bounds` gives more chunks and a wider sketch distance.)

Documents with equal sets are one vertex. Those that share a key with another one get their full sets and a wide sketch
of SKETCH one-bit MinHash values, whose distance screens pairs more sharply than the signature could (at most
SKETCH_DISTANCE; a pair at the link threshold of 0.85 differs in more places once in twenty million times). First every
member of a bucket is held against its smallest and its largest one, two stars of as many rows as members; those links
make components. Members of buckets in which components still meet are then held against those that share a shingle among
their rarest (`rarest`): a passage that many documents share makes a large bucket, but no pairs. Full sets decide
on every link. MAX_DISTANCE says what the chunks guarantee; no filter uses it, as pairs beyond it that share a key count
too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, drop_stash, stash
from .rarest import rarest_members
from .subwords import slices

CHUNKS, WIDTH, MAX_DISTANCE = 11, 6, 21
SYMBOLS = CHUNKS * WIDTH
SKETCH, SKETCH_DISTANCE = 1024, 125
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 1 << 63, SYMBOLS, "u8") * np.uint64(2) + np.uint64(1)
#: Rows of one hub are dealt to this many tasks.
SALTS = 32
#: A pair at the link threshold may be missed this often by the chunk keys, and by the sketches.
CHUNK_MISS, SKETCH_MISS = 1e-7, 5e-8
#: A lower threshold would take more than 140 chunks.
LEAST_PERCENT = 50
_LANES = np.arange(WIDTH, dtype="u8") * np.uint64(10)
_SHIFTS = _RANDOM.integers(0, 1 << 63, SYMBOLS, "u8")
_PLACES = _RANDOM.integers(1, 1 << 63, 64, "u8") * np.uint64(2) + np.uint64(1)
_WIDE = _RANDOM.integers(1, 1 << 31, SKETCH, "u4") * np.uint32(2) + np.uint32(1)
_WIDE_SHIFTS = _RANDOM.integers(0, 1 << 32, SKETCH, "u4")
_MORE = np.random.default_rng(20240301).integers(0, 1 << 63, (2, 140 * WIDTH), "u8")
_FACTORS, _SHIFTS = np.append(_FACTORS, _MORE[0] * np.uint64(2) + np.uint64(1)), np.append(_SHIFTS, _MORE[1])


@cache
def bounds(percent: int) -> tuple[int, int]:
    """(chunks, sketch distance) for a link threshold: at 85 CHUNKS and SKETCH_DISTANCE, below it more; never fewer."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must lie between {LEAST_PERCENT} and 100, not {percent}")
    p, bit = 1 - percent / 100, (1 - percent / 100) / 2
    broken, chunks = 1 - (1 - p) ** WIDTH - WIDTH * p * (1 - p) ** (WIDTH - 1), CHUNKS
    while broken**chunks > CHUNK_MISS:
        chunks += 1
    tail, most = 0.0, SKETCH
    while (tail := tail + comb(SKETCH, most) * bit**most * (1 - bit) ** (SKETCH - most)) <= SKETCH_MISS and most > SKETCH_DISTANCE:
        most -= 1
    return chunks, most


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes() -> Memo:
    """Hashes of words, remembered by a task."""
    return Memo(xxhash.xxh64_intdigest, 32 << 20)


def shingle_set(text: str | None, width: int, known: Memo | None = None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text. Words are what bytes.split() gives: runs of anything but the
    space and 0x09-0x0D, with A-Z in lower case. Fewer words than width are one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "u8")
    hashes = np.fromiter(map((known if known is not None else word_hashes()).__getitem__, words), "u8", len(words))
    n = max(1, len(words) - width + 1)
    total = np.full(n, len(words) if len(words) < width else width, "u8")
    for k in range(min(width, len(words))):
        total = total * _PLACES[0] + _mix(hashes[k : k + n] ^ _PLACES[k + 1])
    return np.unique(_mix(total))


def signature(hashes: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """Longs, one for each chunk, with the MinHash values of a set that is not empty."""
    symbols = chunks * WIDTH
    low = np.full(symbols, np.iinfo("u8").max, "u8")
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * _FACTORS[:symbols] + _SHIFTS[:symbols]
        part ^= part >> np.uint64(32)
        np.minimum(low, part.min(axis=0), out=low)
    return ((_mix(low) & np.uint64(0x1FF)).reshape(chunks, WIDTH) << _LANES).sum(axis=1, dtype="u8").view("i8")


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """All keys of signatures (rows of longs): for each chunk and each place in it a hash of the chunk without it, whose
    low ten bits are the number of the key."""
    without = signatures.view("u8")[:, :, None] & ~(np.uint64(0x1FF) << _LANES)
    place = np.arange(signatures.shape[1], dtype="u8")[:, None] * np.uint64(8) + np.arange(WIDTH, dtype="u8")
    keys = _mix(_mix(without) + place * _PLACES[63]).reshape(len(signatures), -1)
    return ((keys & ~np.uint64(1023)) | np.arange(keys.shape[1], dtype="u8")).view("i8")


def wide_sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH one-bit MinHash values of a set that is not empty, packed into longs."""
    short, low = (hashes >> np.uint64(32)).astype("u4"), np.full(SKETCH, 0xFFFFFFFF, "u4")
    for at in range(0, len(short), 512):
        for k in range(0, SKETCH, 64):
            part = short[at : at + 512, None] * _WIDE[k : k + 64] + _WIDE_SHIFTS[k : k + 64]
            part = (part ^ (part >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            np.minimum(low[k : k + 64], part.min(axis=0), out=low[k : k + 64])
    bits = _mix(low.astype("u8") * np.uint64(SKETCH) + np.arange(SKETCH, dtype="u8")) & np.uint64(1)
    return np.packbits(bits.astype("u1")).view("<i8")


def sketches(docs: DataFrame, key: str, text: str, width: int, chunks: int = CHUNKS) -> DataFrame:
    """(id, n, digest, sig) of every row: set size, a 128-bit digest of the set, the signature packed into longs; no shuffle."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for batch in batches:
            ids, sizes, digests, sigs = batch.column(0), [], [], []
            for value in batch.column(1):
                found = shingle_set(value.as_py(), width, known)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found, chunks).tolist() if len(found) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["id", "n", "digest", "sig"])

    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(sketch, "id long, n long, digest binary, sig array<long>")


def _keyed(vertices: DataFrame) -> DataFrame:
    """(id, bucket): every key of every vertex."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                keys = chunk_keys(np.array(some.column(1).to_pylist(), "i8"))
                ids = np.repeat(some.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys.ravel())], names=["id", "bucket"])

    return vertices.select("id", "sig").mapInArrow(keyed, "id long, bucket long")


def _near(percent: int) -> Column:
    """Sketches within the distance and set sizes that allow the similarity."""
    differing = reduce(lambda x, y: x + y, [F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(SKETCH // 64)])
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (differing <= bounds(percent)[1])


def _side(vertices: DataFrame, end: str, *columns: str) -> DataFrame:
    return vertices.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])


def _with_hub(pairs: DataFrame, vertices: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with columns of both ends. Many pairs may have one b, so its rows are dealt by a salt as well; of its
    columns at most SALTS copies are made."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    hubs = salted.select("b", "salt").distinct().join(_side(vertices, "b", *columns), "b")
    return salted.join(_side(vertices, "a", *columns), "a").join(hubs, ["b", "salt"]).drop("salt")


def _linked(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the similarity."""
    both = _with_hub(pairs, vertices, "hashes")
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return both.filter(100 * shared >= percent * (F.size("hashes_a") + F.size("hashes_b") - shared)).select("a", "b")


def _pairs_across(rows: DataFrame, by: str, own: Column, *also: str) -> DataFrame:
    """(a, b), a > b, of rows (by, id, component, also...) of one group and of different components that meet `own`, a
    condition on columns with _a and _b. Most rows of a group are of its main component; those are held against the
    others only, never against each other."""
    counted = rows.groupBy(by, "component").agg(F.count("*").alias("rows"))
    main = counted.groupBy(by).agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.count("*").alias("kinds")).filter("kinds > 1").drop("kinds")
    open_rows = rows.join(main, by)
    columns = ("id", "component", *also)
    left = open_rows.filter("component <> main").select(by, "main", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = open_rows.select(by, *[F.col(c).alias(f"{c}_b") for c in columns])
    once = (F.col("component_b") == F.col("main")) | (F.col("component_a") < F.col("component_b"))
    found = left.join(right, by).filter((F.col("component_a") != F.col("component_b")) & once & own)
    return found.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b"))


def _across(open_rows: DataFrame, vertices: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """((a, b), a > b, of vertices (id, component) in different components that may be links; the table it is found in)."""
    placed = rarest_members(vertices.select("id", "bits", "hashes").join(open_rows, "id"), percent)
    # Of the first shared shingle on, what is left of either set bounds what they share; a pair comes out there only.
    most = F.least(F.col("n_a") - F.col("before_a"), F.col("n_b") - F.col("before_b"))
    enough = most * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    first = F.coalesce(F.get(F.array_intersect("prefix_a", "prefix_b"), 0) == F.col("shingle"), F.lit(True))
    return _pairs_across(placed, "shingle", enough & _near(percent) & first, "n", "bits", "prefix", "before").distinct(), placed


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the smallest id reachable. Large-star and small-star
    steps until nothing changes, each written to the shared folder; no row count or star size matters to a task."""
    now, seen = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low).distinct()
        after = stash(small, "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stash(now)
        now = after
        if mark == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = mark


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """One row (key, n_shingles, component_id, kept) for each row of docs.

    Two rows are linked if 100 * |A & B| >= percent * |A | B| for their shingle sets; component_id is the smallest key
    reachable over links, kept says whether it is the row's own. Texts without words (null, empty, white space) have
    an empty set and are linked with nothing. Rows that repeat a key are one vertex and get the same component; a null
    key is linked with nothing, has a null component and is kept. An empty table gives an empty one; other columns of
    docs are left out. Whole texts count, however long. What is written on the way is deleted, but for the sketches and
    components that the result reads.
    """
    chunks, _ = bounds(percent)
    whole = stash(sketches(docs, key, text, width, chunks), "sketches")
    usable = whole.filter("n > 0 and id is not null")
    # Equal sets: one vertex for each, by its smallest key.
    heads = usable.groupBy("digest", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.count("*").alias("members"))
    heads = stash(heads.select("id", "n", "sig", "digest"), "heads")
    keys = stash(_keyed(heads), "keys")
    ends = keys.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub < top")
    shared = stash(keys.join(ends, "bucket"), "buckets")
    drop_stash(keys)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for batch in batches:
            for first, after in slices([len(value.as_py() or "") for value in batch.column(1)], 500):
                some = batch.slice(first, after - first)
                found = [shingle_set(value.as_py(), width, known) for value in some.column(1)]
                yield pa.RecordBatch.from_arrays([
                    some.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.view("i8") for x in found], pa.list_(pa.int64())),
                    pa.array([wide_sketch(x).tolist() for x in found], pa.list_(pa.int64())),
                ], names=["id", "n", "hashes", "bits"])

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    open_ids = shared.select("id").distinct()
    vertices = stash(texts.join(open_ids, "id", "left_semi").mapInArrow(full, "id long, n long, hashes array<long>, bits array<long>"), "vertices")

    seen = stash(shared.select("id", "hub", "top").distinct(), "seen")
    stars = seen.select(F.col("id").alias("a"), F.col("hub").alias("b")).union(seen.select("top", "hub")).union(seen.select("id", "top")).filter("a <> b")
    stars = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stash(_with_hub(stars, vertices, "n", "bits").filter(_near(percent)).select("a", "b"), "pairs")
    star = stash(_linked(pairs, vertices, percent), "links")
    same = usable.join(heads.select("digest", "n", F.col("id").alias("head")), ["digest", "n"]).select(F.col("id").alias("a"), F.col("head").alias("b")).filter("a <> b")
    part = stash(connected(star), "components")

    # Members of one bucket in different components: the rest of the links, if there are any.
    of_hub = part.select(F.col("id").alias("hub"), F.col("component").alias("of_hub"))
    off = seen.select("id", "hub").distinct().join(part, "id", "left").join(of_hub, "hub", "left").filter(F.coalesce("component", "id") != F.coalesce("of_hub", "hub"))
    mixed = shared.join(off.select("id", "hub"), ["id", "hub"], "left_semi").select("bucket").distinct()
    open_rows = shared.join(mixed, "bucket", "left_semi").select("id").distinct().join(part, "id", "left")
    open_rows = stash(open_rows.select("id", F.coalesce("component", "id").alias("component")), "open")
    drop_stash(shared)
    across, placed = _across(open_rows, vertices, percent)
    rest = stash(across.join(pairs, ["a", "b"], "left_anti"), "rest")
    links = stash(star.union(_linked(rest, vertices, percent)).union(same), "links")
    components = stash(connected(links), "components")
    for done in (heads, seen, vertices, pairs, star, part, open_rows, placed, rest, links):
        drop_stash(done)
    return (
        whole.join(components, "id", "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
