"""Token ids in a file of byte or bit planes.

Ids of whole documents, in key order, fill chunks. A chunk's ids lie in blocks of a fixed number of ids (the last one is
shorter); each block is transposed into planes - all lowest bytes, all second bytes, ... or single bits - and every
plane is compressed by itself with zstandard. One row of the Parquet table that holds the file is one chunk: its index
entry (part, chunk, first id within the part, number of ids, the documents and their lengths) and its planes. Readers
of the index never touch the planes. Spark's own committer writes the table, so a lost task is simply run again.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, run_length_prefix

PLANES = {"byte": 8, "bit": 1}
SCHEMA = "part int, chunk int, start long, n_ids int, block int, kind string, keys array<long>, lengths array<int>, planes array<binary>"


def to_planes(ids: np.ndarray, block: int, kind: str) -> list[bytes]:
    """The compressed planes of each block of uint32 ids, lowest plane first."""
    pack, out = zstandard.ZstdCompressor(level=3), []
    for at in range(0, len(ids), block):
        lanes = np.ascontiguousarray(ids[at : at + block], "<u4").view("u1").reshape(-1, 4)
        if kind == "bit":
            lanes = np.unpackbits(lanes, axis=1, bitorder="little")
            out += [pack.compress(np.packbits(lanes[:, i], bitorder="little").tobytes()) for i in range(32)]
        else:
            out += [pack.compress(lanes[:, i].tobytes()) for i in range(4)]
    return out


def from_planes(planes: list[bytes], n_ids: int, block: int, kind: str) -> np.ndarray:
    """The inverse of to_planes."""
    unpack, out = zstandard.ZstdDecompressor(), np.empty(n_ids, "<u4")
    width = 32 if kind == "bit" else 4
    for b, at in enumerate(range(0, n_ids, block)):
        n = min(block, n_ids - at)
        own = [np.frombuffer(unpack.decompress(p), "u1") for p in planes[b * width : (b + 1) * width]]
        if kind == "bit":
            own = np.packbits(np.stack([np.unpackbits(p, count=n, bitorder="little") for p in own], axis=1), axis=1, bitorder="little").T
        out[at : at + n] = np.ascontiguousarray(np.stack(list(own), axis=1)).view("<u4").ravel()
    return out


_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,;:!?|%&*#$"


class WordEncoder:
    """A tokenizer of the tokenizers library that drops white space and separates letters from marks: its ids of a text
    are those of the words between spaces and line ends, one after the other, so each word is encoded once and
    remembered. A word of Latin letters goes straight to the library's model, which is most of the work saved, and only in
    lower case, as the tokenizer makes it; with marks behind it, or capitals, it is made of words that are remembered
    already; whatever else there is takes the whole path."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known = Memo(self._encode, 96 << 20)

    def _encode(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if not (core.isalpha() if core.isascii() else _LATIN.fullmatch(core)):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low = core.lower()
        if low != word:
            return self.known[low] + self.known[word[len(core) :]] if len(core) < len(word) else self.known[low]
        shown = low if low.isascii() else self.byte_level.pre_tokenize_str(low)[0][0]
        return array("I", [token.id for token in self.model.tokenize(shown)]).tobytes()

    def encode(self, text: str, end: int) -> bytes:
        """Packed little-endian uint32 ids of a text, with the end id after them."""
        text = (text.lower() if text.isascii() else text).replace("\n", " ")
        return b"".join(map(self.known.__getitem__, text.split(" "))) + end.to_bytes(4, "little")


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_planes(docs: DataFrame, path: str, tokenizer: str, *, end: int = 1, key: str = "doc_id", text: str = "text", chunk: int = 1 << 16, block: int = 1 << 14, kind: str = "byte") -> None:
    """Encode every whole text and write the ids, in key order, to the plane file at path.

    Texts are shuffled once, by ranges of the key. A null or empty text has the end id alone. Rows with equal keys lie
    in order of their texts, null keys come first. A chunk ends with the document that brings it to `chunk` ids, so one
    very long document makes one long chunk. An empty table makes a file without chunks; other columns are left out.
    """
    PLANES[kind]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        keys: list[int] = []
        parts: list[bytes] = []
        number = start = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, start, held
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [part, number, start, len(ids), block, kind, list(keys), [len(p) // 4 for p in parts], to_planes(ids, block, kind)]
            number, start, held = number + 1, start + len(ids), 0
            keys.clear(), parts.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(k), parts.append(words.encode(value.as_py(), end))
                held += len(parts[-1]) // 4
                if held >= chunk:
                    yield flush()
        if keys:
            yield flush()
        words.known.forget()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own.repartitionByRange(n, "key").sortWithinPartitions("key", "text").mapInArrow(encode, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index with each chunk's place among all ids; the planes are not read."""
    index = spark.read.schema(SCHEMA).parquet(path).drop("planes")
    totals = index.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    offsets = run_length_prefix(totals, "part", {"offset": "part_ids"}).drop("part_ids")
    return index.join(F.broadcast(offsets), "part").withColumn("start", F.col("start") + F.col("offset")).drop("offset")


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a plane file: (key, start, ids), ids packed as little-endian unsigned 32-bit integers."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    offsets = run_length_prefix(totals, "part", {"offset": "part_ids"}).drop("part_ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                packed = from_planes(row["planes"], row["n_ids"], row["block"], row["kind"]).tobytes()
                ends = np.cumsum(row["lengths"], dtype="i8")
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["keys"], pa.int64()), pa.array(starts + row["start"]),
                    pa.array([packed[4 * a : 4 * b] for a, b in zip(starts, ends)], pa.binary()),
                ], names=["part", "key", "start", "ids"])

    rows = stored.mapInArrow(decode, "part int, key long, start long, ids binary")
    return rows.join(F.broadcast(offsets), "part").select("key", (F.col("start") + F.col("offset")).alias("start"), "ids")
