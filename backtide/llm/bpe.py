"""Byte-level BPE by monoid tree reduction.

The tokens of a piece are the reduction of a balanced tree over its bytes. A leaf is a string that is a token by
itself. `join` puts two neighbours together: it re-encodes a window of tokens around the border and widens it until
both outer borders are *compatible*, that is, until the pair of tokens on either side of a border encodes to just that
pair. A sequence in which every neighbouring pair is compatible is the encoding of its bytes: the first merge across a
border would also happen in the pair by itself. So tokens outside the window are stable and `join` is associative.
Decoding concatenates byte strings up the same kind of tree.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo

#: What white space is to the pattern's \s (Unicode White_Space).
_SPACE = regex.compile(r"\p{White_Space}")
_LATIN = regex.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks that begin no match of the pattern with the letters before them; the apostrophe may.
_MARKS = ".,;:!?|%&*#$"
#: What an ASCII match of _LATIN of two characters or more may begin with.
_BEGINS = frozenset(" ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
UNSURE = b"?"
#: Above every rank.
NO_RANK = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._whole: dict[bytes, bool] = {}
        self._merged = Memo(self.merge, 64 << 20)
        self._short = Memo(self._tree, 48 << 20)
        self._units = Memo(self._unit, 64 << 20)
        self._words = Memo(self._spaced, 128 << 20)

    def forget(self) -> None:
        """Give back what was remembered: workers outlive their tasks."""
        for memo in (self._merged, self._short, self._units, self._words):
            memo.forget()

    def merge(self, text: bytes) -> tuple[int, ...]:
        """Plain merging, for leaves and windows: the neighbours of lowest rank first, the leftmost of equal ones."""
        if len(text) > 64:
            return self._merge_long(text)
        ranks, parts = self.ranks, [text[i : i + 1] for i in range(len(text))]
        costs = [ranks.get(text[i : i + 2], NO_RANK) for i in range(len(text) - 1)]
        while costs and (low := min(costs)) != NO_RANK:
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        return tuple([ranks[part] for part in parts])

    def _merge_long(self, text: bytes) -> tuple[int, ...]:
        """The same with a heap, in n log n steps."""
        ranks, parts = self.ranks, [text[i : i + 1] for i in range(len(text))]
        last, after, heap = len(parts) - 1, list(range(1, len(parts) + 1)), []
        before = list(range(-1, len(parts) - 1))

        def offer(i: int) -> None:
            if i >= 0 and after[i] <= last and (rank := ranks.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (rank, i, len(parts[i]), len(parts[after[i]])))

        for i in range(last):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if len(parts[i]) != left or after[i] > last or len(parts[j := after[i]]) != right:
                continue
            parts[i] += parts[j]
            parts[j] = b""
            after[i] = after[j]
            if after[j] <= last:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return tuple([ranks[part] for part in parts if part])

    def is_token(self, text: bytes) -> bool:
        """Whether text is a token that merging reaches."""
        if (found := self._whole.get(text)) is None:
            found = self._whole[text] = (rank := self.ranks.get(text)) is not None and self.merge(text) == (rank,)
        return found

    def _stable(self, left: int, right: int) -> bool:
        """Whether the border between two tokens is one that merging never crosses."""
        return self._merged[self.bytes_of[left] + self.bytes_of[right]] == (left, right)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours that are not empty. Borders inside either of them are stable already, so only
        those beside tokens that the window changes are looked at."""
        bytes_of, a, b = self.bytes_of, 1, 1
        inner = left[-1], right[0]
        window = self._merged[bytes_of[inner[0]] + bytes_of[inner[1]]]
        if window == inner:
            return left + right
        while True:
            ok_left = a == len(left) or window[0] == left[-a] or self._stable(left[-a - 1], window[0])
            ok_right = b == len(right) or window[-1] == right[b - 1] or self._stable(window[-1], right[b])
            if ok_left and ok_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if ok_left else min(len(left), 2 * a), b if ok_right else min(len(right), 2 * b)
            text = b"".join([bytes_of[t] for t in (*left[len(left) - a :], *right[:b])])
            window = self._merged[text] if len(text) <= 24 else self.merge(text)

    def _tree(self, text: bytes) -> tuple[int, ...]:
        if len(text) == 1 or (text in self.ranks and self.is_token(text)):
            return (self.ranks[text],)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        if len(right) <= 12:
            return self.join(self._short[left], self._short[right])
        return self.join(self._reduce(left), self._reduce(right))

    def _reduce(self, text: bytes) -> tuple[int, ...]:
        return self._short[text] if len(text) <= 12 else self._tree(text)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one match of the pattern."""
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else self._reduce(piece)

    def _matches(self, text: str) -> bytes:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.encode_piece(piece.encode())
        return array("i", out).tobytes()

    def _unit(self, unit: str) -> bytes:
        """The ids of a space and what follows up to the next one; UNSURE if white space at its ends may match beyond it.
        Latin letters after it are one match, and marks behind them another, if both are all there is."""
        core = unit.rstrip(_MARKS)
        if core.isascii() and core[1:].isalpha() and core[0] in _BEGINS or _LATIN.fullmatch(core):
            piece = core.encode()
            whole = self.ranks.get(piece)
            ids = (array("i", (whole,) if whole is not None else self._short[piece] if len(piece) <= 12 else self._tree(piece))).tobytes()
            return ids if len(core) == len(unit) else ids + self._units[unit[len(core) :]]
        word = unit.removeprefix(" ")
        return UNSURE if not word or _SPACE.match(word[0]) or _SPACE.match(word[-1]) else self._matches(unit)

    def _spaced(self, word: str) -> bytes:
        return self._unit(" " + word)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as packed little-endian 32-bit integers. Single spaces between other characters are always
        borders between matches, so the words between them are encoded once and remembered."""
        first, *rest = text.split(" ")
        found = [self._units[first], *map(self._words.__getitem__, rest)]
        return self._matches(text) if UNSURE in found else b"".join(found)

    def decode(self, ids: list[int]) -> bytes:
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + 1024])) for i in range(0, len(ids), 1024)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> TreeBpe:
    """One for each Python worker and rank file."""
    return TreeBpe(load_ranks(path), pattern)


def _packed_lists(packed: list[bytes]) -> pa.ListArray:
    """Lists of packed 32-bit integers as an Arrow array."""
    offsets = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in packed])]).astype("i4")
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode_text(text: Column, path: str, pattern: str) -> Column:
    """array<int> of token ids of a string column; a null or empty text has none."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = codec(path, pattern)
        for batch in batches:
            yield _packed_lists([bpe.encode(text.as_py()) for text in batch])
        bpe.forget()

    return encode(F.coalesce(text, F.lit("")))


def decode_ids(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of a column of array<int>; null and empty arrays give no bytes, an id outside the ranks is an error."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = codec(path, pattern)
        for batch in batches:  # row by row: a batch's ids as Python integers would take ten times its bytes
            yield pa.array([bpe.decode(row.as_py() or []) for row in batch], pa.binary())

    return decode(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """struct<ids array<int>, decoded binary>: encode_text, and decode_ids of its ids, in one pass through one worker."""

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = codec(path, pattern)
        for batch in batches:
            packed = [bpe.encode(text.as_py()) for text in batch]
            decoded = pa.array([bpe.decode(array("i", ids).tolist()) for ids in packed], pa.binary())
            yield pa.StructArray.from_arrays([_packed_lists(packed), decoded], ["ids", "decoded"])
        bpe.forget()

    return both(F.coalesce(text, F.lit("")))


def encode_documents(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, ids, decoded) for each row of docs, in no order; nothing is shuffled.

    A null text counts as empty: no ids, no bytes. Repeated rows give repeated results; a null key stays null; other
    columns of docs are left out, so none can clash. An empty table gives an empty one.
    """
    coded = docs.select(F.col(key).alias("doc_id"), round_trip(F.col(text), path, pattern).alias("coded"))
    return coded.select("doc_id", "coded.ids", "coded.decoded")
