"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in lower case with every run of other characters than letters and digits as one space. Each
benchmark item is cut into overlapping windows. If a passage equals a window but for `edits` edits, then it shares at
least window + 1 - q - edits * q of the window's q-grams with it, and these lie on neighbouring diagonals (place in the
document less place in the window). So shared q-grams are counted in overlapping bands of diagonals, bands that reach
that bound are kept, and a banded alignment decides. A document is contaminated if one window matches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subwords import slices

_OTHER = re.compile(r"[\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Benchmark text beyond this many characters is searched for in further passes over the documents.
BLOCK_CHARS = 4_000_000
#: Distance in bytes of the window starts inside a long word, as in scripts without spaces.
STEP = 8
#: Bytes of documents that are looked through at once, and q-gram hits that are counted at once.
SEGMENT, HITS = 1 << 19, 1 << 21


def normal(text: str | None) -> bytes:
    return _OTHER.sub(" ", (text or "").lower()).strip().encode("utf-8", "surrogatepass")


def qgrams(text: bytes, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes (8 to 16) from each place on."""
    if len(text) < q:
        return np.zeros(0, "u8")
    n = len(text) - q + 1
    first = np.ndarray(n, "<u8", text, 0, (1,))
    last = np.ndarray(n, "<u8", text, q - 8, (1,))
    return (first * _ODD) ^ (last * _ODD >> np.uint64(29)) ^ last


def banded_distance(window: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """The least edit distance between window and any substring of text: (distance, start, end), or None above `most`.

    text is the region of a band, little longer than the window, so every row has a bounded number of cells. Rows keep,
    for each end in the text, the distance and the start that gives it."""
    at = text.find(window)
    if at >= 0:
        return 0, at, at + len(window)
    if len(text) < len(window) - most:
        return None
    costs, starts = [0] * (len(text) + 1), list(range(len(text) + 1))
    slack = len(text) - len(window) + most
    for i, byte in enumerate(window, 1):
        low, high = max(1, i - most), min(len(text), i + slack)
        above, above_start = costs[low - 1], starts[low - 1]
        costs[low - 1] = i if low == 1 else most + 1
        for j in range(low, high + 1):
            cost, start = above + (text[j - 1] != byte), above_start
            above, above_start = costs[j], starts[j]
            if above + 1 < cost:
                cost, start = above + 1, above_start
            if costs[j - 1] + 1 < cost:
                cost, start = costs[j - 1] + 1, starts[j - 1]
            costs[j], starts[j] = cost, start
        if high < len(text):
            costs[high + 1] = most + 1
    end = min(range(len(costs)), key=costs.__getitem__)
    return (costs[end], starts[end], end) if costs[end] <= most else None


def _spans(text: bytes, window: int, least: int, words: int) -> list[list[tuple[int, int]]]:
    """(start, end) of the windows of an item, in order: those of `window` bytes, and shorter ones of `words` words."""
    found = [m.span() for m in re.finditer(rb"[^ ]+", text)]
    size, stops = min(window, len(text)), [end for _, end in found]
    starts = sorted({p for start, end in found for p in range(start, end, STEP)} | {*range(0, len(text), max(1, window // 2)), len(text) - size})
    by_words = []
    for at in starts:
        last = bisect_right(stops, at) + words - 1
        if last < len(stops) and (end := max(at + least, stops[last])) < at + size and end <= len(text):
            by_words.append((at, end))
    return [[(at, at + size) for at in starts if at + size <= len(text)], by_words]


def _whole_words(item: bytes, text: bytes, start: int, end: int) -> tuple[int, int, int] | None:
    """As banded_distance, of the first place in text[start:end] where item stands between spaces or ends of texts."""
    at = text.find(item, start, end)
    while at >= 0:
        if text[at - 1 : at] in (b"", b" ", b"\0") and text[at + len(item) : at + len(item) + 1] in (b"", b" ", b"\0"):
            return 0, at - start, at - start + len(item)
        at = text.find(item, at + 1, end)
    return None


class WindowIndex:
    """The q-grams of a block of benchmark items, and the windows that hold each.

    Windows start at every word, at every STEP bytes of a longer one and at every half window. One ends after `window`
    bytes, another one after `words` words where that is less, but not before `least` bytes. So a passage of `words` words (and `least` bytes) or of
    `window` bytes from the start of a word holds a whole window, wherever it lies in its item. An item too short for
    that is one window; one shorter than `least` has to stand in the document as it is, as whole words."""

    def __init__(self, items: list[tuple[int, bytes]], window: int, share: float, q: int, least: int, words: int):
        self.q, self.items, self.text = q, items, b"\0".join(text for _, text in items)
        none, base, count = np.zeros(0, "i8"), 0, 0
        windows, grams = [(none, none, none, none)], [(np.zeros(0, "u8"), none, none, none)]
        for number, (_, text) in enumerate(items):
            hashes = qgrams(text, q)
            place = np.arange(len(hashes))
            for own in filter(None, _spans(text, window, least, words)):
                starts, ends = np.array(own, "i8").T
                edits = ((ends - starts) * (share if len(text) >= least else 0)).astype("i8")
                windows.append((np.full(len(starts), number), base + starts, base + ends, edits))
                # Starts and ends rise together, so the windows that hold a q-gram follow one another.
                grams.append((hashes, base + place, count + np.searchsorted(ends, place + q), count + np.searchsorted(starts, place, "right")))
                count += len(starts)
            base += len(text) + 1
        self.item, self.starts, self.ends, self.edits = map(np.concatenate, zip(*windows))
        self.exact = np.array([len(text) < least for _, text in items], bool)[self.item]
        self.bounds = self.ends - self.starts + 1 - q - self.edits * q
        self.width = 2 * int(self.edits.max(initial=0)) + 2
        hashes, *rest = map(np.concatenate, zip(*grams))
        order = np.argsort(hashes, kind="stable")
        hashes, (self.place, self.low, self.high) = hashes[order], (x[order] for x in rest)
        # Of each distinct q-gram a run of entries; within a run the windows rise, so (run, window) is in order.
        self.hashes, self.first = np.unique(hashes, return_index=True)
        self.first = np.append(self.first, len(hashes))
        run, self.stride = np.repeat(np.arange(len(self.hashes)), np.diff(self.first)), count + 1
        self.at_low, self.at_high = run * self.stride + self.low, run * self.stride + np.maximum(self.low, self.high)
        self.reach = int((self.ends - self.starts).max(initial=0)) + 4 * self.width + q
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.hashes))))) + 6)
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self._slot(self.hashes)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * _ODD) >> np.uint64(64 - self.bits)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int, int]]:
        """(text, item, windows matched, windows, start, end, fewest edits) of every item found in the texts, which are
        looked through as one string; a zero byte between them stands in no q-gram of an item. The string is taken in
        segments that overlap by more than a match's length, so long texts need no more memory."""
        joined = b"\0".join(texts)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        found: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = {}
        for at in range(0, len(joined), SEGMENT):
            for number, from_ in self._bands(joined[at : at + SEGMENT + self.reach], at):
                self._verify(joined, starts, number, from_, found)
        totals = np.bincount(self.item, minlength=len(self.items))
        return [
            (text, self.items[item][0], len(own), int(totals[item]), min(m[1] for m in own.values()), max(m[2] for m in own.values()), min(m[0] for m in own.values()))
            for (text, item), own in found.items()
        ]

    def _bands(self, segment: bytes, offset: int) -> Iterator[tuple[int, int]]:
        """(window, first diagonal) of the bands that share enough q-grams with a window. Where the hits of a segment are
        many (a q-gram of very many windows), windows are taken in ranges; none is left out."""
        hashes = qgrams(segment, self.q)
        at = np.flatnonzero(self.filter[self._slot(hashes)])
        run = np.searchsorted(self.hashes, hashes[at])
        some = self.hashes[np.minimum(run, len(self.hashes) - 1)] == hashes[at] if len(self.hashes) else np.zeros(0, bool)
        at, run = at[some] + offset, run[some]
        if not len(at):
            return
        held = np.maximum(self.high - self.low, 0)
        work = np.add.reduceat(np.append(held + 1, 0), self.first[:-1])[run].sum()
        parts = int(work // HITS) + 1
        for part in range(parts):
            low, high = len(self.item) * part // parts, len(self.item) * (part + 1) // parts
            first, last = np.searchsorted(self.at_high, run * self.stride + low, "right"), np.searchsorted(self.at_low, run * self.stride + high, "left")
            n = np.maximum(last - first, 0)
            entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            here = np.repeat(at, n)
            begin, end = np.maximum(self.low[entry], low), np.minimum(self.high[entry], high)
            n = np.maximum(end - begin, 0)
            owner = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            diagonal = np.repeat(here - self.place[entry], n) + self.starts[owner]
            # Two layers of bands, half a width apart: any `edits + 1` neighbouring diagonals lie in one band.
            lowest = offset - self.reach
            span = (len(segment) + 2 * self.reach) // self.width + 4
            for layer in (0, self.width // 2):
                keys, counts = np.unique(owner * span + (diagonal - lowest + layer) // self.width, return_counts=True)
                for key in keys[counts >= np.maximum(1, self.bounds[keys // span])].tolist():
                    yield key // span, key % span * self.width - layer + lowest

    def _verify(self, joined: bytes, starts: np.ndarray, number: int, from_: int, found: dict[tuple[int, int], dict[int, tuple[int, int, int]]]) -> None:
        """Look for a window along a band, in each text that it touches."""
        item, window, edits = int(self.item[number]), self.text[self.starts[number] : self.ends[number]], int(self.edits[number])
        for text in range(max(0, np.searchsorted(starts, from_, "right") - 1), np.searchsorted(starts, from_ + self.width + len(window), "left")):
            if text + 1 >= len(starts) or number in found.get((text, item), ()):
                continue
            region = max(starts[text], from_ - edits)
            end = min(starts[text + 1] - 1, from_ + self.width + len(window) + edits)
            if end > region and (match := _whole_words(window, joined, region, end) if self.exact[number] else banded_distance(window, joined[region:end], edits)):
                first = int(region - starts[text])
                found.setdefault((text, item), {})[number] = (match[0], first + match[1], first + match[2])


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 80, share: float = 0.06, q: int = 10, least: int = 30, words: int = 13) -> DataFrame:
    """One row for each document and benchmark item of which it holds a window with edits of `share` of it at most:
    (key, item, windows, of_windows, start, end, edits); start and end are bytes of the normalised document. See
    WindowIndex for the windows.

    Items of fewer than `least` normalised bytes are found where they stand whole and unedited; one of fewer than `q`, a
    short word or two that many clean texts hold, where it is the whole document. Null items and those without letters or
    digits are found nowhere. Null and empty documents have no row; repeated documents and repeated items give repeated
    rows; null keys stay null; other columns are left out, so none can clash. An empty table on either side gives an
    empty one. The benchmark goes to the tasks in blocks of BLOCK_CHARS bytes, one pass over the documents for each;
    documents are not shuffled, and very long ones are looked through in segments.
    """
    schema = "doc_id long, item_id long, windows int, of_windows int, start long, end long, edits int"
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def one_pass(items: list[tuple[int, bytes]]) -> DataFrame:
        index = docs.sparkSession.sparkContext.broadcast(items)
        built: list[tuple[WindowIndex, dict[bytes, list[int]]]] = []

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not built:
                tiny: dict[bytes, list[int]] = {}
                for number, text_ in index.value:
                    if len(text_) < q:
                        tiny.setdefault(text_, []).append(number)
                built.append((WindowIndex([x for x in index.value if len(x[1]) >= q], window, share, q, least, words), tiny))
            windows, tiny = built[0]
            for batch in batches:
                for first, after in slices([len(value.as_py() or "") for value in batch.column(1)], 512, SEGMENT):
                    some = batch.slice(first, after - first)
                    ids = some.column(0).to_pylist()
                    texts = [normal(value) for value in some.column(1).to_pylist()]
                    rows = windows.search(texts)
                    rows += [(i, number, 1, 1, 0, len(text_), 0) for i, text_ in enumerate(texts) if text_ in tiny for number in tiny[text_]]
                    if rows:
                        columns = list(zip(*[(ids[row[0]], *row[1:]) for row in rows]))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (0, 1, 4, 5) else pa.int32()) for i, c in enumerate(columns)], names=["doc_id", "item_id", "windows", "of_windows", "start", "end", "edits"])

        return own.mapInArrow(search, schema)

    passes, block, size = [], [], 0
    for row in benchmark.select(F.col(item).cast("long"), item_text).toLocalIterator():
        if text_ := normal(row[1]):
            block.append((row[0], text_))
            size += len(text_)
        if size >= BLOCK_CHARS:
            passes.append(one_pass(block))
            block, size = [], 0
    if block or not passes:
        passes.append(one_pass(block))
    return reduce(DataFrame.union, passes)


def without_leaks(docs: DataFrame, found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key has no leak; rows with a null key stay."""
    return docs.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])
