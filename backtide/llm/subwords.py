"""Hashed word and character n-gram features, computed for each distinct word once, and linear scores on them."""

from __future__ import annotations

from array import array

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_features(words: list[str], buckets: int, low: int, high: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every feature of the words: the character n-grams of `<word>` with low to high
    characters and, with whole, the word itself. Words may be of any length; the empty word has only its marks."""
    marked = ["<" + word + ">" for word in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8") + np.uint64(1)
    lengths = np.fromiter(map(len, marked), "i8", len(marked))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))
    owners, hashes = [], []
    rolled = np.zeros(len(points), "u8")
    for n in range(1, high + 1):
        if n > 1:
            rolled = rolled[:-1] if len(rolled) else rolled
        rolled = rolled * _STEP + points[n - 1 :][: len(rolled)]
        if n >= low:
            fits = np.flatnonzero(left[: len(rolled)] >= n)
            owners.append(owner[fits])
            hashes.append(_mix(rolled[fits] + np.uint64(n)))
    if whole and len(words):
        # Of each word, a hash of all its characters with their places.
        place = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
        owners.append(np.arange(len(words)))
        hashes.append(_mix(np.add.reduceat(_mix(points * _STEP + place.astype("u8") * _MIX), ends - lengths)))
    if not owners:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    return np.concatenate(owners), (np.concatenate(hashes) % np.uint64(buckets)).astype("i8")


class FeatureRows:
    """Features and their shares of many texts, one behind the other in two flat buffers: compact while a model is
    trained on them, and given back whole afterwards."""

    def __init__(self) -> None:
        self.features, self.shares, self.ends = array("i"), array("f"), [0]

    def add(self, counts: dict[str, int], buckets: int, low: int, high: int) -> None:
        """The features of a text with these words."""
        owner, bucket = word_features(list(counts), buckets, low, high)
        features, where = np.unique(bucket, return_inverse=True)
        share = np.bincount(where, np.fromiter(counts.values(), "f8", len(counts))[owner], len(features))
        self.features.frombytes(features.astype("i4").tobytes())
        self.shares.frombytes((share / max(1, share.sum())).astype("f4").tobytes())
        self.ends.append(len(self.features))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.ends[i], self.ends[i + 1])
        return np.frombuffer(self.features, "i4")[own], np.frombuffer(self.shares, "f4")[own, None]


class WordScores:
    """For each word, its features' summed rows of a weight matrix and their number. Known words are remembered until
    they come to about `budget` bytes; then the table begins anew. One belongs to a task and goes with it."""

    def __init__(self, weights: np.ndarray, low: int, high: int, budget: int = 24 << 20):
        self.weights, self.low, self.high, self.budget = weights, low, high, budget
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, self.weights.shape[1] + 1), "f8")
        self.held = 0

    def _learn(self, words: list[str]) -> None:
        first, after = len(self.place), len(self.place) + len(words)
        if after > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(after, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))])
        owner, bucket = word_features(words, len(self.weights), self.low, self.high)
        for k in range(self.weights.shape[1]):
            self.rows[first:after, k] = np.bincount(owner, self.weights[bucket, k], len(words))
        self.rows[first:after, -1] = np.bincount(owner, minlength=len(words))
        self.place.update(zip(words, range(first, after)))
        self.held += sum(map(len, words)) + len(words) * (200 + 8 * self.rows.shape[1])

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """For each list of words the sum of its words' rows; the last column counts features."""
        if self.held > self.budget:
            self._reset()
        fresh, chars, part = {word for words in texts for word in words} - self.place.keys(), 0, []
        for word in fresh:  # features take about a hundred bytes a character while they are made
            part.append(word)
            chars += len(word) + 8
            if chars > 100_000:
                self._learn(part)
                chars, part = 0, []
        if part:
            self._learn(part)
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, words in enumerate(texts):
            if words:
                out[i] = self.rows[list(map(self.place.__getitem__, words))].sum(axis=0)
        return out


def slices(sizes: list[int], most_rows: int = 256, most_chars: int = 800_000) -> list[tuple[int, int]]:
    """(first, after) of consecutive rows with most_rows rows and about most_chars characters at most; a longer text is
    alone."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and (i - first >= most_rows or held + size > most_chars):
            out.append((first, i))
            first, held = i, 0
        held += size
    return [*out, (first, len(sizes))] if sizes else out
