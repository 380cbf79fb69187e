"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a linear classifier on hashed character n-grams tells the languages whose
bit is 1 from the others. A text gets the language whose codeword has the least loss-weighted distance to the bits'
margins, and is flagged as ambiguous if the second is about as near.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import within_bytes
from .quality import held_out
from .subwords import FeatureRows, WordScores, slices

#: Rows of each language, and bytes of all their texts, that a model is fitted on at most.
SAMPLE_PER_LANGUAGE, SAMPLE_BYTES = 600, 24 << 20


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """One row of -1 and 1 for each class. Up to 5 classes: all splits in two; beyond, the best of random dense codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]).T
    random, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    codes = [random.choice((-1, 1), (n, bits)) for _ in range(50)]
    return max(codes, key=lambda c: min((c[i] != c[j]).sum() for i, j in itertools.combinations(range(n), 2)))


@dataclass
class CodeModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    low: int
    high: int

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, whether ambiguous). A bit's loss is log(1 + exp(-code * margin)), its weight how sure
        the classifier is."""
        sure = np.abs(np.tanh(margins / 2)) + 1e-6
        loss = np.stack([(sure * np.logaddexp(0, -code * margins)).sum(axis=1) for code in self.codes], axis=1)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        ranked = np.sort(p, axis=1)
        second = ranked[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, ranked[:, -1], second > 0.5 * ranked[:, -1]


def train(texts: list[str], languages: list[str], *, buckets: int = 1 << 16, low: int = 1, high: int = 4, epochs: int = 12, rate: float = 2.0, seed: int = 5) -> CodeModel:
    """Logistic regression for every bit by stochastic gradient descent on the documents' n-gram shares."""
    names = sorted(set(languages))
    codes = codewords(len(names))
    random, model = np.random.default_rng(seed), CodeModel(names, codes, np.zeros((buckets, codes.shape[1])), np.zeros(codes.shape[1]), low, high)
    rows = FeatureRows()
    for text in texts:
        own: dict[str, int] = {}
        for word in text.lower().split() or [""]:
            own[word] = own.get(word, 0) + 1
        rows.add(own, buckets, low, high)
    steps, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            features, share = rows[i]
            code = codes[names.index(languages[i])]
            pace = rate * (1 - steps / total)
            steps += 1
            margin = (model.weights[features] * share).sum(axis=0) + model.bias
            back = -code / (1 + np.exp(np.clip(code * margin, -30, 30)))
            model.weights[features] -= pace * (share / np.sqrt((share**2).sum() + 1e-12)) * back
            model.bias -= pace * 0.01 * back
    return model


def fit_languages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> CodeModel:
    """Fit on rows with a language and a text whose crc32(key) mod 3 is not 1: of each language the per_language ones
    with the smallest key hashes, as far as all their texts come to sample_bytes. Only counts for
    each language and that sample reach the driver."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key, 3, 1))
    counts = {r[lang]: r["n"] for r in usable.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    usable = usable.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("_order"))
    # The smallest hashes of a language lie below about its share of their range; twice that is read, in one pass.
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, min(1_000_000, 2_000_000 * per_language // n + 1)).otherwise(share)
    low = usable.filter(((F.col("_order") / 2.0**64 + 0.5) * 1_000_000).cast("long") < share)
    first = Window.partitionBy("lang").orderBy("_order", "key", "text")
    sample = low.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= per_language)
    rows = within_bytes(sample, "text", sample_bytes, "_place", "lang")
    rows.sort(key=lambda r: (r.key, r.lang, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def predict_languages(docs: DataFrame, model: CodeModel, *, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_ambiguous; columns of these names are replaced. Whole texts, no
    shuffle; every row, repeated ones alike, whatever its key. A null text, one without
    any letter, or any text if nothing was learned, is `und` with score 0 and ambiguous."""

    weights = model.weights.astype("f4")

    @F.arrow_udf("struct<pred:string, score:double, ambiguous:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = WordScores(weights, model.low, model.high)
        names = np.array(model.languages, dtype=object)
        for batch in batches:
            parts = []
            for first, after in slices([len(text.as_py() or "") for text in batch]):
                sums = table.sums([(text or "").lower().split() for text in batch.slice(first, after - first).to_pylist()])
                best, score, ambiguous = model.decode(sums[:, :-1] / np.maximum(sums[:, -1:], 1) + model.bias)
                parts.append((names[best], score, ambiguous))
            pred, score, ambiguous = map(np.concatenate, zip(*parts)) if parts else ([], [], [])
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], ["pred", "score", "ambiguous"])

    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if model.languages else F.lit(False)
    guess = predict(F.col(text)) if model.languages else F.lit(None).cast("struct<pred:string, score:double, ambiguous:boolean>")
    out = docs.withColumn("_guess", guess)
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_ambiguous")],
        F.when(known, F.col("_guess.pred")).otherwise("und").alias("lang_pred"),
        F.when(known, F.col("_guess.score")).otherwise(0.0).alias("lang_score"),
        F.when(known, F.col("_guess.ambiguous")).otherwise(True).alias("lang_ambiguous"),
    )
