"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its hashed words, their character n-grams and, for a word that
repeats the one before it, a feature of that; a softmax layer turns the mean into class probabilities. Both layers are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, within_bytes
from .subwords import FeatureRows, WordScores, slices

#: How many labelled rows, and bytes of their texts, a model is fitted on at most; scoring covers all rows.
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 24 << 20
REPEAT = "\x00again"


def words_of(text: str | None) -> list[str]:
    """The words between white space; after a word equal to the one before comes the repeat mark."""
    words = (text or "").split()
    if len(words) > 1 and len(set(words)) < len(words):
        out = words[:1]
        for last, word in zip(words, words[1:]):
            out.append(word)
            if word == last:
                out.append(REPEAT)
        return out
    return words


@dataclass
class SubwordModel:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    low: int
    high: int

    def folded(self) -> np.ndarray:
        """Each bucket's vector times the output layer's difference: averaging commutes with a linear layer."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0])[:, None]


def train(texts: list[str], labels: list[int], *, buckets: int = 1 << 17, dim: int = 12, low: int = 3, high: int = 5, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> SubwordModel:
    """Fit on the given texts. The same texts in the same order give the same model; without any, all scores are 0.5."""
    random = np.random.default_rng(seed)
    model = SubwordModel(random.uniform(-1 / dim, 1 / dim, (buckets, dim)), np.zeros((dim, 2)), np.zeros(2), low, high)
    rows = FeatureRows()
    for text in texts:
        own: dict[str, int] = {}
        for word in words_of(text):
            own[word] = own.get(word, 0) + 1
        rows.add(own, buckets, low, high)
    steps, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            features, share = rows[i]
            pace = rate * (1 - steps / total)
            steps += 1
            mean = (model.vectors[features] * share).sum(axis=0)
            logit = mean @ model.output + model.bias
            p = np.exp(logit - logit.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = model.output @ error
            model.output -= pace * np.outer(mean, error)
            model.bias -= pace * 0.1 * error
            # Shares are tiny for long documents; scaled by their norm, every document moves its features alike.
            model.vectors[features] -= pace * (share / np.sqrt((share**2).sum() + 1e-12)) * back
    return model


def score_text(text: Column, model: SubwordModel) -> Column:
    """Probability of class 1 of a text; a null or empty text gets that of the bias alone."""
    weights, low, high, bias = model.folded().astype("f4"), model.low, model.high, float(model.bias[1] - model.bias[0])

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = WordScores(weights, low, high)
        for batch in batches:
            out = []
            for first, after in slices([len(text.as_py() or "") for text in batch]):
                sums = table.sums([words_of(text) for text in batch.slice(first, after - first).to_pylist()])
                out.append(1 / (1 + np.exp(-np.clip(sums[:, 0] / np.maximum(sums[:, 1], 1) + bias, -30, 30))))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(text)


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether a row's key puts it into the fold that is never learned from; a null key does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> SubwordModel:
    """Fit on the sample_rows labelled documents of smallest key hash whose crc32(key) mod 5 is not 0.

    Of a key with several labels the greatest counts, of one with several texts the least; null labels and null keys are
    left out. The sampled keys are bounded, so they are broadcast; of their texts as many as come to sample_bytes reach
    the driver.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key, 5, 0)).groupBy(key).agg(F.max(label).alias("label"))
    sample = bounded_sample(usable, key, sample_rows).select(F.col(key).alias("key"), F.col("label").cast("int").alias("label"))
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    rows = sorted(within_bytes(found.withColumn("_order", F.xxhash64("key")), "text", sample_bytes, "_order", "key"), key=lambda r: r.key)
    return train([r.text or "" for r in rows], [int(r.label == 1) for r in rows])


def score_quality(docs: DataFrame, model: SubwordModel, *, key: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """docs with quality_score and quality_predicted (1 from `least` on); columns of these names are replaced. Nothing
    is shuffled; every row is scored, repeated ones alike, null and empty texts by the bias. An empty table stays so."""
    scored = docs.withColumn("quality_score", score_text(F.col(text), model))
    return scored.withColumn("quality_predicted", (F.col("quality_score") >= least).cast("int"))
