"""Quality classifier from positive and unlabelled text."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Dimensions of the hashed byte pairs and of the statistics of a text.
PAIRS, STATS = 512, 18
#: The classifier is fitted on at most so many trusted positives and so many unlabelled texts.
POSITIVES, UNLABELLED = 6000, 9000
_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.uint16)
_UPPER, _LOWER, _DIGIT = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1


def features(text: str) -> np.ndarray:
    """Of one whole text: square roots of the shares of hashed byte pairs, then statistics; zeros if empty."""
    out = np.zeros(PAIRS + STATS, np.float32)
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(raw)
    if not n:
        return out
    one = np.bincount(raw, minlength=256)
    if n > 1:
        out[:PAIRS] = np.sqrt(np.bincount(_PAIR[raw[:-1].astype(np.uint16) << 8 | raw[1:]], minlength=PAIRS) / (n - 1))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    seen = Counter(words)
    out[PAIRS:] = [
        np.log1p(n) / 10,
        one @ _UPPER / n * 5,
        one @ _LOWER / n,
        one @ _DIGIT / n * 5,
        one[33] / n * 20,
        one[124] / n * 20,
        one[32] / n * 3,
        one[10] / n * 20,
        one[128:].sum() / n * 3,
        (one[:128].sum() - one @ (_UPPER + _LOWER + _DIGIT) - one[32] - one[10]) / n * 5,
        len(seen) / n_words,
        max(seen.values(), default=0) / n_words * 3,
        len(set(lines)) / n_lines,
        np.log1p(n / n_lines) / 10,
        n / n_words / 20,
        len(zlib.compress(text.encode(), 1)) / n,
        sum(map(eq, words, words[1:])) / n_words * 10,
        min(1.0, n_words / 50),
    ]
    return out


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, seed: int = 0, decay: float = 3e-3, rate: float = 0.02) -> Classifier:
    """Minimise the non-negative unbiased risk of a logistic score by Adam.

    risk = prior * E+[loss(+)] + max(0, Eu[loss(-)] - prior * E+[loss(-)]). Where the second part of a batch
    is negative, a step is taken against it alone, which keeps the classifier from fitting the unlabelled
    texts' positives as negatives.
    """
    rng = np.random.default_rng(seed)
    mean = unlabelled.mean(0)
    scale = unlabelled.std(0) + 0.02
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    d = p.shape[1] + 1
    p, u = (np.hstack([a, np.ones((len(a), 1))]).astype(np.float32) for a in (p, u))
    w, m, v, step = np.zeros(d), np.zeros(d), np.zeros(d), 0
    batches, mean_w, kept = max(1, len(u) // 512), np.zeros(d), 0
    for epoch in range(epochs):
        pp, uu = np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)
        for i, j in zip(pp, uu, strict=True):
            if not len(i) or not len(j):
                continue
            a, b = p[i], u[j]
            sa, sb = (1 / (1 + np.exp(-np.clip(x @ w, -40, 40))) for x in (a, b))
            soft = lambda s: -np.log(np.maximum(1 - s, 1e-12))  # noqa: E731  loss of calling it negative
            rest = soft(sb).mean() - prior * soft(sa).mean()
            negative = b.T @ sb / len(j) - prior * (a.T @ sa) / len(i)
            grad = prior * (a.T @ (sa - 1)) / len(i) + negative if rest >= 0 else -negative
            grad = grad + decay * w
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if 2 * epoch >= epochs:  # the result is the mean of the second half's steps
                mean_w, kept = mean_w + w, kept + 1
    w = mean_w / max(1, kept)
    return Classifier(mean, scale, w[:-1], float(w[-1]))


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], np.float32).reshape(-1, PAIRS + STATS)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on rows that aren't held out: trusted positives have label 1, unlabelled texts are any documents.

    Both samples are bounded (``POSITIVES``, ``UNLABELLED``) and chosen by a hash of the id, so reruns agree.
    The prior is the share of label 1 among the labels that aren't held out, shrunk towards one half where
    these are few. Without positives or texts the classifier gives one score for all.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    n, ones = marked.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    prior = (ones + 1) / (n + 2)
    order = F.xxhash64("doc_id", F.lit(8))
    positive = marked.where("quality = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(POSITIVES).withColumn("role", F.lit(1))
    anyone = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(~held_out())
    unlabelled = anyone.distinct().orderBy(order, "doc_id").limit(UNLABELLED).withColumn("role", F.lit(0))
    chosen = F.broadcast(positive.unionByName(unlabelled).groupBy("doc_id").agg(F.max("role").alias("positive"), F.min("role").alias("any")))  # at most POSITIVES + UNLABELLED ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "positive", "any", "x"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("doc_id", "text", "positive", "any").mapInArrow(run, "doc_id long, positive int, any int, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"], kind="stable")
    x = np.array([np.frombuffer(b, np.float16) for b in got["x"]], np.float32).reshape(-1, PAIRS + STATS)
    p, u = x[got["positive"].to_numpy() == 1], x[got["any"].to_numpy() == 0]
    if not len(p) or not len(u):
        zero = np.zeros(PAIRS + STATS)
        return Classifier(zero, zero + 1, zero, float(np.log(prior / (1 - prior))))
    return fit(p, u, prior)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted in place of columns of those names; the other columns stay.

    A score depends on the text alone, so equal texts get equal scores; a null text scores as an empty one.
    A row with a null doc_id isn't held out.
    """
    model = train(docs, labels)
    names = ["held_out", "score", "predicted"]

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(np.concatenate([np.zeros(0), *(model.scores(_matrix(texts.iloc[k : k + 256].tolist())) for k in range(0, len(texts), 256))]))

    out = docs.drop(*names).withColumn("held_out", held_out()).withColumn("score", score("text"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents, from labels that aren't held out; odd rows as in ``classify``."""
    got = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
