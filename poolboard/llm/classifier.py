"""Quality scores of texts: Bradley-Terry ranking over preference pairs, thresholded by a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolboard.llm.common import encoded, map_rows, read_documents, share_of

#: Labelled rows the ranking is fitted on, those with the smallest hashes of their id.
SAMPLE = 20_000
#: Preference pairs drawn from them, and steps of the fit.
PAIRS, STEPS, PENALTY = 40_000, 300, 1e-3
#: Byte classes: others, small and capital letters, digits, space, line break, each ASCII mark, high bytes.
CLASSES = 40


def byte_classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[ord("a"):ord("z") + 1], table[ord("A"):ord("Z") + 1], table[ord("0"):ord("9") + 1] = 1, 2, 3
    table[ord(" ")], table[ord("\n")], table[128:] = 4, 5, 6
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[marks] = np.arange(7, 7 + len(marks))
    return table


TABLE = byte_classes()
#: Features: shares of classes, of coarse class pairs, and a few figures of words and lines.
COARSE = np.minimum(np.arange(CLASSES), 7)
N_FEATURES = CLASSES + 64 + 8


def features(raw: bytes) -> np.ndarray:
    """What a text looks like, independent of its language and words: shares, means and repetitions."""
    codes = TABLE[np.frombuffer(raw, dtype=np.uint8)]
    n = max(1, len(codes))
    shares = np.bincount(codes, minlength=CLASSES) / n
    coarse = COARSE[codes]
    pairs = np.bincount(coarse[:-1] * 8 + coarse[1:], minlength=64) / n if len(codes) > 1 else np.zeros(64)
    words, lines = raw.split(), raw.split(b"\n")
    w, unique = max(1, len(words)), set(words)
    few = np.array([
        np.log1p(len(raw)), np.log1p(len(words)), min(20.0, len(raw) / w), len(unique) / w, len(set(lines)) / len(lines),
        np.log1p(len(raw) / len(lines)), np.log1p(w / max(1, len(unique))),
        sum([word[:1].isupper() for word in words]) / w,
    ])
    return np.concatenate((np.sqrt(shares), np.sqrt(pairs), few)).astype(np.float32)


@dataclass
class Ranking:
    """A document's strength is ``weights`` times its standardised features; ``threshold`` parts good from bad."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, one half at the threshold."""
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.threshold) / self.scale, -50, 50)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = STEPS) -> Ranking:
    """Fit strengths so that sigmoid(strength of a good text - strength of a bad one) is near 1 over random pairs.

    The loss log(1 + exp(-w * (x_good - x_bad))) is convex; gradient steps with per-weight scaling. The threshold is
    the quantile of all strengths at the share of bad texts, moved to the best cut near it: half-way where the
    training error is least within five per cent of the rows. Without both labels every score is one half.
    """
    mean, spread = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES), x.std(axis=0) + 1e-3 if len(x) else 1.0
    weights = np.zeros(N_FEATURES)
    model = Ranking(mean, spread, weights, 0.0, 1.0)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return model
    rng = np.random.default_rng(1)
    z = np.clip((x - mean) / spread, -8, 8).astype(np.float32)
    a, b = rng.choice(better, pairs), rng.choice(worse, pairs)
    difference = z[a] - z[b]
    first, second = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for step in range(1, steps + 1):
        missing = 1 / (1 + np.exp(np.clip(difference @ weights.astype(np.float32), -30, 30)))
        gradient = -(missing @ difference) / pairs + PENALTY * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        weights = weights - 0.05 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    strength = z @ weights
    order = np.argsort(strength, kind="stable")
    sorted_strength, sorted_good = strength[order], good[order]
    # errors if the first n texts are called bad
    errors = np.concatenate(([0], np.cumsum(sorted_good))) + (~good).sum() - np.concatenate(([0], np.cumsum(~sorted_good)))
    at, reach = int((~good).sum()), max(1, len(x) // 20)
    low, high = max(1, at - reach), min(len(x) - 1, at + reach)
    cut = low + int(np.argmin(errors[low:high + 1])) if low <= high else at
    cut = min(max(cut, 1), len(x) - 1)
    return Ranking(mean, spread, weights, float(sorted_strength[cut - 1] + sorted_strength[cut]) / 2,
                   float(strength.std()) / 4 + 1e-9)


def train(docs: DataFrame, labels: DataFrame, learn: str, sample: int = SAMPLE, doc_id: str = "doc_id",
          text: str = "text", label: str = "quality") -> Ranking:
    """Fit on at most ``sample`` labelled rows; ``learn`` is an SQL condition on ``doc_id`` that marks those allowed.

    The ids are picked from the labels alone; only the picked texts become features, and only distinct features of an id
    (some 450 bytes), ``sample`` at most, come to the driver: repeated rows count once.
    """
    picked = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(learn)
              .where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chosen = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")  # ``picked``: two numbers a row

    def extract(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for rows in slices:
            yield [(key, y, features(encoded(t)).tobytes()) for key, y, t in rows]

    vectors = map_rows(chosen, extract, "doc_id bigint, label int, x binary").distinct()
    ranked = vectors.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("x"))).where(F.col("n") <= sample)
    found = ranked.orderBy("n", F.xxhash64("doc_id"), "doc_id").limit(sample)  # a row of every id before second ones
    rows = sorted(map(tuple, found.select("label", "x").collect()))
    x = np.array([np.frombuffer(r[1], dtype=np.float32) for r in rows]).reshape(-1, N_FEATURES)
    return fit(x.astype(np.float64), np.array([r[0] == 1 for r in rows], dtype=bool))


def scores(docs: DataFrame, model: Ranking, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if the score is at least one half) of every whole text.

    Null counts as empty and has the score of the empty text. Repeated rows and null ids: scored each for itself. An
    empty table gives no rows. No other column takes part.
    """

    def run(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for rows in slices:
            if rows:
                score = model.score(np.array([features(encoded(t)) for _, t in rows], dtype=np.float64))
                yield [(key, float(s), int(s >= 0.5)) for (key, _), s in zip(rows, score, strict=True)]

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run,
                    "doc_id bigint, score double, predicted int")


def good_documents(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """The rows whose text the ranking accepts, with all columns and without a shuffle."""
    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        x = np.array([features(encoded(t)) for t in texts.to_pylist()], dtype=np.float64).reshape(-1, N_FEATURES)
        return pa.array(model.score(x) >= 0.5, pa.bool_())

    return docs.where(accepted(F.col(text)))


#: Rows that may be learned from.
LEARN = "crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = scores(docs, train(docs, labels, LEARN))
    return found.select("doc_id", (share_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
