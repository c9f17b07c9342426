"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader.

A text's pieces are runs of letters, digits and other characters. Words in capitals are marked,
and a word that repeats the one before, or the one before that, counts as a repeat. One- and
two-grams of pieces are hashed into 2**BITS features; a feature's value is log(1 + count), and a
text's features are scaled to unit length. FTRL-proximal with per-coordinate rates learns the
weights in the order of the sample, a few passes. A score is a sparse dot product with the
weights, through the logistic function.

Learning uses a bounded sample of labelled rows (MAX_ROWS rows, texts up to MAX_CHARS); scoring
takes all texts whole. Null and empty texts have no features: their score is the bias's. Without
labels of both kinds every score is 0.5. Repeated rows get equal scores; other columns are left
out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, read, small_batches
from graphloom.llm.features import Words, fitted, flat, hashed, training_rows

BITS = 18
MAX_ROWS, MAX_CHARS = 6000, 60_000
#: Passes over the sample: as many as make about so many updates, within the bounds.
UPDATES, LEAST_PASSES, MOST_PASSES = 12_000, 2, 30
FTRL_ALPHA, FTRL_BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
THRESHOLD = 0.3
#: The number that stands for a repeated word.
REPEAT = 0x9E3779B1


def _number(piece: str) -> int:
    if len(piece) > 3 and piece.isupper():
        return hashed("^" + piece) | 1 << 32  # marked: in capitals
    return hashed(piece)


def features(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: features, their values, and the bounds of each text's."""
    mask = np.int64((1 << BITS) - 1)
    numbers, sizes = flat(texts, words)
    owner = np.repeat(np.arange(len(texts)), sizes)
    capital = numbers >> 32 == 1
    word = numbers & np.int64(0xFFFFFFFF)
    for back in (1, 2):
        again = np.zeros(len(word), bool)
        again[back:] = (numbers[back:] == numbers[:-back]) & (owner[back:] == owner[:-back])
        word = np.where(again, np.int64(REPEAT), word)
    one = (word * np.int64(0x85EBCA6B) >> np.int64(7)) & mask
    two = ((word[:-1] * np.int64(0x27D4EB2F) ^ word[1:] * np.int64(0x165667B1)) >> np.int64(9)) & mask
    inside = owner[:-1] == owner[1:]
    marks = np.full(int(capital.sum()), mask)  # one feature for all capitals
    keys = np.concatenate([owner << np.int64(BITS) | one, (owner[:-1] << np.int64(BITS) | two)[inside], owner[capital] << np.int64(BITS) | marks])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    values = np.log1p(counts)
    owner = keys >> np.int64(BITS)
    norm = np.sqrt(np.bincount(owner, values**2, len(texts)))
    return keys & mask, values / norm[owner] if len(owner) else values, np.searchsorted(owner, np.arange(len(texts) + 1))


class Ftrl:
    """FTRL-proximal logistic regression (McMahan et al. 2013) over sparse rows."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((FTRL_BETA + np.sqrt(n)) / FTRL_ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / FTRL_ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows: list[tuple[str, int]]) -> np.ndarray:
    """Weights of all features, the bias last."""
    model = Ftrl((1 << BITS) + 1)
    if len({y for _, y in rows}) == 2:
        words = Words(_number)
        parts = [features([t for t, _ in rows[i : i + 256]], words) for i in range(0, len(rows), 256)]
        for _ in range(min(MOST_PASSES, max(LEAST_PASSES, UPDATES // len(rows)))):
            for i, (at, x, bounds) in zip(range(0, len(rows), 256), parts):
                for k, (_, y) in enumerate(rows[i : i + 256]):
                    own = slice(bounds[k], bounds[k + 1])
                    model.learn(np.append(at[own], 1 << BITS), np.append(x[own], 1.0), y)
    return model.weights().astype(np.float32)


def score_texts(texts: list[str], weights: np.ndarray, words: Words) -> np.ndarray:
    at, x, bounds = features(texts, words)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    dot = np.bincount(owner, weights[at].astype(np.float64) * x, len(texts)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


_WORDS = Words(_number)


def score(docs: DataFrame, weights: np.ndarray, *keep: str) -> DataFrame:
    """The kept columns and the score of each document's whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)  # 2**BITS + 1 floats
    chosen = docs.select(*[docs[c] for c in keep], docs["text"].cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes if c != "_text") + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            scores = score_texts(texts, shared.value, _WORDS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return chosen.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, divisor: int = 5, value: int = 0) -> np.ndarray:
    """The weights, from labelled rows that aren't held out."""
    sample = training_rows(docs, labels, "quality", divisor, value, MAX_ROWS, MAX_CHARS)
    return np.frombuffer(fitted(sample, lambda rows: fit(rows).tobytes()), np.float32)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")), "doc_id").select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
ORACLE: dict[str, str] = {}
