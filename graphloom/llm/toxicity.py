"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are runs of letters, lower-cased. A word's vector is the sum of two rows of one hashed
table: that of the word and that of its first four letters, so that inflected forms share what
they have in common. Filters of one, two and three words slide over the text; each filter's
largest response (max pooling, not below zero) goes into a logistic output. Everything is trained
in numpy with Adagrad; the gradient of a max pool reaches only the windows that won.

Thresholds are calibrated by language on a part of the labelled rows kept from training: for each
language with labels enough, the threshold that makes the fewest errors there, in the middle of
its best range; other languages use the one of all. They decide `flagged`; the score itself
depends on the text alone.

Learning takes all labelled rows that aren't held out, in blocks side by side whose changes are
averaged after each pass. Learning and scoring
take all texts whole, in segments of bounded size whose maxima are merged. Null and empty texts
have zero responses. Without labels of both kinds every score is 0.5. Repeated rows get equal
scores; a null language uses the common threshold; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import aside, held_out, read, restored, shared_table, small_batches
from graphloom.llm.features import Words, hashed, labelled_rows, learned
from graphloom.storage import discard

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 8
PREFIX = 4
#: Updates in all, within bounds on the passes; the learning rate; the weight of a toxic text.
UPDATES, LEAST_PASSES, MOST_PASSES, RATE, POSITIVE = 24_000, 3, 40, 0.1, 1.5
#: The spread of untrained vectors, and the share of words left out at each training step: few
#: rows can't then be told by words they alone have.
START, DROP = 0.02, 0.7
#: Of so many labelled rows, by a hash of the id, one calibrates instead of training.
CALIBRATE, LEAST_LABELS = 5, 20
THRESHOLD = 0.7
#: The cuts that a threshold is chosen from.
CUTS = np.linspace(0.02, 0.98, 97)
#: Words that are looked at in one go.
SEGMENT = 1 << 16
LETTERS = re.compile(r"[^\W\d_]+")


def _number(word: str) -> int:
    """Bucket of the word, and of its prefix, in one number. Bucket 0 is for padding."""
    return (1 + hashed(word) % (BUCKETS - 1)) << 32 | 1 + hashed(word[:PREFIX] + "*") % (BUCKETS - 1)


_WORDS = Words(_number)


def numbers(text: str | None) -> list[int]:
    return [*map(_WORDS.__getitem__, LETTERS.findall((text or "").lower()))]


def code(text: str) -> bytes:
    """The numbers of a text's words, four bytes each."""
    n = np.array(numbers(text), np.int64)
    return (n >> np.int64(32) << np.int64(15) | n & np.int64(BUCKETS - 1)).astype(np.int32).tobytes()


def decoded(own: bytes) -> np.ndarray:
    n = np.frombuffer(own, np.int32).astype(np.int64)
    return n >> np.int64(15) << np.int64(32) | n & np.int64(BUCKETS - 1)


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, START, (BUCKETS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(0)

    def parts(self) -> list[np.ndarray]:
        return [self.table, *self.filters, self.shift, self.out]

    def weights(self) -> np.ndarray:
        """All weights in one array, the bias last."""
        return np.concatenate([*(x.ravel() for x in self.parts()), [self.bias]]).astype(np.float32)

    def take(self, weights: np.ndarray) -> Net:
        """Takes its weights from such an array: views of it, but for the bias."""
        bounds = np.cumsum([x.size for x in self.parts()])
        own = [w.reshape(x.shape) for w, x in zip(np.split(weights[:-1], bounds[:-1]), self.parts())]
        self.table, *self.filters, self.shift, self.out = own
        self.bias = np.float32(weights[-1])
        return self

    def vectors(self, words: np.ndarray) -> np.ndarray:
        return self.table[words >> np.int64(32)] + self.table[words & np.int64(0xFFFFFFFF)]

    def responses(self, x: np.ndarray, starts: int) -> np.ndarray:
        """Responses of all filters to the windows at the first ``starts`` rows of x."""
        parts = []
        for w, f in zip(WIDTHS, self.filters):
            r = x[:starts] @ f[0]
            for j in range(1, w):
                r += x[j : starts + j] @ f[j]
            parts.append(r)
        return np.concatenate(parts, 1)

    def learn(self, words: np.ndarray, y: int, state: dict) -> None:
        pad = max(WIDTHS) - 1
        if not len(words):
            return
        padded = np.append(words, np.zeros(pad, np.int64))
        every = np.arange(self.out.size)
        where, top = np.zeros(self.out.size, np.int64), np.full(self.out.size, -np.inf, np.float32)
        for a in range(0, len(words), SEGMENT):
            r = self.responses(self.vectors(padded[a : a + SEGMENT + pad]), min(SEGMENT, len(words) - a)) + self.shift
            at = r.argmax(0)
            better = r[at, every] > top
            where[better], top[better] = at[better] + a, r[at, every][better]
        pooled = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(float(pooled @ self.out) + float(self.bias), -30, 30)))
        g = np.float32((p - y) * (POSITIVE if y else 1.0))
        if abs(g) < 1e-3:
            return
        d = g * self.out * (top > 0)
        grads = []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            at = slice(k * FILTERS, (k + 1) * FILTERS)
            rows = where[at][:, None] + np.arange(w)  # filters x width
            grad = self.vectors(padded[rows]) * d[at][:, None, None]  # filters x width x dim
            into = np.einsum("f,wdf->fwd", d[at], f)
            grads.append((f, grad.transpose(1, 2, 0), f"f{k}"))
            state["rows"].append(padded[rows].ravel())
            state["into"].append(into.reshape(-1, DIM))
        self.step(self.out, g * pooled, state, "out")
        self.step(self.shift, d, state, "shift")
        self.bias -= np.float32(0.05) * g
        for f, grad, name in grads:
            self.step(f, grad, state, name)
        rows, into = np.concatenate(state["rows"]), np.concatenate(state["into"])
        state["rows"].clear()
        state["into"].clear()
        live = np.abs(into).sum(1) > 0
        rows, into = rows[live], into[live]
        for part in (rows >> np.int64(32), rows & np.int64(0xFFFFFFFF)):
            own, inverse = np.unique(part, return_inverse=True)
            total = np.zeros((len(own), DIM), np.float32)
            np.add.at(total, inverse, into)
            total[own == 0] = 0
            state["table"][own] += total**2
            self.table[own] -= RATE * total / np.sqrt(state["table"][own] + 1e-6)

    def step(self, what: np.ndarray, grad: np.ndarray, state: dict, name: str) -> None:
        total = state.setdefault(name, np.zeros_like(what))
        total += grad**2
        what -= RATE * grad / np.sqrt(total + 1e-6)

    def scores(self, texts: list[list[int]]) -> np.ndarray:
        """Scores of whole texts: segments of all their words, one after another."""
        pad = [0] * (max(WIDTHS) - 1)
        words = np.array([x for t in texts for x in (*t, *pad)], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) + len(pad) for t in texts])
        pooled = np.zeros((len(texts), self.out.size), np.float32)
        for a in range(0, len(words), SEGMENT):
            own = owner[a : a + SEGMENT]
            x = self.vectors(np.append(words[a : a + SEGMENT + len(pad)], np.zeros(len(pad), np.int64)))
            r = self.responses(x, len(own)) + self.shift
            r[words[a : a + SEGMENT] == 0] = -np.inf  # from a pad, windows reach the next text
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            pooled[own[first]] = np.maximum(pooled[own[first]], np.maximum.reduceat(r, first, 0))
        return 1 / (1 + np.exp(-np.clip(pooled.astype(np.float64) @ self.out + self.bias, -30, 30)))


def fit(rows: list[tuple[str, int]]) -> Net:
    net = Net()
    if len({y for _, y in rows}) < 2:
        net.out[:] = 0
        return net
    coded = [(np.array(w, np.int64), y) for t, y in rows if (w := numbers(t))]
    state: dict = {"rows": [], "into": [], "table": np.zeros_like(net.table)}
    order = np.random.default_rng(11)
    for _ in range(min(MOST_PASSES, max(LEAST_PASSES, UPDATES // max(1, len(coded))))):
        for i in order.permutation(len(coded)):
            words, y = coded[i]
            net.learn(words[order.random(len(words)) >= DROP] if len(words) > 4 else words, y, state)
    return net


def thresholds(counted: list[Row]) -> dict[str | None, float]:
    """The threshold of each language, and under None that of all, from rows (lang, y, k, n): n rows of label y score at the first k cuts or above."""
    found: dict[str | None, np.ndarray] = {None: np.zeros((2, len(CUTS) + 1), np.int64)}
    for r in counted:
        found.setdefault(r["lang"], np.zeros((2, len(CUTS) + 1), np.int64))[r["y"], r["k"]] += r["n"]
    out: dict[str | None, float] = {}
    for lang, (plain, toxic) in found.items():
        errors = plain.sum() - plain.cumsum()[:-1] + toxic.cumsum()[:-1]
        out[lang] = float(np.median(CUTS[errors == errors.min()])) if plain.sum() and toxic.sum() else THRESHOLD
    return out


def score(docs: DataFrame, net: Net, *keep: str, text_col: str = "text") -> DataFrame:
    """The kept columns and the score of each document's whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # about BUCKETS * DIM floats
    chosen = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes if c != "_text") + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([numbers(t) for t in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return chosen.mapInArrow(run, schema)


def _learn(weights: np.ndarray, squares: np.ndarray, y: list[int], codes: list[bytes], turn: int, block: int, passes: int) -> None:
    """Learns the rows of a block: both arrays are changed in place."""
    net, sums = Net().take(weights), Net().take(squares)
    state: dict = {"rows": [], "into": [], "table": sums.table, "shift": sums.shift, "out": sums.out} | {f"f{k}": f for k, f in enumerate(sums.filters)}
    order = np.random.default_rng([11, turn, block])
    for _ in range(passes):
        for i in order.permutation(len(codes)):
            words = decoded(codes[i])
            net.learn(words[order.random(len(words)) >= DROP] if len(words) > 4 else words, y[i], state)
    weights[-1] = net.bias
    squares[-1] += passes * len(codes)


def _calibrated(rows: DataFrame, net: Net) -> dict[str | None, float]:
    """The thresholds by the scores of these rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([decoded(c).tolist() for c in batch.column("code").to_pylist()])
            k = np.searchsorted(CUTS, scores, "right")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), pa.array(k, pa.int32())], names=["lang", "y", "k"])

    counted = rows.select(F.col("lang").cast("string").alias("lang"), "y", "code").mapInArrow(run, "lang string, y int, k int")
    counted = shared_table(counted.groupBy("lang", "y", "k").agg(F.count("*").alias("n")), "scores")
    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    many = counted.where("lang is not null").groupBy("lang").agg(of(0).alias("plain"), of(1).alias("toxic")).where((F.col("plain") >= LEAST_LABELS) & (F.col("toxic") >= LEAST_LABELS))
    own = counted.join(many, "lang", "left_semi").select("lang", "y", "k", "n")
    every = counted.groupBy("y", "k").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "y", "k", "n")
    out = thresholds(own.unionByName(every).collect())  # counts of each cut, of languages with labels enough
    discard(spark, counted)
    return out


def train(docs: DataFrame, labels: DataFrame, divisor: int = 3, value: int = 1) -> tuple[Net, dict[str | None, float]]:
    """The net and the thresholds, from all labelled rows that aren't held out."""
    rows, blocks = labelled_rows(docs, labels, "toxic", divisor, value, code, "lang")
    kept = F.pmod(F.xxhash64("place", F.lit(1)), F.lit(CALIBRATE)) == 0
    known = rows.where(~kept & (F.length("code") > 0))
    kinds = known.groupBy("y").count().collect()
    net = Net()
    if len(kinds) < 2:
        net.out[:] = 0
    else:
        passes = min(MOST_PASSES, max(LEAST_PASSES, UPDATES // sum(r["count"] for r in kinds)))
        rounds, each = (1, passes) if blocks == 1 else (passes, 1)
        net.take(learned(known, blocks, net.weights(), rounds, lambda *x: _learn(*x, passes=each)))
    cuts = _calibrated(rows.where(kept), net)
    discard(docs.sparkSession, rows)
    return net, cuts


def _cut(cuts: dict[str | None, float], lang: str):
    """The threshold of a row's language."""
    cut = F.lit(cuts[None])
    for name, c in sorted((k, v) for k, v in cuts.items() if k is not None):
        cut = F.when(F.col(lang) == name, F.lit(c)).otherwise(cut)
    return cut


def judge(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, doc_id, score, predicted and flagged (by the language's threshold)."""
    net, cuts = train(docs, labels)
    columns = list(dict.fromkeys(["doc_id", "lang", *keep]))
    scored = score(docs, net, *columns)
    return scored.select(*columns, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= _cut(cuts, "lang")).alias("flagged"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the documents that aren't flagged, with their own columns."""
    net, cuts = train(docs, labels)
    held, names = aside(docs)
    scored = score(held, net, *names.values(), text_col=names["text"])
    return restored(scored.where(F.col("score") < _cut(cuts, names["lang"])), names)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, flagged of every document."""
    found = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted", "flagged")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
