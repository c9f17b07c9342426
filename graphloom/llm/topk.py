"""Exact top-k search by inner product over norm buckets.

Vectors are grouped into buckets of nearly the same length. A bucket is dealt out in blocks of
about BLOCK rows, so a bucket that holds most rows is many blocks. Queries come in blocks too. First
every block of queries meets the SEEDS longest blocks of vectors, which gives each query the score
that k vectors reach at least. A block of queries then goes to the buckets that may hold better
vectors for one of its queries, and to no others: only queries travel, in the narrowest whole
numbers that hold them. Where a block of queries meets one of vectors, each query's least score
and the block's largest length give a local cosine threshold, which chooses the pruning:

* threshold above 1: the block can't hold a better vector, and is skipped;
* high threshold: coordinate pruning. On the query's largest coordinates the partial products are
  worked out; what the other coordinates can add is bounded by the two rests' lengths;
* low threshold: length pruning. Only vectors whose length times the query's reaches the least
  score are looked at.

What is left is verified by full products. All products are of integers, so scores are exact; where
doubles could round them, Python's integers are used. Scores beyond 64 bits stay at the ends of long.

Vectors that are null, or hold null or non-finite components, take no part; neither do rows with a
null id. Components missing at the end of a shorter vector count as zeros. Ties go to the smaller
id; repeated rows of an id are candidates each. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read, shared_table

#: Rows of a block of vectors and of queries, about.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Longest blocks that every query meets first.
SEEDS = 4
#: Coordinates that coordinate pruning starts from, and the least cosine threshold to choose it.
FOCUS, LEAST_COSINE = 12, 0.5
#: Ratio of the lengths at a bucket's ends.
RATIO = 1.05
#: Products below this are exact in doubles.
EXACT = 2.0**53


def quantise(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, e array<double>, bucket) of the rows that take part; buckets rise with the vectors' lengths."""
    x = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("e"))
    fine = F.forall("e", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = x.where(F.col("id").isNotNull() & F.col("e").isNotNull() & fine)
    # in units of the largest component, squares stay finite
    most = F.greatest(F.abs(F.array_max("e")), F.abs(F.array_min("e")))
    squares = F.aggregate("e", F.lit(0.0), lambda a, e: a + (e / F.col("_m")) * (e / F.col("_m")))
    x = x.withColumn("_m", F.coalesce(most, F.lit(0.0)))
    length = F.when(F.col("_m") > 0, F.log("_m") + F.log(squares) / 2)
    return x.select("id", "e", F.coalesce(F.floor(length / float(np.log(RATIO))), F.lit(-(1 << 20))).cast("long").alias("bucket"))


def _whole(lists: list[list[float]], scale: float) -> np.ndarray:
    """floor(scale * x) of all components as a matrix: exact doubles, or Python's integers where those would round."""
    width = max(map(len, lists), default=0)
    matrix = np.zeros((len(lists), width))
    for row, e in zip(matrix, lists):
        row[: len(e)] = e
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * matrix)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[int(v) if np.isfinite(v) else int(scale) * int(x) for v, x in zip(r, e)] for r, e in zip(scaled.tolist(), matrix.tolist())], object).reshape(matrix.shape)


def _pack(matrix: np.ndarray) -> bytes:
    """A matrix in the narrowest type that holds it."""
    if matrix.dtype == object:
        return b"p" + pickle.dumps(matrix)
    most = np.abs(matrix).max(initial=0)
    kind = next((k for k in ("i1", "i2", "i4") if most < 2 ** (8 * int(k[1]) - 1)), "f8")
    return kind.encode() + matrix.astype(kind).tobytes()


def _unpack(data: bytes, rows: int) -> np.ndarray:
    """The matrix, as doubles or Python's integers."""
    if data[:1] == b"p":
        return pickle.loads(data[1:])
    x = np.frombuffer(data[2:], data[:2].decode()).astype(np.float64)
    return x.reshape(rows, -1) if rows else x.reshape(0, 0)


def _lengths(matrix: np.ndarray) -> np.ndarray:
    if matrix.dtype == object:  # too long for doubles in part
        return np.array([float("inf") if any(abs(v) >= 1 << 1023 for v in r) else _lengths(np.array([r], np.float64))[0] for r in matrix.tolist()])
    x = matrix
    most = np.maximum(np.abs(x).max(1, initial=0), 1)
    with np.errstate(over="ignore"):
        return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def _packed(rows: DataFrame, *group: str, scale: float) -> DataFrame:
    """A row for each block: its ids and vectors as bytes, longest first, and its largest length."""

    def pack(table: pa.Table) -> pa.Table:
        matrix = _whole(table.column("e").to_pylist(), scale)
        length = _lengths(matrix)
        ids = table.column("id").to_numpy()
        order = np.lexsort((ids, -length))
        keys = {c: table.column(c).slice(0, 1) for c in group}
        return pa.table({**keys, "ids": pa.array([ids[order].tobytes()], pa.binary()), "matrix": pa.array([_pack(matrix[order])], pa.binary()), "top": pa.array([float(length.max())], pa.float64())})

    return rows.groupBy(*group).applyInArrow(pack, ", ".join(f"{c} long" for c in group) + ", ids binary, matrix binary, top double")


def blocks(vectors: DataFrame, scale: float) -> DataFrame:
    """(bucket, part, ids, matrix, top): the blocks of all buckets."""
    counts = vectors.groupBy(F.col("bucket").alias("_b")).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("_parts"))
    dealt = vectors.join(F.broadcast(counts), F.col("bucket") == F.col("_b"))  # lengths are doubles: 30,000 buckets at most
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    return _packed(dealt, "bucket", "part", scale=scale)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score for vectors and queries of ``quantise``."""
    count = queries.count()
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-count // QUERY_BLOCK)))).cast("long"))
    asked = shared_table(_packed(dealt, "block", scale=scale).withColumnRenamed("top", "q_top"), "queries")
    held = shared_table(blocks(vectors, scale), "blocks")
    asked_names = ["block", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")]
    # the longest blocks give each query a least score, and each block of queries a least length
    seeds = held.select("bucket", "part", "top").orderBy(F.desc("top"), "bucket", "part").limit(SEEDS).select("bucket", "part")
    first = asked.select(*asked_names).join(F.broadcast(held.join(F.broadcast(seeds), ["bucket", "part"]).select("ids", "matrix")))  # SEEDS rows
    started = first.select("q_ids", "q_matrix", F.lit(None).cast("binary").alias("least"), "ids", "matrix", "block").mapInArrow(lambda it: _least(it, k), "block long, least binary")
    least = started.groupBy("block").applyInArrow(_merged(k), "block long, least binary")
    ready = shared_table(asked.join(least.withColumnRenamed("block", "_block"), F.col("block") == F.col("_block")).select(*asked_names, "least"), "ready")
    needed = ready.select("q_ids", "q_matrix", "least", "block").mapInArrow(_needs, "block long, need double")
    # a bucket's longest vector decides which blocks of queries it gets
    buckets = held.groupBy("bucket").agg(F.max("part").alias("last"), F.max("top").alias("top"))
    wanted = needed.join(F.broadcast(buckets), F.col("top") >= F.col("need"))  # 30,000 buckets at most
    wanted = wanted.select(F.col("block").alias("_block"), F.col("bucket").alias("_bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("_part"))
    sent = ready.join(wanted, F.col("block") == F.col("_block"))
    pairs = held.join(sent, (F.col("bucket") == F.col("_bucket")) & (F.col("part") == F.col("_part")))
    found = pairs.select("q_ids", "q_matrix", "least", "ids", "matrix").mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def _least(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k-th best scores of a block's queries in a block of vectors, or less; k values for each query."""
    for q_ids, q_matrix, _, ids, matrix, block in _rows(batches):
        best = _Best(q_ids, q_matrix, None, k)
        best.meet(ids, matrix)
        out = np.full((len(best.ids), k), -np.inf)
        for row, (_, scores) in zip(out, best.found):
            row[: len(scores)] = _below(scores)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([out.tobytes()], pa.binary())], names=["block", "least"])


def _below(scores: list[int]) -> np.ndarray:
    """Doubles that aren't above the scores."""
    x = np.array([float(min(s, 10**300)) if s > -(10**300) else -np.inf for s in scores])
    return np.where((np.abs(x) < EXACT) | np.isinf(x), x, x - np.abs(x) * 1e-15)


def _merged(k: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.float64).reshape(-1, k) for x in table.column("least").to_pylist()]
        least = np.sort(np.concatenate(parts, 1), 1)[:, -k]
        return pa.table({"block": table.column("block").slice(0, 1), "least": pa.array([least.tobytes()], pa.binary())})

    return run


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The length below which no vector can be among the best of any of a block's queries."""
    for q_ids, q_matrix, least, block in _rows(batches):
        least, length = np.frombuffer(least, np.float64), _lengths(_unpack(q_matrix, len(q_ids) // 8))
        need = np.where(least > 0, least / np.maximum(length, 1e-300), -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([float(need.min(initial=np.inf)) * (1 - 1e-9)])], names=["block", "need"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for q_ids, q_matrix, least, ids, matrix in _rows(batches):
        best = _Best(q_ids, q_matrix, least, k)
        best.meet(ids, matrix)
        yield best.rows()


class _Best:
    """The k best of each query of a block, among those that reach its least score."""

    def __init__(self, ids: bytes, matrix: bytes, least: bytes | None, k: int):
        self.ids, self.k = np.frombuffer(ids, np.int64), k
        self.q = _unpack(matrix, len(self.ids))
        self.length = _lengths(self.q)
        self.found: list[tuple[np.ndarray, list]] = [(np.array([], np.int64), []) for _ in self.ids]
        self.least = np.full(len(self.ids), -np.inf) if least is None else np.frombuffer(least, np.float64).copy()

    def meet(self, ids: bytes, matrix: bytes) -> None:
        """A block of vectors, in order of falling length."""
        ids = np.frombuffer(ids, np.int64)
        p = _unpack(matrix, len(ids))
        width = min(p.shape[1], self.q.shape[1])
        q, p, length = self.q[:, :width], p[:, :width], _lengths(p)
        if not len(length):
            return
        if object in (q.dtype, p.dtype) or float(np.abs(p).max(initial=0)) * float(np.abs(q).max(initial=0)) * width >= EXACT:
            # bounds in doubles don't hold here: all products, in Python's integers
            q, p = ([[int(v) for v in r] for r in x.tolist()] for x in (q, p))
            for at, own in enumerate(q):
                self.take(at, ids, np.array([sum(a * b for a, b in zip(own, r)) for r in p], object))
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = self.least / (self.length * length[0])
        cosine = np.where(self.length * length[0] > 0, cosine, np.where(self.least > 0, 2.0, -np.inf))
        plain = np.flatnonzero(cosine <= LEAST_COSINE)
        for chosen in np.array_split(plain, max(1, len(plain) // 128)):
            if not len(chosen):
                continue
            # length pruning: lengths fall, so the vectors that are long enough come first
            need = (self.least[chosen] / np.maximum(self.length[chosen], 1e-300)).min()
            upto = int(np.searchsorted(-length, -(need * (1 - 1e-12) - 1e-9), "right")) if np.isfinite(need) else len(p)
            scores = q[chosen] @ p[:upto].T
            for row, at in zip(scores, chosen):
                self.take(at, ids[:upto], row)
        near = np.flatnonzero((cosine > LEAST_COSINE) & (cosine <= 1 + 1e-9))
        squares = p**2 if len(near) else p
        for at in near:
            focus = np.argsort(-np.abs(q[at]), kind="stable")[:FOCUS]
            rest = np.maximum(squares.sum(1) - squares[:, focus].sum(1), 0)
            own = max(float((q[at] ** 2).sum() - (q[at, focus] ** 2).sum()), 0.0)
            bound = p[:, focus] @ q[at, focus] + np.sqrt(rest * own) * (1 + 1e-9) + 1e-6
            left = np.flatnonzero(bound >= self.least[at])
            if len(left):
                self.take(at, ids[left], p[left] @ q[at])

    def take(self, at: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = np.flatnonzero((scores >= self.least[at]) & (ids != self.ids[at]))
        if len(good) > 4 * self.k and scores.dtype != object:  # only the k-th best and better, before sorting
            kth = np.partition(scores[good], len(good) - self.k)[len(good) - self.k]
            good = good[scores[good] >= kth]
        best = sorted(zip((-int(s) for s in scores[good]), ids[good].tolist()))[: self.k]
        self.found[at] = np.array([x for _, x in best], np.int64), [-s for s, _ in best]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(x) for x, _ in self.found]
        scores = [min(max(s, -(2**63)), 2**63 - 1) for _, own in self.found for s in own]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, sizes)), pa.array(np.concatenate([np.array([], np.int64), *(x for x, _ in self.found)])), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of each query among all other vectors."""
    vectors = quantise(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("id") % 20 == 0))


_ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

QUERIES = {"op7_topk": op7_topk}
ORACLE = {"op7_topk": _ORACLE}
