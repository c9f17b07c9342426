"""Hard negatives by a full sort of each anchor's scores.

Rows are packed, where they are read, into blocks of BLOCK rows in order of their ids. A block of
anchors meets every block of rows twice; only the anchors travel, and only the best of each block
come back:

* first, each anchor's scores with the rows of its own label are sorted: the best of all blocks are
  its positives;
* then all scores of an anchor with a block are sorted by score and, where equal, by id. A binary
  search finds the first score that isn't above a positive's, and from there the next rows of other
  labels are read until one falls below the lower limit. Of all blocks' finds the first k stay.

Scores are inner products of whole numbers, exact; where doubles could round them, Python's integers
are used. Scores beyond 64 bits stay at the ends of long. The limits are compared as whole numbers.

The work is anchors times rows, as it is for any exact search; no group is a task, so one label
or id that most rows have makes no difference.

Vectors that are null, or hold null or non-finite components, take no part, neither do rows with a
null id or label. Components missing at the end of a shorter vector count as zeros. An anchor isn't
its own candidate, nor is any other row of its id; an id with several rows is one anchor, with the
least label and vector. Repeated rows of other ids are candidates each. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read, shared_table
from graphloom.llm.topk import EXACT, _pack, _unpack, _whole

#: Rows of a block of vectors and of anchors.
BLOCK, ANCHOR_BLOCK = 8192, 256
#: Positives of an anchor, negatives of a positive, and the share of the positive's score that a negative has at least.
POSITIVES, NEGATIVES, LOWER = 5, 5, (80, 100)
ENDS = -(2**63), 2**63 - 1


def valid(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, e) of the rows that take part."""
    x = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].cast("array<double>").alias("e"))
    fine = F.forall("e", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & fine)


def packed(rows: DataFrame, size: int, scale: float, *more: str) -> DataFrame:
    """(task, number, ids, labels, matrix, more columns as lists): the rows of each task in blocks of ``size``, each in order of ids."""
    kinds = dict(rows.dtypes)
    schema = "task long, number long, ids binary, labels binary, matrix binary" + "".join(f", `{c}` array<{kinds[c]}>" for c in more)

    def block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        order = np.argsort(ids, kind="stable")
        matrix = _whole(table.column("e").to_pylist(), scale)[order]
        lists = [pa.array([table.column(c).take(pa.array(order)).to_pylist()], pa.list_(table.schema.field(c).type)) for c in more]
        first = [pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), number)]
        return pa.RecordBatch.from_arrays([*first, *(pa.array([x], pa.binary()) for x in (ids[order].tobytes(), labels[order].tobytes(), _pack(matrix))), *lists], names=["task", "number", "ids", "labels", "matrix", *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = 0
        for batch in batches:
            while batch.num_rows:
                took = batch.slice(0, size - sum(b.num_rows for b in held))
                batch = batch.slice(took.num_rows)
                held.append(took)
                if sum(b.num_rows for b in held) == size:
                    yield block(held, number)
                    held, number = [], number + 1
        if held:
            yield block(held, number)

    return rows.select("id", "label", "e", *more).mapInArrow(run, schema)


def _scores(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products, as 64-bit integers."""
    width = min(a.shape[1], v.shape[1])
    a, v = a[:, :width], v[:, :width]
    if object not in (a.dtype, v.dtype) and float(np.abs(a).max(initial=0)) * float(np.abs(v).max(initial=0)) * width < EXACT:
        return (a @ v.T).astype(np.int64)
    a, v = ([[int(x) for x in r] for r in m.tolist()] for m in (a, v))
    return np.array([[min(max(sum(map(int.__mul__, x, y)), ENDS[0]), ENDS[1]) for y in v] for x in a], np.int64).reshape(len(a), len(v))


def best_of_label(anchor: int, label: int, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best other rows of the anchor's label; ids rise."""
    own = np.flatnonzero((labels == label) & (ids != anchor))
    return own[np.lexsort((ids[own], ~scores[own]))[:k]]  # ~x falls as x rises, and has no overflow


def below(positives: list[int], label: int, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, k: int, lower: tuple[int, int]) -> list[np.ndarray]:
    """For each positive's score, the places of the first k rows of other labels from it down to the lower limit."""
    order = np.lexsort((ids, ~scores))
    ranked = ~scores[order]
    other = np.flatnonzero(labels[order] != label)
    out = []
    for score in positives:
        start = np.searchsorted(other, np.searchsorted(ranked, ~score, "left"), "left")
        places = order[other[start : start + k]]
        out.append(np.array([p for p in places if lower[0] * score <= lower[1] * int(scores[p])], np.int64))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _table(names: list[str], parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate([np.asarray(p[i], np.int64) for p in parts]) if parts else np.array([], np.int64) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _met(anchors: DataFrame, blocks: DataFrame, count: int, *columns: str) -> DataFrame:
    """Each block of anchors beside each block of rows."""
    sent = anchors.select(*[F.col(c).alias(f"a_{c}") for c in columns], F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_to"))
    cells = blocks.select("ids", "labels", "matrix", F.pmod(F.xxhash64("task", "number"), F.lit(count)).cast("int").alias("cell"))
    return cells.join(sent, F.col("cell") == F.col("_to")).select("ids", "labels", "matrix", *[f"a_{c}" for c in columns])


def positives(anchors: DataFrame, blocks: DataFrame, count: int, k: int) -> DataFrame:
    """(anchor, place from 1, positive, score): the k best rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, matrix, a_ids, a_labels, a_matrix in _rows(batches):
            ids, labels, a_ids, a_labels = map(_numbers, (ids, labels, a_ids, a_labels))
            scores = _scores(_unpack(a_matrix, len(a_ids)), _unpack(matrix, len(ids)))
            parts = []
            for anchor, label, own in zip(a_ids.tolist(), a_labels.tolist(), scores):
                best = best_of_label(anchor, label, ids, labels, own, k)
                parts.append((np.full(len(best), anchor), ids[best], own[best]))
            yield _table(["anchor", "positive", "score"], parts)

    found = _met(anchors, blocks, count, "ids", "labels", "matrix").mapInArrow(run, "anchor long, positive long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = POSITIVES, k: int = NEGATIVES, lower: tuple[int, int] = LOWER, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows and anchors of ``valid``."""
    blocks = shared_table(packed(rows, BLOCK, scale), "blocks")
    count = max(1, blocks.count())
    first = F.min(F.struct("label", "e"))
    asked = shared_table(anchors.groupBy("id").agg(first.alias("r")).select("id", "r.label", "r.e"), "anchors")
    found = positives(packed(asked, ANCHOR_BLOCK, scale), blocks, count, n_positives)
    own = found.groupBy(F.col("anchor").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("place", "positive", "score"))).alias("pos"))  # n_positives at most
    ready = shared_table(packed(asked.join(own, F.col("id") == F.col("_id")), ANCHOR_BLOCK, scale, "pos"), "ready")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor_id", "place", "positive_id", "negative_id", "positive_score", "negative_score"]
        for ids, labels, matrix, a_ids, a_labels, a_matrix, a_pos in _rows(batches):
            ids, labels, a_ids, a_labels = map(_numbers, (ids, labels, a_ids, a_labels))
            scores = _scores(_unpack(a_matrix, len(a_ids)), _unpack(matrix, len(ids)))
            parts = []
            for anchor, label, pos, all_scores in zip(a_ids.tolist(), a_labels.tolist(), a_pos, scores):
                for p, places in zip(pos, below([p["score"] for p in pos], label, ids, labels, all_scores, k, lower)):
                    same = [np.full(len(places), x) for x in (anchor, p["place"], p["positive"], p["score"])]
                    parts.append((*same[:3], ids[places], same[3], all_scores[places]))
            yield _table(names, parts)

    met = _met(ready, blocks, count, "ids", "labels", "matrix", "pos")
    negatives = met.mapInArrow(run, "anchor_id long, place long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = negatives.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted(label: Column, vec_id: Column) -> Column:
    """The label that the query uses: the next of ten where the id is divisible by 7."""
    return F.when(vec_id % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for anchors whose id is divisible by 100."""
    table = read(spark, sf_dir, "embeddings")
    rows = valid(table.withColumn("label", shifted(F.col("label"), F.col("vec_id"))), "vec_id", "label", "embedding")
    return mine(rows, rows.where(F.col("id") % 100 == 0))


_ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op13_hard_negatives": _ORACLE}
