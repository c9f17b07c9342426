"""Hashed word features shared by the text classifiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, shared_table, small_batches
from graphloom.storage import discard

#: A run of letters, of digits, or of other characters that aren't white space.
PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w \t-\r]+|_+")
#: Entries that a worker keeps of its word tables before it starts anew.
CACHE = 400_000
#: Rows of a block that learns by itself, and bytes of their codes, about; weights in a slice.
BLOCK_ROWS, BLOCK_BYTES, SLICE = 6000, 1 << 24, 1 << 12
#: Blocks from which on a task learns several, and how many then; sums that are added at a time, and bytes of them in a task.
TASKS, SEVERAL, FAN, SUM_BYTES = 256, 16, 64, 1 << 23


def training_rows(docs: DataFrame, labels: DataFrame, label: str, divisor: int, value: int, max_rows: int, max_chars: int, *more: str) -> DataFrame:
    """(text, y 0 or 1, more columns, place): a bounded sample of labelled texts that aren't held out.

    Texts of more than ``max_chars`` characters are left out of training, whole (scoring takes all
    texts whole). Of the ids that have a label and a text, the first ``max_rows`` by md5 are taken;
    an id with several texts gives the one of least md5. A document with several label rows has the
    largest label. Null labels and ids take no part.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), divisor, value))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    text = docs["text"].cast("string")
    texts = docs.select(docs["doc_id"].alias("_id"), text.alias("text"), *[docs[c].alias(f"_{i}") for i, c in enumerate(more)]).where(text.isNotNull() & (F.length(text) <= max_chars))
    order = F.md5(F.concat(F.lit("train:"), F.col("doc_id").cast("string")).cast("binary"))
    chosen = known.join(texts.select(F.col("_id").alias("doc_id")), "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_rows)
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id"))
    first = F.min_by(F.struct("text", *[F.col(f"_{i}").alias(c) for i, c in enumerate(more)]), F.md5(F.col("text").cast("binary")))
    one = rows.groupBy("doc_id").agg(first.alias("t"), F.first("y").alias("y"))
    return one.select("t.text", (F.col("y") > 0).cast("int").alias("y"), *[f"t.{c}" for c in more], order.alias("place"))


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], bytes]) -> bytes:
    """What ``fit`` makes of the sample's rows, in the order of their last column; it runs in one task, off the driver.

    The sample is bounded by its maker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[-1])
        yield pa.RecordBatch.from_arrays([pa.array([fit([r[:-1] for r in rows])], pa.binary())], names=["model"])

    small_batches(sample.sparkSession)
    got = sample.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(got["model"]) if got else fit([])


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, divisor: int, value: int, code: Callable[[str], bytes], *more: str) -> tuple[DataFrame, int]:
    """(block, place, y 0 or 1, code, more columns) of all labelled texts that aren't held out, and the number of blocks.

    Texts are whole, as ``code`` writes them. An id with several texts gives the one of least md5; a
    document with several label rows has the largest label. Null labels, ids and texts take no part.
    A row's block is a hash of its id, so how the input is dealt out doesn't matter.
    """
    spark = docs.sparkSession
    free = lambda i: i.isNotNull() & ~held_out(i, divisor, value)
    known = labels.where(free(F.col("doc_id")) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    text, names = docs["text"].cast("string"), [f"_{i}" for i in range(len(more))]
    texts = docs.where(free(docs["doc_id"]) & text.isNotNull()).select(docs["doc_id"].alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), *[docs[c].alias(n) for c, n in zip(more, names)], text.alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != "text") + ", code binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pa.array([code(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes], names=[*batch.schema.names[:-1], "code"])

    small_batches(spark)
    one = texts.mapInArrow(run, schema).join(known, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("code", *names), "digest").alias("t"), F.first("y").alias("y"))
    place = F.md5(F.concat(F.lit("train:"), F.col("doc_id").cast("string")).cast("binary"))
    rows = shared_table(one.select(place.alias("place"), (F.col("y") > 0).cast("int").alias("y"), "t.code", *[F.col(f"t.{n}").alias(c) for c, n in zip(more, names)]), "labelled")
    discard(spark)  # the texts' shuffle
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.length("code")).alias("size")).first()
    blocks = max(1, -(-sums["n"] // BLOCK_ROWS), -(-(sums["size"] or 0) // BLOCK_BYTES))
    out = rows.select(F.pmod(F.xxhash64("place"), F.lit(blocks)).alias("block"), "*")
    out._shared_path = rows._shared_path
    return out, blocks


def learned(rows: DataFrame, blocks: int, weights: np.ndarray, rounds: int, learn: Callable[..., None]) -> np.ndarray:
    """Weights learned from all rows, in blocks side by side.

    In each round every block starts from the weights, and from the sums of squared gradients, of all:
    ``learn(weights, squares, y, codes, round, block)`` changes both in place. What the blocks changed
    a weight by is averaged, a block counting by the squares it added there: what one block alone
    has met counts whole. Blocks and their rows have a fixed order, so reruns agree.

    Blocks are dealt to tasks by their number, evenly. A task learns its blocks one after another, holds one
    of them at a time and sends one sum for all.
    Sums are added FAN at a time, slice by slice, level on level, so no task adds up more than FAN of them.
    """
    spark, squares, kind = rows.sparkSession, np.zeros_like(weights), weights.dtype
    schema, names = "slice long, part long, change binary, added binary, share binary", ["slice", "part", "change", "added", "share"]
    size, bounds = SLICE, range(0, len(weights), SLICE)
    tasks = min(blocks, max(TASKS, -(-blocks // SEVERAL)))

    def sums(parts: Iterable[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        """Of parts (mean change, squares added, mean of a block's squares weighed by themselves) the same of all together."""
        whole = total = square = 0.0
        for change, added, share in parts:
            added = added.astype(np.float64)
            whole, total, square = whole + added * change, total + added, square + added * share
        least = np.maximum(total, 1e-300)
        return [np.asarray(x).astype(kind) for x in (whole / least, total, square / least)]

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        parts = (tuple(np.frombuffer(x.as_py(), kind) for x in row) for row in zip(*(table.column(c) for c in names[2:])))
        own = [pa.array([x.tobytes()], pa.binary()) for x in sums(parts)]
        return pa.table([table.column("slice").slice(0, 1), table.column("group").slice(0, 1), *own], names=names)

    small_batches(spark)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((weights, squares))  # of the model's fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            old, held = shared.value
            first: list[int] = []

            def changes() -> Iterator[tuple[np.ndarray, ...]]:
                in_order = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
                for block, found in groupby(in_order, key=lambda r: r[0]):
                    first.append(block)
                    new, more = old.copy(), held.copy()
                    y, codes = map(list, zip(*((r[2], r[3]) for r in found)))
                    learn(new, more, y, codes, turn, block)
                    yield new - old, more - held, more - held

            got = sums(changes())
            if first:
                sent = [pa.array([x[a : a + size].tobytes() for a in bounds], pa.binary()) for x in got]
                places = [pa.array(x, pa.int64()) for x in (range(len(bounds)), [first[0]] * len(bounds))]
                yield pa.RecordBatch.from_arrays([*places, *sent], names=names)

        dealt = rows.select("block", "place", "y", "code").repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block", "place")
        level, span = dealt.mapInArrow(run, schema), blocks
        while span > 1:
            held = min(tasks, span) * 3 * weights.nbytes
            grouped = level.withColumn("group", F.floor(F.col("part") / FAN)).repartition(max(1, -(-held // SUM_BYTES)), "slice", "group")
            level, span = grouped.groupBy("slice", "group").applyInArrow(merge, schema), -(-span // FAN)
        by_slice = sorted((r["slice"], r["change"], r["added"], r["share"]) for r in level.collect())  # the model's size
        if by_slice:
            change, added, share = (np.concatenate([np.frombuffer(r[k], kind) for r in by_slice]) for k in (1, 2, 3))
            weights, squares = weights + change, squares + added.astype(np.float64) * share
        weights, squares = weights.astype(kind), squares.astype(kind)
        shared.unpersist()
        del by_slice, dealt, level
        discard(spark)  # the round's shuffles
    return weights


class Words(dict):
    """Numbers of pieces; made by ``make`` when first asked for.

    A worker serves many stages: it keeps the table of one of them, and the first new piece of another empties it.
    """

    filling: Words | None = None

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> int:
        if Words.filling is not self:
            if Words.filling is not None:
                Words.filling.clear()
            Words.filling = self
        if len(self) >= CACHE:
            self.clear()
        number = self[piece] = self.make(piece)
        return number


def hashed(piece: str) -> int:
    return crc32(piece.encode("utf-8", "surrogatepass"))


def flat(texts: Iterable[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts' pieces in one array, and how many each text has."""
    parts = [[*map(words.__getitem__, PIECE.findall(t))] for t in texts]
    return np.array([x for p in parts for x in p], np.int64), np.array([len(p) for p in parts], np.int64)


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """The chance that a positive scores above a negative, ties counting half."""
    order = np.argsort(score, kind="stable")
    _, inverse, counts = np.unique(score[order], return_inverse=True, return_counts=True)
    ranks = np.empty(len(y))
    ranks[order] = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    n1 = y.sum()
    n0 = len(y) - n1
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else 0.5
