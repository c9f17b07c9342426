"""Connected components: union-find within partitions, then alternating stars over what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import ranked
from graphloom.storage import shared_table

#: Links that a task merges before it writes what they make and starts anew.
LOCAL = 1 << 20


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link of each node to the least of the nodes that the links tie it to."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at.reshape(-1)[: len(u)], at.reshape(-1)[len(u) :]
    above = np.arange(len(ids))
    while True:
        a, b = above[a], above[b]  # roots
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(above, np.maximum(a, b), np.minimum(a, b))
        while (up := above[above]).sum() != above.sum():  # falls until all point to roots
            above = up
    low = above != np.arange(len(ids))
    return ids[low], ids[above[low]]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of numbered nodes, merged LOCAL at a time: a link for each node."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        ends = _stars(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["u", "v"])

    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        if sum(len(x) for x, _ in held) >= LOCAL:
            yield stars()
    if held:
        yield stars()


def components(links: DataFrame, merge: bool = True) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is the component's least node.

    Tasks merge the links they hold before the first shuffle and after each: what comes out is a link
    for each node, not for each link. Each round ties every node's larger neighbours to its least neighbour, then every node and its
    smaller neighbours to the least one (Kiveris et al. 2014). It ends when all links point to
    roots. Every round is written to the shared folder, so plans don't grow with the rounds.

    Nodes that aren't numbers are numbered in their order first, so a task merges numbers, at a few bytes each, and
    names are joined again at the end.

    Without ``merge`` there are stars only, all in the JVM: for links that Python workers make, whose
    tasks would hold a second worker each.
    """
    if merge and dict(links.dtypes)["a"] != "bigint":
        return _numbered(links)
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    kind = f"u {dict(pairs.dtypes)['u']}, v {dict(pairs.dtypes)['v']}"
    merged = lambda rows: shared_table(rows.distinct().mapInArrow(_merged, kind) if merge else rows.distinct(), "links")
    pairs = merged(pairs.mapInArrow(_merged, kind) if merge else pairs)
    while True:
        several = pairs.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        linked_roots = pairs.join(pairs.select(F.col("u").alias("_u")), F.col("v") == F.col("_u"), "left_semi").select("u")
        if several.unionByName(linked_roots).isEmpty():
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("_u")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        small = large.join(low, F.col("u") == F.col("_u")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        pairs = merged(small.where("u <> v"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _numbered(links: DataFrame) -> DataFrame:
    """``components`` of links whose nodes are numbered in their order."""
    links = links.where("a <> b").select("a", "b")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = shared_table(ranked(nodes.withColumn("g", F.lit(0)), "g", [F.col("node")], "n").select("node", "n"), "numbered")
    at = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"_{end}"))
    found = components(links.join(at("a"), "a").join(at("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    found = found.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return found.join(at("node"), "_node").join(at("root"), "_root").select("node", "root")
