"""Clusters of bounded size: a tree of coarse centres, and deferred acceptance between names and centres.

A graph of n names has k = max(1, n // capacity) clusters of ``capacity`` names, and one more for
what is left over. Names rank centres by distance (in steps of 1e-9), equal ones by number. First all names claim their
nearest centre, then those still free their second nearest, and so on; a centre with more claims
than room takes names in order of their keys, a digest each. Centres are those of k-means from the
first k names by key.

A node of the tree that has FAN clusters or fewer holds names of a bounded number, and one task
works it out. A larger one is split in FAN children by the same rules: centres of k-means over its
first SAMPLE names by key, each with room for a share of the node's clusters. There names and
centres meet in rounds. A name claims the first centre in its order whose cut it doesn't exceed; a
centre with too many claims lowers its cut to the last (rank, key) that it has room for. A claim of a
rank is settled after as many rounds, so there are FAN + 1 rounds at most, and the outcome is that of going
rank by rank. Only cuts change from round to round: neither names nor centres pass through the driver.
All graphs, and all nodes of a level, are worked on at once.

Null vectors count as zeros, shorter ones are filled up with zeros. Names are distinct within a
graph; null ones take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import broadcast_if_small, shared_table

CAPACITY, ITERATIONS = 128, 20
#: Children of a node at most, and names that its centres are learned from.
FAN, SAMPLE = 64, 4096
#: Leading digits of a key that claims are counted by.
DIGITS = 3
OPEN = 1 << 20
#: Rows of a node that meet its centres at once, about.
BLOCK = 2048
NODE = ["graph_id", "first"]


def distances(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Euclidean distances in steps of 1e-9, so that rounding doesn't order equal ones."""
    return np.round(np.stack([np.sqrt(((v - c) ** 2).sum(1)) for c in centers], 1), 9)


def lloyd(v: np.ndarray, k: int) -> np.ndarray:
    """Centres of k-means, started from the first k rows; an empty one stays where it is."""
    centers = v[:k].copy()
    for _ in range(ITERATIONS):
        own = distances(v, centers).argmin(1)
        sums, counts = np.zeros_like(centers), np.bincount(own, minlength=k)[:, None]
        np.add.at(sums, own, v)
        centers = np.where(counts > 0, sums / np.maximum(counts, 1), centers)
    return centers


def rank_by_rank(order: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The centre of each row, rows in order of their keys; -1 for those that no centre has room for."""
    out, room = np.full(len(order), -1), room.copy()
    for claims in order.T:
        free = np.flatnonzero(out < 0)
        for center in np.unique(claims[free]):
            own = free[claims[free] == center][: room[center]]
            out[own] = center
            room[center] -= len(own)
    return out


def _matrix(lists: list, width: int = 0) -> np.ndarray:
    matrix = np.zeros((len(lists), max([width, *(len(x or ()) for x in lists)])))
    for row, x in zip(matrix, lists):
        row[: len(x or ())] = x or ()
    return matrix


def _leaves(rows: DataFrame, capacity: int) -> DataFrame:
    """(graph_id, name, cluster) of nodes with FAN clusters at most."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        first, m = (table.column(c)[0].as_py() for c in ("first", "m"))
        v = _matrix(table.column("v").to_pylist())
        own = rank_by_rank(np.argsort(distances(v, lloyd(v, m)), 1, kind="stable"), np.full(m, capacity))
        return pa.table({"graph_id": table.column("graph_id"), "name": table.column("name"), "cluster": pa.array(first + np.where(own < 0, m, own), pa.int64())})

    return rows.groupBy(*NODE).applyInArrow(run, "graph_id string, name string, cluster long")


def _centers(rows: DataFrame) -> DataFrame:
    """(graph_id, first, centers): FAN centres of each node, as bytes."""
    order = Window.partitionBy(*NODE).orderBy("key")
    sample = rows.select(*NODE, "key", "v", F.row_number().over(order).alias("_n")).where(F.col("_n") <= SAMPLE)

    def run(table: pa.Table) -> pa.Table:
        centers = lloyd(_matrix(table.sort_by("key").column("v").to_pylist()), FAN)
        return pa.table({**{c: table.column(c).slice(0, 1) for c in NODE}, "centers": pa.array([centers.tobytes()], pa.binary())})

    return sample.groupBy(*NODE).applyInArrow(run, "graph_id string, first long, centers binary")


def _same_node() -> Column:
    return F.col("graph_id").eqNullSafe(F.col("_graph_id")) & (F.col("first") == F.col("_first"))


def _ranked(rows: DataFrame) -> DataFrame:
    """The rows with their node's centres in order of distance."""
    centers = shared_table(_centers(rows), "centers").select(*[F.col(c).alias(f"_{c}") for c in NODE], "centers")
    columns = [*NODE, "m", "name", "key", "v"]
    # a node's centres go once to each block of about BLOCK of its rows, not to each row
    parts = F.ceil(F.count("*") / BLOCK).cast("long").alias("_parts")
    sizes = shared_table(rows.groupBy(*[F.col(c).alias(f"_{c}") for c in NODE]).agg(parts), "sizes")
    dealt = rows.join(broadcast_if_small(sizes, 256), _same_node()).select(*columns, F.pmod(F.xxhash64("key"), F.col("_parts")).alias("part"))
    sent = centers.join(sizes.select(*[F.col(f"_{c}").alias(c) for c in NODE], "_parts"), _same_node()).select(*NODE, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"), "centers")

    def run(own: pa.Table, centers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return own.select(columns).append_column("order", pa.array([], pa.list_(pa.int32())))
        c = np.frombuffer(centers.column("centers")[0].as_py(), np.float64).reshape(FAN, -1)
        v = _matrix(own.column("v").to_pylist(), c.shape[1])
        order = np.argsort(distances(v, np.pad(c, ((0, 0), (0, v.shape[1] - c.shape[1])))), 1, kind="stable")
        return own.select(columns).append_column("order", pa.array(order.tolist(), pa.list_(pa.int32())))

    kinds, by = dict(rows.dtypes), [*NODE, "part"]
    met = dealt.groupBy(*by).cogroup(sent.groupBy(*by))
    return met.applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", order array<int>")


def share(m: Column, child: Column) -> Column:
    """Clusters of a node's child."""
    return F.floor(m / FAN) + F.when(child < m % FAN, 1).otherwise(0)


def _claims(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows with the centre that each claims and its rank there; both null where all centres are closed to it."""
    cuts = cuts.select(*[F.col(c).alias(f"_{c}") for c in NODE], "cuts")
    met = ranked.join(broadcast_if_small(cuts, 256), _same_node())
    fits = lambda c, r: (r < F.get("cuts", c)["rank"]) | ((r == F.get("cuts", c)["rank"]) & (F.col("key") <= F.get("cuts", c)["key"]))
    at = F.array_position(F.transform("order", fits), F.lit(True)).cast("int")
    met = met.withColumn("_at", F.when(at > 0, at - 1))
    return met.select(*[F.col(c) for c in ranked.columns if c != "order"], F.get("order", F.col("_at")).alias("child"), F.col("_at").alias("rank"))


def _lower(claims: DataFrame, cuts: DataFrame, capacity: int) -> tuple[DataFrame, bool]:
    """The cuts after a round, and whether any was lowered. Claims are counted by centre, rank and leading digits first."""
    place, bucket = [*NODE, "child"], F.substring("key", 1, DIGITS).alias("bucket")
    counted = claims.where("child is not null").groupBy(*place, "rank", bucket).agg(F.count("*").alias("n"), F.max("m").alias("m"))
    upto = Window.partitionBy(*place).orderBy("rank", "bucket")
    room = (capacity * share(F.col("m"), F.col("child"))).cast("long")
    counted = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("room", room)
    crossing = shared_table(counted.where((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("n") <= F.col("room"))).select(*place, "rank", "bucket", (F.col("room") - F.col("upto") + F.col("n")).alias("left")), "crossing")
    if crossing.isEmpty():
        return cuts, False
    # of the rows that share the digits at the cut, those in the room that is left; without room the digits, which lie below all of them, cut
    met = crossing.select(*[F.col(c).alias(f"_{c}") for c in NODE], F.col("child").alias("_child"), F.col("rank").alias("_rank"), F.col("bucket").alias("_bucket"), "left")
    same = _same_node() & (F.col("child") == F.col("_child")) & (F.col("rank") == F.col("_rank")) & (F.col("bucket") == F.col("_bucket"))
    own = claims.select(*place, "rank", bucket, "key").join(broadcast_if_small(met), same)
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy(*place).orderBy("key")))
    last = own.groupBy(*place).agg(F.first("rank").alias("rank"), F.coalesce(F.max(F.when(F.col("_n") <= F.col("left"), F.col("key"))), F.first("bucket")).alias("key"))
    new = last.groupBy(*[F.col(c).alias(f"_{c}") for c in NODE]).agg(F.map_from_entries(F.collect_list(F.struct("child", F.struct("rank", "key")))).alias("new"))  # FAN at most
    met = cuts.join(new, _same_node(), "left")
    lowered = F.transform("cuts", lambda cut, c: F.coalesce(F.try_element_at("new", c), cut))
    return shared_table(met.select(*NODE, lowered.alias("cuts")), "cuts"), True


def _split(rows: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """The rows of nodes in their children, and (graph_id, name, cluster) of what is left over."""
    ranked = shared_table(_ranked(rows), "ranked")
    open_ = F.array_repeat(F.struct(F.lit(OPEN).alias("rank"), F.lit("").alias("key")), FAN)
    cuts = shared_table(ranked.select(*NODE).distinct().select(*NODE, open_.alias("cuts")), "cuts")
    for _ in range(FAN + 1):
        cuts, more = _lower(_claims(ranked, cuts), cuts, capacity)
        if not more:
            break
    claims = shared_table(_claims(ranked, cuts), "claims")
    m, child = F.col("m"), F.col("child")
    start = child * F.floor(m / FAN) + F.least(child, m % FAN)
    placed = claims.where("child is not null").select("graph_id", (F.col("first") + start).alias("first"), share(m, child).cast("long").alias("m"), "name", "key", "v")
    return placed, claims.where("child is null").select("graph_id", "name", (F.col("first") + m).alias("cluster"))


def bounded_clusters(vectors: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(graph_id, name, cluster) from vectors (graph_id, name, embedding): each graph's clusters, numbered from 0."""
    rows = vectors.where("name is not null").select("graph_id", "name", F.concat(F.md5(F.col("name").cast("binary")), "name").alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    rows = shared_table(rows, "vectors")
    sizes = rows.groupBy(F.col("graph_id").alias("_graph_id")).agg(F.greatest(F.lit(1), F.floor(F.count("*") / capacity)).cast("long").alias("m"))
    rows = rows.join(broadcast_if_small(sizes), F.col("graph_id").eqNullSafe(F.col("_graph_id"))).select("graph_id", F.lit(0).cast("long").alias("first"), "m", "name", "key", "v")
    out = None
    while True:
        small = _leaves(rows.where(F.col("m") <= FAN), capacity)
        out = small if out is None else out.unionByName(small)
        large = rows.where(F.col("m") > FAN)
        if large.isEmpty():
            return shared_table(out, "clusters")
        placed, rest = _split(large, capacity)
        out, rows = out.unionByName(rest), shared_table(placed, "placed")
