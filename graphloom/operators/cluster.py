"""Clusters of bounded size, and de-duplication by a language model within them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.bounded import CAPACITY, bounded_clusters
from graphloom.operators.dedupe import first_match, rewrite
from graphloom.operators.retrieve import EPSILON, K1, B
from graphloom.schema import KGFrames
from graphloom.storage import shared_table

#: What a model is shown of a cluster.
CANDIDATES = 16


def capacity_clusters(vectors: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(name, cluster) from vectors (name, embedding) of one graph."""
    return bounded_clusters(vectors.select(F.lit("graph").alias("graph_id"), "name", "embedding"), capacity).select("name", "cluster")


def nearest_candidates(item: str, rest: list[str], vectors: dict[str, np.ndarray], k: int = CANDIDATES) -> list[str]:
    """The k names of the rest that rank first for the item by half BM25 and half cosine, ties by name; in the rest's order."""
    if len(rest) <= k:
        return rest
    terms = [x.lower().split() for x in rest]
    mean = sum(map(len, terms)) / len(terms) or 1.0
    df = Counter(t for own in terms for t in set(own))
    weight = {t: np.log(len(rest) - n + 0.5) - np.log(n + 0.5) for t, n in df.items()}
    floor = EPSILON * (sum(weight.values()) / len(weight)) if weight else 0.0
    asked = Counter(item.lower().split())

    def score(at: int) -> float:
        tf, size = Counter(terms[at]), K1 * (1 - B + B * len(terms[at]) / mean)
        words = sum(n * (w if (w := weight.get(t, 0.0)) >= 0 else floor) * tf[t] * (K1 + 1) / (tf[t] + size) for t, n in asked.items() if tf[t])
        a, b = vectors.get(item), vectors.get(rest[at])
        length = 0.0 if a is None or b is None else float(np.linalg.norm(a) * np.linalg.norm(b))
        return 0.5 * words + 0.5 * (float(a @ b) / length if length else 0.0)

    best = sorted(range(len(rest)), key=lambda i: (-score(i), rest[i]))[:k]
    return [rest[i] for i in sorted(best)]


def fold_cluster(names: list[str], ask, candidates=lambda item, rest: rest) -> list[tuple[str, str]]:
    """(rep, member) of a cluster: its last name is asked for duplicates among the rest's candidates, and so on.

    ``ask(name, candidates)`` gives (alias, duplicates). Repeated or unknown duplicates are left out;
    the alias names the group only if there are duplicates.
    """
    rest, out = list(names), []
    while rest:
        item = rest.pop()
        shown = candidates(item, list(rest))
        alias, found = ask(item, shown)
        dups = [d for d in dict.fromkeys(found) if d in shown]
        rest = [x for x in rest if x not in set(dups)]
        out += [(alias if dups else item, m) for m in (item, *dups)]
    return out


def lm_clusters(clustered: DataFrame, backend) -> tuple[DataFrame, DataFrame]:
    """((graph_id, ord, rep, member), errors): each cluster folded by the backend's ``duplicates``.

    The model is shown the CANDIDATES names that rank first for each item; embeddings, where the rows
    have them, take part in the ranking. A cluster whose fold fails keeps its names as they are, and
    is an error row.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        names, graph, cluster = sorted(frame["name"]), frame["graph_id"].iloc[0], int(frame["cluster"].iloc[0])
        vectors = {n: np.asarray(v, float) for n, v in zip(frame["name"], frame["embedding"]) if v is not None} if "embedding" in frame else {}
        try:
            pairs, error = fold_cluster(names, backend.duplicates, lambda item, rest: nearest_candidates(item, rest, vectors)), None
        except Exception as e:  # kept as a row, not lost
            pairs, error = [(n, n) for n in names], f"{type(e).__name__}: {e}"
        return pd.DataFrame({"graph_id": graph, "ord": [cluster * 1_000_000 + i for i in range(len(pairs))], "rep": [p[0] for p in pairs], "member": [p[1] for p in pairs], "error": error})

    out = clustered.groupBy("graph_id", "cluster").applyInPandas(fold, "graph_id string, ord long, rep string, member string, error string")
    out = shared_table(out, "folded")
    return out.drop("error"), out.where("error is not null").select("graph_id", "ord", "error")


def graph_clusters(names: DataFrame, embed, capacity: int = CAPACITY) -> DataFrame:
    """(graph_id, name, cluster, embedding) of names (graph_id, name): each graph's clusters of bounded size, all graphs at once.

    Names of equal vectors, as spellings that differ in case only, are clustered as one, by the least of
    them, so that no cluster's bound parts them. A cluster that holds more than ``capacity`` names so is cut
    between them; only more than half of ``capacity`` names of one vector are several units.
    """
    names = names.select("graph_id", "name").distinct()
    vectors = embed(names.select(F.col("name").alias("node")).distinct()).select(F.col("node").alias("name"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = names.join(vectors, "name").select("graph_id", "name", "embedding")
    half = max(1, capacity // 2)
    place = F.row_number().over(Window.partitionBy("graph_id", "embedding").orderBy("name")) - 1
    rows = shared_table(rows.withColumn("_piece", F.floor(place / half)), "named")
    units = shared_table(rows.groupBy("graph_id", "embedding", "_piece").agg(F.min("name").alias("unit"), F.count("*").alias("n")), "units")
    placed = units.drop("_piece").join(bounded_clusters(units.select("graph_id", F.col("unit").alias("name"), "embedding"), capacity).withColumnRenamed("name", "unit"), ["graph_id", "unit"])
    own = Window.partitionBy("graph_id", "cluster")  # of capacity units at most
    begin = F.sum("n").over(own.orderBy("unit")) - F.col("n")
    cut = F.when(F.sum("n").over(own) > capacity, F.floor(begin / half)).otherwise(F.lit(0))
    placed = placed.select("graph_id", "unit", (F.col("cluster") * (2 * capacity) + cut).alias("cluster"))
    member = rows.join(units.select("graph_id", "embedding", "_piece", "unit"), ["graph_id", "embedding", "_piece"]).select("graph_id", "name", "embedding", "unit")
    return member.join(placed, ["graph_id", "unit"]).select("graph_id", "name", "cluster", "embedding")


def lm_deduplicate(graph: KGFrames, embed, backend) -> KGFrames:
    """The graphs with names merged by the backend, cluster by cluster, and the clusters it made."""
    made = [lm_clusters(graph_clusters(names, embed), backend)[0] for names in (graph.entities, graph.predicates)]
    entities, predicates = (first_match(m) for m in made)
    triples = rewrite(graph.triples, entities, predicates)
    reps = lambda m: m.select("graph_id", F.col("rep").alias("name")).distinct()
    return KGFrames(reps(made[0]), reps(made[1]), triples, made[0].drop("ord"), made[1].drop("ord"))


def hashing_embedder(dim: int = 64):
    """An embedder without a model: hashed letter trigrams, as unit vectors.

    Each trigram has ``dim`` signs, drawn by its hash, and a name has the sum of its trigrams' signs. No two trigrams share the
    first 64, so names of different trigrams don't get one vector, as they may where a trigram is one place of a few.
    """

    def vectors(it):
        for frame in it:
            names = frame["node"].tolist()
            codes = [np.array([ord(c) for c in f"  {n.lower()} "], np.uint64) for n in names]
            sizes = np.array([len(c) - 2 for c in codes], np.int64)
            flat = [np.concatenate([c[j : len(c) - 2 + j] for c in codes] or [np.zeros(0, np.uint64)]) for j in range(3)]
            key = flat[0] << np.uint64(42) | flat[1] << np.uint64(21) | flat[2]  # a code point has 21 bits
            rows = np.zeros((len(names), dim))
            for at in range(0, dim if names else 0, 64):
                h = key + np.uint64(0x9E3779B97F4A7C15 * (at // 64 + 1) % 2**64)
                h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                signs = np.unpackbits((h ^ h >> np.uint64(31)).view(np.uint8).reshape(-1, 8), axis=1)[:, : dim - at]
                ones = np.add.reduceat(signs, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
                rows[:, at : at + 64] = 2 * ones - sizes[:, None]
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"node": frame["node"], "embedding": rows.tolist()})

    return lambda names: names.select("node").mapInPandas(vectors, "node string, embedding array<double>")
