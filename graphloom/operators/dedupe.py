"""De-duplicating names: by spelling, by similarity, and rewriting triples to what is left."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import dot, norm, words
from graphloom.operators.components import components
from graphloom.schema import KGFrames
from graphloom.storage import shared_table


def singular(word: str) -> str:
    """The singular of an English word, by rule."""
    low = word.lower()
    if len(low) > 4 and low.endswith("ies"):
        return word[:-3] + "y"
    if len(low) > 4 and re.search(r"(ss|sh|ch|x|z)es$", low):
        return word[:-2]
    if len(low) > 3 and low.endswith("s") and not low.endswith(("ss", "us", "is")):
        return word[:-1]
    return word


def _normal_form(name: str) -> Column:
    return F.pandas_udf(_normal_series, "string")(name)


def _normal_series(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else " ".join(singular(w) for w in unicodedata.normalize("NFKC", x).split()))


def ascii_form(name: Column) -> Column:
    """The normal form of ASCII names, in JVM expressions; the same rules."""
    low = lambda w: F.lower(w)
    one = lambda w: (
        F.when((F.length(w) > 4) & low(w).endswith("ies"), F.concat(F.substring(w, 1, F.length(w) - 3), F.lit("y")))
        .when((F.length(w) > 4) & low(w).rlike(r"(ss|sh|ch|x|z)es$"), F.substring(w, 1, F.length(w) - 2))
        .when((F.length(w) > 3) & low(w).endswith("s") & ~low(w).rlike("(ss|us|is)$"), F.substring(w, 1, F.length(w) - 1))
        .otherwise(w)
    )
    return F.array_join(F.transform(words(name), one), " ")


def normal_forms(names: DataFrame) -> DataFrame:
    """(name, norm) of distinct names: NFKC, singular words, single spaces.

    ASCII names stay in the JVM; only others go through Python.
    """
    distinct = names.select("name").distinct()
    plain = F.col("name").rlike(r"^[\x00-\x7F]*$")
    return distinct.where(plain).select("name", ascii_form(F.col("name")).alias("norm")).unionByName(distinct.where(~plain).select("name", _normal_form("name").alias("norm")))


def collapse(names: DataFrame) -> DataFrame:
    """(graph_id, name, norm, chosen): of names with one normal form the least is chosen."""
    forms = names.select("graph_id", "name").distinct().join(normal_forms(names), "name")
    chosen = forms.groupBy("graph_id", "norm").agg(F.min("name").alias("chosen"))
    return forms.join(chosen, ["graph_id", "norm"]).select("graph_id", "name", "norm", "chosen")


def independent_set(nodes: DataFrame, links: DataFrame, cliques: DataFrame | None = None) -> DataFrame:
    """(node, keeper): what going through the nodes in order keeps, if a kept node drops its later neighbours; those are given to their least kept one.

    ``links`` (a, b) may stand in either order; all nodes of a clique (clique, node) are neighbours,
    without a row for each pair. Components of TASK_LINKS rows at most are gone through in order, many
    in a task, so a long chain takes no rounds. Larger ones shrink in rounds: a node is kept if
    it is the least undecided one of all its links and cliques, and drops the others there.
    """
    pairs = shared_table(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low <> high").distinct(), "similar")
    both = pairs.unionByName(pairs.select(F.col("high").alias("low"), F.col("low").alias("high")))
    member = nodes.select(F.lit(None).cast("string").alias("clique"), "node").where("false") if cliques is None else cliques.select("clique", "node").distinct()
    member = shared_table(member, "cliques")

    def neighbours(kept: DataFrame) -> DataFrame:
        """(node, keeper): neighbours of kept nodes, and each of those that a clique with one has; a clique keeps one at most."""
        of = member.join(kept, "node", "left_semi").groupBy("clique").agg(F.min("node").alias("keeper"))
        near = both.join(kept.withColumnRenamed("node", "low"), "low", "left_semi").select(F.col("high").alias("node"), F.col("low").alias("keeper"))
        return near.unionByName(member.join(of, "clique").where(F.col("node") != F.col("keeper")).select("node", "keeper"))

    linked = both.select(F.col("low").alias("node")).unionByName(member.select("node")).distinct()
    kept, undecided = None, shared_table(linked, "undecided")
    while not undecided.isEmpty():
        open_pairs, open_members = shared_table(_among(pairs, undecided), "open-pairs"), shared_table(member.join(undecided, "node", "left_semi"), "open-cliques")
        least = open_members.groupBy("clique").agg(F.min("node").alias("least"))
        stars = open_members.join(least, "clique").select(F.col("least").alias("a"), F.col("node").alias("b"))
        placed = components(open_pairs.select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(stars))
        rows = open_pairs.join(placed, open_pairs["low"] == placed["node"]).select("root", F.col("low").alias("a"), F.col("high").alias("b"), F.lit(None).cast(dict(member.dtypes)["clique"]).alias("clique"))
        rows = rows.unionByName(open_members.join(placed, "node").select("root", F.col("node").alias("a"), F.col("node").alias("b"), "clique"))
        rows = shared_table(rows, "by-component")
        sizes = shared_table(rows.groupBy("root").agg(F.count("*").alias("n")), "sizes")
        small = sizes.where(F.col("n") <= TASK_LINKS)
        total = small.agg(F.sum("n")).first()[0] or 0
        dealt = rows.join(small.select("root"), "root").withColumn("task", F.pmod(F.xxhash64("root"), F.lit(max(1, -(-total // TASK_LINKS)))))
        done = dealt.select("task", "a", "b", "clique").groupBy("task").applyInArrow(_in_order, f"node {dict(pairs.dtypes)['low']}")
        large = placed.join(small, "root", "left_anti").select("node")
        alone = undecided.join(placed.select("node"), "node", "left_anti")  # nothing undecided is left beside them
        fresh = [done, alone]
        left = shared_table(large, "undecided")
        for _ in range(ROUNDS if not left.isEmpty() else 0):
            lows = member.join(left, "node", "left_semi").groupBy("clique").agg(F.min("node").alias("least"))
            behind = member.join(left, "node", "left_semi").join(lows, "clique").where(F.col("node") != F.col("least")).select("node")
            behind = behind.unionByName(_among(pairs, left).select(F.col("high").alias("node")))
            first = shared_table(left.join(behind.distinct(), "node", "left_anti"), "kept")
            fresh.append(first)
            left = shared_table(left.join(first, "node", "left_anti").join(neighbours(first).select("node").distinct(), "node", "left_anti"), "undecided")
        new = fresh[0]
        for more in fresh[1:]:
            new = new.unionByName(more)
        new = shared_table(new, "kept")
        kept = new if kept is None else kept.unionByName(new)
        undecided = left
    every = nodes.select("node").distinct()
    if kept is None:
        return every.select("node", F.col("node").alias("keeper"))
    dropped = neighbours(kept).groupBy("node").agg(F.min("keeper").alias("keeper")).join(kept, "node", "left_anti")
    return every.join(dropped, "node", "left_anti").select("node", F.col("node").alias("keeper")).unionByName(dropped)


#: Links and memberships that a task goes through in order, about; rounds between two looks at the components that are left.
TASK_LINKS, ROUNDS = 20_000, 4


def _among(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.join(nodes.withColumnRenamed("node", "low"), "low", "left_semi").join(nodes.withColumnRenamed("node", "high"), "high", "left_semi").select("low", "high")


def _in_order(table: pa.Table) -> pa.Table:
    """The nodes that are kept, of whole components: rows (a, b) are links, rows with a clique memberships of a."""
    key = lambda x: tuple((v is not None, v) for v in x.values()) if isinstance(x, dict) else x
    a, b, clique = (table.column(c).to_pylist() for c in ("a", "b", "clique"))
    values, near, cliques, members = {}, {}, {}, {}
    for x, y, c in zip(a, b, clique):
        i, j = key(x), key(y)
        values[i], values[j] = x, y
        if c is None:
            near.setdefault(i, []).append(j)
            near.setdefault(j, []).append(i)
        else:
            cliques.setdefault(i, []).append(key(c))
            members.setdefault(key(c), []).append(i)
    kept, gone = [], set()
    for i in sorted(values):
        if i in gone:
            continue
        kept.append(values[i])
        gone.update(near.get(i, ()))
        for c in cliques.get(i, ()):
            gone.update(members.pop(c, ()))
    return pa.table({"node": pa.array(kept, table.schema.field("a").type)})


def _bands(threshold: float, rows: int) -> tuple[int, int]:
    """Bits of a band and bands: a pair at the threshold is missed with a chance of MISSED, and unlike pairs seldom meet."""
    agree = 1 - float(np.arccos(min(max(threshold, -1.0), 1.0))) / np.pi
    bits = min(24, max(4, int(np.log2(max(rows, 2))) - 2))
    if agree > 0.5 and agree**bits > 0.5:  # a high threshold: as many bits as half of the pairs at it share
        bits = min(MOST_BITS, int(np.log(0.5) / np.log(agree))) if agree < 1 else MOST_BITS
    while bits > 1 and np.log(MISSED) / np.log1p(-(agree**bits)) > MOST_BANDS:
        bits -= 1
    return bits, max(1, int(np.ceil(np.log(MISSED) / np.log1p(-(agree**bits) + 1e-15))))


MISSED, MOST_BANDS, MOST_BITS = 1e-9, 192, 192
#: Names in a bucket beyond which they are held against its least name first.
CROWD = 32
#: Longs of a sketch: the signs of 64 more hyperplanes each.
SKETCH = 4


def _most_apart(angle: float) -> int:
    """Signs of a sketch in which two vectors of at most this angle differ, but for a chance of MISSED."""
    n, p = 64 * SKETCH, min(max(angle / np.pi, 1e-12), 1.0)
    if p >= 1:
        return n
    chance = [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(n + 1)]
    return next((k for k in range(n) if sum(chance[k + 1 :]) <= MISSED), n)


def similar_links(vectors: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) and cliques (clique, node) of vectors (node, embedding): two nodes of a cosine similarity of at least ``threshold`` are a pair or share a clique.

    Candidates share a band of random hyperplanes' signs: at the threshold itself a pair is missed
    with a chance of MISSED, above it with less. In a bucket of more than CROWD names each is first compared
    with the least one. Those within half of the threshold's angle of the same name are all alike:
    they are its clique, a row each, and no pairs among them are made. Candidates of different
    cliques, or of none, are compared in full, a pair once, if a sketch of more signs doesn't tell them
    apart already (for cliques that of their least name, at an angle wider by what their members may be off it): unlike
    names that share a bucket are never met with their vectors. Two like names are taken for unlike by their
    sketches with a chance of MISSED at most. So a group of m nearly equal vectors takes
    rows in proportion to m; vectors that are like one another, but spread wider than that, meet pair by pair.
    Vectors that are equal to a bit meet as one: the others of them are paired with their least node.
    """
    distinct = vectors.groupBy("embedding").agg(F.min("node").alias("node"))
    size = norm(F.col("embedding"))
    unit = distinct.withColumn("_size", size).where("_size > 0").select("node", F.transform("embedding", lambda x: x.cast("double") / F.col("_size")).alias("u"))
    unit = shared_table(unit, "units")
    bits, bands = _bands(threshold, unit.count())
    kind = dict(unit.dtypes)["node"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        more: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        if bits > 62:  # a digest of the bits
            powers = np.random.default_rng(bits).integers(-(1 << 63), (1 << 63) - 1, bits, np.int64)
        for batch in batches:
            parts: list[np.ndarray] = []
            sketched: list[np.ndarray] = []
            for row in batch.column("u").to_pylist():
                if len(row) not in planes:
                    planes[len(row)] = np.random.default_rng(len(row)).normal(size=(len(row), bands * bits))
                    more[len(row)] = np.random.default_rng([len(row), SKETCH]).normal(size=(len(row), 64 * SKETCH))
                parts.append((np.array(row) @ planes[len(row)] > 0).reshape(bands, bits) @ powers)
                sketched.append(np.packbits(np.array(row) @ more[len(row)] > 0).view(np.int64))
            lists = [pa.array([x.tolist() for x in own], pa.list_(pa.int64())) for own in (parts, sketched)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *lists], names=["node", "bands", "sketch"])

    sketches = [f"s{i}" for i in range(SKETCH)]
    signed = unit.mapInArrow(sign, f"node {kind}, bands array<long>, sketch array<long>")
    signed = shared_table(signed.select("node", "bands", *[F.get("sketch", F.lit(i)).alias(c) for i, c in enumerate(sketches)]), "signed")
    rows = signed.select("node", F.posexplode("bands").alias("band", "bucket"))
    left, right = (unit.select(F.col("node").alias(n), F.col("u").alias(f"_u{n}")) for n in "ab")
    cosine = dot(F.col("_ua"), F.col("_ub"))
    # buckets with many names: who is near their least one
    crowds = shared_table(rows.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("node").alias("a")).where(F.col("n") > CROWD), "crowds")
    asked = rows.join(crowds, ["band", "bucket"]).select("a", F.col("node").alias("b")).distinct()
    angle = float(np.arccos(min(max(threshold, -1.0), 1.0)))
    half = float(np.cos(angle / 2)) + 1e-9
    homes = asked.join(left, "a").join(right, "b").where(cosine >= half).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("clique"))
    homes = shared_table(homes, "homes")
    # cliques and names of none that share a bucket, as far as sketches allow for like names
    housed = shared_table(signed.join(homes, "node", "left").withColumn("home", F.coalesce("clique", "node")), "housed")
    centre = signed.select(F.col("node").alias("home"), *[F.col(c).alias(f"h{c}") for c in sketches])
    placed = housed.where("clique is not null").select("home", "bands").join(centre, "home").withColumn("wide", F.lit(1))
    alone = housed.where("clique is null").select("home", "bands", *[F.col(c).alias(f"h{c}") for c in sketches]).withColumn("wide", F.lit(0))
    known = placed.unionByName(alone).select("home", *[f"h{c}" for c in sketches], "wide", F.posexplode("bands").alias("band", "bucket")).distinct()
    known = shared_table(known, "known")
    x, y = (known.select("band", "bucket", F.col("home").alias(f"home_{n}"), F.col("wide").alias(f"wide_{n}"), *[F.col(f"h{c}").alias(f"{c}_{n}") for c in sketches]) for n in "ab")
    apart = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in sketches)
    cut = F.get(F.array(*[F.lit(_most_apart(angle * (1 + w / 2))) for w in range(3)]), F.col("wide_a") + F.col("wide_b"))
    met = x.join(y, ["band", "bucket"]).where((F.col("home_a") < F.col("home_b")) & (apart <= cut)).select("band", "bucket", "home_a", "home_b")
    met = shared_table(met, "met")
    # their members in that bucket
    open_homes = met.select(F.col("home_a").alias("home")).unionByName(met.select(F.col("home_b").alias("home"))).distinct()
    members = housed.join(open_homes, "home", "left_semi").select("node", "home", *sketches, F.posexplode("bands").alias("band", "bucket"))
    x, y = (members.select("band", "bucket", F.col("home").alias(f"home_{n}"), F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in sketches]) for n in "ab")
    pairs = met.join(x, ["band", "bucket", "home_a"]).join(y, ["band", "bucket", "home_b"]).where(apart <= _most_apart(angle))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    good = pairs.join(left, "a").join(right, "b").where(cosine >= threshold).select("a", "b")
    copies = vectors.join(distinct.select("embedding", F.col("node").alias("a")), "embedding").where("node <> a").select("a", F.col("node").alias("b"), "embedding")
    return good.unionByName(copies.where(norm(F.col("embedding")) > 0).select("a", "b")), homes.select("clique", "node")


def similar_pairs(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs (a, b) of vectors (node, embedding) of cosine similarity at least ``threshold``, those of a clique written out; for tables without large groups."""
    pairs, cliques = similar_links(vectors, threshold)
    inside = cliques.alias("x").join(cliques.alias("y"), "clique").where("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return pairs.unionByName(inside).distinct()


def semantic(names: DataFrame, embed: Callable[[DataFrame], DataFrame], threshold: float = 0.95) -> DataFrame:
    """(graph_id, name, norm, chosen) after spelling and similarity: normal forms in order, each
    dropping later ones that are as similar; ``embed`` turns (node) into (node, embedding)."""
    spelled = collapse(names)
    forms = shared_table(spelled.select("graph_id", "norm").distinct(), "forms")
    vectors = shared_table(embed(forms.select(F.col("norm").alias("node")).distinct()), "vectors")
    first = vectors.groupBy("embedding").agg(F.min("node").alias("first"))
    of = vectors.join(first, "embedding").where(norm(F.col("embedding")) > 0).select(F.col("node").alias("norm"), F.col("first").alias("same"))
    # within a graph equal vectors share the fate of the least of them there
    keyed = lambda c: F.struct("graph_id", F.col(c).alias("n"))
    local = forms.join(of, "norm", "left").select("graph_id", "norm", F.coalesce("same", "norm").alias("same"))
    least = local.groupBy("graph_id", "same").agg(F.min("norm").alias("low"))
    links, cliques = similar_links(vectors.join(first.select(F.col("first").alias("node")), "node", "left_semi"), threshold)
    ends = [least.select("graph_id", F.col("same").alias(c), F.col("low").alias(f"_{c}")) for c in "ab"]
    near = links.join(ends[0], "a").join(ends[1], ["b", "graph_id"]).select("graph_id", "_a", "_b")
    alike = cliques.join(ends[0], F.col("node") == F.col("a")).select(keyed("clique").alias("clique"), keyed("_a").alias("node"))
    kept = independent_set(least.select(keyed("low").alias("node")), near.select(keyed("_a").alias("a"), keyed("_b").alias("b")), alike)
    kept = kept.select(F.col("node.graph_id").alias("graph_id"), F.col("node.n").alias("low"), F.col("keeper.n").alias("keeper"))
    placed = local.join(least, ["graph_id", "same"]).join(kept, ["graph_id", "low"]).select("graph_id", "norm", "keeper")
    chosen = spelled.select("graph_id", F.col("norm").alias("keeper"), F.col("chosen").alias("_c")).distinct()
    return spelled.join(placed, ["graph_id", "norm"]).join(chosen, ["graph_id", "keeper"]).select("graph_id", "name", "norm", F.col("_c").alias("chosen"))


def rewrite(triples: DataFrame, entities: DataFrame, predicates: DataFrame) -> DataFrame:
    """Distinct triples with names replaced by ``chosen``; names that aren't mapped stay."""
    out = triples
    for column, mapping in (("s", entities), ("p", predicates), ("o", entities)):
        of = mapping.select("graph_id", F.col("name").alias(column), F.col("chosen").alias("_to"))
        out = out.join(of, ["graph_id", column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
    return out.select("graph_id", "s", "p", "o").distinct()


def statistics(mapping: DataFrame) -> DataFrame:
    """Names, kept names, duplicates and reduction in percent of each graph."""
    out = mapping.groupBy("graph_id").agg(F.count("*").alias("total"), F.count_distinct("chosen").alias("kept"))
    out = out.withColumn("duplicates", F.col("total") - F.col("kept"))
    return out.withColumn("reduction", F.round(F.when(F.col("total") > 0, 100.0 * F.col("duplicates") / F.col("total")).otherwise(F.lit(0.0)), 1))


METHODS = ("semhash", "lm_based", "full")


def cluster(graph: KGFrames, **options) -> KGFrames:
    """The graph de-duplicated, under the name that builders of graphs use."""
    return deduplicate(graph, **options)


def deduplicate(graph: KGFrames, method: str = "full", embed=None, backend=None, threshold: float = 0.95) -> KGFrames:
    """The graph without duplicate names. Methods but the first need an embedder and a backend."""
    from graphloom.operators.cluster import lm_deduplicate

    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if embed is None or method != "semhash" and backend is None:
        raise ValueError("this method needs an embedder and, but for semhash, a backend")
    if method in ("semhash", "full"):
        entities, predicates = semantic(graph.entities, embed, threshold), semantic(graph.predicates, embed, threshold)
        chosen = lambda m: m.select("graph_id", F.col("chosen").alias("name")).distinct()
        graph = KGFrames(chosen(entities), chosen(predicates), rewrite(graph.triples, entities, predicates))
    return lm_deduplicate(graph, embed, backend) if method in ("lm_based", "full") else graph


def first_match(clusters: DataFrame) -> DataFrame:
    """(graph_id, name, chosen) from (graph_id, ord, rep, member): each member's first cluster; representatives stay."""
    reps = clusters.select("graph_id", F.col("rep").alias("member")).distinct()
    of = clusters.groupBy("graph_id", "member").agg(F.min_by("rep", F.struct("ord", "rep")).alias("chosen"))
    return of.join(reps, ["graph_id", "member"], "left_anti").select("graph_id", F.col("member").alias("name"), "chosen")


def rank_by(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(*order)))
