"""Degrees, rankings, statistics and the views a dashboard shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import with_color
from graphloom.operators.components import components
from graphloom.operators.graph import endpoints, ranked
from graphloom.schema import KGFrames

DEFAULT_COLOR = "#64748b"


def degrees(triples: DataFrame) -> DataFrame:
    """(graph_id, name, degree, in_degree, out_degree), counted by triple: a loop adds two to the degree."""
    ends = triples.select("graph_id", F.explode(F.array(F.struct(F.col("s").alias("name"), F.lit(1).alias("out")), F.struct(F.col("o").alias("name"), F.lit(0).alias("out")))).alias("e")).select("graph_id", "e.*")
    return ends.groupBy("graph_id", "name").agg(F.count("*").alias("degree"), F.sum(1 - F.col("out")).alias("in_degree"), F.sum("out").alias("out_degree"))


def all_degrees(graph: KGFrames) -> DataFrame:
    """Degrees of all entities and ends, zeros included: ends and entities are summed up in one pass."""
    name, ends = F.col("name"), lambda end, out: F.struct(F.col(end).alias("name"), F.lit(out).alias("out"), F.lit(1 - out).alias("into"))
    both = graph.triples.select("graph_id", F.explode(F.array(ends("s", 1), ends("o", 0))).alias("e")).select("graph_id", "e.*")
    listed = graph.entities.select("graph_id", name, F.lit(0).alias("out"), F.lit(0).alias("into"))
    sums = both.unionByName(listed).groupBy("graph_id", "name").agg(F.sum("into").alias("in_degree"), F.sum("out").alias("out_degree"))
    return sums.select("graph_id", "name", (F.col("in_degree") + F.col("out_degree")).alias("degree"), "in_degree", "out_degree")


def top(rows: DataFrame, value: str, name: str, k: int = 10) -> DataFrame:
    """The k rows of each graph with the highest value, then by lower-cased name, then by name."""
    order = Window.partitionBy("graph_id").orderBy(F.desc(value), F.lower(name), name)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_entities(graph: KGFrames, k: int = 10) -> DataFrame:
    return top(all_degrees(graph).select("graph_id", "name", "degree"), "degree", "name", k)


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("graph_id", F.col("p").alias("name")).agg(F.count("*").alias("n"))


def top_relations(graph: KGFrames, k: int = 10) -> DataFrame:
    return top(predicate_counts(graph.triples), "n", "name", k)


def isolated(graph: KGFrames) -> DataFrame:
    """Entities that no triple touches."""
    return graph.entities.join(endpoints(graph.triples).distinct(), ["graph_id", "name"], "left_anti")


def graph_components(graph: KGFrames) -> DataFrame:
    """(graph_id, name, component): the component's least name; lone entities are their own."""
    key = lambda c: F.struct(F.col("graph_id").alias("g"), F.col(c).alias("n"))
    found = components(graph.triples.select(key("s").alias("a"), key("o").alias("b")))
    found = found.select(F.col("node.g").alias("graph_id"), F.col("node.n").alias("name"), F.col("root.n").alias("_root"))
    names = graph.entities.unionByName(endpoints(graph.triples)).distinct()
    return names.join(found, ["graph_id", "name"], "left").select("graph_id", "name", F.coalesce("_root", "name").alias("component"))


def component_sizes(graph: KGFrames) -> DataFrame:
    """Components by size, then by first member."""
    sizes = graph_components(graph).groupBy("graph_id", "component").agg(F.count("*").alias("size"))
    return ranked(sizes, "graph_id", [-F.col("size"), F.col("component")]).withColumn("rank", (F.col("rank") + 1).cast("int"))


def statistics(graph: KGFrames) -> DataFrame:
    """Counts, average degree (2 digits) and density (3 digits) of each graph."""
    names = all_degrees(graph).groupBy("graph_id").agg(F.count("*").alias("entities"), F.count_if(F.col("degree") == 0).alias("isolated"), (F.sum("degree") / 2).cast("long").alias("relations"))
    kinds = graph.triples.select("graph_id", "p").distinct().groupBy("graph_id").agg(F.count("*").alias("predicates"))
    out = names.join(kinds, "graph_id", "left").na.fill(0, ["predicates"])
    n, m = F.col("entities"), F.col("relations")
    average = F.when(n > 0, F.round(2.0 * m / n, 2)).otherwise(F.lit(0.0))
    density = F.when(n > 1, F.round(m.cast("double") / (n * (n - 1)), 3)).otherwise(F.lit(0.0))
    return out.select("graph_id", "entities", "relations", "predicates", "isolated", average.alias("average_degree"), density.alias("density"))


def full_statistics(graph: KGFrames) -> DataFrame:
    """``statistics`` with the numbers of components and of clusters of both kinds."""
    out = statistics(graph).join(graph_components(graph).groupBy("graph_id").agg(F.count_distinct("component").alias("components")), "graph_id", "left")
    for name, clusters in (("entity_clusters", graph.entity_clusters), ("edge_clusters", graph.predicate_clusters)):
        if clusters is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
        else:
            out = out.join(clusters.groupBy("graph_id").agg(F.count_distinct("rep").alias(name)), "graph_id", "left")
    return out.na.fill(0, ["components", "entity_clusters", "edge_clusters"])


def edge_ids(triples: DataFrame) -> DataFrame:
    """Triples numbered in order of lower-cased p, s, o: e0, e1, ..."""
    order = [F.lower("p"), F.lower("s"), F.lower("o"), F.col("p"), F.col("s"), F.col("o")]
    return ranked(triples, "graph_id", order).select("graph_id", "s", "p", "o", F.concat(F.lit("e"), "rank").alias("id"))


def cluster_of(clusters: DataFrame) -> DataFrame:
    """(graph_id, member, rep): members belong to the last cluster by name; a rep is a member of its own."""
    both = clusters.select("graph_id", "rep", "member").unionByName(clusters.select("graph_id", "rep", F.col("rep").alias("member")))
    return both.groupBy("graph_id", "member").agg(F.max("rep").alias("rep"))


def cluster_view(clusters: DataFrame, kind: str = "entity") -> DataFrame:
    """(graph_id, id, members, size, color): members sorted without case."""
    both = clusters.select("graph_id", "rep", "member").unionByName(clusters.select("graph_id", "rep", F.col("rep").alias("member")))
    members = F.transform(F.array_sort(F.collect_set(F.struct(F.lower("member").alias("l"), F.col("member").alias("m")))), lambda x: x["m"])
    out = both.groupBy("graph_id", F.col("rep").alias("id")).agg(members.alias("members")).select("graph_id", "id", "members", F.size("members").alias("size"))
    return with_color(out, F.concat(F.lit(f"{kind}::"), "id"))


def edge_view(graph: KGFrames) -> DataFrame:
    """Edges with id, source, target, predicate, cluster, color and tooltip."""
    edges = edge_ids(graph.triples)
    if graph.predicate_clusters is not None:
        of = cluster_of(graph.predicate_clusters).select(F.col("graph_id"), F.col("member").alias("p"), F.col("rep").alias("cluster"))
        edges = edges.join(of, ["graph_id", "p"], "left")
    else:
        edges = edges.withColumn("cluster", F.lit(None).cast("string"))
    key = F.coalesce(F.concat(F.lit("edge::"), "cluster"), F.concat(F.lit("predicate::"), "p"))
    tooltip = F.concat("s", F.lit(" —"), "p", F.lit("→ "), "o").alias("tooltip")
    return with_color(edges, key).select("graph_id", "id", F.col("s").alias("source"), F.col("o").alias("target"), F.col("p").alias("predicate"), "cluster", "color", tooltip)


def relation_records(graph: KGFrames) -> DataFrame:
    return edge_view(graph).select("graph_id", "source", "predicate", "target", F.col("id").alias("edge_id"), "color")


def _without_case(name: str) -> Column:
    """The distinct names of a group, sorted without case, those alike by code point; nulls are left out."""
    keyed = F.when(F.col(name).isNotNull(), F.struct(F.lower(name).alias("l"), F.col(name).alias("m")))
    return F.transform(F.array_sort(F.collect_set(keyed)), lambda x: x["m"])


def neighbors(triples: DataFrame) -> DataFrame:
    """(graph_id, name, neighbors): distinct, of both directions, sorted without case."""
    both = triples.select("graph_id", F.explode(F.array(F.struct(F.col("s").alias("name"), F.col("o").alias("n")), F.struct(F.col("o").alias("name"), F.col("s").alias("n")))).alias("e")).select("graph_id", "e.*")
    return both.groupBy("graph_id", "name").agg(_without_case("n").alias("neighbors"))


def node_view(graph: KGFrames) -> DataFrame:
    """Nodes with cluster, color, degrees, radius, neighbors and the ids of their edges.

    One pass over the ends of all edges gives a node's lists and degrees. A node's lists are one row:
    a dashboard shows them so.
    """
    edges = edge_ids(graph.triples).select("graph_id", "s", "o", F.substring("id", 2, 20).cast("long").alias("n"))
    end = lambda own, other, out: F.struct(F.col(own).alias("name"), F.col(other).alias("x"), F.lit(out).alias("out"))
    ends = edges.select("graph_id", "n", F.explode(F.array(end("s", "o", True), end("o", "s", False))).alias("e")).select("graph_id", "n", "e.*")
    listed = graph.entities.select("graph_id", F.lit(None).cast("long").alias("n"), "name", F.lit(None).cast("string").alias("x"), F.lit(None).cast("boolean").alias("out"))
    ids = lambda which: F.transform(F.sort_array(F.collect_list(F.when(which, F.col("n")))), lambda n: F.concat(F.lit("e"), n))
    nodes = ends.unionByName(listed).groupBy("graph_id", "name").agg(
        F.count("n").alias("degree"), F.count_if(~F.col("out")).alias("in_degree"), F.count_if("out").alias("out_degree"),
        _without_case("x").alias("neighbors"), ids(~F.col("out")).alias("incoming"), ids(F.col("out")).alias("outgoing"),
    )
    if graph.entity_clusters is not None:
        of = with_color(cluster_of(graph.entity_clusters), F.concat(F.lit("entity::"), "rep"))
        of = of.select("graph_id", F.col("member").alias("name"), F.col("rep").alias("cluster"), "color")
        nodes = nodes.join(of, ["graph_id", "name"], "left").withColumn("color", F.coalesce("color", F.lit(DEFAULT_COLOR)))
    else:
        nodes = with_color(nodes.withColumn("cluster", F.lit(None).cast("string")), F.concat(F.lit("entity::"), "name"))
    return nodes.select(
        "graph_id", "name", "cluster", "color", "degree", "in_degree", "out_degree", F.coalesce(F.col("cluster") == F.col("name"), F.lit(False)).alias("is_representative"),
        (18 + 2 * F.least("degree", F.lit(8))).alias("radius"), "neighbors", "incoming", "outgoing",
    )
