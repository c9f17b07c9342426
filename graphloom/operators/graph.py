"""Building, repairing, merging and converting graphs held as long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.schema import KGFrames
from graphloom.storage import bound_tasks, shared_table

TRIPLE = ["graph_id", "s", "p", "o"]


def endpoints(triples: DataFrame) -> DataFrame:
    """(graph_id, name) of every end of every triple, once for each end."""
    return triples.select("graph_id", F.explode(F.array("s", "o")).alias("name"))


def build(triples: DataFrame, entities: DataFrame | None = None) -> KGFrames:
    """A graph from triples and, if given, a list of entities; predicates come from the triples."""
    bound_tasks(triples.sparkSession)
    triples = triples.select(*TRIPLE).distinct()
    names = endpoints(triples) if entities is None else entities.select("graph_id", "name")
    return KGFrames(names.distinct(), triples.select("graph_id", F.col("p").alias("name")).distinct(), triples)


def missing_endpoints(graph: KGFrames) -> DataFrame:
    """Ends of triples that the list of entities lacks."""
    return endpoints(graph.triples).distinct().join(graph.entities, ["graph_id", "name"], "left_anti")


def repair(graph: KGFrames) -> KGFrames:
    """The graph with every end among the entities and every predicate among the predicates."""
    entities = graph.entities.unionByName(endpoints(graph.triples)).distinct()
    predicates = graph.predicates.unionByName(graph.triples.select("graph_id", F.col("p").alias("name"))).distinct()
    return KGFrames(entities, predicates, graph.triples, graph.entity_clusters, graph.predicate_clusters)


def aggregate(*graphs: KGFrames, graph_id: str = "all") -> KGFrames:
    """The union of graphs; clusters are dropped."""
    union = lambda parts: reduce(DataFrame.unionByName, parts).withColumn("graph_id", F.lit(graph_id)).distinct()
    return KGFrames(union([g.entities for g in graphs]), union([g.predicates for g in graphs]), union([g.triples for g in graphs]))


def digraph(triples: DataFrame) -> DataFrame:
    """(graph_id, src, dst, rel): one edge for each pair, of parallel predicates the greatest."""
    return triples.groupBy("graph_id", F.col("s").alias("src"), F.col("o").alias("dst")).agg(F.max("p").alias("rel"))


def counts(graph: KGFrames) -> DataFrame:
    """graph_id with the numbers of entities, predicates and triples."""
    parts = [t.groupBy("graph_id").agg(F.count("*").alias(n)) for t, n in ((graph.entities, "entities"), (graph.predicates, "predicates"), (graph.triples, "relations"))]
    out = reduce(lambda a, b: a.join(b, "graph_id", "full"), parts)
    return out.na.fill(0, ["entities", "predicates", "relations"])


def ranked(rows: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """The rows numbered from 0 within their group, in the given order.

    Rows are dealt in ranges of (group, order), so a group of most rows is many tasks: a range counts
    its rows of each group, and starts at what the ranges before it hold.
    """
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    places = [F.col(f"_o{i}") for i in range(len(order))]
    dealt = rows.select("*", *keys).repartitionByRange(F.col(group), *places).select("*", F.spark_partition_id().alias("_range"))
    dealt = shared_table(dealt, "ranges")
    sizes = dealt.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_g", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*places)) - 1
    met = dealt.withColumn("_own", own).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return met.select(*rows.columns, (F.col("_start") + F.col("_own")).alias(name))


def convert(positioned: DataFrame) -> DataFrame:
    """Distinct triples of each graph in the order in which they first stand: (graph_id, s, p, o, rank).

    ``positioned`` has graph_id, pos, s, p, o; parts are stripped.
    """
    clean = positioned.select("graph_id", "pos", *[strip(F.col(c)).alias(c) for c in "spo"])
    first = clean.groupBy(*TRIPLE).agg(F.min("pos").alias("pos"))
    return ranked(first, "graph_id", [F.col(c) for c in ("pos", "s", "p", "o")]).select(*TRIPLE, F.col("rank").cast("int").alias("rank"))


def nested(triples: DataFrame) -> DataFrame:
    """A row for each graph in the interchange form: sorted names, triples in order of s, p, o."""
    return triples.groupBy("graph_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("s", "o"))))).alias("entities"),
        F.sort_array(F.collect_set("p")).alias("edges"),
        F.sort_array(F.collect_set(F.array("s", "p", "o"))).alias("relations"),
    )


def unnest(graphs: DataFrame, repaired: bool = False) -> KGFrames:
    """Long tables from rows (graph_id, entities, edges, relations, and clusters if there are any)."""
    names = lambda c: graphs.select("graph_id", F.explode(c).alias("name")).distinct()
    triples = graphs.select("graph_id", F.explode("relations").alias("r")).select("graph_id", *[F.get("r", F.lit(i)).alias(c) for i, c in enumerate("spo")]).distinct()
    members = lambda c: graphs.select("graph_id", F.explode(c).alias("rep", "members")).select("graph_id", "rep", F.explode("members").alias("member")) if c in graphs.columns else None
    graph = KGFrames(names("entities"), names("edges"), triples, members("entity_clusters"), members("edge_clusters"))
    return repair(graph) if repaired else graph


def endpoint_filter(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples whose ends both are known entities."""
    bound_tasks(triples.sparkSession)
    known = entities.select("graph_id", "name").distinct()
    for end in ("s", "o"):
        triples = triples.join(known.withColumnRenamed("name", end), ["graph_id", end], "left_semi")
    return triples.select(*TRIPLE)


def novel_pairs(triples: DataFrame, prior: DataFrame) -> DataFrame:
    """Triples whose (s, o) the prior triples don't have."""
    return triples.join(prior.select("graph_id", "s", "o").distinct(), ["graph_id", "s", "o"], "left_anti").select(*TRIPLE)
