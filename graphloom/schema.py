"""Types of the interchange forms, and the long tables a set of graphs is held in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_names = T.ArrayType(T.StringType())
GRAPH = T.StructType([
    T.StructField("entities", _names),
    T.StructField("edges", _names),
    T.StructField("relations", T.ArrayType(_names)),
    T.StructField("entity_clusters", T.MapType(T.StringType(), _names)),
    T.StructField("edge_clusters", T.MapType(T.StringType(), _names)),
])
FACT = T.StructType([
    T.StructField("fact", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("relational_type", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("kg_entailment_score", T.IntegerType()),
    T.StructField("evaluation_status", T.StringType()),
    T.StructField("error", T.StringType()),
])
ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("extracted_kg", GRAPH),
    T.StructField("relational_facts", T.MapType(T.StringType(), T.ArrayType(FACT))),
])


@dataclass(frozen=True)
class KGFrames:
    """Graphs as long tables keyed by graph_id.

    entities (graph_id, name), predicates (graph_id, name), triples (graph_id, s, p, o), and
    clusters (graph_id, rep, member) of entities and of predicates, if there are any.
    """

    entities: DataFrame
    predicates: DataFrame
    triples: DataFrame
    entity_clusters: DataFrame | None = None
    predicate_clusters: DataFrame | None = None
