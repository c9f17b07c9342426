"""Writing graphs and results: JSON lines, Parquet, property-graph tables and a dashboard."""

from __future__ import annotations

import html
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import relationship_type
from graphloom.operators import analytics
from graphloom.operators.graph import endpoints
from graphloom.schema import KGFrames
from graphloom.sources.json_arrays import write_array
from graphloom.sources.property_graph import KEYS
from graphloom.sources.snapshots import Snapshots


def graph_documents(graph: KGFrames) -> DataFrame:
    """A row for each graph: graph_id and its JSON document, with all that the graph holds.

    ``unnest`` of the documents gives the graph again.
    """
    lists = lambda rows, value, name: rows.groupBy("graph_id").agg(F.sort_array(F.collect_set(value)).alias(name))
    names = graph.entities.select("graph_id", "name").unionByName(endpoints(graph.triples).select("graph_id", "name"))
    kinds = graph.predicates.select("graph_id", "name").unionByName(graph.triples.select("graph_id", F.col("p").alias("name")))
    whole = lists(names, "name", "entities").join(lists(kinds, "name", "edges"), "graph_id", "full")
    whole = whole.join(lists(graph.triples, F.array("s", "p", "o"), "relations"), "graph_id", "full")
    for clusters, name in ((graph.entity_clusters, "entity_clusters"), (graph.predicate_clusters, "edge_clusters")):
        if clusters is not None:
            groups = clusters.groupBy("graph_id", "rep").agg(F.sort_array(F.collect_set("member")).alias("members"))
            of = groups.groupBy("graph_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rep", "members")))).alias(name))
            whole = whole.join(of, "graph_id", "left")
    none = {"entities": "array<string>", "edges": "array<string>", "relations": "array<array<string>>"}
    filled = [F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in none.items()]
    return whole.select("graph_id", F.to_json(F.struct(*filled, *[c for c in whole.columns if c.endswith("_clusters")])).alias("json"))


def write_graphs(graph: KGFrames, path: str) -> None:
    """Writes all graphs with their ids, as JSON arrays that ``json_records.graph_array`` reads; a graph is one element."""
    named = F.to_json(F.struct("graph_id"), {"ignoreNullFields": "false"})
    head = F.concat(F.substring(named, 1, F.length(named) - 1), F.lit(","))
    write_array(graph_documents(graph).select(F.concat(head, F.substring("json", 2, 2**31 - 1)).alias("value")), path)


def write_json(graph: KGFrames, path: str) -> None:
    graph_documents(graph).select("json").write.mode("overwrite").text(path)


def property_nodes(graph: KGFrames) -> DataFrame:
    """(name, graph_name): one node for each name, whatever graphs it is in; the least graph names it."""
    names = graph.entities.unionByName(endpoints(graph.triples))
    return names.groupBy("name").agg(F.min("graph_id").alias("graph_name"))


def property_relationships(graph: KGFrames) -> DataFrame:
    """(s, rel_type, o, predicate): predicates of one type between the same nodes are one; the greatest names it."""
    nodes = graph.entities.select("name").distinct()
    known = graph.triples
    for end in ("s", "o"):
        known = known.join(nodes.withColumnRenamed("name", end), end, "left_semi")
    return known.groupBy("s", relationship_type(F.col("p")).alias("rel_type"), "o").agg(F.max("p").alias("predicate"))


def property_stats(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: nodes, relationships and kinds of relationships."""
    n = nodes.agg(F.count_distinct("name").alias("nodes"))
    return n.join(relationships.agg(F.count("*").alias("relationships"), F.count_distinct("rel_type").alias("types")))


@dataclass(frozen=True)
class PropertyGraphSink:
    """Node and edge tables under a path; writing the same graph again changes nothing that a reader sees.

    Both tables change at once: an upload is a new version (``snapshots``), and one that is killed
    leaves the store as it was. Only hash buckets that the graph's rows fall in are rewritten.
    """

    path: str
    clear: bool = False
    buckets: int = 64

    def upload(self, graph: KGFrames) -> tuple[int, int]:
        """Numbers of nodes and relationships that the store then holds."""
        nodes, edges = property_nodes(graph), property_relationships(graph)
        held = self.store(nodes.sparkSession).merge({"nodes": nodes, "relationships": edges}, self.clear)
        return held["nodes"], held["relationships"]

    def store(self, spark: SparkSession) -> Snapshots:
        return Snapshots(spark, self.path, KEYS, self.buckets)


def connection(uri: str, user: str, password: str, database: str | None = None) -> dict[str, str]:
    """Options of a connection to a property-graph store."""
    out = {"url": uri, "authentication.basic.username": user, "authentication.basic.password": password}
    return out | ({"database": database} if database else {})


def local_connection(user: str, password: str, host: str = "localhost", port: int = 7687) -> dict[str, str]:
    """Options of a connection to a store on this or another machine, over the store's own protocol."""
    return connection(f"bolt://{host}:{port}", user, password)


def view_model(graph: KGFrames) -> dict[str, DataFrame]:
    """What a dashboard shows, a table for each part."""
    out = {
        "nodes": analytics.node_view(graph), "edges": analytics.edge_view(graph), "relations": analytics.relation_records(graph),
        "topEntities": analytics.top_entities(graph), "topRelations": analytics.top_relations(graph), "stats": analytics.full_statistics(graph),
        "isolatedEntities": analytics.isolated(graph), "components": analytics.component_sizes(graph),
    }
    if graph.entity_clusters is not None:
        out["clusters"] = analytics.cluster_view(graph.entity_clusters, "entity")
    if graph.predicate_clusters is not None:
        out["edgeClusters"] = analytics.cluster_view(graph.predicate_clusters, "edge")
    return out


PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif}}table{{border-collapse:collapse;margin:1em 0}}td,th{{border:1px solid #ccc;padding:2px 6px}}i{{display:inline-block;width:1em;height:1em}}</style>
<h1>{title}</h1><main></main><script>const view={data};
for(const [name,rows] of Object.entries(view)){{if(!rows.length)continue;const t=document.createElement("table"),keys=Object.keys(rows[0]);
t.createCaption().textContent=name+" ("+rows.length+")";const head=t.createTHead().insertRow();keys.forEach(k=>head.insertCell().textContent=k);
const body=t.createTBody();rows.forEach(r=>{{const row=body.insertRow();keys.forEach(k=>{{const c=row.insertCell();
if(k=="color"){{const i=document.createElement("i");i.style.background=r[k];c.append(i)}}c.append(String(r[k]??""))}})}});document.querySelector("main").append(t)}}
</script>"""


def dashboard(graph: KGFrames, title: str = "graph", most_rows: int = 5000, path: str | None = None) -> str:
    """An HTML page that shows a small graph's nodes, edges, clusters and rankings; with a path it is
    written there too. A graph of more than ``most_rows`` rows in a part, or without entities, is an
    error: larger graphs are written as view-model tables."""
    parts = {}
    for name, table in view_model(graph).items():
        rows = table.limit(most_rows + 1).toJSON().collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows")
        parts[name] = [json.loads(r) for r in rows]
    if not parts["nodes"]:
        raise ValueError("the graph has no entities")
    page = PAGE.format(title=html.escape(title), data=json.dumps(parts, ensure_ascii=False).replace("</", "<\\/"))
    if path is not None:
        context = graph.triples.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
        try:
            out.write(page.encode())
        finally:
            out.close()
    return page
