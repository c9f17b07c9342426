"""Graphs and facts derived from the tables, the same way in Spark and in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import backends
from graphloom.storage import bound_tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers located in nations, nations part of regions."""
    t = lambda n: table(spark, sf_dir, n)
    triple = lambda s, p, o: [s.alias("s"), F.lit(p).alias("p"), o.alias("o")]
    nation = t("nation")
    located = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(*triple(F.col("s_name"), "located in", F.col("n_name")))
    part_of = nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(*triple(F.col("n_name"), "part of", F.col("r_name")))
    return located.unionByName(part_of).select(F.lit("kg").alias("graph_id"), "s", "p", "o").distinct()


def kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, s, p, o) of suppliers, nations, regions, customers and parts."""
    bound_tasks(spark)
    t = lambda n: table(spark, sf_dir, n)
    triple = lambda s, p, o: [F.lit("kg").alias("graph_id"), s.alias("s"), F.lit(p).alias("p"), o.alias("o")]
    part = F.concat(F.lit("Part#"), F.col("p_partkey").cast("string"))
    based = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(*triple(F.col("c_name"), "based in", F.col("n_name")))
    brand = t("part").select(*triple(part, "has brand", F.col("p_brand")))
    kind = t("part").select(*triple(part, "has type", F.col("p_type")))
    pairs = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    supplies = pairs.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(*triple(F.col("s_name"), "supplies", F.concat(F.lit("Part#"), F.col("l_partkey").cast("string"))))
    return place(spark, sf_dir).unionByName(based).unionByName(brand).unionByName(kind).unionByName(supplies).distinct()


def activity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("Item#"), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.lit("activity").alias("graph_id"), F.concat(F.lit("User#"), F.col("user_id").cast("string")).alias("s"), F.col("event_type").alias("p"), item.alias("o"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, s, p, o) of what users do with items; pairs have parallel predicates."""
    return activity_rows(spark, sf_dir).select("graph_id", "s", "p", "o").distinct()


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of documents with labels, some scored."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("fact")).join(table(spark, sf_dir, "labels"), "doc_id")
    i = F.col("doc_id")
    level = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, "high").otherwise("medium")).otherwise(F.when(F.col("toxic") == 0, "low").otherwise("unknown"))
    status = F.when(i % 7 == 0, "service_error").when(i % 11 == 0, "error").otherwise("scored")
    return d.select(
        F.floor(i / 20).cast("string").alias("item_id"), level.alias("quality_level"), i.cast("int").alias("fact_pos"), "fact",
        F.get(F.array(*map(F.lit, ("easy", "medium", "hard", "unknown"))), (i % 4).cast("int")).alias("difficulty"),
        F.when(status == "scored", F.col("quality")).alias("score"), status.alias("status"),
    )


def node_vectors(spark: SparkSession, sf_dir: str, triples: DataFrame) -> DataFrame:
    """(graph_id, name, embedding): each name of the graph has the vector whose place is the name's, by code point, modulo the number of vectors."""
    from graphloom.operators.graph import endpoints, ranked

    numbered = ranked(endpoints(triples).distinct(), "graph_id", [F.col("name")])
    vectors = table(spark, sf_dir, "embeddings").select(F.lit("e").alias("e"), "vec_id", "embedding")
    vectors = ranked(vectors, "e", [F.col("vec_id")], "place").select("place", "embedding")
    size = vectors.agg(F.count("*").alias("size"))  # one row
    return numbered.join(F.broadcast(size)).join(vectors, F.col("rank") % F.col("size") == F.col("place")).select("graph_id", "name", "embedding")


PLACE = """place AS (SELECT s_name AS s, 'located in' AS p, n_name AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT n_name, 'part of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
KG = f"""{PLACE},
kg AS (SELECT * FROM place UNION SELECT c_name, 'based in', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'Part#' || p_partkey, 'has brand', p_brand FROM part UNION SELECT 'Part#' || p_partkey, 'has type', p_type FROM part
  UNION SELECT s_name, 'supplies', 'Part#' || l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey)"""
ACTIVITY = """act AS (SELECT DISTINCT 'User#' || user_id AS s, event_type AS p, 'Item#' || json_extract_string(props, '$.k') AS o FROM events)"""
FACTS = """facts AS (SELECT (doc_id // 20)::VARCHAR AS item_id, CASE WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN 'high' ELSE 'medium' END ELSE CASE WHEN toxic = 0 THEN 'low' ELSE 'unknown' END END AS quality_level,
  doc_id::INT AS fact_pos, text AS fact, ['easy', 'medium', 'hard', 'unknown'][(doc_id % 4)::INT + 1] AS difficulty,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN NULL ELSE quality END AS score,
  CASE WHEN doc_id % 7 = 0 THEN 'service_error' WHEN doc_id % 11 = 0 THEN 'error' ELSE 'scored' END AS status FROM documents JOIN labels USING (doc_id))"""
VECTORS = """names AS (SELECT s AS name FROM act UNION SELECT o FROM act),
vec AS (SELECT name, embedding FROM (SELECT name, (row_number() OVER (ORDER BY name) - 1) % (SELECT count(*) FROM embeddings) AS place FROM names) JOIN (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) USING (place))"""


class LinesBackend(backends.RuleBackend):
    """Typed relations fail for texts of an odd number of characters; lines hold one of unknown ends more."""

    def relations(self, text, entities):
        if len(text) % 2:
            raise ValueError("no relations")
        return super().relations(text, entities)

    def relation_lines(self, text, entities):
        return [" | ".join(t) for t in super().relations(text, entities)] + ["none of these | precedes | nor this"]


class GapsBackend(backends.RuleBackend):
    """Texts of 7, 14, ... characters never get an answer, of 3, 6, ... none the first time; facts of 3, 6, ... are an error."""

    def __init__(self):
        self.asked = {}

    def generate(self, system, prompts):
        of = (lambda p: p.partition("\nText: ")[2]) if system == backends.PromptBackend.RELATIONS else (lambda p: p)  # a text may hold such a line itself
        return [None if self._missing(p, len(of(p))) else answer for p, answer in zip(prompts, super().generate(system, prompts))]

    def _missing(self, prompt, size):
        key = hashlib.blake2b(prompt.encode("utf-8", "surrogatepass"), digest_size=16).digest()  # a digest each, of the last KEPT
        first = key not in self.asked
        self.asked[key] = None
        if len(self.asked) > backends.HttpBackend.KEPT:
            self.asked.pop(next(iter(self.asked)))
        return size % 7 == 0 or size % 3 == 0 and first

    def judge(self, fact, context):
        if len(fact) % 3 == 0:
            raise ValueError("no answer")
        return super().judge(fact, context)
