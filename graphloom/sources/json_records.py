"""Reading records, graphs and text from files any Spark reader reaches."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.operators.graph import unnest
from graphloom.schema import GRAPH, ITEM, KGFrames
from graphloom.sources.json_arrays import array_elements
from graphloom.storage import shared_table

__all__ = ["array_elements"]


def json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """The objects of files that each hold a JSON array; anything else at the top is an error."""
    return array_elements(spark, path).select(F.from_json("value", schema).alias("_v")).select("_v.*")


def items(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, ITEM)


def graph_file(spark: SparkSession, path: str, graph_id: str = "graph", repaired: bool = True) -> KGFrames:
    """A graph's JSON file, with missing ends and predicates added unless told not to."""
    return unnest(spark.read.schema(GRAPH).option("multiLine", True).json(path).withColumn("graph_id", F.lit(graph_id)), repaired)


def graph_array(spark: SparkSession, path: str, repaired: bool = True) -> KGFrames:
    """The graphs of files that ``sinks.write_graphs`` wrote, under their own ids."""
    rows = json_array(spark, path, StructType([StructField("graph_id", StringType()), *GRAPH.fields]))
    return unnest(shared_table(rows, "graphs"), repaired)


def texts(spark: SparkSession, path: str | None) -> DataFrame:
    """(doc_id, text): a row for each file; without a path, one of the standard input."""
    if path is None:
        return spark.createDataFrame([("-", sys.stdin.read())], "doc_id string, text string")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
