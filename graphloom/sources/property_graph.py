"""Queries over the tables a property-graph sink has written."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from graphloom.sources.snapshots import Snapshots

#: The store's tables and the columns that tell their rows apart.
KEYS = {"nodes": ["name"], "relationships": ["s", "rel_type", "o"]}


def query_graph(spark: SparkSession, path: str, sql: str, version: int | None = None, **params) -> DataFrame:
    """The rows of a SQL query over {nodes} and {relationships}, of the newest version or a named one;
    no rows where there is no store or the query can't be planned. Parameters are bound by name."""
    store = Snapshots(spark, path, KEYS)
    numbers = store.versions()
    chosen = max(numbers, default=None) if version is None else version
    try:
        if chosen in numbers:  # one version for both tables
            return spark.sql(sql, args=params or None, **{t: store.read(t, chosen) for t in KEYS})
    except AnalysisException:
        pass
    return spark.createDataFrame([], StructType([]))
