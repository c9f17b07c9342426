"""Times the headline queries at one scale and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = [
    "graph_build_triples", "graph_repair_endpoints", "digraph_collapse", "degree_counts", "top_entities", "graph_stats_counts", "edge_ids", "node_view",
    "connected_components", "khop_context_2", "khop_context_3", "cosine_topk", "bm25_topk", "retrieve_context_stats", "chunk_text_500", "sentence_split",
    "normalize_collapse", "rewrite_triples", "extract_pipeline_rule_based", "item_stats", "property_graph_rels",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from graphloom.plans import catalogue

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/nation.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
