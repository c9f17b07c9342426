"""Whole runs over files: converting, extracting with resumption, evaluating with checkpoints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import parse
from graphloom.operators import evaluate, extract, graph, retrieve
from graphloom.operators.graph import digraph, endpoints
from graphloom.schema import KGFrames
from graphloom.sources import json_records
from graphloom.storage import append_by_task, bound_tasks, exists, has_rows_files, remove, shared_table


def graph_of(relations: Column) -> Column:
    """The interchange form of a list of triples: names in order of code points, triples as they come."""
    ends = F.flatten(F.transform(relations, lambda r: F.array(F.get(r, F.lit(0)), F.get(r, F.lit(2)))))
    return F.struct(
        F.sort_array(F.array_distinct(ends)).alias("entities"),
        F.sort_array(F.array_distinct(F.transform(relations, lambda r: F.get(r, F.lit(1))))).alias("edges"),
        relations.alias("relations"),
    )


def convert_records(records: DataFrame, key: str = "triple", overwrite: bool = False) -> DataFrame:
    """JSON records (column value) with extracted_kg: that which they have, unless overwritten, or one built from their triples."""
    rows = records.select("value", parse.converted_triples(F.col("value"), key).alias("_r"))
    built = F.to_json(graph_of(F.col("_r")))
    had = F.try_variant_get(F.try_parse_json("value"), "$.extracted_kg", "string")
    return rows.select("value", (built if overwrite else F.coalesce(had, built)).alias("extracted_kg"))


def _slices(rows: DataFrame, key: str, size: int) -> Iterator[DataFrame]:
    """The rows in slices of about ``size`` keys, all rows of a key in one.

    They are written once, sorted by slice, so that a slice reads the row groups that hold it. Each
    is a job or more of the driver's: large tables want a large ``size``.
    """
    n = max(1, -(-rows.select(key).distinct().count() // size))
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(n)))
    dealt = shared_table(dealt.repartitionByRange("_slice").sortWithinPartitions("_slice"), "slices")
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, 1 + size // 32)
    for i in range(n):
        yield dealt.where(F.col("_slice") == i).drop("_slice").repartition(tasks, key)


def _by_slices(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The rows dealt to a task for each slice of about ``size`` keys, all rows of a key in one; no job for each."""
    return rows.repartition(max(1, -(-rows.select(key).distinct().count() // size)), key)


def extract_to(records: DataFrame, path: str, backend, config: extract.ExtractConfig = extract.ExtractConfig(), overwrite: bool = False, failures: str | None = None) -> int:
    """Extracts records (id, text) into a table, leaving out those an earlier run has written.

    Records are asked in slices of about save_interval, a task each: what a task has asked is kept in a
    folder beside the table when it ends, and goes to the table at the end of the run, or at the start of the run
    after a killed one. With ``config.answers`` slices are saved one after another, and a stage that a
    killed run has saved isn't asked again either. Returns the number of records that failed; they aren't written,
    so the next run asks again. With ``failures``, a path, each failure (id, stage, at) is added to a table
    there, which ``open_failures`` reads.
    """
    spark = records.sparkSession
    place = "pos" if "pos" in records.columns else "id"
    saving = path.rstrip("/") + "-saving"
    if overwrite:
        remove(spark, saving)
    _keep_saved(records, saving, path, config, failures)  # a killed run's
    rows = records if config.max_samples is None else records.orderBy(place).limit(config.max_samples)
    if not overwrite and has_rows_files(spark, path):
        rows = extract.pending(rows, spark.read.parquet(path))
    rows = shared_table(rows, "pending")
    if config.answers is None:
        if overwrite:
            remove(spark, path)
        append_by_task(extract.extract_in_tasks(_by_slices(rows, "id", config.save_interval), backend, config), saving)
        return _keep_saved(records, saving, path, config, failures)
    failed, mode = 0, "overwrite" if overwrite else "append"
    for part in _slices(rows, "id", config.save_interval):
        done, lost = extract.extract(part, backend, replace(config, max_samples=None))
        lost = shared_table(lost, "failures")
        good = done.join(lost.select("id").distinct(), "id", "left_anti")
        _written(good, config).write.mode(mode).parquet(path)
        failed, mode = failed + _add_failures(lost, failures), "append"
    return failed


def _written(good: DataFrame, config: extract.ExtractConfig) -> DataFrame:
    """Extracted records under the names of their table."""
    good = good.withColumnRenamed("triples", config.output_key)
    return good.withColumnRenamed("entities", config.entity_key) if config.save_entity else good.drop("entities")


def _add_failures(lost: DataFrame, failures: str | None) -> int:
    n = lost.select("id").distinct().count()
    if n and failures:
        lost.withColumn("at", F.current_timestamp()).write.mode("append").parquet(failures)
    return n


def _keep_saved(records: DataFrame, saving: str, path: str, config: extract.ExtractConfig, failures: str | None) -> int:
    """Moves what tasks have saved to the table and the table of failures; returns the number of records that failed.

    A run that is killed here does so again: records that the table has already aren't added twice.
    """
    spark, failed = records.sparkSession, 0
    if has_rows_files(spark, saving):
        saved = spark.read.schema(extract.saved_schema(records)).parquet(saving)
        good = _written(saved.where(F.size("stages") == 0).drop("stages"), config)
        if has_rows_files(spark, path):
            good = good.join(spark.read.parquet(path).select("id").distinct(), "id", "left_anti")
        good.write.mode("append").parquet(path)
        failed = _add_failures(saved.select("id", F.explode("stages").alias("stage")), failures)
    remove(spark, saving)
    return failed


def open_failures(spark: SparkSession, failures: str, path: str) -> DataFrame | None:
    """(id, stage, at, times): the stage and time of the last failure, and the number of failures, of each
    record that no run has written to ``path`` since; None where nothing ever failed."""
    if not exists(spark, failures):
        return None
    lost = spark.read.parquet(failures)
    if exists(spark, path):
        lost = lost.join(spark.read.parquet(path).select("id"), "id", "left_anti")
    return lost.groupBy("id").agg(F.max_by("stage", F.struct("at", "stage")).alias("stage"), F.max("at").alias("at"), F.count("*").alias("times"))


@dataclass(frozen=True)
class EvalConfig:
    retrieval_k: int = 8
    retrieval_depth: int = 2
    retriever: str = "hashed-trigrams"
    evaluator: str = "rules"

    def __post_init__(self):
        if self.retrieval_k < 0 or self.retrieval_depth < 0:
            raise ValueError("k and depth must not be negative")


def _with_contexts(items: DataFrame, embed, config: EvalConfig, previous: DataFrame | None) -> DataFrame:
    """Facts of items with retrieval_stats and context; the context is null where a fact isn't to be judged."""
    rows = evaluate.flatten_facts(items).withColumnsRenamed({"kg_entailment_score": "score", "evaluation_status": "status"}).drop("error")
    if previous is not None:
        rows = evaluate.restore(rows, previous)
    rows = shared_table(rows, "facts")
    with_graph = items.where(F.col("extracted_kg").isNotNull()).select(F.col("id").alias("graph_id"), "extracted_kg.*")
    kg = graph.unnest(with_graph)
    nodes, _ = embeddings(kg, embed)
    open_ = rows.where("score is null").join(with_graph.select(F.col("graph_id").alias("item_id")), "item_id", "left_semi")
    query = F.concat_ws("/", "item_id", "quality_level", "fact_pos")
    asked = open_.select(F.col("item_id").alias("graph_id"), query.alias("query_id"), "fact")
    facts = shared_table(embed(asked.select(F.col("fact").alias("node")).distinct()), "vectors")
    asked = asked.join(facts, F.col("fact") == F.col("node")).select("graph_id", "query_id", F.col("embedding").alias("q"))
    best = shared_table(retrieve.relevant_nodes(asked, nodes, config.retrieval_k), "best")
    of, texts = retrieve.distinct_contexts(best, kg.triples, config.retrieval_depth)
    sizes = retrieve.stats_of(best, of, config.retrieval_k, config.retrieval_depth)
    sizes = sizes.select("query_id", F.struct(*sizes.columns[2:]).alias("retrieval_stats"))
    keys = ["item_id", "quality_level", "fact_pos"]
    placed = open_.select(*keys, query.alias("query_id")).join(of.select("query_id", F.col("ctx").alias("_ctx")), "query_id", "left").join(sizes, "query_id", "left").drop("query_id")
    placed = shared_table(placed, "placed")
    # texts come last, and go to blocks of the facts that share them: they are in no other shuffle
    bound_tasks(items.sparkSession)
    parts = placed.groupBy("item_id", "_ctx").agg(F.ceil(F.count("*") / SHARED).cast("long").alias("_parts"))
    placed = placed.join(parts, ["item_id", "_ctx"], "left").withColumn("_part", F.pmod(F.xxhash64(*keys), F.coalesce("_parts", F.lit(1)))).drop("_parts").withColumn("_open", F.lit(True))
    sent = texts.select(F.col("graph_id").alias("item_id"), F.col("ctx").alias("_ctx"), "context").join(parts, ["item_id", "_ctx"])
    sent = sent.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    met = rows.join(placed, keys, "left").join(sent, ["item_id", "_ctx", "_part"], "left")
    return met.select(*rows.columns, F.when(F.col("_open"), F.coalesce("context", F.lit(""))).alias("context"), "retrieval_stats")


#: Facts that a copy of their shared context goes to, about.
SHARED = 256


def evaluate_items(items: DataFrame, embed, backend, config: EvalConfig = EvalConfig(), previous: DataFrame | None = None) -> DataFrame:
    """Facts of items (id, extracted_kg, relational_facts) with score, status and error.

    Items without a graph keep their facts as they are. Scores of an earlier run come back by item,
    level and place; only facts without a score are retrieved for and judged.
    """
    return evaluate.judge(_with_contexts(items, embed, config, previous), backend)


def evaluate_dataset(spark: SparkSession, dataset: str, output: str, embed, backend, config: EvalConfig = EvalConfig(), save_interval: int = 20) -> DataFrame:
    """Evaluates a file of items and appends their facts to the output table under the next run number; returns the totals of all facts.

    Contexts are found for all items at once. The model is asked in slices of about save_interval
    items, a task each: what a task has judged is in the table when it ends, and the run after a killed one brings it back.
    ``result_payload`` makes the interchange document of the output.
    """
    items = shared_table(json_records.items(spark, dataset), "items")
    previous, run = None, 0
    if has_rows_files(spark, output):
        previous = spark.read.parquet(output)
        run = previous.agg(F.max("run").alias("r")).first()["r"]
        run = 0 if run is None else run + 1
        previous = shared_table(previous, "previous")  # the target grows while it is read
    facts = shared_table(_with_contexts(items, embed, config, previous), "prepared")
    done = evaluate.judge(_by_slices(facts, "item_id", save_interval), backend).withColumn("run", F.lit(run))
    append_by_task(done, output)
    return evaluate.overall_stats(spark.read.schema(done.schema).parquet(output).where(F.col("run") == run))


def result_payload(spark: SparkSession, dataset: str, output: str, config: EvalConfig = EvalConfig()) -> DataFrame:
    """The payload of the last run in the output table, with the items' titles."""
    facts = spark.read.parquet(output)
    last = facts.join(facts.agg(F.max("run").alias("_last")), F.col("run") == F.col("_last"), "left_semi").drop("run")
    titles = json_records.items(spark, dataset).select(F.coalesce("id", F.lit("unknown")).alias("item_id"), "title")
    return evaluate.payload(last, config.retriever, config.retrieval_k, config.retrieval_depth, config.evaluator, titles)


def embeddings(graph: KGFrames, embed) -> tuple[DataFrame, DataFrame]:
    """(graph_id, name, embedding) of a graph's nodes, and of the relations of its simple graph."""
    if embed is None:
        raise ValueError("embeddings need a model")
    names = graph.entities.unionByName(endpoints(graph.triples)).distinct()
    kinds = digraph(graph.triples).select("graph_id", F.col("rel").alias("name")).distinct()
    vectors = shared_table(embed(names.unionByName(kinds).select(F.col("name").alias("node")).distinct()), "vectors").withColumnRenamed("node", "name")
    return names.join(vectors, "name").select("graph_id", "name", "embedding"), kinds.join(vectors, "name").select("graph_id", "name", "embedding")


def convert_file(spark: SparkSession, path: str, output: str, key: str = "triple", overwrite: bool = False) -> int:
    """Converts a file that holds a JSON array of records, and writes them with extracted_kg as JSON lines; returns their number."""
    records = json_records.array_elements(spark, path)
    done = shared_table(convert_records(records, key, overwrite), "converted")
    merged = F.concat(F.regexp_replace(F.rtrim("value"), r"\}$", ""), F.when(F.trim("value").rlike(r"^\{\s*\}$"), "").otherwise(", "), F.lit('"extracted_kg": '), "extracted_kg", F.lit("}"))
    plain = F.when(F.try_variant_get(F.try_parse_json("value"), "$.extracted_kg", "string").isNull(), merged).otherwise(F.col("value"))
    done.select(plain.alias("value")).write.mode("overwrite").text(output)
    return done.count()
