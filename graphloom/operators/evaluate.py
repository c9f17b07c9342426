"""Fact entailment: flattening items, restoring progress, scoring and rolling up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEVELS = ("high", "medium", "low", "unknown")
DIFFICULTIES = ("easy", "medium", "hard")


def flatten_facts(items: DataFrame) -> DataFrame:
    """(item_id, quality_level, fact_pos, fact fields) of items (id, relational_facts), levels in fixed order."""
    levels = F.filter(F.transform(F.array(*map(F.lit, LEVELS)), lambda q: F.struct(q.alias("q"), F.try_element_at("relational_facts", q).alias("facts"))), lambda x: x["facts"].isNotNull())
    rows = items.select(F.coalesce("id", F.lit("unknown")).alias("item_id"), F.explode(levels).alias("l"))
    return rows.select("item_id", F.col("l.q").alias("quality_level"), F.posexplode("l.facts").alias("fact_pos", "f")).select("item_id", "quality_level", "fact_pos", "f.*")


def fully_scored(items: DataFrame, facts: DataFrame) -> DataFrame:
    """(item_id, done): whether an item has facts and all are scored."""
    state = facts.groupBy("item_id").agg(F.bool_and(F.col("score").isNotNull()).alias("done"))
    return items.select("item_id").distinct().join(state, "item_id", "left").select("item_id", F.coalesce("done", F.lit(False)).alias("done"))


def _rollup() -> list:
    scored, share = F.count("score"), F.try_divide(F.sum("score").cast("double"), F.count("score"))
    return [
        F.count("*").alias("total_facts"), scored.alias("scored_facts"), F.coalesce(F.sum("score"), F.lit(0)).cast("long").alias("correct_facts"),
        F.count_if(F.col("status") == "service_error").alias("service_error_facts"), F.count_if(F.col("status") == "error").alias("error_facts"),
        F.coalesce(F.round(share, 6), F.lit(0.0)).alias("accuracy"),
    ]


def item_stats(facts: DataFrame) -> DataFrame:
    """Totals of each item from facts (item_id, difficulty, score, status)."""
    return facts.groupBy("item_id").agg(*_rollup())


def overall_stats(facts: DataFrame) -> DataFrame:
    """One row of totals over all facts, those of no known difficulty included."""
    return facts.agg(*_rollup())


def difficulty_breakdown(facts: DataFrame) -> DataFrame:
    """A row for each known difficulty, zeros where it has no facts."""
    known = facts.sparkSession.createDataFrame([(d,) for d in DIFFICULTIES], "difficulty string")
    return known.join(facts.groupBy("difficulty").agg(*_rollup()), "difficulty", "left").na.fill(0)


def restore(facts: DataFrame, previous: DataFrame, check_text: bool = False) -> DataFrame:
    """Facts with the scores of an earlier run, matched by item, level and place.

    Of rows of the earlier run for one place the last (by ``run``) counts. Earlier errors bring back
    their status but leave the fact unscored. ``check_text`` also asks for the same fact text.
    """
    keys = ["item_id", "quality_level", "fact_pos"]
    last = previous.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("run")))).where("_n = 1")
    last = last.select(*keys, F.col("score").alias("_score"), F.col("status").alias("_status"), F.col("fact").alias("_fact"))
    joined = facts.drop("score", "status").join(last, keys, "left")
    same = F.col("fact").eqNullSafe(F.col("_fact")) if check_text else F.lit(True)
    failed = F.col("_status").isin("error", "service_error")
    return joined.withColumns({"score": F.when(same & ~F.coalesce(failed, F.lit(False)), F.col("_score")), "status": F.when(same, F.col("_status"))}).drop("_score", "_status", "_fact")


def restored_items(restored: DataFrame) -> DataFrame:
    """How many items got a score back, as one row."""
    return restored.where("score is not null").agg(F.count_distinct("item_id").alias("restored_items"))


def evaluate(facts: DataFrame, contexts: DataFrame, backend) -> DataFrame:
    """Facts with score, status and error: facts without a score are judged in their context.

    ``contexts`` (item_id, quality_level, fact_pos, context). Scored facts skip the judge.
    """
    from graphloom.operators.backends import judge_partition

    keys = ["item_id", "quality_level", "fact_pos"]
    pending = facts.where("score is null").join(contexts, keys, "left").select(*keys, "fact", F.coalesce("context", F.lit("")).alias("context"))
    judged = pending.mapInPandas(judge_partition(backend), "item_id string, quality_level string, fact_pos int, _s int, _st string, error string")
    done = facts.where("score is not null").withColumn("error", F.lit(None).cast("string"))
    fresh = facts.where("score is null").drop("score", "status").join(judged, keys).withColumnsRenamed({"_s": "score", "_st": "status"})
    return done.unionByName(fresh)


def judge(facts: DataFrame, backend) -> DataFrame:
    """Facts (with score, status and context) with score, status and error, judged where they have a context.

    No shuffle follows the model: a task that writes what comes out keeps what it has asked.
    """
    from graphloom.operators.backends import judge_batches

    kept = [f for f in facts.schema.fields if f.name not in ("score", "status", "error", "context")]
    schema = StructType(kept).add("score", "integer").add("status", "string").add("error", "string")
    return facts.mapInArrow(judge_batches(backend), schema)


RESULT_FIELDS = ("fact", "difficulty", "relational_type", "confidence", "triples")


def _result(columns: list[str]) -> Column:
    """A fact's result: fields that the facts don't have are left out, and so are an empty corrected_fact, retrieval_stats and error."""
    fields = [F.col("quality_level"), *[F.col(c) for c in RESULT_FIELDS if c in columns], F.col("score").alias("kg_entailment_score"), F.col("status").alias("evaluation_status")]
    return F.struct(*fields, *[F.col(c) for c in ("corrected_fact", "retrieval_stats", "error") if c in columns])


def item_results(facts: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(id, title, evaluation_stats, fact_results): a row for each item, its facts by level and place.

    ``titles`` (item_id, title) names items; others are called unknown.
    """
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("quality_level"))
    ordered = F.sort_array(F.collect_list(F.struct(level.alias("l"), F.col("fact_pos").alias("p"), _result(facts.columns).alias("r"))))
    results = facts.groupBy("item_id").agg(F.transform(ordered, lambda x: x["r"]).alias("fact_results"))
    stats = item_stats(facts)
    out = results.join(stats.select("item_id", F.struct(*stats.columns[1:]).alias("evaluation_stats")), "item_id")
    named = out.join(titles, "item_id", "left") if titles is not None else out.withColumn("title", F.lit(None).cast("string"))
    return named.select(F.col("item_id").alias("id"), F.coalesce("title", F.lit("unknown")).alias("title"), "evaluation_stats", "fact_results")


def payload(facts: DataFrame, retriever: str, k: int, depth: int, evaluator: str, titles: DataFrame | None = None) -> DataFrame:
    """One row, the interchange form of a run: evaluation_config, dataset_stats (each item's statistics and facts) and overall_stats with its breakdown, as JSON.

    It is a document for data sets that one document can hold; ``item_results`` gives the same rows without that bound.
    """
    items = item_results(facts, titles).agg(F.to_json(F.array_sort(F.collect_list(F.struct("*")), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))).alias("dataset_stats"))
    kinds = difficulty_breakdown(facts)
    each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("difficulty", F.struct(*kinds.columns[1:]).alias("s")))))
    overall = overall_stats(facts)
    totals = overall.join(kinds.agg(each.alias("difficulty_breakdown"))).select(F.to_json(F.struct("*")).alias("overall_stats"))  # a row each
    config = F.struct(F.lit(retriever).alias("retrieval_model"), F.lit(k).alias("retrieval_k"), F.lit(depth).alias("retrieval_depth"), F.lit(evaluator).alias("evaluator_model"))
    return items.join(totals).select(F.to_json(config).alias("evaluation_config"), F.coalesce("dataset_stats", F.lit("[]")).alias("dataset_stats"), "overall_stats")


def token_usage(history: DataFrame) -> DataFrame:
    """Sums of token counts; a missing count is 0, and counts under ``response`` stand in for missing ones."""
    usage = lambda c: F.coalesce(F.col(f"usage.{c}"), F.col(f"response.usage.{c}"), F.lit(0))
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    return history.agg(*[F.coalesce(F.sum(usage(c)), F.lit(0)).cast("long").alias(c) for c in names])
