"""Extracting entities and triples from texts, and whole graphs from documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.functions import parse
from graphloom.functions.text import once, strip
from graphloom.operators.backends import PromptBackend, generate_pending
from graphloom.operators.chunks import chunks, flatten
from graphloom.operators.dedupe import deduplicate
from graphloom.operators.graph import build
from graphloom.schema import KGFrames
from graphloom.sources.sinks import write_json
from graphloom.storage import bound_batches, exists, shared_table

ENTITY_PROMPT = PromptBackend.ENTITIES
RELATION_PROMPT = PromptBackend.RELATIONS


@dataclass(frozen=True)
class ExtractConfig:
    """Options of batch extraction; bounds are checked when it is made.

    One record at a time is a batch_size of 1 and a backend of one worker. ``answers`` is the path of a
    table of answers that runs share, by the digest of model, instructions and prompt; ``model`` must
    name all that makes a backend answer otherwise.
    """

    text_key: str | None = None
    output_key: str = "triple"
    entity_key: str = "entity"
    max_samples: int | None = None
    batch_size: int = 32
    rerun_rounds: int = 2
    rerun_backoff: float = 2.0
    retry_until_success: bool = False
    max_rerun_rounds: int = -1
    save_interval: int = 20
    save_entity: bool = False
    answers: str | None = None
    model: str = ""

    def __post_init__(self):
        bounds = {
            "max_samples": self.max_samples is not None and self.max_samples < 0, "batch_size": self.batch_size < 1, "rerun_rounds": self.rerun_rounds < 0,
            "rerun_backoff": self.rerun_backoff < 0, "max_rerun_rounds": self.max_rerun_rounds < -1, "save_interval": self.save_interval < 1,
        }
        if bad := [name for name, out in bounds.items() if out]:
            raise ValueError(f"out of bounds: {', '.join(bad)}")

    @property
    def rounds(self) -> int | None:
        """How often what failed is asked again; None: until it succeeds."""
        if not self.retry_until_success:
            return self.rerun_rounds
        return None if self.max_rerun_rounds < 0 else self.max_rerun_rounds


def records_of(values: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """(id, pos, text, existing, value) of JSON records (id, value): the text under text_key, or the first of raw_chunk and text that isn't blank; the triples it has already."""
    parsed = values.withColumn("_v", F.try_parse_json("value"))  # once for all fields
    field = lambda k: F.try_variant_get("_v", f"$['{k}']", "variant")
    string = lambda k: once(field(k), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    text = F.coalesce(string(config.text_key), F.lit("")) if config.text_key else parse.record_text(string("raw_chunk"), string("text"))
    pos = F.col("pos") if "pos" in values.columns else F.col("id")
    return parsed.select("id", pos.alias("pos"), text.alias("text"), parse.existing_triples(F.col("value")).alias("existing"), "value")


def _answers(rows: DataFrame, backend, system: str, config: ExtractConfig) -> DataFrame:
    """(id, response, failed) of rows (id, prompt), asked in batches on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), config.batch_size):
                part = f.iloc[i : i + config.batch_size]
                got, failed = generate_pending(backend, system, list(part["prompt"]), config.rounds, config.rerun_backoff)
                yield pd.DataFrame({"id": part["id"], "response": got, "failed": [k in set(failed) for k in range(len(got))]})

    bound_batches(rows.sparkSession)
    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "prompt").mapInPandas(run, f"id {kind}, response string, failed boolean")


def _all_answers(rows: DataFrame, backend, system: str, config: ExtractConfig, name: str) -> DataFrame:
    """``_answers``, written. With a table of answers only prompts that it lacks are asked, each once, and what was answered goes there.

    Of the table only the parts that the prompts' digests fall in are read, 256 at most.
    """
    if config.answers is None:
        return shared_table(_answers(rows, backend, system, config), name)
    spark, parts = rows.sparkSession, F.substring("key", 1, 2)
    key = F.sha2(F.to_json(F.array(F.lit(config.model), F.lit(system), F.col("prompt"))), 256)
    keyed = shared_table(rows.select("id", "prompt", key.alias("key")), "prompts")
    ask = keyed.groupBy("key").agg(F.min("prompt").alias("prompt"))
    kept = None
    if exists(spark, config.answers):
        met = [r["part"] for r in keyed.select(parts.alias("part")).distinct().collect()]  # 256 at most
        table = spark.read.schema("key string, response string, part string").parquet(config.answers)
        kept = table.where(F.col("part").isin(met)).join(ask.select("key"), "key", "left_semi").groupBy("key").agg(F.min("response").alias("response"))
        kept = shared_table(kept, "kept")
        ask = ask.join(kept, "key", "left_anti")
    got = shared_table(_answers(ask.withColumnRenamed("key", "id"), backend, system, config), name).withColumnRenamed("id", "key")
    got = got.where("not failed").select("key", "response")
    got.withColumn("part", parts).repartition("part").write.mode("append").partitionBy("part").parquet(config.answers)
    found = got if kept is None else kept.unionByName(got)
    return shared_table(keyed.join(found, "key", "left").select("id", F.coalesce("response", F.lit("")).alias("response"), F.col("response").isNull().alias("failed")), name)


def extract(records: DataFrame, backend, config: ExtractConfig = ExtractConfig()) -> tuple[DataFrame, DataFrame]:
    """((id, text, entities, triples), failures) of records (id, text, and existing triples and pos if they have them).

    With max_samples the first records by pos are taken, or by id. Blank texts aren't sent to the
    model; triples that a record has already go into the prompt and aren't given again. Each model
    stage is written before it is used, so that no action asks twice. Failures are rows of their
    own; they don't stop the run.
    """
    place = "pos" if "pos" in records.columns else "id"
    rows = records if config.max_samples is None else records.orderBy(place).limit(config.max_samples)
    lists, none = "array<array<string>>", F.array().cast("array<string>")
    rows = rows.select("id", "text", _had(records).alias("_had"))
    full = rows.where(strip(F.col("text")) != "")
    first = _all_answers(full.select("id", F.col("text").alias("prompt")), backend, ENTITY_PROMPT, config, "entity-answers")
    named = full.join(first.select("id", parse.entities(F.col("response")).alias("entities")), "id")
    prompts = named.select("id", _relation_prompt().alias("prompt"))
    second = _all_answers(prompts, backend, RELATION_PROMPT, config, "relation-answers")
    fresh = F.array_except(parse.relations(F.col("response")), F.col("_had"))
    done = named.join(second, "id").select("id", "entities", fresh.alias("triples"))
    out = rows.join(done, "id", "left").select("id", "text", F.coalesce("entities", none).alias("entities"), F.coalesce("triples", F.array().cast(lists)).alias("triples"))
    failures = first.where("failed").select("id", F.lit("entities").alias("stage")).unionByName(second.where("failed").select("id", F.lit("relations").alias("stage")))
    return out, failures


def _asked_in_task(rows: DataFrame, backend, system: str, config: ExtractConfig) -> DataFrame:
    """The rows with response and failed, asked where they have a prompt; the prompt goes. No shuffle, no other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, config.batch_size):
                part = batch.slice(i, config.batch_size)
                prompts = part.column("prompt").to_pylist()
                at = [k for k, p in enumerate(prompts) if p is not None]
                got, failed = generate_pending(backend, system, [prompts[k] for k in at], config.rounds, config.rerun_backoff)
                answers, lost = dict(zip(at, got)), {at[k] for k in failed}
                kept = [c for c in part.schema.names if c != "prompt"]
                new = [pa.array([answers.get(k) for k in range(len(prompts))], pa.string()), pa.array([k in lost for k in range(len(prompts))])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], names=[*kept, "response", "failed"])

    bound_batches(rows.sparkSession)
    schema = StructType([f for f in rows.schema.fields if f.name != "prompt"]).add("response", "string").add("failed", "boolean")
    return rows.mapInArrow(run, schema)


def _relation_prompt() -> Column:
    known = F.when(F.size("_had") > 0, F.concat(F.lit("Known: "), F.to_json("_had"), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("Entities: "), F.to_json("entities"), F.lit("\n"), known, F.lit("Text: "), "text")


def _had(records: DataFrame) -> Column:
    lists = F.array().cast("array<array<string>>")
    return F.coalesce("existing", lists) if "existing" in records.columns else lists


def extract_in_tasks(records: DataFrame, backend, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """(id, text, entities, triples, stages) of records as ``extract`` takes them; stages that failed.

    A task asks both stages for the records it holds, and nothing is shuffled: what it writes isn't asked again.
    """
    rows = records.select("id", "text", _had(records).alias("_had"))
    full = F.when(strip(F.col("text")) != "", F.col("text"))
    first = _asked_in_task(rows.withColumn("prompt", full), backend, ENTITY_PROMPT, config)
    named = first.select("id", "text", "_had", F.when(full.isNotNull(), parse.entities(F.col("response"))).alias("entities"), F.col("failed").alias("_failed"))
    second = _asked_in_task(named.withColumn("prompt", F.when(full.isNotNull(), _relation_prompt())), backend, RELATION_PROMPT, config)
    fresh = F.array_except(parse.relations(F.col("response")), F.col("_had"))
    triples = F.coalesce(F.when(full.isNotNull(), fresh), F.array().cast("array<array<string>>"))
    stages = F.array_compact(F.array(F.when(F.col("_failed"), "entities"), F.when(F.col("failed"), "relations")))
    return second.select("id", "text", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), triples.alias("triples"), stages.alias("stages"))


def saved_schema(records: DataFrame) -> str:
    """The columns of ``extract_in_tasks``."""
    return f"id {dict(records.dtypes)['id']}, text string, entities array<string>, triples array<array<string>>, stages array<string>"


def pending(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records an earlier run hasn't written yet."""
    return records.join(done.select("id"), "id", "left_anti")


def rule_triples(docs: DataFrame) -> DataFrame:
    """(graph_id, s, p, o): neighbouring names of each document, by pattern, in the JVM."""
    names = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))
    found = docs.select(F.col("doc_id").cast("string").alias("graph_id"), names.alias("n"))
    pairs = F.explode(F.arrays_zip(F.slice("n", 1, F.size("n") - 1).alias("a"), F.slice("n", 2, F.size("n")).alias("b")))
    return found.where(F.size("n") > 1).select("graph_id", pairs.alias("z")).select("graph_id", F.col("z.a").alias("s"), F.lit("precedes").alias("p"), F.col("z.b").alias("o")).distinct()


def generate(docs: DataFrame, backend, chunk_size: int | None = None, cluster: bool = False, embed=None, output: str | None = None) -> KGFrames:
    """A graph for each document (doc_id, text): its chunks' entities and relations, merged.

    ``backend`` has entities(text) and relations(text, entities). If typed relations fail, lines of
    text are asked for and parsed, and only those between known entities stay. With ``cluster`` names
    are de-duplicated in full, which needs ``embed``; with ``output`` the graphs are written there.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = chunks(docs, chunk_size) if chunk_size else docs.select("doc_id", F.lit(0).alias("chunk_id"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for graph, text in zip(f["graph_id"], f["text"]):
                names = backend.entities(text)
                lines: list[str] = []
                try:
                    found = backend.relations(text, names)
                except Exception:
                    found, lines = [], list(backend.relation_lines(text, names))
                rows.append((graph, list(names), [list(t) for t in found], lines))
            yield pd.DataFrame(rows, columns=["graph_id", "names", "triples", "lines"])

    bound_batches(docs.sparkSession)
    got = parts.select(F.col("doc_id").cast("string").alias("graph_id"), "text").mapInPandas(run, "graph_id string, names array<string>, triples array<array<string>>, lines array<string>")
    got = shared_table(got, "generated")
    entities = got.select("graph_id", F.explode("names").alias("name")).distinct()
    typed = got.select("graph_id", F.explode("triples").alias("t")).select("graph_id", *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate("spo")])
    lines = got.select("graph_id", "names", F.explode("lines").alias("line")).select("graph_id", "names", parse.relation_line(F.col("line")).alias("t"))
    lines = lines.where(F.array_contains("names", F.col("t.s")) & F.array_contains("names", F.col("t.o"))).select("graph_id", "t.*")
    graph = build(typed.unionByName(lines), entities)
    if cluster:
        graph = deduplicate(graph, "full", embed, backend)
    if output:
        write_json(graph, output)
    return graph


def generate_from_messages(messages: DataFrame, backend, chunk_size: int | None = None, cluster: bool = False, embed=None, output: str | None = None) -> KGFrames:
    """A graph for each conversation (conv_id, turn, role, text), of what users and assistants say.

    A message without a role or a text is an error. ``PromptBackend(model, conversation=True)`` asks
    with the instructions for conversations.
    """
    if not messages.where(F.col("role").isNull() | F.col("text").isNull()).isEmpty():
        raise ValueError("messages need a role and a text")
    return generate(flatten(messages).withColumnRenamed("conv_id", "doc_id"), backend, chunk_size, cluster, embed, output)
