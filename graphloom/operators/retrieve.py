"""Ranking by similarity and retrieving the context of ranked nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import sentence, words
from graphloom.operators.graph import digraph, ranked
from graphloom.storage import broadcast_if_small, shared_table


def top_k(scored: DataFrame, k: int, score: str = "score", name: str = "name") -> DataFrame:
    """The k best names of each query, ties by name. A negative k is an error."""
    if k < 0:
        raise ValueError("k must not be negative")
    order = Window.partitionBy("query_id").orderBy(F.desc(score), name)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Rows of a block of queries and of nodes, about.
QUERY_BLOCK, NODE_BLOCK = 512, 4096


def _blocks(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(graph_id, part, keys, unit): blocks of about ``size`` rows of a graph, their unit vectors as bytes; no length gives zeros."""
    counts = rows.groupBy(F.col("graph_id").alias("_g")).agg(F.ceil(F.count("*") / size).cast("long").alias("_parts"))
    dealt = rows.select("graph_id", F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    dealt = dealt.join(counts, F.col("graph_id") == F.col("_g")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("_parts")))
    kind = dict(dealt.dtypes)["key"]

    def pack(table: pa.Table) -> pa.Table:
        lists = table.column("v").to_pylist()
        matrix = np.zeros((len(lists), max(map(len, lists))))
        for row, v in zip(matrix, lists):
            row[: len(v)] = v
        length = np.sqrt((matrix**2).sum(1, keepdims=True))
        unit = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
        keys = pa.array([table.column("key").to_pylist()], pa.list_(table.schema.field("key").type))
        return pa.table({"graph_id": table.column("graph_id").slice(0, 1), "part": table.column("part").slice(0, 1), "keys": keys, "unit": pa.array([unit.tobytes()], pa.binary())})

    return dealt.groupBy("graph_id", "part").applyInArrow(pack, f"graph_id string, part long, keys array<{kind}>, unit binary")


def cosine_scores(queries: DataFrame, nodes: DataFrame, k: int | None = None) -> DataFrame:
    """(graph_id, query_id, name, score) of a stated set of queries (query_id, q) against all nodes (name, embedding) of their graph.

    Vectors are normalised once and packed in blocks; blocks of queries, a stated set, go to the
    blocks of nodes, so no graph is one task. With k only the k best of each query and block come out.
    """
    asked = _blocks(queries, "query_id", "q", QUERY_BLOCK).select(F.col("graph_id").alias("_g"), F.col("part").alias("q_part"), F.col("keys").alias("q_keys"), F.col("unit").alias("q_unit"))
    held = _blocks(nodes, "name", "embedding", NODE_BLOCK)
    last = held.groupBy(F.col("graph_id").alias("_h")).agg(F.max("part").alias("_last"))
    sent = asked.join(last, F.col("_g") == F.col("_h")).select("_g", "q_keys", "q_unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_part"))
    met = held.join(sent, (F.col("graph_id") == F.col("_g")) & (F.col("part") == F.col("_part"))).select("graph_id", "keys", "unit", "q_keys", "q_unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                graph, names, unit, asked, q_unit = (c[i].as_py() for c in batch.columns)
                p, q = (np.frombuffer(x, np.float64).reshape(n, -1) for x, n in ((unit, len(names)), (q_unit, len(asked))))
                width = min(p.shape[1], q.shape[1])
                scores, order = q[:, :width] @ p[:, :width].T, np.array(names, object)
                for query, row in zip(asked, scores):
                    at = np.arange(len(row))
                    if k is not None and len(row) > k:
                        at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if k else at[:0]
                    found = {"graph_id": pa.array([graph] * len(at), pa.string()), "query_id": pa.array([query] * len(at), kinds[1]), "name": pa.array(order[at], pa.string()), "score": pa.array(row[at])}
                    yield pa.RecordBatch.from_pydict(found)

    kinds = pa.string(), {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[dict(queries.dtypes)["query_id"]]
    return met.mapInArrow(run, f"graph_id string, query_id {dict(queries.dtypes)['query_id']}, name string, score double")


def relevant_nodes(queries: DataFrame, nodes: DataFrame, k: int = 8) -> DataFrame:
    if k < 0:
        raise ValueError("k must not be negative")
    return top_k(cosine_scores(queries, nodes, k), k)


K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, name, score) by BM25 for every pair that shares a term.

    ``queries`` (query_id, text), ``corpus`` (name, text). A term's weight is ln(N - df + 0.5) -
    ln(df + 0.5); negative weights become EPSILON times the mean weight. Query terms count as
    often as they stand in the query. Pairs meet by term: nothing is crossed.
    """
    docs = corpus.select("name", words(F.lower("text")).alias("w"))
    sizes = docs.select("name", F.size("w").alias("dl"))
    stats = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    freq = docs.select("name", F.explode("w").alias("term")).groupBy("name", "term").agg(F.count("*").alias("tf"))
    df = freq.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.join(F.broadcast(stats)).withColumn("w", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row of stats
    mean = weights.agg(F.avg("w").alias("mean"))
    weights = weights.join(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("w") < 0, EPSILON * F.col("mean")).otherwise(F.col("w")).alias("idf"))
    asked = queries.select("query_id", F.explode(words(F.lower("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    met = asked.join(weights, "term").join(freq, "term").join(sizes, "name")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", "name").agg(F.sum(part).alias("score"))


def hybrid_scores(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    """Half of each raw score; a pair that shares no term has BM25 0."""
    joined = dense.select("query_id", "name", F.col("score").alias("_c")).join(bm25.select("query_id", "name", F.col("score").alias("_b")), ["query_id", "name"], "left")
    return joined.select("query_id", "name", (0.5 * F.coalesce("_b", F.lit(0.0)) + 0.5 * F.col("_c")).alias("score"))


#: Edges of a block of a node's neighbourhood; queries of a set, of which a reached node holds a bit each.
EDGE_BLOCK, QUERY_SET = 512, 1024
BLOCK = ["graph_id", "name", "part", "block"]


def neighbourhoods(triples: DataFrame) -> DataFrame:
    """(graph_id, name, part, block, edges), written: the edges (to, rel, out) of each node in blocks of at most EDGE_BLOCK.

    Edges are those of the simple graph, each at both ends; ``out`` tells which end the node is. They
    are dealt in ranges of node and neighbour, so a hub is many ranges, and a block lies in one of them.
    """
    edges = shared_table(digraph(triples), "edges")  # ranges are found from a sample first, so it is read twice
    side = lambda at, to, out: edges.select("graph_id", F.col(at).alias("name"), F.struct(F.col(to).alias("to"), "rel", F.lit(out).alias("out")).alias("edge"))
    both = side("src", "dst", True).unionByName(side("dst", "src", False))
    dealt = both.repartitionByRange("graph_id", "name", "edge.to").select("*", F.spark_partition_id().alias("part"))
    place = F.row_number().over(Window.partitionBy("graph_id", "name", "part").orderBy("edge")) - 1
    blocks = dealt.withColumn("block", F.floor(place / EDGE_BLOCK)).groupBy(*BLOCK).agg(F.collect_list("edge").alias("edges"))
    return shared_table(blocks, "neighbourhoods")


def _met(reached: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of ``reached`` with the edges of each block of their node.

    Nodes ask for the names of their blocks first; edges meet queries by block, so a hub is no single key.
    """
    return reached.join(blocks.select(*BLOCK), ["graph_id", "name"]).join(blocks.select(*BLOCK, "edges"), BLOCK)


def _told(seeds: DataFrame, triples: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """((graph_id, sentence, set, bits), asked, names of the bits): sentences of edges that touch a node within depth - 1 hops of a seed, a bit for each query of a set.

    Rows have only as many longs of bits as the largest number of queries in a set asks for.
    """
    asked = ranked(seeds.select("graph_id", "query_id").distinct(), "graph_id", [F.col("query_id")], "n")
    asked = shared_table(asked.select("graph_id", "query_id", F.floor(F.col("n") / QUERY_SET).alias("set"), (F.col("n") % QUERY_SET).cast("int").alias("at")), "asked")
    key, bits = ["graph_id", "name", "set"], [f"b{i}" for i in range((asked.agg(F.max("at")).first()[0] or 0) // 64 + 1)]
    either = lambda rows, *keys: rows.groupBy(*keys).agg(*[F.bit_or(b).alias(b) for b in bits])
    marks = [F.when(F.floor(F.col("at") / 64) == i, F.expr("shiftleft(1L, at % 64)")).otherwise(F.lit(0).cast("long")).alias(b) for i, b in enumerate(bits)]
    first = seeds.select("graph_id", "query_id", "name").join(asked, ["graph_id", "query_id"]).select(*key, *marks)
    reached = frontier = shared_table(either(first, *key), "frontier")
    blocks = neighbourhoods(triples)
    for _ in range(depth - 1):
        step = either(_met(frontier, blocks).select("graph_id", F.explode("edges.to").alias("name"), "set", *bits), *key)
        had = reached.select(*key, *[F.col(b).alias(f"_{b}") for b in bits])
        fresh = step.join(had, key, "left").select(*key, *[F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(f"_{b}", F.lit(0).cast("long")))).alias(b) for b in bits])
        frontier = shared_table(fresh.where(" or ".join(f"{b} <> 0" for b in bits)), "frontier")  # plans don't grow with the hops
        reached = shared_table(either(reached.unionByName(frontier), *key), "reached")
    touched = _met(reached, blocks).select("graph_id", "name", "set", *bits, F.explode("edges").alias("e"))
    text = F.when(F.col("e.out"), sentence(F.col("name"), F.col("e.rel"), F.col("e.to"))).otherwise(sentence(F.col("e.to"), F.col("e.rel"), F.col("name")))
    return either(touched.select("graph_id", "set", text.alias("sentence"), *bits), "graph_id", "sentence", "set"), asked, bits


def context(seeds: DataFrame, triples: DataFrame, depth: int = 2) -> DataFrame:
    """(graph_id, query_id, sentence): sentences of edges that touch a node within depth - 1 hops of a seed.

    ``seeds`` (graph_id, query_id, name). Edges are those of the simple graph, in the blocks of
    ``neighbourhoods``, which are written once for all hops. A graph's queries are numbered, and dealt in sets of
    QUERY_SET; a node, and at the end a sentence, holds a bit for each query of a set, so what is
    shuffled is a row for each of them and each set, and queries are written out after the last shuffle. Only
    nodes found in the hop before are expanded. A depth of 0 gives no sentence.
    """
    if depth <= 0:
        return seeds.select("graph_id", "query_id", F.lit("").alias("sentence")).where("false")
    told, asked, bits = _told(seeds, triples, depth)
    # a set's queries by their place, QUERY_SET at most
    ids = asked.groupBy(F.col("graph_id").alias("_g"), F.col("set").alias("_set")).agg(F.map_from_entries(F.collect_list(F.struct("at", "query_id"))).alias("_ids"))
    ids = ids.select("_g", "_set", F.transform(F.sequence(F.lit(0), F.lit(QUERY_SET - 1)), lambda i: F.try_element_at("_ids", i)).alias("_ids"))
    words = F.explode(F.array(*[F.struct(F.lit(64 * i).alias("start"), F.col(b).alias("bits")) for i, b in enumerate(bits)]))
    rows = told.join(broadcast_if_small(ids, 256), (F.col("graph_id") == F.col("_g")) & (F.col("set") == F.col("_set"))).select("graph_id", "sentence", "_ids", words.alias("w")).where("w.bits <> 0")
    rows = rows.select("graph_id", "sentence", "_ids", "w", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where("getbit(w.bits, i) = 1")
    return rows.select("graph_id", F.get("_ids", F.col("w.start") + F.col("i")).alias("query_id"), "sentence")


def context_sizes(seeds: DataFrame, triples: DataFrame, depth: int = 2) -> DataFrame:
    """(graph_id, query_id, edges, chars, words): sentences of each query's ``context``, and their characters and words.

    They are summed where the bits of the queries are: no row is made for a query and a sentence.
    """
    if depth <= 0:
        return seeds.select("graph_id", "query_id", *[F.lit(0).cast("long").alias(c) for c in SIZES]).where("false")
    told, asked, bits = _told(seeds, triples, depth)
    return _summed(told, bits, {}).join(asked, ["graph_id", "set", "at"]).select("graph_id", "query_id", *SIZES)


def _summed(told: DataFrame, bits: list[str], more: dict[str, Column]) -> DataFrame:
    """(graph_id, set, at, sizes and more): sums over the sentences of each query; a value of ``more`` has 21 bits at most, so float sums of a batch are exact."""
    sized = told.select("graph_id", "set", F.lit(1).cast("long").alias("edges"), F.length("sentence").cast("long").alias("chars"), F.size(words(F.col("sentence"))).cast("long").alias("words"), *[c.alias(n) for n, c in more.items()], *bits)
    names = [*SIZES, *more]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.Table.from_batches([batch.select(["graph_id", "set"])]).to_pandas().groupby(["graph_id", "set"], sort=False, dropna=False).indices
            weights = np.stack([batch.column(c).to_numpy() for c in names]).astype(np.float64)
            packed = np.stack([batch.column(b).to_numpy() for b in bits], axis=1).astype("<i8")
            for (graph, of), rows in groups.items():
                on = np.unpackbits(packed[rows].view(np.uint8), axis=1, bitorder="little")
                sums = (weights[:, rows] @ on).astype(np.int64)
                at = np.flatnonzero(sums[0])
                columns = [pa.array([graph] * len(at), pa.string()), pa.array([of] * len(at), pa.int64()), pa.array(at, pa.int32()), *map(pa.array, sums[:, at])]
                yield pa.RecordBatch.from_arrays(columns, names=["graph_id", "set", "at", *names])

    sums = sized.mapInArrow(add, "graph_id string, set long, at int, " + ", ".join(f"{c} long" for c in names))
    return sums.groupBy("graph_id", "set", "at").agg(*[F.sum(c).alias(c) for c in names])


def distinct_contexts(seeds: DataFrame, triples: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """((graph_id, query_id, edges, chars, words, ctx), (graph_id, ctx, context)): the joined context of each query, written out once for all queries that have the same.

    Queries of a graph have the same context if their sentences have the same number, sizes and sums of two hashes of
    64 bits each; only one of them gets rows of its own.
    """
    if depth <= 0:
        none = seeds.select("graph_id", "query_id", *[F.lit(0).cast("long").alias(c) for c in SIZES], F.lit("").alias("ctx"), F.lit("").alias("context")).where("false")
        return none.drop("context"), none.select("graph_id", "ctx", "context")
    told, asked, bits = _told(seeds, triples, depth)
    told = shared_table(told, "told")
    hashes = F.xxhash64("sentence"), F.xxhash64(F.lit("second"), "sentence")
    parts = {f"h{i}_{j}": F.shiftrightunsigned(h, j).bitwiseAND(F.lit((1 << 21) - 1)) for i, h in enumerate(hashes) for j in (0, 21, 42)}
    parts |= {f"top{i}": F.shiftrightunsigned(h, 63) for i, h in enumerate(hashes)}
    of = _summed(told, bits, parts).join(asked, ["graph_id", "set", "at"])
    of = shared_table(of.select("graph_id", "query_id", "set", "at", *SIZES, F.concat_ws(",", *[F.col(c).cast("string") for c in (*SIZES, *parts)]).alias("ctx")), "contexts")
    own = of.groupBy("graph_id", "ctx").agg(F.min(F.struct("set", "at")).alias("of")).select("graph_id", "ctx", "of.*")
    rows = told.join(own, ["graph_id", "set"]).where(F.expr(f"getbit(get(array({', '.join(bits)}), at div 64), at % 64) = 1"))
    texts = rows.groupBy("graph_id", "ctx").agg(F.array_join(F.sort_array(F.collect_set("sentence")), " ").alias("context"))
    return of.drop("set", "at"), texts


#: What is summed of a context.
SIZES = ("edges", "chars", "words")


def retrieve(queries: DataFrame, nodes: DataFrame, triples: DataFrame, k: int = 8, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """The top nodes of each query, and the context of all of them together."""
    best = shared_table(relevant_nodes(queries, nodes, k), "best")
    return best, context(best, triples, depth)


def context_text(found: DataFrame) -> DataFrame:
    return found.groupBy("graph_id", "query_id").agg(F.array_join(F.sort_array(F.collect_set("sentence")), " ").alias("context"))


def retrieval_stats(best: DataFrame, found: DataFrame, k: int, depth: int) -> DataFrame:
    """Sizes of what was retrieved for each query; characters and words of the joined context."""
    tokens: Column = F.size(words(F.col("sentence")))
    sizes = found.groupBy("graph_id", "query_id").agg(F.count("*").alias("edges"), F.sum(F.length("sentence")).alias("chars"), F.sum(tokens).alias("words"))
    return stats_of(best, sizes, k, depth)


def retrieved_sizes(queries: DataFrame, nodes: DataFrame, triples: DataFrame, k: int = 8, depth: int = 2) -> DataFrame:
    """``retrieval_stats`` of what ``retrieve`` finds, without a row for each query and sentence."""
    best = shared_table(relevant_nodes(queries, nodes, k), "best")
    return stats_of(best, context_sizes(best, triples, depth), k, depth)


def stats_of(best: DataFrame, sizes: DataFrame, k: int, depth: int) -> DataFrame:
    nodes = best.groupBy("graph_id", "query_id").agg(F.count_distinct("name").alias("retrieved_node_count"))
    edges = sizes.select("graph_id", "query_id", F.col("edges").alias("retrieved_context_edge_count"), (F.col("chars") + F.col("edges") - 1).alias("retrieved_context_char_length"), F.col("words").alias("retrieved_context_word_count"))
    out = nodes.join(edges, ["graph_id", "query_id"], "left").na.fill(0)
    return out.select("graph_id", "query_id", F.lit(k).alias("top_k"), F.lit(depth).alias("depth"), "retrieved_node_count", *[F.col(c).cast("long").alias(c) for c in ("retrieved_context_edge_count", "retrieved_context_char_length", "retrieved_context_word_count")])
