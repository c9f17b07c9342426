"""What a task or a Python worker holds doesn't grow with the tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.functions import parse
from graphloom.operators import bounded, components, extract, graph, lexical, sentences
from graphloom.operators.backends import RuleBackend
from graphloom.plans import fixtures


def test_merging_links_holds_numbers_only():
    rng = np.random.default_rng(0)
    batches = [pa.RecordBatch.from_arrays([pa.array(rng.integers(0, 1 << 40, 10_000)) for _ in "uv"], names=["u", "v"]) for _ in range(20)]
    tracemalloc.start()
    rows = sum(b.num_rows for b in components._merged(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 150_000 and peak < 40e6


def test_stars_are_those_of_union_find():
    rng = np.random.default_rng(1)
    for _ in range(100):
        u, v = rng.integers(0, 40, 45), rng.integers(0, 40, 45)
        root = {x: x for x in [*u.tolist(), *v.tolist()]}
        for _ in root:
            for a, b in zip(u.tolist(), v.tolist()):
                root[a] = root[b] = min(root[a], root[b])
        a, b = components._stars(u, v)
        assert dict(zip(a.tolist(), b.tolist())) == {x: r for x, r in root.items() if x != r}


def test_graphs_bound_what_a_task_reads(spark):
    key, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    for name in (key, parts):
        spark.conf.unset(name)
    graph.build(spark.createDataFrame([("g", "a", "p", "b")], "graph_id string, s string, p string, o string"))
    assert int(spark.conf.get(key)) == 8 << 20 and int(spark.conf.get(parts)) == 200


def test_extraction_bounds_batches_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "Ann Bob")], "doc_id long, text string")
    for ask in (lambda: extract.generate(docs, RuleBackend()), lambda: sentences.split(docs, sentences.Splitter(), "doc_id"), lambda: extract._answers(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("prompt")), RuleBackend(), "", extract.ExtractConfig())):
        spark.conf.unset(key)
        ask()
        assert int(spark.conf.get(key)) == 1 << 19


def test_a_backend_with_gaps_keeps_no_prompts():
    backend = fixtures.GapsBackend()
    prompts = [f"{i:05d}" + "x" * 1000 for i in range(12_000)]
    for p in prompts:
        backend._missing(p)
    assert len(backend.asked) <= 10_000 and max(map(len, backend.asked)) == 16


def test_centres_go_to_blocks_of_rows(spark):
    rng = np.random.default_rng(2)
    rows = [("g", f"n{i}", [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "graph_id string, name string, v array<double>")
    held = vectors.select("graph_id", F.lit(0).cast("long").alias("first"), F.lit(70).cast("long").alias("m"), "name", F.md5("name").alias("key"), "v")
    got = bounded._ranked(held)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    by_key = sorted(held.collect(), key=lambda r: r["key"])
    v = np.array([r["v"] for r in by_key])
    order = np.argsort(bounded.distances(v, bounded.lloyd(v, bounded.FAN)), 1, kind="stable").tolist()
    assert {r["name"]: list(r["order"]) for r in got.collect()} == {r["name"]: o for r, o in zip(by_key, order)}


def test_counts_of_different_tokens_are_those_of_all(spark):
    docs = spark.createDataFrame([(1, 'Dr. Ann said: "No." e.g. 3.5 or 7, ... dr. no! Dr'), (2, "No no. NO dr. ..."), (3, None)], "doc_id long, text string")
    want = sentences.word_counts(sentences.token_pairs(docs)).select("w", "n", "n_dot").collect()
    assert sorted(sentences.type_counts(docs).collect()) == sorted(want) and want


def test_a_line_is_stripped_once(spark):
    line = spark.range(1).select(parse.relation_line(F.lit("a | b | c")).alias("t"))
    assert str(line._jdf.queryExecution().logical()).count("regexp_replace") <= 8


def test_copies_of_a_text_give_their_best_names_only(spark):
    rng = np.random.default_rng(3)
    names = [f"n{i:03d}" for i in range(60)]
    e = {n: [float(x) for x in rng.normal(size=5)] for n in names}
    of = {n: "ab"[i % 2] for i, n in enumerate(names)}
    q = {7: [1.0, 0.0, 0.0, 0.0, 0.0], 9: [0.0, 1.0, 0.0, 0.0, 2.0]}
    found = [(7, "a", 2.0), (9, "a", 1.0), (9, "b", 1.2)]
    got = lexical._best_of_texts(
        spark.createDataFrame(found, "query_id long, text string, bm25 double"), spark.createDataFrame([(t, n) for n, t in of.items()], "name string, member string"),
        spark.createDataFrame(list(q.items()), "query_id long, q array<double>"), spark.createDataFrame(list(e.items()), "name string, embedding array<double>"), 4, 6,
    ).collect()
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    want = set()
    for query in q:
        scores = [(-round(0.5 * b + 0.5 * float(unit(q[query]) @ unit(e[n])), 6), n) for i, t, b in found if i == query for n in names if of[n] == t]
        want |= {(query, n) for _, n in sorted(scores)[:4]}
    assert {tuple(r) for r in got} == want and len(got) == 8
