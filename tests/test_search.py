"""BM25 by blocks and hybrid ranking by thresholds against plain versions of both."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import lexical, retrieve


def plain_bm25(corpus, text):
    docs = {n: (t or "").lower().split() for n, t in corpus}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(t for own in docs.values() for t in set(own))
    weight = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(weight.values()) / len(weight) if weight else 0
    weight = {t: w if w >= 0 else floor for t, w in weight.items()}
    out = defaultdict(float)
    for t, qf in Counter((text or "").lower().split()).items():
        for name, own in docs.items():
            if t in own:
                tf = own.count(t)
                out[name] += qf * weight[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / mean))
    return out


def plain_cosine(a, b):
    length = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / length if length else 0.0


def ranked(scores, k):
    best = sorted((-round(s, 6), n) for n, s in scores.items())[:k]
    return [(n, -s, i + 1) for i, (s, n) in enumerate(best)]


def agree(rows, want):
    got = defaultdict(list)
    for r in rows:
        got[r["query_id"]].append((r["rank"], r["name"], r["score"]))
    assert set(got) == {q for q, x in want.items() if x}
    for q, own in got.items():
        assert [n for _, n, _ in sorted(own)] == [n for n, *_ in want[q]]
        assert [s for *_, s in sorted(own)] == pytest.approx([s for _, s, _ in want[q]], abs=2e-6)


def corpus_of(rng, n, vocabulary=40, every="all"):
    """Texts of words of falling frequency; one word stands in all of them."""
    return [(f"n{i:04}", " ".join([every, *(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(rng.randint(0, 12)))])) for i in range(n)]


@pytest.mark.parametrize("k,n,block", [(3, 200, 8), (16, 60, 1024), (16, 10, 4)])
def test_bm25_top_k_by_plain_scores(spark, monkeypatch, k, n, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = random.Random(n)
    corpus = [*corpus_of(rng, n), ("empty", ""), ("null", None)]
    asked = [(i, t) for i, (_, t) in enumerate(rng.sample(corpus[:n], 8))] + [(90, None), (91, "unknown words"), (92, "all"), (93, "W1 w1 all all w39")]
    index = lexical.build(spark.createDataFrame(corpus, "name string, text string"))
    got, _ = lexical.bm25_top_k(index, spark.createDataFrame(asked, "query_id long, text string"), k)
    agree(got.collect(), {q: ranked(plain_bm25(corpus, t), k) for q, t in asked})


def test_words_of_most_rows_weigh_less_than_nothing(spark):
    """Where most words are frequent the mean weight, and so theirs, is negative."""
    corpus = [(f"n{i}", "a b c" + (" d" if i % 2 else "") + (" e" if i == 3 else "")) for i in range(12)]
    asked = [(1, "a d"), (2, "e a b"), (3, "a")]
    index = lexical.build(spark.createDataFrame(corpus, "name string, text string"))
    for k in (2, 5, 20):
        got, _ = lexical.bm25_top_k(index, spark.createDataFrame(asked, "query_id long, text string"), k)
        agree(got.collect(), {q: ranked(plain_bm25(corpus, t), k) for q, t in asked})


def test_a_word_of_every_row_is_not_read(spark):
    rng = random.Random(3)
    corpus = [(f"n{i:05}", f"all w{i % 700} " + " ".join(f"x{rng.randrange(3000)}" for _ in range(4))) for i in range(6000)]
    index = lexical.build(spark.createDataFrame(corpus, "name string, text string"))
    assert index.blocks.where("term = 'all'").count() > 4 and index.blocks.agg(F.max("n")).first()[0] < 2 * lexical.BLOCK
    asked = spark.createDataFrame([(i, f"all w{i}") for i in range(20)], "query_id long, text string")
    got, met = lexical.bm25_top_k(index, asked, 3)
    agree(got.collect(), {q: ranked(plain_bm25(corpus, f"all w{q}"), 3) for q in range(20)})
    assert all(r["postings"] < 100 for r in lexical.met_postings(met).collect()) and met.where("term = 'all'").isEmpty()


def hybrid(spark, corpus, texts, vectors, asked, k, depth=4):
    index = lexical.build(spark.createDataFrame(corpus, "name string, text string"))
    frame = lambda rows, columns: spark.createDataFrame([("g", *r) for r in rows], "graph_id string, " + columns)
    got, met = lexical.hybrid_top_k(index, spark.createDataFrame(texts, "query_id long, text string"), frame(asked, "query_id long, q array<double>"), frame(vectors, "name string, embedding array<double>"), k, depth=depth)
    text = dict(texts)
    want = {}
    for q, v in asked:
        bm = plain_bm25(corpus, text.get(q))
        want[q] = ranked({n: 0.5 * bm.get(n, 0.0) + 0.5 * plain_cosine(v, e) for n, e in vectors}, k)
    agree(got.collect(), want)
    return met


@pytest.mark.parametrize("seed,n,k,depth", [(1, 150, 4, 1), (2, 150, 4, 2), (3, 9, 16, 4)])
def test_hybrid_top_k_by_plain_scores(spark, seed, n, k, depth):
    rng = random.Random(seed)
    corpus = corpus_of(rng, n)
    vectors = [(name, [rng.gauss(0, 1) for _ in range(4)]) for name, _ in corpus] + [("bare", [0.0, 0.0, 0.0, 0.0]), ("only", [1.0, 0.0, 0.0, 0.0])]
    corpus = [*corpus, ("nowhere", "w1 w2 w3")]
    texts = [(i, rng.choice(corpus)[1]) for i in range(6)] + [(6, "unknown"), (7, "all")]
    hybrid(spark, corpus, texts, vectors, [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(9)], k, depth)


def test_hybrid_of_few_words_and_many_like_vectors(spark):
    """One name has a great BM25, all others share no word and lie at the same angle: ties go by name."""
    corpus = [("best", "rare word here"), *((f"n{i}", "other") for i in range(40))]
    vectors = [("best", [0.0, 1.0]), *((f"n{i}", [1.0, 0.0]) for i in range(40))]
    hybrid(spark, corpus, [(1, "rare word"), (2, None)], vectors, [(1, [1.0, 0.1]), (2, [1.0, 0.1])], 3, 1)


def test_hybrid_scores_few_pairs(spark):
    rng = random.Random(5)
    corpus = [(f"n{i:04}", f"all w{i % 90}") for i in range(1200)]
    vectors = [(n, [rng.gauss(0, 1) for _ in range(6)]) for n, _ in corpus]
    met = hybrid(spark, corpus, [(i, f"all w{i}") for i in range(10)], vectors, [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(10)], 4)
    assert met.groupBy("query_id").count().agg(F.max("count")).first()[0] < 100


def test_retrieval_functions_of_all_pairs(spark):
    corpus = corpus_of(random.Random(8), 20)
    got = retrieve.bm25_scores(spark.createDataFrame([(1, "all w1")], "query_id long, text string"), spark.createDataFrame(corpus, "name string, text string"))
    want = plain_bm25(corpus, "all w1")
    assert {r["name"]: r["score"] for r in got.collect()} == pytest.approx(dict(want))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_contexts_by_blocks_of_hubs(spark, monkeypatch, depth):
    """A hub of many blocks, loops, parallel edges and several sets of queries against a plain walk; absent and repeated seeds too."""
    monkeypatch.setattr(retrieve, "EDGE_BLOCK", 4)
    monkeypatch.setattr(retrieve, "QUERY_SET", 2)
    rng = random.Random(depth)
    rows = [("g", "hub", "r", f"n{i}") for i in range(60)] + [("g", f"n{rng.randrange(90)}", rng.choice("pq"), f"n{rng.randrange(90)}") for _ in range(80)]
    rows += [("h", "hub", "r", "n1"), ("g", "hub", "r", "hub"), ("g", "n1", "a", "n2"), ("g", "n1", "z", "n2")]
    seeds = [("g", q, f"n{7 * q}") for q in range(9)] + [("g", 3, "n1"), ("g", 3, "n1"), ("h", 1, "hub"), ("g", 50, "none")]
    edges = {}
    for g, a, r, b in rows:
        edges[g, a, b] = max(r, edges.get((g, a, b), r))
    want = set()
    for g, q in {x[:2] for x in seeds}:
        at = {n for h, p, n in seeds if (h, p) == (g, q)}
        for _ in range(depth - 1):
            at |= {b for h, a, b in edges if h == g and a in at} | {a for h, a, b in edges if h == g and b in at}
        want |= {(g, q, f"{a} {r} {b}.") for (h, a, b), r in edges.items() if h == g and (a in at or b in at)}
    kg = spark.createDataFrame(rows, "graph_id string, s string, p string, o string")
    got = [tuple(r) for r in retrieve.context(spark.createDataFrame(seeds, "graph_id string, query_id int, name string"), kg, depth).collect()]
    assert sorted(got) == sorted(want)
    held = retrieve.neighbourhoods(kg)
    assert held.where("name = 'hub' and graph_id = 'g'").count() >= 60 // 4 and held.agg(F.max(F.size("edges"))).first()[0] <= 4


def test_copies_are_indexed_once(spark):
    """Many rows of few texts, in other orders and cases too: a posting for each text, ties of copies by name."""
    corpus = [(f"n{i:04}", ["a b c", "C a b", "a d", "e e a"][i % 4]) for i in range(600)]
    asked = [(i, ["a b", "B A", "e d", "c c a"][i % 4]) for i in range(40)]
    index = lexical.build(spark.createDataFrame(corpus, "name string, text string"))
    got, _ = lexical.bm25_top_k(index, spark.createDataFrame(asked, "query_id long, text string"), 5)
    agree(got.collect(), {q: ranked(plain_bm25(corpus, t), 5) for q, t in asked})
    assert index.postings.count() == 7 and index.members.count() == 600
    rng = random.Random(2)
    vectors = [(n, [rng.gauss(0, 1) for _ in range(4)]) for n, _ in corpus[::3]]
    hybrid(spark, corpus, asked, vectors, [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)], 5)


def test_contexts_hold_queries_as_bits(spark):
    """A hundred queries that reach one hub: sentences are shuffled once for all of them, not a row for each."""
    kg = spark.createDataFrame([("g", f"n{i}", "r", "hub") for i in range(100)], "graph_id string, s string, p string, o string")
    found = retrieve.context(spark.createDataFrame([("g", i, f"n{i}") for i in range(100)], "graph_id string, query_id int, name string"), kg, 2)
    assert found.count() == found.distinct().count() == 100 * 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "query_id" not in "".join(line for line in plan.splitlines() if "Aggregate" in line and "sentence" in line)
