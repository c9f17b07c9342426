import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from graphloom.llm import neardup


def weights(text):
    w = text.encode().lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def both(a, b):
    """Probability Jaccard and plain Jaccard by definition."""
    if not set(a) & set(b):
        return 0.0, 0.0
    union = set(a) | set(b)
    jp = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in union) for d in set(a) & set(b))
    return jp, len(set(a) & set(b)) / len(union)


def brute(rows):
    """Classes by comparing all pairs of texts."""
    texts = sorted({t for _, t in rows if t is not None})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    w = {t: weights(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if max(both(w[a], w[b])) >= 0.8:
                parent[find(a)] = find(b)
    names = {}
    for i, t in rows:
        if t is not None and i is not None:
            names[find(t)] = min(i, names.get(find(t), i))
    return sorted(((i, names.get(find(t)) if t is not None else i) for i, t in rows), key=str)


def family(rng, words, copies, edits):
    base = [rng.choice(words) for _ in range(120)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(words) + "x"
        out.append(" ".join(own))
    return out


def test_classes_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [t for edits in (2, 5, 8) for t in family(rng, words, 25, edits)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    texts += ["", "", "  \n", "one", "one", "One", "a b c", "spam " * 300, "spam " * 299, None, None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "nobody"), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("class_id", F.lit(1))
    got = sorted(((r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect()), key=str)
    assert got == brute([r for r in rows if r[0] is not None]) + [] or got == sorted(brute(rows), key=str)


def test_either_similarity_links_whoever_is_the_pivot(spark):
    """Texts alike as sets but not as weighted shingles are linked in a large bucket too."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(6):
        base = [rng.choice(words) for _ in range(150)]
        rows += [(len(rows) + k, " ".join([f"x{group}-{k}", *base, *(base[:9] * (1 + 12 * (k % 4)))])) for k in range(12)]
    texts = [weights(t) for _, t in rows]
    kinds = {(jp >= 0.8, j >= 0.8) for i, a in enumerate(texts) for b in texts[:i] for jp, j in [both(a, b)]}
    assert (False, True) in kinds and (True, True) in kinds
    got = sorted(((r["doc_id"], r["class_id"]) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_classes_of_the_table_are_those_of_all_pairs(spark):
    """On the given documents every link that comparing all pairs finds is found: recall 1."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").cache()
    got = sorted(((r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()]) and len({c for _, c in got}) < len(got)


def test_one_of_each_class_stays(spark):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (7, "x"), (None, None), (9, None)]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_copy", F.lit(0)))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == [(2, "a b c d e f"), (7, "x"), (9, None), (None, None)]
    assert kept.columns == ["doc_id", "text", "_copy"]


def test_empty_table(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = random.Random(8)
    for _ in range(5):
        a = Counter({i: rng.randint(1, 4) for i in range(80)})
        b = Counter({i: rng.randint(1, 4) for i in range(20, 100)})
        items = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        owner = np.repeat([0, 1], 80)
        hits = []
        for salt in range(24):
            sign = neardup.signatures(owner, neardup.mixed(items + np.uint64(salt * 1000003)), np.array([*a.values(), *b.values()], float), 2)
            hits.append((sign[0] == sign[1]).mean())
        assert np.mean(hits) == pytest.approx(both(a, b)[0], abs=0.04)


def test_similarity_is_exact():
    rng = random.Random(6)
    for _ in range(20):
        a = Counter(rng.randint(0, 12) for _ in range(25))
        b = Counter(rng.randint(0, 12) for _ in range(25))
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert neardup.similarity(*arrays) == pytest.approx(both(a, b))


def test_near_copies_without_an_id_name_no_class(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = family(rng, words, 9, 2)
    rows = [(None, min(texts, key=len)), *((i + 3, t) for i, t in enumerate(texts[:6])), *((None, t) for t in texts[6:])]
    nameless = family(rng, words, 3, 2)
    found = neardup.classes(spark.createDataFrame(rows + [(None, t) for t in nameless], "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in found), key=str) == sorted(brute(rows + [(None, t) for t in nameless]), key=str)
    assert sorted(r["doc_id"] for r in found if r["kept"] and r["doc_id"] is not None) == [3] and sum(r["kept"] for r in found) == 2
