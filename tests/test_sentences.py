"""The trained sentence splitter: learning against a plain version, and what it splits."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import chunks, sentences


def plain_learn(texts):
    """The splitter, a token at a time."""
    strip = lambda raw: re.sub(f"^[{sentences.OPENERS}]+|[{sentences.CLOSERS}]+$", "", raw)
    rows = []
    for text in texts:
        before = None
        for raw in (text or "").split():
            bare = strip(raw)
            word = sentences._type(bare)
            if not word:
                continue
            own = (word, bare.endswith(".") and not bare.endswith(".."), bare[-1:] in "!?", bare[:1].isupper(), bare[:1].islower())
            rows.append((own, before))
            before = own
    n, dots, low = Counter(o[0] for o, _ in rows), Counter(o[0] for o, _ in rows if o[1]), Counter(o[0] for o, _ in rows if o[4])
    within = Counter(o[0] for o, b in rows if o[3] and b and not b[1] and not b[2])
    total, p = len(rows), sum(dots.values()) / max(len(rows), 1)
    short = set()
    for w, a in dots.items():
        if any(c.isalpha() for c in w):
            b, size = n[w] - a, len(w.replace(".", ""))
            value = 2 * (a * (math.log(0.99) - math.log(p)) + (b * (math.log(0.01) - math.log(1 - p)) if b else 0))
            if value * math.exp(-size) * (len(w) - size + 1) * size**-b >= 0.3:
                short.add(w)

    def ratio(both, first, second):
        cells = [(both, first * second), (first - both, first * (total - second)), (second - both, (total - first) * second), (total - first - second + both, (total - first) * (total - second))]
        return 2 * sum(o * math.log(o * total / e) for o, e in cells if o > 0)

    after = Counter(o[0] for o, b in rows if b and (b[2] or b[1] and b[0] not in short))
    for o, b in rows:  # a token with a period and a mark counts by its period
        if b and b[1] and b[2]:
            raise AssertionError
    ends = sum(after.values())
    starters = {w for w, k in after.items() if w[0].isalpha() and k / ends > n[w] / total and ratio(k, ends, n[w]) >= 30}
    doubt = lambda b: b and b[1] and (b[0] in short or b[0] == "##" or len(b[0]) == 1 and b[0].isalpha())
    pairs = Counter((b[0], o[0]) for o, b in rows if doubt(b))
    tied = {(a, w) for (a, w), k in pairs.items() if k / n[a] > n[w] / total and ratio(k, n[a], n[w]) >= 7.88}
    met = {w for _, w in pairs}
    return sentences.Splitter(frozenset(short), frozenset(starters), frozenset(tied), frozenset(w for w in met if low[w] and not within[w]), frozenset(w for w in met if not low[w]))


def corpus(seed=1, n=150):
    """Plain prose with doctors, initials, dates and dots."""
    rng = random.Random(seed)
    nouns = ["house", "river", "letter", "garden", "window", "stone", "morning", "story"]
    verbs = ["saw", "left", "found", "kept", "wrote", "made"]
    names = ["Smith", "Brown", "Keller", "Moreau"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(3, 9)):
            who = rng.choice(["The " + rng.choice(nouns), "Dr. " + rng.choice(names), "Mr. " + rng.choice(names), rng.choice("ABJ") + ". " + rng.choice(names), "It"])
            rest = rng.choice(["the " + rng.choice(nouns), "it on 3. May", "a " + rng.choice(nouns) + " etc. and more", "(the " + rng.choice(nouns) + ")"])
            parts.append(f"{who} {rng.choice(verbs)} {rest}{rng.choice(['.', '.', '.', '!', '?', '...'])}")
        out.append(rng.choice([" ", "\n"]).join(parts))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_learning_by_a_plain_version(spark, seed):
    texts = [*corpus(seed), None, "", " \n ", "...", "One."]
    got = sentences.learn(frame(spark, texts).repartition(3))
    assert got == plain_learn(texts)
    assert {"dr", "mr"} <= got.abbreviations and not {"house", "it", "river"} & got.abbreviations


def test_what_is_split(spark):
    splitter = sentences.learn(frame(spark, corpus(3, 300)))
    assert splitter.sentences("Dr. Smith saw the river. It left! The story (it was long) ended. \"So.\" Mr. Brown wrote?\nThe house") == [
        "Dr. Smith saw the river.", "It left!", "The story (it was long) ended.", '"So."', "Mr. Brown wrote?", "The house"]
    assert splitter.sentences("J. Keller found it on 3. May. The end.") == ["J. Keller found it on 3. May.", "The end."]
    assert splitter.sentences("He waited... and left.") == ["He waited... and left."]
    assert splitter.sentences(None) == splitter.sentences(" \n ") == []
    assert sentences.Splitter().sentences("Dr. Smith left.") == ["Dr.", "Smith left."]


def test_splitting_and_chunks(spark):
    docs = frame(spark, ["Dr. Smith saw it. It left.", None, ""]).withColumn("n", F.lit(1))
    splitter = sentences.Splitter(frozenset(["dr"]))
    got = {r["doc_id"]: r["sentences"] for r in sentences.split(docs, splitter, "doc_id", "n").collect()}
    assert got == {0: ["Dr. Smith saw it.", "It left."], 1: [], 2: []}
    of = lambda **o: [r["text"] for r in chunks.chunks(docs.where("doc_id = 0"), 12, drop_empty=True, **o).orderBy("chunk_id").collect()]
    assert of(splitter=splitter) == ["Dr. Smith", "saw it.", "It left."] and of()[0] == "Dr."
    empty = sentences.learn(docs.limit(0))
    assert empty == sentences.Splitter() and sentences.split(docs.limit(0), empty, "doc_id").collect() == []


def test_a_model_is_bounded(spark):
    model = sentences.learn(frame(spark, corpus(4)), most=1)
    assert all(len(x) <= 1 for x in (model.abbreviations, model.starters, model.collocations, model.begins, model.names))


def test_a_large_model_is_whole(spark):
    """Nothing is left out unless asked for: a model beyond what is broadcast stays tables, and splits as the whole one does."""
    texts = [*corpus(5), corpus(6)[0], None, "", " \n ", "...", "One.", "Dr. J. Keller left. Dr. J. Keller left. 3. May it. 3. may"]
    docs = frame(spark, [*texts, texts[0]])
    whole, tables = sentences.learn(docs), sentences.learn(docs, local=0)
    assert whole == plain_learn([*texts, texts[0]]) and isinstance(tables, sentences.TableSplitter)
    of = lambda splitter: [r["sentences"] for r in sentences.split(docs, splitter, "doc_id").orderBy("doc_id").collect()]
    assert of(tables) == of(whole) == [whole.sentences(t) for t in [*texts, texts[0]]]


def test_no_bound_leaves_entries_out():
    import inspect

    assert inspect.signature(sentences.learn).parameters["most"].default is None
