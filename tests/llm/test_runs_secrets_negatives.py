"""Periodic runs, secret scans and hard negatives against brute force, and their odd cases."""

import hashlib
import itertools
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from graphloom.llm import negatives, runs, secret_scan
from graphloom.llm.common import read
from test_llm import odd_documents

# ---- runs


def brute_runs(words):
    """All runs, a period at a time."""
    least = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                least.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    dropped = {i for start, length, q in found for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in dropped]


def test_runs_by_brute_force():
    rng = random.Random(1)
    for _ in range(800):
        words = [str(rng.randrange(rng.choice([1, 2, 3, 5, 20]))) for _ in range(rng.randint(0, 90))]
        if len(words) > 20 and rng.random() < 0.6:
            a, p = rng.randrange(len(words) // 2), rng.randint(1, len(words) // 3)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        words = words * rng.choice([1, 1, 2, 3])
        found = runs.find_runs(words)
        assert found == brute_runs(words)
        assert runs.collapsed(words, found) == brute_collapsed(words, found)


def test_runs_of_words_that_overlap():
    """Fibonacci words hold as many runs as there are; lists of the ordered sets are split."""
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    full = runs.FULL
    try:
        runs.FULL = 7
        assert runs.find_runs(b) == brute_runs(b) and len(runs.find_runs(b)) > 60
    finally:
        runs.FULL = full


def test_long_runs():
    rng = random.Random(2)
    assert runs.find_runs(["x"] * 50_000) == [(0, 50_000, 1)]
    unit = [str(rng.randrange(900)) for _ in range(7_000)]
    assert runs.find_runs(["start", *unit, *unit, *unit[:99], "end"]) == [(1, 14_099, 7_000)]


def test_runs_query_by_brute_force(spark):
    """The whole query over the whole table, a document at a time."""
    from graphloom.llm.queries import queries

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in read(spark, SF, "documents").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n, h = len(words), crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = brute_runs(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        want.append((r["doc_id"], len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(brute_collapsed(words, found)))))
    got = [tuple(r) for r in queries()["op11_periodic_runs"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in got) > 10


def test_runs_of_odd_documents(spark):
    rows = runs.detect(odd_documents(spark), "doc_id", "size", "kept").collect()
    of = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows}
    assert len(rows) == 8 and of[2] == of[3] == of[4] == ([], "")
    assert of[5] == ([(0, 30_000, 1)], "word") and of[1] == ([], "a b c") and rows[0]["kept"] == 1
    assert runs.detect(odd_documents(spark, False), "doc_id").collect() == []


def test_planted_period_of_odd_documents(spark):
    """Null ids and texts, and texts of blanks, stay as they are."""
    ids = [i for i in range(500) if crc32(str(i).encode()) % 10 == 0][:4]
    data = [(None, "a b c"), (ids[0], None), (ids[1], " \n "), (ids[2], "one"), (ids[3], " a b  c\td e f g h ")]
    got = {r["doc_id"]: r["t"] for r in spark.createDataFrame(data, "doc_id long, text string").select("doc_id", runs.repeating(F.col("text"), F.col("doc_id")).alias("t")).collect()}
    assert got[None] == "a b c" and got[ids[0]] is None and got[ids[1]] == " \n " and got[ids[2]] == "one" and len(got[ids[3]].split(" ")) == 8


# ---- secrets


def test_base_spans():
    spans = lambda t: [(k, t[s:e]) for k, s, e in secret_scan.base_spans(t)]
    assert spans('API_key": "abc/def=ghi-12" é') == [("assign", 'API_key": "abc/def=ghi-12')]
    assert spans("token: secret: abcdefghijklmnop") == []  # the short first match takes its words
    assert spans("tokeN=abcdefghijkl ſecret=abcdefghijklm") == [("assign", "tokeN=abcdefghijkl")]
    assert spans("AKIA" + "X" * 13) == [] and spans("xAKIA" + "X" * 14 + "a") == [("access", "AKIA" + "X" * 14)]
    assert spans("z0123456789abcdefz ABCDEF0123456789") == [("hex", "0123456789abcdef")]
    assert [s[:2] for s in secret_scan.base_spans("token=0123456789abcdef")] == [("assign", 0), ("hex", 6)]


def test_base_spans_by_plain_patterns():
    """Against the contract's own patterns, letters given in both cases."""
    rng = random.Random(4)
    parts = ["password", "SECRET", "api_key", "apikey", "Token", "=", ": ", '"', "'", " ", "AKIA", "ABCDEF0123456789", "deadbeefcafe", "x" * 12, "0123", "\n", "é", "-"]
    both = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", "(password|passwd|secret|token|api_?key)")
    patterns = {"assign": both + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if len(m[2] if k == "assign" else m[0]) >= secret_scan.LENGTHS[k]]
        assert sorted(want) == sorted(secret_scan.base_spans(text))


def some_field(seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    field = secret_scan.Field()
    field.weights[1:] = rng.normal(0, scale, field.weights[1:].shape)
    field.files[:] = rng.normal(0, scale, field.files.shape)
    field.changes[:] = rng.normal(0, 1, (3, 3))
    field.words = frozenset(["token", "the"])
    return field


def test_viterbi_by_all_paths():
    for seed in range(20):
        field, scores = some_field(seed), np.random.default_rng(seed).normal(0, 2, (6, 3))
        value = lambda p: sum(scores[i, t] for i, t in enumerate(p)) + sum(field.changes[a, b] for a, b in zip((0, *p), (*p, 0)))  # noqa: B023, E731
        assert field.viterbi(scores) == list(max(itertools.product(range(3), repeat=6), key=value))


def test_added_spans_by_plain_decoding():
    """Whole texts decoded token by token, without skipping what is outside for sure."""
    rng = random.Random(6)
    words = ["the", "token", "=", '"', "Ab3dE5fG7hI9jK1lM3", "12345", "Été", "x.y.z", "--", "internationalisation", "4f" * 20]
    texts = ["", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    field = some_field(3)
    field.weights[:, 0] += 0.4
    base = [secret_scan.base_spans(t) for t in texts]
    got = secret_scan.added_spans(texts, base, secret_scan.Types(field))
    kinds = 0
    for text, own, spans in zip(texts, base, got):
        tokens, places = secret_scan.tokens_of(text)
        shapes = [secret_scan.shape(t) for t in tokens]
        numbers = [secret_scan.feature_numbers(t, secret_scan.spelling(t, field.words)) for t in tokens]
        bucket = secret_scan.file_bucket(sum(s[1] for s in shapes), sum(s[2] for s in shapes), len(tokens))
        scores = np.array([sum((field.weights[n] for role, o in zip(secret_scan.ROLES, (0, -1, -2, 1)) if 0 <= i + o < len(tokens) for n in numbers[i + o][role]), np.zeros(3)) + field.files[bucket, shapes[i][0]] for i in range(len(tokens))])
        tags = field.viterbi(scores) if tokens else []
        want = []
        for i, tag in enumerate(tags):
            if tag == secret_scan.INSIDE and i and tags[i - 1] != secret_scan.OUT:
                want[-1] = (want[-1][0], places[i][1])
            elif tag != secret_scan.OUT:
                want.append(places[i])
        want = [(s, e) for s, e in want if not any(a < e and s < b for _, a, b in own)]
        assert spans == want
        kinds += len(want)
    assert kinds > 30


def test_expected_tags_by_all_paths():
    rng = np.random.default_rng(8)
    scores, changes = rng.normal(0, 1, (2, 4, 3)), rng.normal(0, 1, (3, 3))
    node, edge = secret_scan._expected(scores, changes)
    for row in range(2):
        weight = {p: math.exp(sum(scores[row, i, t] for i, t in enumerate(p)) + sum(changes[a, b] for a, b in zip((0, *p), (*p, 0)))) for p in itertools.product(range(3), repeat=4)}
        total = sum(weight.values())
        for i, t in itertools.product(range(4), range(3)):
            assert node[row, i, t] == pytest.approx(sum(w for p, w in weight.items() if p[i] == t) / total)
        for i, a, b in itertools.product(range(3), range(3), range(3)):
            assert edge[row, i, a, b] == pytest.approx(sum(w for p, w in weight.items() if p[i : i + 2] == (a, b)) / total)


def test_secrets_are_learned_from_patterns(spark):
    """Formats that no pattern knows are found in documents that weren't learned; clean ones get no span."""
    rng = random.Random(9)
    plain = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    value = lambda letters, n: "".join(rng.choice(letters) for _ in range(n - 2)) + "a7"
    rows = [(i, f'{prose(40)} token = "{value("0123456789abcdef", 40)}" {prose(30)} mail {prose(1)}@{prose(1)}.com {rng.randrange(10**16)}') for i in range(60)]
    rows += [(100 + i, f"{prose(60)} See https://www.{prose(1)}.org/{prose(1)}/{prose(1)}-{prose(1)}.html, {prose(1)}: {rng.randrange(10**9)}.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = secret_scan.train(docs)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = [(1000 + i, f"{prose(20)} Authorization: Bearer {v} {prose(20)}", v) for i in range(40) for v in [value(mixed, 36)]]
    clean = [(2000 + i, f"{prose(40)} {prose(1)}: {prose(3)}, {rng.randrange(10**12)} {prose(1)}@{prose(1)}.org.") for i in range(80)]
    new = spark.createDataFrame([*[(i, t) for i, t, _ in planted], *clean], "doc_id long, text string")
    found = {r["doc_id"]: [s["text"] for s in r["added"]] for r in secret_scan.scan(new, field, "doc_id").collect()}
    assert sum(found[i] == [v] for i, _, v in planted) >= 36
    assert sum(bool(found[i]) for i, *_ in clean) <= 2
    again = secret_scan.train(docs.repartition(5))
    assert (again.weights == field.weights).all() and (again.changes == field.changes).all()


def test_secrets_of_odd_documents(spark):
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(7, "token=abcdefghijklmnop " * 3, "en", "s")], "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "size": F.lit(7), "score": F.lit("x"), "kept": F.lit(1), "word": F.lit("w")}))
    for field in (secret_scan.train(docs), secret_scan.train(docs.where("doc_id < 7"))):
        rows = secret_scan.scan(docs, field, "doc_id", "kept").collect()
        of = {r["doc_id"]: r for r in rows}
        assert len(rows) == 9 and all(not r["base"] for r in rows if r["doc_id"] != 7) and [s["start"] for s in of[7]["base"]] == [0, 23, 46]
    assert all(not r["added"] for r in rows)  # nothing was labelled
    empty = odd_documents(spark, False)
    assert secret_scan.scan(empty, secret_scan.train(empty), "doc_id").collect() == []


def test_secrets_query(spark):
    from graphloom.llm.queries import queries

    texts = {r["doc_id"]: r["text"] or "" for r in read(spark, SF, "documents").collect()}
    rows = queries()["op12_secrets"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = secret_scan.base_spans(texts[r["doc_id"]])
        written = [f"{k}:{s}:{e}" for k, s, e in own]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secret_scan.LENGTHS] == [sum(x[0] == k for x in own) for k in secret_scan.LENGTHS]
        every = r["spans"].split(",") if r["spans"] else []
        assert [x for x in every if not x.startswith("crf:")] == written and len(every) == len(own) + r["n_added"]


# ---- hard negatives


def brute_negatives(data, asked, scale=256.0, k=5):
    good = [(i, y, [math.floor(scale * x) for x in e]) for i, y, e in data if None not in (i, y, e) and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for anchor in sorted({i for i, *_ in good if asked(i)}):
        label, v = min((y, e) for i, y, e in good if i == anchor)
        scored = sorted((-sum(a * b for a, b in zip(v, e)), i, y) for i, y, e in good if i != anchor)
        for score, i, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(s, j) for s, j, y in scored if y != label and 80 * -score <= 100 * -s <= 100 * -score][:k]
            out += [(anchor, i, rank + 1, j, -score, -s) for rank, (s, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, data, asked="id % 20 = 0"):
    rows = negatives.valid(spark.createDataFrame(data, "vec_id long, label int, e array<double>"), "vec_id", "label", "e")
    return sorted(tuple(r) for r in negatives.mine(rows, rows.where(asked)).collect())


@pytest.mark.parametrize("block", [4, 8192])
def test_negatives_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    rng = random.Random(3)
    near = [rng.gauss(0, 1) for _ in range(6)]
    data = [(i, rng.randrange(3), [x + rng.gauss(0, 0.2) for x in near][: 5 + i % 2]) for i in range(100)]
    data += [(i, 5, [rng.gauss(0, 1) for _ in range(6)]) for i in range(100, 130)]
    data += [(500, 1, None), (501, None, [1.0]), (520, 1, [1.0, None]), (540, 1, [float("nan")]), (560, 1, [float("-inf")]), (None, 1, [1.0]), (580, 1, [])]
    data += [(7, data[7][1], data[7][2])] * 3  # the same row again
    data += [(i, 9, [0.0, 0.0]) for i in range(600, 640)]  # ties, and scores of zero
    got = mined(spark, data)
    assert got == brute_negatives(data, lambda i: i % 20 == 0) and len(got) > 60
    assert any(r[4] == 0 for r in got)


def test_negatives_of_one_hot_label_and_id(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rng = random.Random(5)
    data = [(1, 0, [1.0, 1.0])] * 60 + [(i, i % 2, [1 + rng.random(), 1.0]) for i in range(2, 90)]
    assert mined(spark, data) == brute_negatives(data, lambda i: i % 20 == 0)


def test_negatives_beyond_doubles_and_of_empty_tables(spark):
    data = [(i, i % 2, [1e12 + i, 3.0 * i]) for i in range(0, 60, 5)]
    assert mined(spark, data) == [] or all(r[4] <= negatives.ENDS[1] for r in mined(spark, data))
    small = [(i, i % 2, [2.0**20 + i, 2.0**21 - 3 * i]) for i in range(0, 60, 5)]
    assert mined(spark, small) == brute_negatives(small, lambda i: i % 20 == 0) != []
    assert mined(spark, []) == [] and mined(spark, [(0, None, [1.0])]) == []
