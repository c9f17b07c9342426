"""The corpus operators against brute force, exact round trips and held-out accuracy, and their odd cases."""

import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF, same_rows
from graphloom.llm import bpe, features, language_model, licenses, mixing, neardup, quality, queries, rules, topk, toxicity, urls
from graphloom.llm.common import read


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


def odd_documents(spark, rows=True):
    """Nulls in all columns, empty and long texts, repeated rows, and columns with clashing names."""
    data = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, None), (None, "x y", "de", "s"), (3, "", "en", None), (4, "  \n ", "fr", "t"), (5, "word " * 30_000, "es", "s"), (6, "é ñ 漢字 \u00a0 z", "de", "t")]
    frame = spark.createDataFrame(data if rows else [], "doc_id long, text string, lang string, source string")
    return frame.withColumns({"n_chars": F.length("text").cast("long"), "size": F.lit(7), "score": F.lit("x"), "kept": F.lit(1), "word": F.lit("w")})


def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (5, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "urls": lambda d, y: urls.judge(d, d.select(F.col("text").alias("url"), F.lit(True).alias("block")), url_col="text"),
    "top k": lambda d, y: topk.top_k(*[topk.quantise(d.withColumn("e", F.array(F.col("doc_id").cast("double"), F.lit(1.0))), "doc_id", "e")] * 2, k=9),
    "rules": lambda d, y: rules.judge(d, y),
    "rules stage": lambda d, y: rules.keep_good(d, y),
    "quality": lambda d, y: quality.score(d, quality.train(d, y), "doc_id"),
    "toxicity": lambda d, y: toxicity.judge(d, y),
    "toxicity stage": lambda d, y: toxicity.keep_clean(d, y),
    "licenses": lambda d, y: licenses.scan(d, "doc_id"),
    "mixing": lambda d, y: mixing.mix(d),
    "mixing stage": lambda d, y: mixing.mixed_rows(d),
    "language model": lambda d, y: language_model.score(d, F.lit(True), "doc_id"),
    "bpe": lambda d, y: bpe.digest_documents(d),
    "bpe full": lambda d, y: bpe.encode_documents(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_documents(spark, name):
    got = OPERATORS[name](odd_documents(spark), odd_labels(spark)).collect()
    assert len(got) == (39 if name == "top k" else 8) or name.endswith("stage")
    assert OPERATORS[name](odd_documents(spark, False), odd_labels(spark).limit(0)).collect() == []


VALUES = {
    "rules": lambda r: (r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"], r["kept"]),
    "quality": lambda r: r["score"], "toxicity": lambda r: (r["score"], r["predicted"]), "licenses": lambda r: r["licenses"], "language model": lambda r: (r["n_tokens"], r["base_score"], r["score"]),
    "bpe": lambda r: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]), "mixing": lambda r: r["size"],
}


@pytest.mark.parametrize("name", sorted(VALUES))
def test_odd_values(spark, name):
    """A null text has an empty one's result, a repeated row the same as its copy, and a text of blanks is as it is said."""
    rows = [(r["doc_id"], VALUES[name](r)) for r in OPERATORS[name](odd_documents(spark), odd_labels(spark)).collect()]
    of = {i: v for i, v in rows}
    first, again = [v for i, v in rows if i == 1]
    assert first == again and of[2] == of[3]
    want = {"rules": (0, 0, 0, True, False), "licenses": [], "mixing": 0}
    if name in want:
        assert of[2] == want[name]
    if name == "rules":
        assert of[5] == (30_000, 120_000, 30_000, True, False) and of[4] == of[3]
    if name == "mixing":
        assert of[5] == 30_000 and of[6] == 5 and of[4] == 0
    if name == "language model":
        assert of[3][0] == 1 and of[4] == of[3] and of[5][0] == 30_001
    if name == "bpe":
        assert of[2][0] == 0 and of[2][2] == hashlib.sha256(b"").hexdigest()
    if name in ("quality", "toxicity"):
        assert all(0 <= (v if name == "quality" else v[0]) <= 1 for v in of.values())


def test_quality_by_plain_python():
    """Scores from the weights, a text and a feature at a time."""
    texts = ["One two two one TWO!", "", "a", "GOOD Words words, words 12 12 x_y", "é漢 " * 5]
    weights = np.random.default_rng(3).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    got = quality.score_texts(texts, weights, features.Words(quality._number))
    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    for text, score in zip(texts, got):
        pieces = features.PIECE.findall(text)
        capital = [len(x) > 3 and x.isupper() for x in pieces]
        names = [features.hashed("^" + x if c else x) for x, c in zip(pieces, capital)]
        words = [quality.REPEAT if any(i >= b and (names[i], capital[i]) == (names[i - b], capital[i - b]) for b in (1, 2)) else n for i, n in enumerate(names)]
        mask, counts = (1 << quality.BITS) - 1, Counter()
        for i, w in enumerate(words):
            counts[signed(w * 0x85EBCA6B) >> 7 & mask] += 1
            if i:
                counts[(signed(words[i - 1] * 0x27D4EB2F) ^ signed(w * 0x165667B1)) >> 9 & mask] += 1
            if capital[i]:
                counts[mask] += 1
        values = {k: math.log(1 + n) for k, n in counts.items()}
        length = math.sqrt(sum(v * v for v in values.values())) or 1.0
        dot = float(weights[-1]) + sum(float(weights[k]) * v / length for k, v in values.items())
        assert score == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-9)


def test_toxicity_by_plain_python():
    """Scores from the net, a window at a time."""
    rng, net = np.random.default_rng(5), toxicity.Net()
    net.table[1:] = rng.normal(0, 1, net.table[1:].shape)
    net.shift[:], net.bias = rng.normal(0, 0.3, net.shift.size), np.float32(0.2)
    texts = ["some words of a text some", "", "one", "ÉÈ Straße 12 two-three"]
    for text, score in zip(texts, net.scores([toxicity.numbers(t) for t in texts])):
        words = toxicity.LETTERS.findall(text.lower())
        vectors = [net.table[1 + features.hashed(w) % (toxicity.BUCKETS - 1)] + net.table[1 + features.hashed(w[:4] + "*") % (toxicity.BUCKETS - 1)] for w in words] + [np.zeros(toxicity.DIM)] * 2
        total = float(net.bias)
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                at = k * toxicity.FILTERS + f
                responses = [sum(float(vectors[i + j] @ net.filters[k][j][:, f]) for j in range(width)) + float(net.shift[at]) for i in range(len(words))]
                total += float(net.out[at]) * max([0.0, *responses])
        assert score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-4)


def test_pipeline_by_brute_force(spark, duck, tokenizer, monkeypatch):
    """The chain of all five stages: each against a plain one on what its predecessor keeps."""
    import corpus_pipeline
    from test_neardup import brute

    stages, seen = corpus_pipeline.STAGES, {}
    docs = read(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count()
    for name, stage in stages[:-1]:
        docs = corpus_pipeline.shared_table(stage(spark, docs, SF), "stage")
        assert docs.columns == read(spark, SF, "documents").columns
        seen[name] = docs.collect()
    sql = queries.oracle_sql()["op10_quality_rules"]
    good = {r[0] for r in duck.execute(f"select doc_id from ({sql}) where kept").fetchall()}
    assert {r["doc_id"] for r in seen["quality rules"]} == good
    kept = [rows[i] for i in sorted(good)]
    net, cuts = toxicity.train(spark.createDataFrame(kept, read(spark, SF, "documents").schema), read(spark, SF, "labels"))
    clean = [r for r in kept if net.scores([toxicity.numbers(r["text"])])[0] < cuts.get(r["lang"], cuts[None])]
    assert {r["doc_id"] for r in seen["toxicity"]} == {r["doc_id"] for r in clean}
    classes = dict(brute([(r["doc_id"], r["text"]) for r in clean]))
    assert {r["doc_id"] for r in seen["minhash near-dedup"]} == set(classes.values())
    single = [r for r in clean if r["doc_id"] in set(classes.values())]
    sizes = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in single}
    copies = Counter(r["doc_id"] for r in seen["mixing sources"])
    by_source, taken = Counter(), Counter()
    for r in single:
        by_source[r["source"]] += sizes[r["doc_id"]]
    for i, n in copies.items():
        taken[rows[i]["source"]] += n * sizes[i]
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight, open_, left, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(names), float(sum(by_source.values())), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * by_source[s]} or open_
        for s in over:
            target[s] = min(share[s], 3.0 * by_source[s])
        left, open_ = left - sum(target[s] for s in over), open_ - over
    largest = {s: max(sizes[r["doc_id"]] for r in single if r["source"] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names) and max(copies.values()) <= 3
    out = corpus_pipeline.run(spark, SF).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert Counter(r["doc_id"] for r in out) == copies
    for r in out:
        ids = tokenizer.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_stages_keep_columns(spark):
    d, y = odd_documents(spark), odd_labels(spark)
    for stage in (rules.keep_good(d, y), toxicity.keep_clean(d, y), mixing.mixed_rows(d)):
        assert stage.columns == d.columns


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_is_the_library(spark, tokenizer):
    rows = bpe.op9_bpe(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_a_task_of_bpe_leaves_no_caches():
    """A worker that other stages use afterwards keeps the tokenizer's tables only; a word is cached once."""
    import pyarrow as pa

    codec = bpe.codec_of(bpe.default_path())
    codec.forget()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["first " + " ".join(f"{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(200))])], names=["doc_id", "text"])
    rows = bpe._made(iter([batch]), codec, bpe._digests, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    assert next(rows).num_rows == 1
    assert len(codec.pieces) == 200 and len(codec.words) == 1
    assert not list(rows)
    assert not codec.pieces and not codec.words and not codec.fits


def test_a_worker_keeps_the_words_of_one_operator():
    one, other = features.Words(len), features.Words(len)
    assert one["ab"] == 2 and one["abc"] == 3
    assert other["abcd"] == 4 and not one and len(other) == 1
    assert one["ab"] == 2 and not other


def test_bpe_of_odd_strings(tokenizer):
    rng, codec = random.Random(7), bpe.codec_of(bpe.default_path())
    letters = list(" \n\t\r\x0b\x1c\x85\xa0'sdtrevmlab1²½Ⅷ一éñ😀_-.!") + ["<|endoftext|>", "  ", "'ll", "the ", " aaaa"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 16)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids
        assert codec.decode(np.array(ids, np.int64)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_mix_by_definition(spark):
    rng = random.Random(3)
    data = [(i, "w " * rng.randint(0, 9), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for i, t, s in data:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_whole_documents_come_near_the_target(spark):
    data = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(200)]
    rows = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), whole=True).collect()
    for s in "ab":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 7 and all(r["taken"] == r["copies"] * r["size"] for r in own)


def test_classifiers_on_held_out_rows(spark):
    """Held-out labelled rows of the table of 1,000 documents; that of 200 has too few labels to learn from."""
    table = SF.replace("0.001", "0.01")
    for query, label, least in (("op2_quality", "quality", 0.9), ("op3_toxicity", "toxic", 0.9)):
        rows = queries.queries()[query](spark, table).join(read(spark, table, "labels"), "doc_id").where("held_out").select(label, "score").collect()
        assert {r[0] for r in rows} == {0, 1}
        assert features.auc(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])) >= least


def test_toxicity_learns_words():
    rng = random.Random(1)
    plain = [f"w{i}"[::-1] + "abcdefgh"[i % 8] for i in range(200)]
    text = lambda bad: " ".join(["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(30)] + (["gromble"] if bad else []))
    net = toxicity.fit([(text(i % 3 == 0), int(i % 3 == 0)) for i in range(240)])
    assert plain and net.scores([toxicity.numbers(text(True))])[0] > 0.7 > net.scores([toxicity.numbers(text(False))])[0]


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Only the last of many labelled rows, by md5, are toxic; a long text counts too."""
    rng = random.Random(3)
    ids = sorted((i for i in range(9800) if crc32(str(i).encode()) % 3 != 1), key=lambda i: hashlib.md5(f"train:{i}".encode()).hexdigest())
    bad = set(ids[6100:])
    text = lambda i: " ".join(["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(6)] + (["gromble"] if i in bad else []))
    rows = [(i, text(i) + " word" * (20_000 if i == ids[6200] else 0), "en") for i in ids]
    d, y = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i in bad)) for i in ids], "doc_id long, toxic int")
    net, cuts = toxicity.train(d, y)
    bad_score, good_score = net.scores([toxicity.numbers("abcd gromble efgh"), toxicity.numbers("abcd efgh")])
    assert len(bad) > 200 and good_score < cuts[None] < bad_score
    again, same = toxicity.train(d.repartition(7), y)
    assert same == cuts and (again.weights() == net.weights()).all()
    rows, blocks = features.labelled_rows(d, y, "toxic", 3, 1, toxicity.code, "lang")
    assert rows.count() == len(ids) and blocks == -(-len(ids) // features.BLOCK_ROWS) > 1
    long = rows.where(F.length("code") > 60_000).first()
    assert len(toxicity.decoded(bytes(long["code"]))) == 20_007


def test_blocks_are_averaged_in_levels(spark, monkeypatch):
    """Blocks that share tasks, added up two at a time, give what a plain average of all blocks gives."""
    size, blocks, rounds = 11, 9, 2
    for name, value in {"SLICE": 4, "FAN": 2, "TASKS": 2, "SEVERAL": 4, "SUM_BYTES": 64}.items():
        monkeypatch.setattr(features, name, value)

    def learn(weights, squares, y, codes, turn, block):
        for label, code in zip(y, codes):
            at = code[0] % size
            squares[at] += 1 + label
            weights[at] += (1 + turn) * 0.1 * code[1] - 0.5 * weights[at]

    rng = random.Random(6)
    data = [(b, f"{i:03}", rng.randrange(2), bytes([rng.randrange(11), rng.randrange(20)])) for i, b in enumerate([rng.randrange(blocks - 1) for _ in range(60)])]  # the last block is empty
    start = np.linspace(0, 1, size).astype(np.float32)
    rows = spark.createDataFrame(rng.sample(data, 60), "block long, place string, y int, code binary").repartition(5)
    got = features.learned(rows, blocks, start, rounds, learn)
    weights, squares = start.astype(np.float64), np.zeros(size)
    for turn in range(rounds):
        whole = total = square = np.zeros(size)
        for b in range(blocks):
            new, more = weights.copy(), squares.copy()
            own = [r for r in data if r[0] == b]
            learn(new, more, [r[2] for r in own], [r[3] for r in own], turn, b)
            added = more - squares
            whole, total, square = whole + added * (new - weights), total + added, square + added**2
        weights, squares = weights + whole / np.maximum(total, 1e-300), squares + square
    assert got.dtype == np.float32 and got == pytest.approx(weights, rel=1e-4)
    assert (features.learned(rows.where("false"), 1, start, rounds, learn) == start).all()


def test_gradients_by_finite_differences():
    """A step's gradients are those of the weighted logistic loss."""
    text = toxicity.numbers("alpha beta gamma delta alpha epsilon zeta")
    for y in (0, 1):
        base = toxicity.Net(3).weights().astype(np.float64)
        weight = toxicity.POSITIVE if y else 1.0

        def loss(weights):
            p = toxicity.Net().take(weights.copy()).scores([text])[0]
            return -weight * math.log(p if y else 1 - p)

        new = base.copy()
        net = toxicity.Net().take(new)
        state = {"rows": [], "into": [], "table": np.zeros_like(net.table)}
        net.learn(np.array(text, np.int64), y, state)
        squares = np.concatenate([state["table"].ravel(), *[state[f"f{k}"].ravel() for k in range(len(net.filters))], state["shift"].ravel(), state["out"].ravel()])
        found = np.sqrt(squares) * np.sign(base[:-1] - new[:-1])
        for i in np.argsort(-np.abs(found))[:: max(1, int((np.abs(found) > 0.02).sum()) // 60)][:60]:
            up, down = base.copy(), base.copy()
            up[i] += 1e-3
            down[i] -= 1e-3
            assert found[i] == pytest.approx((loss(up) - loss(down)) / 2e-3, rel=0.05, abs=5e-3)


def test_segments_give_the_same_scores(monkeypatch):
    net = toxicity.Net()
    texts = [toxicity.numbers(" ".join("abcdefgh"[(i * j) % 8] * 3 for i in range(j))) for j in (0, 1, 5, 40, 90)]
    whole = net.scores(texts)
    monkeypatch.setattr(toxicity, "SEGMENT", 7)
    assert net.scores(texts) == pytest.approx(whole)


def test_top_k_by_brute_force(spark):
    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1 + i % 5) for _ in range(6 + i % 2)]) for i in range(150)] + [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (504, []), (None, [1.0])]
    data += [(7, data[7][1]), (300, data[8][1])]
    vectors = topk.quantise(spark.createDataFrame(data, "vec_id long, e array<double>"), "vec_id", "e")
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("id % 20 = 0 and id <> 500"), 5).collect())
    good = [(i, [math.floor(64 * x) for x in e]) for i, e in data if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:5]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    assert got == sorted(want)


@pytest.mark.parametrize("cosine", [-2.0, 2.0])
def test_either_pruning_is_exact(spark, monkeypatch, cosine):
    monkeypatch.setattr(topk, "LEAST_COSINE", cosine)
    rng = np.random.default_rng(3)
    p, q = rng.integers(-60, 60, (400, 16)), rng.integers(-60, 60, (9, 16))
    p = p[np.argsort(-(p**2).sum(1), kind="stable")]
    least = np.sort(q @ p.T, 1)[:, -4].astype(float)
    best = topk._Best(np.arange(1000, 1009).tobytes(), topk._pack(q.astype(float)), least.tobytes(), 4)
    best.meet(np.arange(400).tobytes(), topk._pack(p.astype(float)))
    for i in range(9):
        want = sorted((-int(x), j) for j, x in enumerate(p @ q[i]))[:4]
        assert [(-int(s), int(j)) for j, s in zip(*best.found[i])] == want


@pytest.mark.parametrize("large", [1e8, 1e15, 1e17, 1e300, 1.7e308])
def test_large_components_score_exactly(spark, large):
    """Scores beyond doubles are exact, those beyond 64 bits stay at the ends of long."""
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(30)] + [(40, [large, -1.0, 3.0]), (41, [-large, 2.0, 0.3]), (60, [0.0, 1.0, 0.3])]
    vectors = topk.quantise(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), 5).collect())
    floor = lambda x: math.floor(64 * x) if math.isfinite(64 * x) else 64 * int(x)
    whole = [(i, [floor(x) for x in e]) for i, e in data]
    want = []
    for q, v in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:5]
            want += [(q, n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(scores)]
    beyond = {q for q, _, _, s in want if abs(s) >= 2**63 - 1}
    assert [r for r in got if r[0] not in beyond] == [r for r in sorted(want) if r[0] not in beyond]
    assert [r[3] for r in got] == [r[3] for r in sorted(want)]


def test_top_k_of_odd_vectors(spark):
    """An empty table gives an empty result; repeated rows are candidates each; shorter vectors end in zeros; other columns don't matter."""
    schema = "vec_id long, embedding array<float>, id string, e int, bucket int, block int"
    rows = [(0, [1.0, 2.0], "a", 1, 1, 1), (1, [1.0], "a", 1, 1, 1), (1, [1.0], "a", 1, 1, 1), (2, [0.0, 0.0, 0.0], "b", 2, 2, 2), (3, [], None, None, None, None), (20, [3.0], None, None, None, None), (20, [3.0], None, None, None, None)]
    vectors = topk.quantise(spark.createDataFrame(rows, schema), "vec_id", "embedding")
    got = [tuple(r) for r in topk.top_k(vectors, vectors.where("id = 0"), 20).orderBy("rank").collect()]
    assert got == [(0, 1, 20, 12288), (0, 2, 20, 12288), (0, 3, 1, 4096), (0, 4, 1, 4096), (0, 5, 2, 0), (0, 6, 3, 0)]
    none = topk.quantise(spark.createDataFrame([], schema), "vec_id", "embedding")
    assert topk.top_k(none, none, 20).collect() == []


def test_language_model_counts(spark):
    rows = language_model.op8_lm_scores(spark, SF).collect()
    docs = {r["doc_id"]: language_model.words_of(r["text"]) for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    counts = Counter(w for i, t in docs.items() if crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        words = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def lm_scores(docs):
    return {r["doc_id"]: r["score"] for r in language_model.score(docs, F.col("doc_id") % 3 != 0, "doc_id").collect()}


@pytest.fixture(scope="module")
def lm_docs(spark):
    return spark.createDataFrame(read(spark, SF, "documents").orderBy("doc_id").limit(30).collect()).repartition(3)


@pytest.fixture(scope="module")
def lm_whole(lm_docs):
    return lm_scores(lm_docs)


@pytest.mark.parametrize("bounds", [{"HEAD": 50, "CACHE": 5, "HELD_TOKENS": 100, "SEATED": 50}, {"HEAD": 0, "CACHE": 0, "FILTERED": 0, "FEW_WORDS": 0}])
def test_language_model_scores_alike_by_cache_and_join(lm_docs, lm_whole, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(language_model, name, value)
    assert lm_scores(lm_docs) == pytest.approx(lm_whole, rel=1e-4)


def test_language_model_after_a_shuffle(spark, lm_docs, lm_whole):
    """Rows keep their scores however the input is dealt out; repeated rows are scored each."""
    docs = lm_docs.join(lm_docs.select("doc_id").hint("merge"), "doc_id").repartition(16, "doc_id")
    assert lm_scores(docs) == pytest.approx(lm_whole, rel=1e-4)
    twice = docs.unionByName(docs.where("doc_id % 3 = 0"))
    assert len(language_model.score(twice, F.col("doc_id") % 3 != 0, "doc_id", "source").collect()) == docs.count() + docs.where("doc_id % 3 = 0").count()


def test_language_model_by_plain_python(spark, lm_docs, lm_whole):
    """Scores from the sampler's tables, worked out token by token."""
    docs = {r["doc_id"]: [language_model.word_id(w) for w in language_model.words_of(r["text"])] for r in lm_docs.collect()}
    types = language_model.shared_table(language_model.count_types(lm_docs.where("doc_id % 3 <> 0")), "types")
    state, rows, parents, d = language_model.gibbs(types, language_model.shared_table(language_model.count_words(types), "words"))
    counts = Counter((u, w) for i, t in docs.items() if i % 3 for u, w in zip([0, *t], t))
    assert {(r["u"], r["w"]): r["n"] for r in types.collect()} == counts
    seen = {(r["u"], r["w"]): r["total"] / len(parents) for r in state.collect()}
    assert seen.keys() == {x for x, n in counts.items() if n > 1}
    follow, kinds = Counter(), Counter()
    for (u, w), n in counts.items():
        follow[u] += n
        kinds[u] += 1
    words = {r["id"]: r for r in rows.collect()}
    total = 0
    for w in {w for _, w in counts}:
        if w not in words:
            assert sum(n for (_, x), n in counts.items() if x == w) == 1
        total += words[w]["own"] if w in words else 1
    assert parents[-1].customers == total  # the parent's customers are its children's tables

    def p(s, w):
        if all(x != w for _, x in counts):
            return parents[s].unknown()
        return words[w][f"p{s}"] if w in words else parents[s].of(1, 1)

    def b(s, u):
        return 1.0 if u not in follow else words[u][f"b{s}"] if u in words else (language_model.STRENGTH + d) / (language_model.STRENGTH + 1)

    for i, t in docs.items():
        want = 0.0
        for u, w in zip([0, *t], t):
            if (u, w) in seen:
                want += math.log10(seen[u, w])
            else:
                mass = (1 - d) / (language_model.STRENGTH + follow[u]) if (u, w) in counts else 0.0
                want += math.log10(mass + sum(p(s, w) * b(s, u) for s in range(len(parents))) / len(parents))
        assert lm_whole[i] == pytest.approx(want, rel=1e-4)
    known = {w for _, w in counts}
    for s in range(len(parents)):  # probabilities of all words and of the unknown one make 1
        assert sum(p(s, w) for w in known) + parents[s].unknown() == pytest.approx(1, rel=1e-6)


@pytest.mark.parametrize("n", [2, 3, 5])
def test_gibbs_draws_the_restaurants_seatings(n):
    """Long runs of the sampler visit seatings as often as their probabilities say."""

    def partitions(n):
        if n == 0:
            yield []
            return
        for rest in partitions(n - 1):
            yield [*rest, 1]
            for i in range(len(rest)):
                yield [*rest[:i], rest[i] + 1, *rest[i + 1 :]]

    d, a, slope = 0.4, 0.7, 0.2
    want = Counter()
    for tables in partitions(n):
        weight = math.prod(a + slope * k for k in range(len(tables))) * math.prod(k - d for size in tables for k in range(1, size))
        want[tuple(sorted(tables, reverse=True))] += weight
    m = 4000
    flat, lengths, ones = np.zeros(0, np.int64), np.zeros(m, np.int64), np.ones(m)
    got, seeds = Counter(), np.random.default_rng(1).integers(0, 2**63, m).astype(np.uint64)
    for sweep in range(12):
        flat, lengths = language_model.reseat(flat, lengths, np.full(m, n), ones * a, ones * slope, d, seeds, sweep)
        if sweep > 3:
            got.update(tuple(sorted(x, reverse=True)) for x in map(tuple, np.split(flat, np.cumsum(lengths)[:-1])))
    for tables, weight in want.items():
        assert got[tables] / sum(got.values()) == pytest.approx(weight / sum(want.values()), abs=0.01)


def test_reseating_follows_its_customers():
    rng = np.random.default_rng(4)
    flat, lengths = np.zeros(0, np.int64), np.zeros(200, np.int64)
    for sweep in range(6):
        n = rng.integers(0, 60, 200)
        flat, lengths = language_model.reseat(flat, lengths, n, np.full(200, 2.0), np.full(200, 0.1), 0.5, np.arange(200, dtype=np.uint64), sweep)
        parts = np.split(flat, np.cumsum(lengths)[:-1])
        assert [int(x.sum()) for x in parts] == n.tolist() and (flat > 0).all() and len(flat) == lengths.sum()


def test_a_sweep_seats_every_customer_anew():
    n = np.array([0, 1, 2, 3, 40, 400])
    flat, lengths = n[n > 0], (n > 0).astype(np.int64)  # one table each
    seeds, ones = np.arange(6, dtype=np.uint64), np.ones(6)
    flat, lengths = language_model.reseat(flat, lengths, n, ones * 1e12, ones, 0.5, seeds, 1)
    assert lengths.tolist() == n.tolist() and (flat == 1).all()  # who is seated anew sits alone


def test_long_types_are_seated_like_short_ones(monkeypatch):
    m = 1500
    n, ones, seeds = np.full(m, 24), np.ones(m), np.random.default_rng(2).integers(0, 2**63, m).astype(np.uint64)
    means = []
    for wide in (64, 8):
        monkeypatch.setattr(language_model, "WIDE", wide)
        flat, lengths, got = np.zeros(0, np.int64), np.zeros(m, np.int64), []
        for sweep in range(12):
            flat, lengths = language_model.reseat(flat, lengths, n - sweep % 2, ones * 0.7, ones * 0.2, 0.4, seeds, sweep)
            assert (np.add.reduceat(flat, np.cumsum(lengths) - lengths) == n - sweep % 2).all()
            if sweep > 3 and sweep % 2 == 0:
                got.append((lengths.mean(), (flat == 1).sum() / m, (flat.astype(float) ** 2).sum() / m))
        means.append(np.mean(got, 0))
    assert means[0] == pytest.approx(means[1], rel=0.04)


def test_license_query_of_planted_texts(spark, tmp_path):
    """Whole texts, cut ones and ones torn apart: the operator and its SQL agree."""
    import duckdb

    rng, rows = random.Random(4), [(0, None), (1, "")]
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        for k in (0, 1, 2, 5, 9):
            at = rng.randrange(len(words) + 1)
            torn = words[: max(1, at)] + [f"z{i}" for i in range(k * 9)] + words[max(1, at) :]
            rows += [(len(rows), " ".join(["w"] * 30 + torn + ["w"] * 30)), (len(rows) + 1, " ".join(words[: len(words) - len(words) * k // 20]))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(licenses.op4_licenses(spark, str(tmp_path)), con, licenses.ORACLE["op4_licenses"])


def test_license_bound_and_odd_texts():
    index = licenses.Index(licenses.TEMPLATES)
    assert min(licenses.collision_bound(len(s)) for s in index.sets) > 0.9999
    notice = licenses.TEMPLATES["gpl-3.0-header"]
    cut = " ".join(notice.split()[:-2])
    far = " ".join([*notice.split()[:20], *(f"x{i}" for i in range(45)), *notice.split()[20:]])  # not in running shingles
    assert index.scan([far]) == [[]]
    whole = licenses.TEMPLATES["mit"]
    assert index.scan([whole, f"a {whole} b"])[1] == index.scan([whole])[0] == ["mit", "mit-permission"]
    assert index.scan([None, "", notice.upper(), f"x {notice} y", cut, "Released under the MIT", "x " * 9 + "Released under the MIT License."]) == [[], [], ["gpl-3.0-header"], ["gpl-3.0-header"], ["gpl-3.0-header"], [], ["mit-notice"]]


@pytest.mark.parametrize("url,want", [
    (None, ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("http://A.com", ("a.com", "", None, "allow")), ("x://Example.COM/en/1?q", ("example.com", "/en/1", "example.com/en/", "block")),
    ("x://a.www.example.com/en/", ("a.www.example.com", "/en/", "www.example.com/en/", "allow")), ("x://a.net/es/1#t", ("a.net", "/es/1", "net/es/", "block")), ("x://net/fr/", ("net", "/fr/", "net/fr/", "block")),
    ("x://a.com?x://b.net/es/", ("a.com", "", None, "allow")), ("x://É.com/", ("É.com", "/", "com/", "allow")), ("x://anet/es/", ("anet", "/es/", None, "allow")),
])
def test_urls(spark, url, want):
    none = spark.createDataFrame([], "url string, block boolean")
    rows = urls.judge(spark.createDataFrame([(1, url)], "page_id int, url string"), none).collect()
    assert [tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in rows] == [want]


def test_mined_rules_block(spark):
    labelled = spark.createDataFrame([(f"http://{'bad' if i % 4 == 0 else 'ok'}.org/{'x' if i % 8 == 0 else 'y'}/{i}", i % 8 == 0) for i in range(200)], "url string, block boolean")
    asked = spark.createDataFrame([("http://bad.org/x/7",), ("http://bad.org/y/7",), ("http://ok.org/y/7",)], "url string")
    assert {r["url"]: r["verdict"] for r in urls.judge(asked, labelled).collect()} == {"http://bad.org/x/7": "block", "http://bad.org/y/7": "allow", "http://ok.org/y/7": "allow"}


def test_binomial_tail(spark):
    rows = spark.createDataFrame([(n, k) for n in (1, 10, 700) for k in (0, 1, 5)], "n long, k long").select("n", "k", rules.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    for r in rows:
        exact = sum(math.comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(1.0 if r["k"] >= r["n"] * 0.01 else exact)


def test_repeats_by_definition(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["a\nb\na\n \n \nb"]
    rows = rules.measure(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), "doc_id").collect()
    for r in rows:
        w = texts[r["doc_id"]].split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert r["n_repeat_words"] == len(covered) and r["n_words"] == len(w)


def test_every_context_has_a_restaurant(spark):
    """What follows a word that isn't among the frequent ones counts in scoring."""
    frequent = " ".join(f"f{i}" for i in range(100) for _ in range(20))
    rows = [(i, f"rare{i % 40} then{i % 40}") for i in range(160)] + [(1000 + i, frequent) for i in range(4)] + [(2000, "rare7 then7"), (2001, "rare7 then8"), (2002, "new then7"), (2003, "rare7 new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in language_model.score(docs, F.col("doc_id") < 2000, "doc_id").collect()}
    assert got[2000] > got[2001] + 1 and got[2000] > got[2002]


def test_language_model_writes_few_bytes_a_token(spark, monkeypatch):
    """Where no word is frequent, what scoring writes beside the sampler's state stays below 40 bytes a token."""
    for name in ("HEAD", "CACHE", "FILTERED"):
        monkeypatch.setattr(language_model, name, 0)
    written, write = Counter(), language_model.shared_table

    def measured(rows, name):
        out = write(rows, name)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out._shared_path)
        written[name] += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        return out

    monkeypatch.setattr(language_model, "shared_table", measured)
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(40_000)}" for _ in range(100))) for i in range(2000)], "doc_id long, text string").repartition(2)
    rows = language_model.score(docs, F.col("doc_id") % 7 != 2, "doc_id").collect()
    tokens = sum(r["n_tokens"] for r in rows)
    assert tokens == 2000 * 101
    assert sum(n for name, n in written.items() if name not in ("seated", "swept")) < 40 * tokens, written


def test_sampler_keeps_no_row_for_a_type(spark, monkeypatch):
    """What a sweep writes are messages of buckets, not rows of types."""
    rows, write = Counter(), language_model.shared_table

    def counted(table, name):
        out = write(table, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(language_model, "shared_table", counted)
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(100)}" for _ in range(100)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert language_model.score(docs, F.lit(True), "doc_id").count() == 300
    types = Counter(x for t in texts for x in zip(t.split(), t.split()[1:]))
    assert sum(n > 1 for n in types.values()) > 5000
    assert sum(n for name, n in rows.items() if name not in ("looked", "worked")) < 500, rows


def test_seating_does_not_depend_on_the_batch():
    """A type's tables are the same whatever else is seated beside it, also where customers have come or gone."""
    rng = np.random.default_rng(3)
    n = rng.integers(1, 120, 300)
    seeds, opening, slope = rng.integers(0, 2**63, 300).astype(np.uint64), np.full(300, 0.7), np.full(300, 0.2)
    flat, lengths = language_model.reseat(np.zeros(0, np.int64), np.zeros(300, np.int64), n, opening, slope, 0.4, seeds, 0)
    later, ends = np.maximum(1, n + rng.integers(-5, 6, 300)), np.cumsum(lengths)
    whole = np.split(*(lambda f, x: (f, np.cumsum(x)[:-1]))(*language_model.reseat(flat, lengths, later, opening, slope, 0.4, seeds, 1)))
    for i in range(300):
        one = slice(i, i + 1)
        alone, _ = language_model.reseat(flat[ends[i] - lengths[i] : ends[i]], lengths[one], later[one], opening[one], slope[one], 0.4, seeds[one], 1)
        assert alone.tolist() == whole[i].tolist()


def test_a_batch_scores_as_each_text_alone():
    net = toxicity.Net()
    rng = np.random.default_rng(2)
    net.shift[:] = rng.normal(0, 0.3, net.shift.size)
    net.table[1:] = rng.normal(0, 1, net.table[1:].shape)
    texts = [toxicity.numbers(t) for t in ("a fine day", "", "awful words open this", "x", "more of it", "a fine day")]
    alone = [net.scores([t])[0] for t in texts]
    assert net.scores(texts) == pytest.approx(alone, rel=1e-5) and net.scores(texts[::-1]) == pytest.approx(alone[::-1], rel=1e-5)


CLASHES = ["_id", "_digest", "_i", "_d", "_key", "_tie", "_source", "_s", "_any", "_range", "_epochs", "_cut", "_copy_of_row", "size", "taken", "kept", "_own_0", "a.b", "_t", "_text", "_cut_symbols", "_stratum", "n_words", "digest"]


def test_stages_mind_no_other_column(spark):
    """Columns named like an operator's own, or with dots, come through the pipeline's stages as they are."""
    d = spark.createDataFrame([(i, f"words {i} " * 40, "en", "s") for i in range(4)] + [(9, "words 1 " * 40, "en", "s")], "doc_id long, text string, lang string, source string")
    d = d.toDF("doc_id", "text", "lang", "source").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    y = odd_labels(spark)
    for stage, rows in ((neardup.keep_one(d), 4), (mixing.mixed_rows(d), 5), (toxicity.keep_clean(d, y), 5), (rules.keep_good(d, y), None)):
        assert stage.columns == d.columns
        got = stage.collect()
        assert (rows is None or len(got) == rows) and all(tuple(r)[4:] == tuple(range(len(CLASHES))) for r in got)


def test_urls_mind_no_other_column(spark):
    none = spark.createDataFrame([], "url string, block boolean")
    pages = spark.createDataFrame([(1, "x://a.com/b", 2, 3, 4, 5, 6, 7), (2, None, 2, 3, 4, 5, 6, 7), (3, "x://" + "a." * 9000 + "com/" + "b/" * 9000, 2, 3, 4, 5, 6, 7)], "page_id int, url string, host int, path int, rule int, verdict int, _tokens int, `a.b` int")
    got = urls.judge(pages, none)
    assert got.columns == ["page_id", "url", "_tokens", "a.b", "host", "path", "rule", "verdict"]
    assert [(r["page_id"], r["_tokens"], r["a.b"], r["host"][-5:], r["rule"], r["verdict"]) for r in got.orderBy("page_id").collect()] == [(1, 6, 7, "a.com", "com/", "allow"), (2, 6, 7, "", None, "allow"), (3, 6, 7, "a.com", "com/", "allow")]
    assert urls.judge(pages.limit(0), none).collect() == []


def test_mined_rules_are_all_frequent_sets(spark):
    """Rules are those that a direct enumeration of the labelled token sets gives, of whatever length; verdicts follow."""
    from itertools import combinations

    rng = random.Random(8)
    rows = []
    for i in range(120):
        tokens = sorted(rng.sample("abcdefg", rng.randint(1, 6)))
        rows.append((tokens, {"a", "b", "c", "d"} <= set(tokens) or rng.random() < 0.1))
    found = urls.mine(spark.createDataFrame(rows, "tokens array<string>, block boolean"), 0.02, 0.8, 1.5, 5).collect()
    want, base = {}, sum(b for _, b in rows) / len(rows)
    for k in range(1, 7):
        for s in combinations("abcdefg", k):
            has = [b for t, b in rows if set(s) <= set(t)]
            if has and sum(has) >= max(5, 0.02 * len(rows)) and sum(has) / len(has) >= max(0.8, 1.5 * base):
                want[s] = sum(has) / len(has)
    assert want and {tuple(r["tokens"]): r["confidence"] for r in found} == pytest.approx(want)
    assert max(map(len, want)) > 3
    sets = spark.createDataFrame([(list(t),) for t in ("abcd", "abce", "gfedcba", "", "a")], "tokens array<string>")
    blocked = {tuple(r["tokens"]) for r in urls.blocked_sets(sets, urls.mine(spark.createDataFrame(rows, "tokens array<string>, block boolean"), 0.02, 0.8, 1.5, 5)).collect()}
    assert blocked == {t for t in map(tuple, ("abcd", "abce", "gfedcba", "a")) if any(set(s) <= set(t) for s in want)}
    assert urls.mine(spark.createDataFrame(rows[:4], "tokens array<string>, block boolean")).collect() == []
