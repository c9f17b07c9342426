"""Secret scans: patterns, and a linear-chain conditional random field that finds what they miss.

Base spans are those of three patterns. The random field tags a text's tokens as the begin of a
secret, inside or outside one. A token's score for a tag is the sum of weights of hashed features:
its shape (kinds of characters, length, changes between letters and digits, variety, vowels) and
spelling (of words met often in learning), spelling and coarse shape of the two tokens before and the one after it, and its coarse
shape together with how rich the file is in random-looking tokens and punctuation. Tags are decoded
by Viterbi. What no token's neighbours could outweigh is outside for sure, so only the
stretches between such tokens are decoded; the result is that of decoding all.

It learns from base spans: the values of key assignments, access keys and hexadecimal runs with a
letter in them are secrets, all else isn't. To be told by more than one format's spelling, each
labelled window is learned again with its value drawn anew in other alphabets and lengths, with
other key words or none, and with an ordinary word, number or address in the value's place,
which is no secret. At most SAMPLE documents with a secret and SAMPLE without, those of least md5,
of at most MAX_CHARS characters, are learned, in one task. Without any labelled span no span is added.

Added spans never overlap base ones, which all stay. Null and empty texts have no spans. Very long
texts are scanned whole. Repeated rows get equal spans; null ids are scanned, not learned. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, UPPER, aside, read, small_batches
from graphloom.llm.features import CACHE, fitted, hashed

#: Fixed patterns of the base spans, by kind, and the least length of a match (of the value of an assignment).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LENGTHS = {"assign": 12, "access": 18, "hex": 16}
KINDS = [*LENGTHS, "crf"]
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# of one run of their characters these two match the whole, so the least length may stand in the pattern
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
#: Texts that may hold a labelled secret, for Spark.
LABELLED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}|AKIA[A-Z0-9]{14}|(?<![0-9a-f])(?=[0-9]*[a-f])[0-9a-f]{16}"""
TOKEN = re.compile(r"[\w+/-]+(?:\.[\w+/-]+)*|[^\w\s+/-]+")

#: Documents of each kind that are learned, the longest in characters; windows of a document without secrets.
SAMPLE, MAX_CHARS, WINDOWS = 400, 20_000, 3
#: Tokens of a window, and redrawn copies of each.
WIDTH, COPIES = 40, 5
BUCKETS, FILES, COARSE = 1 << 14, 16, 256
EPOCHS, BATCH, RATE, MOST = 6, 64, 0.2, 4.0
OUT, BEGIN, INSIDE = range(3)
#: Features of a token by role: its own, those of the one before, of the one before that, and of the one after.
ROLES = {"own": 9, "left": 3, "far": 2, "right": 3}
#: The longest known word, and windows that it is met in at least.
WORDS_MAX, OFTEN = 14, 3
LONG = (3, 6, 9, 12, 16, 24, 32, 48)
VOWELS, CLASSES = set("aeiouyAEIOUY"), [set(LOWER), set(UPPER), set("0123456789"), set("+/_-.")]
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
KEYS = ["password", "passwd", "secret", "token", "api_key", "auth", "bearer", "credential", "private_key", "access_key", "pwd", "client_secret"]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches that are long enough."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LENGTHS["assign"]]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _values(text: str) -> list[tuple[int, int]]:
    """The values that count as secrets when learning."""
    found = [m.span(2) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LENGTHS["assign"]]
    found += [m.span() for m in _ACCESS.finditer(text)] + [m.span() for m in _HEX.finditer(text) if not m[0].isdigit()]
    return sorted(found)


def _step(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n >= b for b in bounds)


def shape(token: str) -> tuple[int, bool, bool]:
    """A token's coarse shape as a number, whether it looks random, and whether it is punctuation."""
    if not (token[0].isalnum() or token[0] in "_+/-"):
        return 0, False, True
    kinds = [*(not own.isdisjoint(token) for own in CLASSES), not token.isascii()]
    mask = sum(1 << i for i, k in enumerate(kinds) if k)
    random_looking = len(token) >= 16 and kinds[2] and (kinds[0] or kinds[1]) and not kinds[4]
    return 1 + mask + 32 * _step(len(token), (3, 6, 10, 14, 20, 32)), random_looking, False


def spelling(token: str, words: frozenset[str]) -> str:
    """The token in lower case if it is one of the words that learning met often, else nothing."""
    low = token.lower() if len(token) <= WORDS_MAX else ""
    return low if low in words else ""


def ordinary(token: str) -> bool:
    """Whether a token is a plain word: its shape is all that tells it from others, besides its spelling."""
    return len(token) < 16 and token.isalpha()


def features(token: str, word: str) -> dict[str, list[str]]:
    """The names of the features of a token spelled as a known word, or as none, by role."""
    coarse, _, punctuation = shape(token)
    near, long = [f"w{word}", f"c{coarse}"], _step(len(token), LONG)
    if punctuation:
        return {"own": [f"w{token[:8]}", "punctuation"], "left": [*near, f"e{token[-1]}"], "far": near, "right": [*near, f"e{token[0]}"]}
    own = [f"w{word}", f"c{coarse}", f"l{long}"]
    if not ordinary(token):
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in token]
        changes = sum((a == "d") != (b == "d") for a, b in zip(kinds, kinds[1:]))
        cases = sum(a + b in ("lu", "ul") for a, b in zip(kinds, kinds[1:]))
        letters = [c for c in token if c.isalpha()]
        vowels = int(4 * sum(c in VOWELS for c in letters) / len(letters)) if letters else -1
        even = all(c in "0123456789abcdefABCDEF" for c in token) and "d" in kinds and len(letters) > 0
        variety = int(6 * len(set(token)) / min(len(token), 36))
        own += [f"x{even}{long}", f"d{_step(changes, (1, 2, 4, 8))}l{long}", f"u{_step(cases, (1, 2, 4, 8))}l{long}", f"v{vowels}l{long}", f"n{variety}l{long}", f"s{'s' in kinds}{token.count('.')}"]
    return {"own": own, "left": near, "far": near, "right": near}


def feature_numbers(token: str, word: str) -> dict[str, list[int]]:
    """Buckets of the features; bucket 0 stands for none."""
    return {role: [1 + hashed(f"{role}:{name}") % (BUCKETS - 1) for name in names] for role, names in features(token, word).items()}


def file_bucket(random_looking: int, punctuation: int, tokens: int) -> int:
    """A file's features: how many random-looking tokens, and the share of punctuation."""
    return _step(random_looking, (1, 2, 5)) * 4 + _step(100 * punctuation // max(tokens, 1), (6, 15, 30))


class Field:
    """Weights of the features, of the file's features with coarse shapes, and of the changes between tags; the known words."""

    def __init__(self) -> None:
        self.weights = np.zeros((BUCKETS, 3))
        self.files = np.zeros((FILES, COARSE, 3))
        self.changes = np.zeros((3, 3))
        self.words: frozenset[str] = frozenset()

    def slack(self) -> float:
        """How much the tags beside it can speak for a tag other than outside, at most."""
        t = self.changes
        return max(t[a, x] + t[x, b] - t[a, OUT] - t[OUT, b] for a in range(3) for b in range(3) for x in (BEGIN, INSIDE))

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags of a stretch that lies between tokens outside."""
        best, back = scores[0] + self.changes[OUT], []
        for own in scores[1:]:
            ways = best[:, None] + self.changes
            back.append(ways.argmax(0))
            best = ways.max(0) + own
        tags = [int((best + self.changes[:, OUT]).argmax())]
        for ways in reversed(back):
            tags.append(int(ways[tags[-1]]))
        return tags[::-1]


# ---- learning


def tokens_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m[0], m.span()) for m in TOKEN.finditer(text)]
    return [t for t, _ in found], [s for _, s in found]


def tagged(spans: list[tuple[int, int]], values: list[tuple[int, int]]) -> list[int]:
    """The tags of tokens at these places."""
    tags, k, last = [], 0, -1
    for start, end in spans:
        while k < len(values) and values[k][1] <= start:
            k += 1
        if k < len(values) and values[k][0] < end:
            tags.append(INSIDE if last == k else BEGIN)
            last = k
        else:
            tags.append(OUT)
    return tags


Window = tuple[list[str], list[int], int]


def _redrawn(window: Window, rng: random.Random, plain: list[str]) -> Window:
    """A labelled window with another value, key word and file, or with something that is no secret in the value's place."""
    tokens, tags, _ = window
    first = tags.index(BEGIN)
    last = first
    while last + 1 < len(tags) and tags[last + 1] == INSIDE:
        last += 1
    before, after = tokens[:first], tokens[last + 1 :]
    secret = rng.random() < 0.6
    if secret:
        value = "".join(rng.choice(alphabet) for alphabet in [rng.choice(ALPHABETS)] for _ in range(rng.randint(16, 64)))
        if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            value += "a7"
    else:
        word = rng.choice(plain)
        value = rng.choice([word, word, word + rng.choice(plain), str(rng.randrange(10 ** rng.randint(4, 18))), f"{word}/{rng.choice(plain)}.html", f"{word}.{rng.choice(plain)}.com"])
    spelled = TOKEN.findall(value)
    keys = [i for i in range(max(0, first - 4), first) if tokens[i].lower() in KEYS]
    if keys and rng.random() < 0.6:
        before[keys[-1]] = rng.choice(KEYS) if rng.random() < 0.8 else rng.choice(KEYS).upper()
    elif keys:
        before = before[: keys[-1]]
        after = after[1:] if after and after[0][:1] in "\"'" else after
    own = [OUT] * len(before) + [(BEGIN if i == 0 else INSIDE) if secret else OUT for i in range(len(spelled))] + [OUT] * len(after)
    return [*before, *spelled, *after], own, rng.randrange(FILES)


def windows(texts: list[str]) -> list[Window]:
    """The windows that are learned: those around secrets, with redrawn copies, and some of each text."""
    rng, out = random.Random(5), []
    plain = sorted({t for text in texts for t in TOKEN.findall(text) if t.isalpha() and 3 <= len(t) <= 30}) or ["word"]
    for text in texts:
        tokens, spans = tokens_of(text)
        if not tokens:
            continue
        tags = tagged(spans, _values(text))
        shapes = [shape(t) for t in tokens]
        own = file_bucket(sum(s[1] for s in shapes), sum(s[2] for s in shapes), len(tokens))
        cut = lambda a: (tokens[a : a + WIDTH], tags[a : a + WIDTH], own)  # noqa: B023, E731
        for at in (i for i, tag in enumerate(tags) if tag == BEGIN):
            window = cut(max(0, at - WIDTH // 2))
            out.append(window)
            out += [_redrawn(window, rng, plain) for _ in range(COPIES)]
        starts = sorted(rng.randrange(max(1, len(tokens) - WIDTH)) for _ in range(WINDOWS))
        out += [cut(a) for a in starts]
    return out


def fit(texts: list[str]) -> Field:
    """The field learned by gradients of the tags' log probability, windows in batches."""
    field, found = Field(), windows(texts)
    if not any(BEGIN in tags for _, tags, _ in found):
        field.weights[:, OUT] = 1.0
        field.files[:, :, OUT] = 1.0
        return field
    met = Counter(t.lower() for tokens, _, _ in found for t in set(tokens) if len(t) <= WORDS_MAX)
    field.words = frozenset(t for t, n in met.items() if n >= OFTEN)
    numbers: dict[str, dict[str, list[int]]] = {}
    width = sum(ROLES.values())
    ids = np.zeros((len(found), WIDTH, width), np.int64)
    files, gold, mask = np.zeros((len(found), WIDTH), np.int64), np.zeros((len(found), WIDTH), np.int64), np.zeros((len(found), WIDTH), bool)
    for row, (tokens, tags, own) in enumerate(found):
        tokens, tags = tokens[:WIDTH], tags[:WIDTH]
        known = [numbers.get(t) or numbers.setdefault(t, feature_numbers(t, spelling(t, field.words))) for t in tokens]
        for i in range(len(tokens)):
            at = 0
            for (role, size), offset in zip(ROLES.items(), (0, -1, -2, 1)):
                if 0 <= i + offset < len(tokens):
                    n = known[i + offset][role]
                    ids[row, i, at : at + len(n)] = n
                at += size
            files[row, i] = own * COARSE + shape(tokens[i])[0]
        gold[row, : len(tags)], mask[row, : len(tags)] = tags, True
    square = [np.full((BUCKETS, 3), 1e-2), np.full((FILES * COARSE, 3), 1e-2), np.full((3, 3), 1e-2)]
    order = np.random.default_rng(5)
    flat = field.files.reshape(-1, 3)
    for _ in range(EPOCHS):
        places = order.permutation(len(found))
        for a in range(0, len(places), BATCH):
            b = places[a : a + BATCH]
            own, live, tags = ids[b], mask[b], gold[b]
            scores = field.weights[own].sum(2) + flat[files[b]]
            scores[~live] = [0.0, -1e9, -1e9]  # past its end a window is outside
            node, edge = _expected(scores, field.changes)
            ahead = np.eye(3)[tags] - node
            ahead[~live] = 0
            pairs = np.zeros((3, 3))
            both = live[:, 1:]
            np.add.at(pairs, (tags[:, :-1][both], tags[:, 1:][both]), 1)
            pairs -= edge[both].sum(0)
            steps = [np.zeros((BUCKETS, 3)), np.zeros((FILES * COARSE, 3)), pairs]
            np.add.at(steps[0], own[live], ahead[live][:, None, :])
            np.add.at(steps[1], files[b][live], ahead[live])
            steps[0][0] = 0  # the bucket of no feature
            for what, step, sums in zip((field.weights, flat, field.changes), steps, square):
                step = step - 1e-3 * what
                sums += step**2
                what += RATE * step / np.sqrt(sums)
            np.clip(field.changes, -MOST, MOST, out=field.changes)
    return field


def _expected(scores: np.ndarray, changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of tags, and of tags of neighbours, by forward and backward sums."""
    rows, width, _ = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + changes[OUT]
    for i in range(1, width):
        ahead[:, i] = np.logaddexp.reduce(ahead[:, i - 1, :, None] + changes, axis=1) + scores[:, i]
    behind[:, -1] = changes[:, OUT]
    for i in range(width - 2, -1, -1):
        behind[:, i] = np.logaddexp.reduce(changes[None] + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], axis=2)
    total = np.logaddexp.reduce(ahead[:, -1] + behind[:, -1], axis=1)
    node = np.exp(ahead + behind - total[:, None, None])
    edge = np.exp(ahead[:, :-1, :, None] + changes + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
    return node, edge


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field, learned in one task from a bounded sample of the documents."""
    text = docs[text_col].cast("string")
    texts = docs.select(docs[id_col].alias("_id"), text.alias("text")).where(F.col("_id").isNotNull() & text.isNotNull() & (F.length(text) <= MAX_CHARS))
    order = F.md5(F.concat(F.lit("secrets:"), F.col("_id").cast("string")).cast("binary"))
    ids = texts.select("_id", F.col("text").rlike(LABELLED).alias("found")).groupBy("_id").agg(F.max("found").alias("found"))
    chosen = [ids.where(F.col("found") == kind).select(F.col("_id").alias("_chosen")).orderBy(order, "_id").limit(SAMPLE) for kind in (True, False)]
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("_id") == F.col("_chosen"))  # 2 * SAMPLE rows
    one = rows.groupBy("_id").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text")).select("text", order.alias("place"))
    return pickle.loads(fitted(one, lambda sample: pickle.dumps(fit([t for (t,) in sample]))))


# ---- scanning


class Types(dict):
    """The row of each token: what it adds to the scores of its own place and of places beside it.

    Plain words of one spelling, coarse shape and step of length share a row.
    """

    def __init__(self, field: Field):
        super().__init__()
        self.field = field
        self.renew()

    def renew(self) -> None:
        """Row 0 is the edge of a text."""
        self.clear()
        self.rows: dict[object, int] = {}
        self.scores, self.coarse, self.flags = np.zeros((1024, len(ROLES), 3)), np.zeros(1024, np.int64), np.zeros((1024, 2))

    def __missing__(self, token: str) -> int:
        word = spelling(token, self.field.words)
        key = (word, shape(token)[0], _step(len(token), LONG)) if ordinary(token) else token
        row = self.rows.get(key)
        if row is None:
            row = self.rows[key] = self._row(token, word)
        self[token] = row
        return row

    def _row(self, token: str, word: str) -> int:
        row = len(self.rows) + 1
        while row >= len(self.scores):
            self.scores, self.coarse, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.coarse, self.flags))
        for k, numbers in enumerate(feature_numbers(token, word).values()):
            self.scores[row, k] = self.field.weights[numbers].sum(0)
        self.coarse[row], *self.flags[row] = shape(token)
        return row


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], types: Types) -> list[list[tuple[int, int]]]:
    """The spans that the field adds to each text's base spans."""
    if len(types) >= CACHE:
        types.renew()
    field, parts = types.field, [[*map(types.__getitem__, TOKEN.findall(t))] for t in texts]
    edge = [0, 0]
    ids = np.array([x for p in parts for x in (*edge, *p)] + edge, np.int64)
    starts = np.cumsum([2, *(len(p) + 2 for p in parts)])[:-1]
    owner = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])
    flags = np.stack([np.bincount(owner, types.flags[ids[:-2], k], len(parts)) for k in (0, 1)])
    files = np.array([file_bucket(int(r), int(p), len(own)) for r, p, own in zip(*flags, parts)], np.int64)
    scores = types.scores[ids[:-2], 0] + field.files[files[owner], types.coarse[ids[:-2]]]
    scores[1:] += types.scores[ids[:-3], 1]
    scores[2:] += types.scores[ids[:-4], 2]
    after = ids[1:-1]
    scores += types.scores[after, 3]
    edges = ids[:-2] == 0
    scores[edges] = [1e9, 0, 0]
    open_ = np.concatenate([[False], scores[:, OUT] - scores[:, 1:].max(1) <= field.slack() + 1e-9, [False]])
    bounds = np.flatnonzero(open_[1:] != open_[:-1])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    hits: dict[int, list[tuple[int, int]]] = {}  # first and last token, by text
    for a, b in zip(bounds[::2].tolist(), bounds[1::2].tolist()):
        tags = field.viterbi(scores[a:b])
        for i, tag in enumerate(tags):
            if tag == OUT:
                continue
            own = hits.setdefault(int(owner[a]), [])
            at = a + i - int(starts[owner[a]])
            if tag == INSIDE and i and tags[i - 1] != OUT:
                own[-1] = (own[-1][0], at)
            else:
                own.append((at, at))
    for k, own in hits.items():
        places = [m.span() for m in TOKEN.finditer(texts[k])]
        for first, last in own:
            start, end = places[first][0], places[last][1]
            if not any(s < end and start < e for _, s, e in base[k]):
                out[k].append((start, end))
    return out


def scan(docs: DataFrame, field: Field, *keep: str, text_col: str = "text") -> DataFrame:
    """The kept columns, base and added: arrays of (kind, start, end, text), by start and kind."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(field)  # of fixed size
    held, names = aside(docs)
    kept = [names[c] for c in keep]
    chosen = held.select(*kept, F.col(names[text_col]).cast("string").alias("_text"))
    kinds = dict(chosen.dtypes)
    span = "array<struct<kind: string, start: bigint, end: bigint, text: string>>"
    schema = ", ".join([f"{c} {kinds[c]}" for c in kept] + [f"base {span}", f"added {span}"])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = Types(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = [[("crf", *s) for s in own] for own in added_spans(texts, base, types)]
            columns = [pa.array([[{"kind": k, "start": s, "end": e, "text": t[s:e]} for k, s, e in own] for t, own in zip(texts, spans)], arrow) for spans in (base, added)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, "base", "added"])

    return chosen.mapInArrow(run, schema).select(*[F.col(names[c]).alias(c) for c in keep], "base", "added")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base spans' numbers by kind and digest, and all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs), "doc_id")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["kind"].alias("kind"), s["end"].alias("end"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    numbers = [of(kind) for kind in LENGTHS]
    every = F.array_sort(F.transform(F.concat("base", "added"), place))
    return found.select("doc_id", *numbers, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


QUERIES = {"op12_secrets": op12_secrets}
#: Learned tags can't be expressed in SQL; the tests hold base spans, decoding and learning against plain versions.
ORACLE: dict[str, str] = {}
