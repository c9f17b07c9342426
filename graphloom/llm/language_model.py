"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: one for a text's start and one for each training word, seating the words that follow;
all share one parent, the restaurant of single words. The parent's base gives half its mass to one
unknown word and half to the known words alike. Customers of the parent are its children's tables.

The state of the sampler is the seating itself: of each type (restaurant, word) the number of
customers at each of its tables. It starts from a draw in the order of arrival. A sweep takes
every customer of each type, one after another and each once, out of the restaurant, and seats
them anew by the Chinese restaurant process given all others: at one of the type's tables in
proportion to its customers less the discount, or at a new table in proportion to
(strength + discount * tables) times the parent's probability. Within a sweep a type
sees its own changes at once; the restaurants' tables and the parent's probabilities are those of
the sweep before, as types are seated in parallel. Then the parent seats its own customers, the
tables, likewise: those that went leave, new ones sit down, and all of each word are
seated anew. A type seen once has one table always, so only its presence is kept. After the
first and BURN_IN more sweeps, predictive probabilities are averaged over SAMPLES sweeps. Discounts come from the
counts of types seen once and twice, of the parent from words with one and two tables.

The state is kept packed: a bucket, by the first bits of a hash of both words, holds the types seen twice or
more as arrays, and a bucket of words, by the first bits of theirs, what the parent knows. No type is a row. In a sweep
buckets tell words how many tables they have seated, and words tell each bucket that has asked once, in
the order it has asked in, their customers and tables, from which it works out the probabilities: whole numbers, a few bits
each. What is moved in a sweep is the state and these, in proportion to the types. A restaurant's types
lie in all buckets, so none is large for a frequent word. Words are known by 64-bit hashes. Draws depend on
the type, the sweep and the step alone, not on what is seated beside it.

Texts are cut into words once. They are kept in chunks of some millions of tokens: each word of a chunk
once, and for each token its word's place. Chunks ask for words and types, each once and once only, in buckets by
hash; a bucket counts what all chunks ask for, notes which type each has asked for, and has one chunk name those that it keeps;
the answers come in the order of the keys, without them. No
word or type is treated apart for being frequent, so what is written grows in proportion to the
tokens. A bucket knows a type by 48 bits of its hash below the bucket's own: of 10**8 types in 2**8 buckets,
two are taken for one with a chance of some percent.

Null texts are empty ones: one token, the end. Repeated rows are scored each: a number given in the
pass over the texts, and written with what the pass finds, holds a row's parts together. Other
columns are left out; kept ones may have any name. An empty table gives an empty result; without
training texts every token is unknown, with probability 1.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import chain, count, islice
from random import Random

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, read, shared_table, small_batches
from graphloom.llm.features import Words
from graphloom.storage import discard

#: Bounds of look-up tables that scoring no longer has; only tests still set them.
HEAD, CACHE, FILTERED, FEW_WORDS = 1 << 18, 1 << 22, 1 << 24, 500_000
STRENGTH = 10.0
BURN_IN, SAMPLES = 1, 2
#: Tokens that a task holds before it hands on its counts, a chunk has a third of them; rows that a task seats in one go.
HELD_TOKENS, SEATED = 6_000_000, 200_000
#: Customers up to which types are seated side by side, as rows of a matrix; longer ones are seated one by one.
WIDE = 64
#: Tokens of a bucket of types, about, before repeats within chunks are put together.
BUCKET_TOKENS = 1 << 20
END, START = b"", 0
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def words_of(text: str | None) -> list[bytes]:
    """Words (A-Z lower-cased, split at U+0020 and U+0009 to U+000D), then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_id(word: bytes) -> int:
    """A 64-bit hash that isn't START."""
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True) | 1


_IDS = Words(word_id)


def ids_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the words' ids, the ids of what stands before them, and how many each text has."""
    words = [[*map(_IDS.__getitem__, words_of(t))] for t in texts]
    sizes = np.array([len(x) for x in words], np.int64)
    flat = np.array([x for own in words for x in own], np.int64)
    before = np.concatenate([[START], flat[:-1]]) if len(flat) else flat
    before[np.cumsum(sizes) - sizes] = START
    return flat, before, sizes


def pair_of(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (u, w)."""
    x = u.view(np.uint64) * _STEP[0] + w.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _STEP[1]
    x = (x ^ (x >> np.uint64(27))) * _STEP[2]
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _uniform(seed: np.ndarray, *numbers: int) -> np.ndarray:
    x = seed.copy()
    for step, n in zip(_STEP, numbers):
        x += np.uint64(n * int(step) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _STEP[1]
        x = (x ^ (x >> np.uint64(27))) * _STEP[2]
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


class Seating:
    """Tables of many types at once: a row for each type, with the customers at each of its tables.

    Steps work on the first rows only, so rows that take most steps stand first.
    """

    def __init__(self, sizes: np.ndarray, opening: np.ndarray, slope: np.ndarray, discount: float, seed: np.ndarray, sweep: int):
        """A new table weighs opening + slope * tables."""
        self.sizes, self.opening, self.slope, self.discount, self.seed, self.sweep = sizes, opening, slope, discount, seed, sweep
        self.tables = (sizes > 0).sum(1)
        self.rows = np.arange(len(sizes))
        self.turn = 0
        #: Columns from here on are empty: a new table takes the first empty place.
        self.width = int((sizes > 0).any(0).nonzero()[0].max(initial=-1)) + 1

    def _draw(self, rows: slice | np.ndarray) -> np.ndarray:
        self.turn += 1
        return _uniform(self.seed[rows], self.sweep, self.turn)

    def leave(self, rows: slice | np.ndarray, at: np.ndarray | None = None) -> None:
        """A customer of each of these rows goes: one of the given tables, else one drawn at random."""
        if at is None:
            upto = self.sizes[rows, : max(1, self.width)].cumsum(1)
            at = (upto <= (self._draw(rows) * upto[:, -1])[:, None]).sum(1)
        place = self.rows[rows], at
        self.sizes[place] -= 1
        self.tables[rows] -= self.sizes[place] == 0

    def enter(self, rows: slice | np.ndarray) -> None:
        """A customer comes to each of these rows."""
        own = self.sizes[rows, : self.width + 1]
        upto = np.maximum(own - self.discount * (own > 0), 0).cumsum(1)
        new = self.opening[rows] + self.slope[rows] * self.tables[rows]
        x = self._draw(rows) * (upto[:, -1] + new)
        opens = x >= upto[:, -1]
        at = np.minimum((upto <= x[:, None]).sum(1), own.shape[1] - 1)
        if opens.any():
            at[opens] = (own[opens] > 0).argmin(1)
            self.width = max(self.width, int(at.max()) + 1)
        self.sizes[self.rows[rows], at] += 1
        self.tables[rows] += opens


def _first_tables(n: np.ndarray, opening: np.ndarray, slope: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """Tables of a seating to start from: customers arrive in groups that grow by an eighth of those seated."""
    tables = np.minimum(n, 1)
    live, seated = np.flatnonzero(n > 1), 1
    while len(live):
        group = max(1, seated // 8)
        weight = opening[live] + slope[live] * tables[live]
        chance = weight / (weight + seated - discount * tables[live])
        tables[live] += np.floor(np.minimum(group, n[live] - seated) * chance + _uniform(seed[live], 1 << 20, seated)).astype(np.int64)
        seated += group
        live = live[n[live] > seated]
    return tables


def _reseat_long(sizes: np.ndarray, n: int, opening: float, slope: float, discount: float, seed: int) -> np.ndarray:
    """A sweep of one type, which gets n customers first: the customers at each table.

    To join a table in proportion to its customers is to follow one of the others, so no step looks at all tables.
    """
    draw, order = Random(seed).random, np.random.default_rng(seed)
    seats, sizes = array("i", np.repeat(np.arange(len(sizes), dtype=np.int32), sizes).tobytes()), sizes.tolist()
    empty: list[int] = []
    tables = len(sizes)
    while len(seats) > n:
        i = int(draw() * len(seats))
        at, seats[i] = seats[i], seats[-1]
        seats.pop()
        sizes[at] -= 1
        if not sizes[at]:
            empty.append(at)
            tables -= 1
    arrived = len(seats)
    seats.extend([0] * (n - arrived))
    for i in chain(range(arrived, n), range(n)):
        if arrived < n:
            others, arrived = arrived, arrived + 1
            weight = others + opening + slope * tables
        else:
            if i == 0:  # all are here: they go in an order that tables have no part in
                seats = array("i", order.permutation(np.frombuffer(seats, np.int32)).tobytes())
                others = n - 1
                weight = others + opening + slope * tables
            at = seats[i]
            size = sizes[at] = sizes[at] - 1
            if not size:
                empty.append(at)
                tables -= 1
                weight = others + opening + slope * tables
        while True:
            x = draw() * weight
            k = int(x)
            if k >= others:
                if empty:
                    at = empty.pop()
                else:
                    at = len(sizes)
                    sizes.append(0)
                tables += 1
                weight = others + opening + slope * tables
                break
            at = seats[k if k < i else k + 1]
            size = sizes[at]
            if (x - k) * size < size - discount:  # a table weighs its customers less the discount
                break
        sizes[at] += 1
        seats[i] = at
    out = np.array(sizes, np.int64)
    return out[out > 0]


def reseat(flat: np.ndarray, lengths: np.ndarray, n: np.ndarray, opening: np.ndarray, slope: np.ndarray, discount: float, seed: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """The seating after a sweep: customers at the tables of all types one after another, and each type's tables.

    ``flat`` and ``lengths`` hold the seating so far; a type without tables starts afresh, and one
    that isn't of n customers any more first gets so many.
    """
    two = n == 2
    if two.any():
        # whoever of two leaves, the other sits alone: what was doesn't matter
        new = opening[two] + slope[two]
        alone = _uniform(seed[two], sweep, 0) * (new + 1 - discount) < new
        many, rest = np.ones(len(n), np.int64), ~two
        kept, many[rest] = reseat(flat[np.repeat(rest, lengths)], lengths[rest], n[rest], opening[rest], slope[rest], discount, seed[rest], sweep)
        many[two] += alone
        out = np.ones(int(many.sum()), np.int64)
        out[np.repeat(rest, many)] = kept
        out[(np.cumsum(many) - many)[two & (many == 1)]] = 2
        return out, many
    ends = np.cumsum(lengths)
    held = np.add.reduceat(np.append(flat, 0), np.minimum(ends - lengths, len(flat))) * (lengths > 0) if len(n) else n
    fresh = held == 0
    tables = np.where(fresh, 0, lengths)
    tables[fresh] = _first_tables(n[fresh], opening[fresh], slope[fresh], discount, seed[fresh])
    more = np.where(fresh, 0, n - held)
    room = np.maximum(np.maximum(n, held), 1)
    out_tables, parts, places = np.zeros(len(n), np.int64), [], []
    numbers = _uniform(seed, sweep, 1 << 21) if (room > WIDE).any() else seed
    for i in np.flatnonzero(room > WIDE).tolist():
        own = flat[ends[i] - lengths[i] : ends[i]]
        if fresh[i]:
            own = np.ones(tables[i], np.int64)
            own[0] += n[i] - tables[i]
        own = _reseat_long(own, int(n[i]), float(opening[i]), float(slope[i]), discount, int(numbers[i] * 2.0**53))
        out_tables[i] = len(own)
        parts.append(own)
        places.append(np.full(len(own), i))
    kinds = np.where(room > WIDE, -1, np.ceil(np.log2(room)).astype(np.int64))
    for kind in np.unique(kinds[kinds >= 0]):
        rows = np.flatnonzero(kinds == kind)
        rows = rows[np.argsort(-n[rows], kind="stable")]
        sizes = np.zeros((len(rows), 1 << int(kind)), np.int32)
        old, new = np.flatnonzero(~fresh[rows]), np.flatnonzero(fresh[rows])
        r = np.repeat(old, lengths[rows[old]])
        c = np.arange(len(r)) - np.repeat(np.cumsum(lengths[rows[old]]) - lengths[rows[old]], lengths[rows[old]])
        sizes[r, c] = flat[np.repeat((ends - lengths)[rows[old]], lengths[rows[old]]) + c]
        sizes[new[:, None], np.arange(sizes.shape[1])] = np.arange(sizes.shape[1]) < tables[rows[new]][:, None]
        sizes[new, 0] += n[rows[new]] - tables[rows[new]]
        seats = Seating(sizes, opening[rows], slope[rows], discount, seed[rows], sweep)
        for k in range(int(np.abs(more[rows]).max(initial=0))):
            for step, live in ((seats.enter, np.flatnonzero(more[rows] > k)), (seats.leave, np.flatnonzero(-more[rows] > k))):
                if len(live):
                    seats.turn = (1 << 23) + k  # draws don't depend on what else is seated here
                    step(live)
        # each customer in turn, in an order that tables have no part in: whoever hasn't been seated anew is still where they were
        first = np.cumsum(n[rows]) - n[rows]
        where, owner = np.repeat(np.tile(np.arange(sizes.shape[1]), len(rows)), sizes.ravel()), np.repeat(np.arange(len(rows)), n[rows])
        turns = (np.arange(len(owner)) - first[owner]).astype(np.uint64) * _STEP[0]
        where = where[np.argsort(owner + _uniform(seed[rows][owner] + turns, sweep, 1 << 22))]
        seats.turn = 0
        for k, live in enumerate(np.searchsorted(-n[rows], -np.arange(int(n[rows].max()))).tolist()):
            seats.leave(slice(0, live), where[first[:live] + k])
            seats.enter(slice(0, live))
        out_tables[rows] = seats.tables
        r, c = np.nonzero(sizes)
        parts.append(sizes[r, c].astype(np.int64))
        places.append(rows[r])
    if not parts:
        return np.zeros(0, np.int64), out_tables
    return np.concatenate(parts)[np.argsort(np.concatenate(places), kind="stable")], out_tables


def count_types(texts: DataFrame) -> DataFrame:
    """(u, w, n) of all types: n times w stands after u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            u, w = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            _, first, n = np.unique(pair_of(u, w), return_index=True, return_counts=True)
            order = np.argsort(u[first], kind="stable")  # equal neighbours take less room in the shuffle
            u, w, n = u[first][order], w[first][order], n[order]
            for a in range(0, len(n), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 200_000]) for x in (u, w, n)], names=["u", "w", "n"])

        for batch in batches:
            flat, before, _ = ids_of(batch.column(0).to_pylist())
            parts.append((before, flat))
            if sum(len(x) for x, _ in parts) > HELD_TOKENS:
                yield from out()
                parts = []
        yield from out()

    small_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(run, "u long, w long, n long").groupBy("u", "w").agg(F.sum("n").alias("n"))


def count_words(types: DataFrame) -> DataFrame:
    """Of each id: n, its tokens; c, tokens that follow it; types that end in it (after) and start with it (before), and those seen once and twice."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    once, twice = (F.col("n") == 1).cast("long"), (F.col("n") == 2).cast("long")
    after = types.select(F.col("w").alias("id"), "n", zero.alias("c"), one.alias("after"), once.alias("once_after"), twice.alias("twice_after"), zero.alias("before"), zero.alias("once_before"))
    before = types.select(F.col("u").alias("id"), zero.alias("n"), F.col("n").alias("c"), zero.alias("after"), zero.alias("once_after"), zero.alias("twice_after"), one.alias("before"), once.alias("once_before"))
    return after.unionByName(before).groupBy("id").agg(*[F.sum(c).alias(c) for c in after.columns[1:]])


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Parent:
    """The parent's totals in a sweep: its customers and tables, of all words."""

    def __init__(self, customers: float, tables: float, discount: float, known: int):
        self.customers, self.tables, self.discount, self.known = customers, tables, discount, known

    def fresh(self) -> float:
        """What a new table weighs before the base's probability."""
        return STRENGTH + self.discount * self.tables

    def base(self) -> float:
        return 0.5 / max(self.known, 1)

    def unknown(self) -> float:
        """The unknown word's probability."""
        return self.fresh() / (STRENGTH + self.customers) * (0.5 if self.known else 1.0)

    def of(self, own: Column | int, tables: Column | int) -> Column | float:
        """The probability of a word with so many customers and tables."""
        return (own - self.discount * tables + self.fresh() * self.base()) / (STRENGTH + self.customers)


#: A message: its receiver, what it is, its sender, and numbers.
MESSAGE = "to long, kind long, src long, data binary"
#: Kinds of messages: a chunk; its types' counts; of them each one's status and slot; the types that it has to name; their names; the counts of slots;
#: a chunk's words; a bucket's state; what it tells words; the words' state; which words are asked for by buckets, and by chunks; what words
#: answer to both; values of a chunk's types; sums for the driver.
CHUNK, COUNT, STATUS, PLACES, NAMES, SLOTS, TOKENS, STATE, UP, WORDS, ASKS, CALLS, DOWN, OF_WORDS, OF_TYPES, SUMS = range(16)
_KINDS = [np.dtype(x) for x in ("u1", "u2", "u4", "u8", "i8", "f4", "f8")]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte of their numbers' places, so that what is alike stands together, and compressed. Whole numbers from 0 on take as few bytes as they need."""
    head, planes = [len(arrays)], []
    for x in arrays:
        if x.dtype == bool:
            x = x.view(np.uint8)
        elif x.dtype.kind in "iu" and (not len(x) or x.min() >= 0):
            x = x.astype(np.min_scalar_type(int(x.max(initial=0))), copy=False)
        head += [_KINDS.index(x.dtype), len(x)]
        planes.append(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
    return np.array(head, np.int64).tobytes() + pa.Codec("zstd", 1).compress(b"".join(planes), asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    """The arrays, whole numbers as int64 (from 2**63 on: uint64)."""
    many = int.from_bytes(data[:8], "little")
    head = np.frombuffer(data, np.int64, 2 * many, 8).reshape(-1, 2).tolist()
    size, out, start = sum(_KINDS[k].itemsize * n for k, n in head), [], 0
    planes = pa.Codec("zstd").decompress(memoryview(data)[8 + 16 * many :], size, asbytes=True)
    for k, n in head:
        kind = _KINDS[k]
        x = np.ascontiguousarray(np.frombuffer(planes, np.uint8, n * kind.itemsize, start).reshape(kind.itemsize, n).T).view(kind).reshape(n)
        out.append(x.astype(np.int64) if kind.kind == "u" and kind.itemsize < 8 else x)
        start += n * kind.itemsize
    return out


def _distinct(keys: np.ndarray, shift: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, an entry of each, and of each entry its key's place. Keys have ``shift`` empty first bits."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    # numbers sort faster than places do: of each key the first bits, and below them its place
    order = (np.sort((keys.astype(np.uint64) << np.uint64(shift)) & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    own = keys[order]
    if (own[1:] < own[:-1]).any():  # the bits left out matter
        order = np.argsort(keys)
        own = keys[order]
    new = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return own[new], order[new], of


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(0, kind)]).astype(kind, copy=False)


def _ids(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) if x.dtype == np.int64 else x.astype(np.uint64)


Message = tuple[int, int, int, bytes]


def _sent(messages: list[Message]) -> pa.Table:
    to, kind, src, data = zip(*messages) if messages else ((), (), (), ())
    return pa.table([pa.array(to, pa.int64()), pa.array(kind, pa.int64()), pa.array(src, pa.int64()), pa.array(data, pa.binary())], names=["to", "kind", "src", "data"])


def _step(spark: SparkSession, parts: int, run: Callable[[int, dict[int, dict[int, list[np.ndarray]]]], Iterator[Message]], *tables: tuple[DataFrame, int], schema: str = MESSAGE) -> DataFrame:
    """What each receiver sends after it got its messages of all tables, by kind and by sender in order."""

    def receive(table: pa.Table) -> pa.Table:
        got: dict[int, dict[int, list[np.ndarray]]] = {}
        rows = zip(*(table.column(c).to_pylist() for c in ("kind", "src", "data")))
        for kind, src, data in sorted(rows, key=lambda x: x[:2]):
            got.setdefault(kind, {})[src] = _unpack(data)
        out = run(table.column("to")[0].as_py(), got)
        return _sent([*out]) if schema == MESSAGE else pa.table([*out], names=[c.split()[0] for c in schema.split(", ")])

    rows = None
    for table, kind in tables:
        own = table.where(F.col("kind") == kind)
        rows = own if rows is None else rows.unionByName(own)
    small_batches(spark)
    return rows.repartition(parts, "to").groupBy("to").applyInArrow(receive, schema)


def _cut(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the buckets of sorted hashes, by their first bits, begin and end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _dealt(kind: int, src: int, keys: np.ndarray, bits: int, *columns: np.ndarray) -> Iterator[Message]:
    """To each bucket of the sorted keys its part of the columns."""
    cuts = _cut(keys, bits).tolist()
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            yield i, kind, src, _pack(*(x[a:b] for x in columns))


def _sums(table: DataFrame, many: int) -> list[int]:
    """The totals of what the receivers have summed up, a few numbers each."""
    rows = [_unpack(r["data"])[0] for r in table.where(F.col("kind") == SUMS).select("data").collect()]
    return np.sum([np.zeros(many, np.int64), *rows], 0).tolist()


class Chunk:
    """Tokens of some running texts: their words, each once and START first, and of each token its word's place among them."""

    def __init__(self, words: np.ndarray, at: np.ndarray, sizes: np.ndarray, training: np.ndarray):
        self.words, self.at, self.sizes, self.training = words, at, sizes, training.astype(bool)
        self.before = np.concatenate([[0], at[:-1]]) if len(at) else at
        self.before[np.cumsum(sizes) - sizes] = 0

    @staticmethod
    def write(words: np.ndarray, at: np.ndarray, sizes: np.ndarray, training: np.ndarray) -> bytes:
        order = np.argsort(-np.bincount(at, minlength=len(words))[1:], kind="stable") + 1  # small numbers for frequent words
        rank = np.zeros(len(words), np.uint32)
        rank[order] = np.arange(1, len(words), dtype=np.uint32)
        return _pack(np.concatenate([words[:1], words[order]]).view(np.uint64), rank[at], sizes, training)

    @classmethod
    def read(cls, arrays: list[np.ndarray]) -> Chunk:
        words, at, sizes, training = arrays
        return cls(_ids(words).view(np.int64), at, sizes, training)

    def types(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The types by their pairs' hashes, in order: hash, a token of each, and of each token its type."""
        return _distinct(pair_of(self.words[self.before], self.words[self.at]).view(np.uint64))

    def by_id(self) -> np.ndarray:
        """The words' places in the order of their hashes."""
        return np.argsort(self.words.view(np.uint64))


def _counts(chunks: DataFrame, bits: int) -> DataFrame:
    """Of each chunk's types, by buckets of their hashes, the 48 bits that follow the bucket's, and the training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.read(_unpack(row["data"]))
                keys, _, of = chunk.types()
                n = np.bincount(of, np.repeat(chunk.training, chunk.sizes), len(keys)).astype(np.int64)
                short = (keys << np.uint64(bits)) >> np.uint64(16)
                yield from _sent([*_dealt(COUNT, row["src"], keys, bits, short, n)]).to_batches()

    return chunks.mapInArrow(run, MESSAGE)


def _count(bucket: int, got: dict[int, dict[int, list[np.ndarray]]]) -> Iterator[Message]:
    """A bucket counts its types over all chunks. Those seen twice or more get slots; the chunk that has one first names it."""
    chunks = got[COUNT]
    ends = np.cumsum([len(n) for _, n in chunks.values()])
    found, first, at = _distinct(_joined([k for k, _ in chunks.values()], np.int64), 16)
    total = np.bincount(at, _joined([n for _, n in chunks.values()], np.int64), len(found)).astype(np.int64)
    many = np.flatnonzero(total > 1)
    many = many[np.argsort(first[many])]
    slot = np.zeros(len(found), np.int64)
    slot[many] = np.arange(len(many))
    status, slots = np.minimum(total, 2)[at], slot[at]
    yield bucket, SLOTS, bucket, _pack(total[many])
    for chunk, a, b in zip(chunks, [0, *ends.tolist()], ends.tolist()):
        own = status[a:b]
        yield bucket, STATUS, chunk, _pack(own, slots[a:b][own == 2])
        lo, hi = np.searchsorted(first[many], [a, b])
        if lo < hi:
            yield chunk, PLACES, bucket, _pack(first[many[lo:hi]] - a)


def _name(bits: int, word_bits: int) -> Callable:
    def run(number: int, got: dict[int, dict[int, list[np.ndarray]]]) -> Iterator[Message]:
        """A chunk names the types that it is asked for, and tells each word's tokens, and those that follow it."""
        chunk = Chunk.read(got[CHUNK][number])
        if PLACES in got:
            keys, token, _ = chunk.types()
            starts = _cut(keys, bits)
            for bucket, (places,) in got[PLACES].items():
                t = token[starts[bucket] + places]
                yield bucket, NAMES, number, _pack(chunk.words[chunk.before[t]].view(np.uint64), chunk.words[chunk.at[t]].view(np.uint64))
        learned, by_id = np.repeat(chunk.training, chunk.sizes), chunk.by_id()
        n, c = (np.bincount(x[learned], minlength=len(chunk.words))[by_id] for x in (chunk.at, chunk.before))
        ids = chunk.words.view(np.uint64)[by_id]
        yield from _dealt(TOKENS, number, ids, word_bits, ids, n, c)

    return run


def _begin(word_bits: int) -> Callable:
    def run(bucket: int, got: dict[int, dict[int, list[np.ndarray]]]) -> Iterator[Message]:
        """A bucket's state: the words of its types in order, each type's two words and count, no tables yet. Words get to know their types in it."""
        (n,), names = got[SLOTS][bucket], got.get(NAMES, {}).values()
        ids, _, at = _distinct(_joined([_ids(x[i]) for i in (0, 1) for x in names], np.uint64))
        u, w, none = at[: len(n)], at[len(n) :], np.zeros(0, np.int64)
        yield bucket, STATE, bucket, _pack(ids, u, w, n, np.zeros(len(n), np.int64), none, np.zeros(len(n)))
        told = [np.bincount(x, weight, len(ids)).astype(np.int64) for x, weight in ((w, None), (w, n), (w, n == 2), (u, None), (u, n))]
        yield from _dealt(UP, bucket, ids, word_bits, ids, *told)

    return run


def _meet(number: int, got: dict[int, dict[int, list[np.ndarray]]]) -> Iterator[Message]:
    """The words' state: hash, tokens, tokens that follow, types seen once that end in it and start with it, customers, tables in its restaurant, customers at its own tables."""
    calls, asked = got[TOKENS], got.get(UP, {})
    ids, _, at = _distinct(_joined([_ids(x[0]) for x in calls.values()], np.uint64))
    n, c = (np.bincount(at, _joined([x[i] for x in calls.values()], np.int64), len(ids)).astype(np.int64) for i in (1, 2))
    places = [np.searchsorted(ids, _ids(x[0])) for x in asked.values()]
    after, after_n, twice, before, before_n = (np.zeros(len(ids), np.int64) for _ in range(5))
    for own, (_, *told) in zip(places, asked.values()):
        for total, x in zip((after, after_n, twice, before, before_n), told):
            total[own] += x
    once_after, once_before = n - after_n, c - before_n
    after, before = after + once_after, before + once_before
    lengths = np.minimum(after, 1)
    sums = [(n > 0).sum(), n.sum(), after.sum(), once_after.sum(), twice.sum(), (after == 1).sum(), (after == 2).sum()]
    yield 0, SUMS, number, _pack(np.array(sums, np.int64))
    yield number, WORDS, number, _pack(ids, n, c, once_after, once_before, after, before, np.zeros(len(ids), np.int64), np.zeros(0, np.int64))
    yield number, ASKS, number, _pack(np.array([*asked], np.int64), np.array([len(x) for x in places], np.int64), _joined(places, np.int64))
    yield number, CALLS, number, _pack(np.array([*calls], np.int64), np.array([len(x[0]) for x in calls.values()], np.int64), at)
    for bucket, own in zip(asked, places):
        yield bucket, DOWN, number, _pack(after[own], lengths[own], before[own], c[own])


def _seat_types(discount: float, parent: Parent, sweep: int, sample: bool, last: bool, word_bits: int) -> Callable:
    def run(bucket: int, got: dict[int, dict[int, list[np.ndarray]]]) -> Iterator[Message]:
        """A bucket's types after a sweep; before it, their predictive probability joins the total if it is a sample's."""
        ids, u, w, n, lengths, flat, total = got[STATE][bucket]
        own, word_tables, tables, c = (_joined([x[i] for x in got.get(DOWN, {}).values()], np.int64) for i in range(4))
        p, tables, c = parent.of(own, word_tables)[w], tables[u], c[u]
        if sample:
            total = total + ((n - discount * lengths) + (STRENGTH + discount * tables) * p) / (STRENGTH + c)
        if last and STATUS in got:
            value = np.log10(total / SAMPLES).astype(np.float32)
            for chunk, (status, slots) in got[STATUS].items():
                yield chunk, OF_TYPES, bucket, _pack(status, value[slots])
            return
        if not last:
            others, hashes = tables - np.where(lengths > 0, lengths, 1), _ids(ids)
            seed, starts = hashes[w] + hashes[u] * _STEP[3], np.cumsum(lengths) - lengths
            parts = []
            for a in range(0, len(n), SEATED):
                at = slice(a, a + SEATED)
                held = flat[starts[a] : starts[a] + int(lengths[at].sum())]
                parts.append(reseat(held, lengths[at], n[at], (STRENGTH + discount * others[at]) * p[at], discount * p[at], discount, seed[at], sweep))
            flat, lengths = (_joined([x[i] for x in parts], np.int64) for i in (0, 1))
            told = [np.bincount(x, lengths, len(ids)).astype(np.int64) for x in (w, u)]
            yield from _dealt(UP, bucket, _ids(ids), word_bits, *told)
        yield bucket, STATE, bucket, _pack(ids, u, w, n, lengths, flat, total)

    return run


def _seat_words(old: Parent, sweep: int, keep: bool, last: bool) -> Callable:
    def run(number: int, got: dict[int, dict[int, list[np.ndarray]]]) -> Iterator[Message]:
        """The words after the parent's sweep; a sample's customers, tables, and tables in the word's restaurant are kept."""
        ids, n, c, once_after, once_before, _, _, lengths, flat, *samples = got[WORDS][number]
        asks, many, at = got[ASKS][number]
        own, tables, places = once_after.copy(), once_before.copy(), np.split(at, np.cumsum(many)[:-1])
        for bucket, place in zip(asks.tolist(), places):
            by_w, by_u = got[UP][bucket]
            own[place] += by_w
            tables[place] += by_u
        several, seated = own > 1, own.copy()  # one customer has one table
        ones, parts, held = np.ones(int(several.sum())), [], flat[np.repeat(several, lengths)]
        hashes, before, starts = _ids(ids)[several], lengths[several], np.cumsum(lengths[several]) - lengths[several]
        opening = ones * (STRENGTH + old.discount * old.tables) * old.base() - old.discount * old.base() * before
        for a in range(0, len(ones), SEATED):
            rows = slice(a, a + SEATED)
            mine = held[starts[a] : starts[a] + int(before[rows].sum())]
            parts.append(reseat(mine, before[rows], own[several][rows], opening[rows], ones[rows] * old.discount * old.base(), old.discount, hashes[rows], sweep))
        after = _joined([x[1] for x in parts], np.int64)
        seated[several] = after
        flat = np.ones(int(seated.sum()), np.int64)
        flat[np.repeat(several, seated)] = _joined([x[0] for x in parts], np.int64)
        yield 0, SUMS, number, _pack(np.array([own.sum(), seated.sum()], np.int64))
        if keep:
            samples += [own, seated, tables]
        yield number, WORDS, number, _pack(ids, n, c, once_after, once_before, own, tables, seated, flat, *samples)
        for bucket, place in zip(asks.tolist(), places):
            yield bucket, DOWN, number, _pack(own[place], seated[place], tables[place], c[place])
        if last and CALLS in got:
            chunks, many, at = got[CALLS][number]
            for chunk, place in zip(chunks.tolist(), np.split(at, np.cumsum(many)[:-1])):
                yield chunk, OF_WORDS, number, _pack(n[place], c[place], *(x[place] for x in samples))

    return run


class Sampled:
    """What the sampler leaves: its last messages to types and words, totals of tokens and known words, the parent in each sample, the children's discount."""

    def __init__(self, types: DataFrame, words: DataFrame, tokens: int, known: int, parents: list[Parent], discount: float):
        self.types, self.words, self.tokens, self.known, self.parents, self.discount = types, words, tokens, known, parents, discount


def _sample(spark: SparkSession, begun: DataFrame, tokens: DataFrame, bits: int, asked: DataFrame | None = None) -> Sampled:
    """``begun``: the buckets' states and what they tell the words; ``tokens``: what chunks tell them; ``asked``: what chunks want to know of types."""
    word_bits = _word_bits(bits)
    met = shared_table(_step(spark, 1 << word_bits, _meet, (tokens, TOKENS), (begun, UP)), "met")
    discard(spark, tokens)
    known, n, kinds, n1, n2, k1, k2 = _sums(met, 7)
    discount, parent, parents = _discount(n1, n2), Parent(float(kinds), float(known), _discount(k1, k2), known), []
    state, words = begun, met
    for sweep in range(BURN_IN + SAMPLES + 1):
        last, final = sweep == BURN_IN + SAMPLES, sweep == BURN_IN + SAMPLES - 1
        more = [(asked, STATUS)] if last and asked is not None else []
        seated = shared_table(_step(spark, 1 << bits, _seat_types(discount, parent, sweep, sweep > BURN_IN, last, word_bits), (state, STATE), (words, DOWN), *more), "answers" if more else "seated")
        discard(spark, state)
        state = seated
        if last:
            break
        more = [(met, CALLS)] if final else []
        swept = shared_table(_step(spark, 1 << word_bits, _seat_words(parent, sweep, sweep >= BURN_IN, final), (words, WORDS), (met, ASKS), (state, UP), *more), "swept")
        discard(spark, *([words] if words is not met else []))
        words = swept
        own, tables = _sums(words, 2)
        parent = Parent(float(own), float(tables), parent.discount, known)
        if sweep >= BURN_IN:
            parents.append(parent)
    discard(spark, met)
    return Sampled(state, words, n, known, parents, discount)


def _bits(tokens: int) -> int:
    """The first bits of a hash that make a bucket, by tokens."""
    return max(1, (tokens // BUCKET_TOKENS).bit_length())


def _word_bits(bits: int) -> int:
    """Those of words, which are fewer than types."""
    return max(1, bits - 3)


def gibbs(types: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, list[Parent], float]:
    """Types seen twice or more (u, w, n, total: averaged probability), words with p0, p1, ... and b0, b1, ... of each sample, the parent in each sample, and the children's discount.

    p: the parent's probability of the word; b: the share of the parent in the word's restaurant.
    """
    spark = types.sparkSession
    bits = _bits(types.count())
    word_bits = _word_bits(bits)
    begin = _begin(word_bits)

    def of_types(table: pa.Table) -> pa.Table:
        u, w, n = (table.column(x).to_numpy() for x in ("u", "w", "n"))
        bucket = table.column("to")[0].as_py()
        return _sent([*begin(bucket, {SLOTS: {bucket: [n]}, NAMES: {0: [u.view(np.uint64), w.view(np.uint64)]}})])

    def of_words(table: pa.Table) -> pa.Table:
        ids, n, c = (table.column(x).to_numpy() for x in ("id", "n", "c"))
        return _sent([(table.column("to")[0].as_py(), TOKENS, 0, _pack(ids.view(np.uint64), n, c))])

    several = types.where("n > 1").withColumn("to", F.pmod(F.xxhash64("u", "w"), F.lit(1 << bits)))
    begun = shared_table(several.groupBy("to").applyInArrow(of_types, MESSAGE), "seated")
    tokens = shared_table(words.withColumn("to", F.shiftrightunsigned("id", 64 - word_bits)).groupBy("to").applyInArrow(of_words, MESSAGE), "tokens")
    got = _sample(spark, begun, tokens, bits)
    ranks, parents, discount = range(SAMPLES), got.parents, got.discount
    values = [f"{x}{k}" for x in "pb" for k in ranks]

    def type_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                ids, u, w, n, _, _, total = _unpack(data)
                ids = _ids(ids).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[u], ids[w], n, total)], names=["u", "w", "n", "total"])

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                ids, n, c, _, _, own, _, _, _, *samples = _unpack(data)
                p, b = _shares(parents, discount, c, samples)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_ids(ids).view(np.int64), n, c, own, *p, *b)], names=["id", "n", "c", "own", *values])

    state = got.types.where(F.col("kind") == STATE).select("data").mapInArrow(type_rows, "u long, w long, n long, total double")
    rows = got.words.where(F.col("kind") == WORDS).select("data").mapInArrow(word_rows, "id long, n long, c long, own long, " + ", ".join(f"{x} double" for x in values))
    return state, rows, parents, discount


def _shares(parents: list[Parent], discount: float, c: np.ndarray, samples: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each sample the parent's probability of words, and its share in their restaurants."""
    p = [np.where(own > 0, x.of(own, tables), x.unknown()) for x, own, tables in zip(parents, samples[::3], samples[1::3])]
    return p, [(STRENGTH + discount * tables) / (STRENGTH + c) for tables in samples[2::3]]


def score(docs: DataFrame, learn: Column, *keep: str, text_col: str = "text") -> DataFrame:
    """The kept columns, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = [f"_own_{i}" for i in range(len(keep))]
    text = docs[text_col].cast("string").alias("text")
    chosen = docs.select(*[docs[f"`{c}`"].alias(k) for c, k in zip(keep, kept)], F.coalesce(learn, F.lit(False)).alias("_learn"), text)
    kinds = {k: t for k, t in chosen.dtypes if k in kept}
    most = max(1, HELD_TOKENS // 3)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with its number; and a row for each chunk, which has the number of its first text."""
        number = TaskContext.get().partitionId() << 40
        numbers = lambda: defaultdict(count(1).__next__, {None: 0})  # noqa: E731  words in the order of arrival, after the start
        at, sizes, training, places = array("I"), [], [], numbers()
        fields: list[pa.Field] = []

        def out() -> pa.RecordBatch:
            words = np.fromiter(chain([START], map(word_id, islice(places, 1, None))), np.int64, len(places))
            packed = Chunk.write(words, np.frombuffer(at, np.uint32), np.array(sizes, np.int64), np.array(training, bool))
            arrays = [*[pa.nulls(1, f.type) for f in fields], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([number - len(sizes)]), pa.array([len(at)]), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=[*kept, "rid", "n_tokens", "chunk", "held", "data"])

        for batch in batches:
            fields, m = [batch.schema.field(i) for i in range(len(kept))], batch.num_rows
            for text in batch.column("text").to_pylist():
                before = len(at)
                at.extend(map(places.__getitem__, words_of(text)))
                sizes.append(len(at) - before)
            training += batch.column("_learn").to_pylist()
            arrays = [*batch.columns[: len(kept)], pa.array(number + np.arange(m)), pa.array(sizes[len(sizes) - m :], pa.int64()), *[pa.nulls(m, pa.int64())] * 2, pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "rid", "n_tokens", "chunk", "held", "data"])
            number += m
            if len(at) >= most:
                yield out()
                at, sizes, training, places = array("I"), [], [], numbers()
        if len(at):
            yield out()

    schema = ", ".join([*(f"{k} {t}" for k, t in kinds.items()), "rid long, n_tokens long, chunk long, held long, data binary"])
    looked = shared_table(chosen.mapInArrow(cut, schema), "looked")
    chunks = looked.where("chunk is not null").select(F.col("chunk").alias("to"), F.lit(CHUNK).cast("long").alias("kind"), F.col("chunk").alias("src"), "data")
    counted_rows = looked.agg(F.sum("held").alias("held"), F.count("chunk").alias("chunks")).first()
    bits, parts = _bits(int(counted_rows["held"] or 0)), max(1, 2 * counted_rows["chunks"])
    counted = shared_table(_step(spark, 1 << bits, _count, (_counts(chunks, bits), COUNT)), "counted")
    discard(spark)  # the counts' shuffles
    named = shared_table(_step(spark, parts, _name(bits, _word_bits(bits)), (chunks, CHUNK), (counted, PLACES)), "named")
    discard(spark)
    begun = shared_table(_step(spark, 1 << bits, _begin(_word_bits(bits)), (counted, SLOTS), (named, NAMES)), "seated")
    got = _sample(spark, begun, named, bits, counted)
    discard(spark, counted)
    parents, discount, scale = got.parents, got.discount, float(got.tokens + got.known + 1)

    def work_out(number: int, asked: dict[int, dict[int, list[np.ndarray]]]) -> tuple[np.ndarray, ...]:
        """The sums of each text of a chunk."""
        chunk = Chunk.read(asked[CHUNK][number])
        back = np.argsort(chunk.by_id())
        n, c, *samples = (np.concatenate(x)[back] for x in zip(*asked[OF_WORDS].values()))
        p, b = (np.stack(x, 1) for x in _shares(parents, discount, c, samples))
        status, values = (np.concatenate(x) for x in zip(*asked[OF_TYPES].values()))
        value = np.zeros(len(status))
        value[status == 2] = values
        _, token, of = chunk.types()
        lone = np.flatnonzero(status < 2)
        u, w = chunk.before[token[lone]], chunk.at[token[lone]]
        value[lone] = np.log10(np.einsum("ij,ij->i", p[w], b[u]) / SAMPLES + status[lone] * (1 - discount) / (STRENGTH + c[u]))
        owner, base, known = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes), np.log10((n + 1) / scale), (n > 0).astype(np.float64)
        total = lambda x: np.bincount(owner, x, len(chunk.sizes))
        return number + np.arange(len(chunk.sizes)), total(known[chunk.at]), total(base[chunk.at]), total(value[of])

    worked = shared_table(_step(spark, parts, work_out, (chunks, CHUNK), (got.words, OF_WORDS), (got.types, OF_TYPES), schema="rid long, n_known double, base_score double, score double"), "worked")
    discard(spark, got.words, got.types)
    whole = looked.where("rid is not null").select(*kept, F.col("rid").alias("_rid"), "n_tokens").join(worked, F.col("_rid") == F.col("rid"))
    results = {"n_tokens": F.col("n_tokens"), "n_known": F.col("n_known").cast("long"), "train_tokens": F.lit(got.tokens).cast("long"), "base_score": F.col("base_score"), "score": F.col("score")}
    own = [F.col(k).alias(c) for k, c in zip(kept, keep) if c not in results]
    return whole.select(*own, *[x.alias(c) for c, x in results.items()])


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, ~held_out(docs["doc_id"], 7, 2), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


QUERIES = {"op8_lm_scores": op8_lm_scores}
ORACLE: dict[str, str] = {}
