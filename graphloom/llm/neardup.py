"""MinHash near-duplicates by ProbMinHash over weighted shingles.

Shingles are five words running (lower-cased; texts of fewer words are one shingle), weighted by
how often they stand in the text. Two texts are linked if the probability Jaccard similarity of
their weighted shingles, or the Jaccard similarity of their sets of shingles, is SIMILARITY at least;
classes are the components of links.

Each shingle is a Poisson process whose rate is its weight; arrivals fall on registers at random,
and a register keeps the shingle that arrives first (Ertl 2020, ProbMinHash1). A shingle's process
ends early, at the largest of the text's registers. Two texts agree on a register with the
probability Jaccard similarity of their weights. A text with repeated shingles has a second
signature, of equal weights, for the other similarity; without repeats both are the same. BANDS
bands of ROWS registers of each signature make candidates: a pair of either similarity 0.8 is missed
with a chance of (1 - 0.8**ROWS)**BANDS, which is 5e-5.

Equal texts are one node. In each bucket (texts that share a band) all are compared with the least
one, the pivot. Texts that these links haven't brought into the component of most of their bucket
then meet the bucket's texts of other components, in blocks of BLOCK texts, so a large bucket is many
tasks. A pair is looked at in the first band it shares, unless the sketches (a byte of each register)
of both signatures agree on fewer than AGREE registers, which a pair of similarity 0.8 does with a
chance of 1e-5. A task goes from the most alike pairs to the least, verifies those whose components
it hasn't joined yet, and hands on the links that join some: rows grow with the texts, not with
their pairs, and no link between components is lost.

Null texts are classes of their own. Empty texts are equal texts; they have no shingles and no
other links. A class is named by its least doc_id; rows with a null id don't name it. Rows that are
repeated or share an id belong to their texts' classes each. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import aside, broadcast_if_small, read, restored, shared_table, small_batches
from graphloom.llm.features import Words
from graphloom.operators.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Arrivals worked out for a text in one go, at least.
ARRIVALS = 700
#: Registers that sketches of similar texts share, of REGISTERS; texts of a block of a bucket.
AGREE, BLOCK = 80, 1024
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _word(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)


_WORDS = Words(_word)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the distinct shingles' owners (rising), hashes and counts."""
    words = [[*map(_WORDS.__getitem__, t.encode("utf-8", "surrogatepass").lower().split())] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.array([x for w in words for x in (*w, 1, 2, 3, 4)], np.int64).view(np.uint64)  # texts end in fixed numbers
    bases = np.cumsum(sizes + 4) - sizes - 4
    counts = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bases, counts)
    total = np.zeros(len(start), np.uint64)
    for j in range(SHINGLE):
        total = mixed(total + flat[start + j] * _ODD[j] if len(start) else total)
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.flatnonzero(np.concatenate([[True], (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])])) if len(total) else np.array([], np.int64)
    return owner[new], total[new], np.diff(np.append(new, len(total)))


def signatures(owner: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash1 of n texts: in each register the item that arrives first (0 if there is none)."""
    m = np.int64(REGISTERS)
    first = np.full(n * REGISTERS, np.inf)
    sign = np.zeros(n * REGISTERS, np.uint64)
    per_text = np.bincount(owner, minlength=n)
    times = np.zeros(len(items))
    done = np.zeros(len(items), np.uint64)
    while len(items):
        # so many arrivals of each item that a text gets ARRIVALS at least
        more = np.maximum(1, -(-ARRIVALS // np.maximum(per_text[owner], 1)))
        at = np.repeat(np.arange(len(items)), more)
        number = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)
        seed = mixed(items[at] + (done[at] + number.astype(np.uint64) + np.uint64(1)) * _ODD[0])
        wait = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / weights[at]
        total = np.cumsum(wait)
        start = np.cumsum(more) - more
        arrival = total - np.repeat(total[start] - wait[start], more) + times[at]
        register = owner[at] * m + (mixed(seed ^ _ODD[3]) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(first, register, arrival)
        won = first[register] == arrival
        sign[register[won]] = items[at[won]]
        limit = first.reshape(n, REGISTERS).max(1)
        last = arrival[start + more - 1]
        go = last < limit[owner]
        items, weights, owner, times, done = items[go], weights[go], owner[go], last[go], (done + more.astype(np.uint64))[go]
        per_text = np.bincount(owner, minlength=n)
    return sign.reshape(n, REGISTERS)


def bands(sign: np.ndarray) -> np.ndarray:
    """A number for each band of each text."""
    cells = sign.reshape(len(sign), BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[4], cells.shape[:2])
    for j in range(ROWS):
        total = mixed(total + cells[:, :, j] * _ODD[0])
    return total.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Exact probability Jaccard and plain Jaccard of two weighted sets (sorted hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = b[0][at] == a[0]
    both = int(shared.sum())
    if not both:
        return 0.0, 0.0
    plain = both / (len(a[0]) + len(b[0]) - both)
    if a[1].max() == 1 and b[1].max() == 1:  # without repeats both are the same
        return plain, plain
    at, bt = shared, at[shared]
    # shared shingles of equal weights count alike: work with the kinds of weight pairs
    kinds, many = np.unique(np.stack([a[1][at], b[1][bt]], 1), axis=0, return_counts=True)
    wa, wb = kinds[:, 0].astype(float), kinds[:, 1].astype(float)
    alone_a, alone_b = a[1].sum() - (wa * many).sum(), b[1].sum() - (wb * many).sum()
    ratios = np.maximum(wa[None] / wa[:, None], wb[None] / wb[:, None]) @ many + alone_a / wa + alone_b / wb
    return float((many / ratios).sum()), plain


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def sign_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, digest, bands array<long>, sketch) of the rows with a text: bands and sketches of both signatures, one after the other."""
    small_batches(docs.sparkSession)
    text = docs[text_col].cast("string")
    chosen = docs.where(text.isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), _digest(text).alias("digest"), text.alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            owner, items, weights = shingles(batch.column(2).to_pylist())
            has = np.bincount(owner, minlength=n) > 0
            sign = plain = signatures(owner, items, weights.astype(float), n)
            repeats = np.flatnonzero(np.bincount(owner, weights > 1, n))
            if len(repeats):
                own = np.isin(owner, repeats)
                plain = sign.copy()
                plain[repeats] = signatures(np.searchsorted(repeats, owner[own]), items[own], np.ones(int(own.sum())), len(repeats))
            both = np.stack([sign, plain], 1)
            numbers = np.concatenate([bands(sign), bands(plain)], 1)
            sketch = pa.array([r.tobytes() for r in (both >> np.uint64(56)).astype(np.uint8)], pa.binary())
            offsets = np.concatenate([[0], np.cumsum(has * 2 * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[has].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, sketch], names=["doc_id", "digest", "bands", "sketch"])

    return chosen.mapInArrow(run, "doc_id long, digest binary, bands array<long>, sketch binary")


def texts_of(wanted: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, t) of the digests (_wanted): the text of each, once.

    Few digests go to the texts; many meet them by a shuffle.
    """
    text = docs[text_col].cast("string")
    texts = docs.where(text.isNotNull()).select(_digest(text).alias("digest"), text.alias("t"))
    wanted = broadcast_if_small(shared_table(wanted.distinct(), "wanted"), 500_000)
    return texts.join(wanted, F.col("digest") == F.col("_wanted"), "left_semi").groupBy("digest").agg(F.first("t").alias("t"))


def verify(pairs: DataFrame, docs: DataFrame, text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar enough."""
    small_batches(docs.sparkSession)
    texts = shared_table(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("_wanted")), docs, text_col), "texts")
    full = pairs.join(texts.select(F.col("digest").alias("b"), F.col("t").alias("tb")), "b").join(texts.select(F.col("digest").alias("a"), F.col("t").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = {t: i for i, t in enumerate(dict.fromkeys(a + b))}
            owner, items, counts = shingles([*texts])
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            own = [(items[x:y], counts[x:y]) for x, y in zip(bounds, bounds[1:])]
            good = [max(similarity(own[texts[x]], own[texts[y]])) >= least for x, y in zip(a, b)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept, digest) of every row; kept: of a class, the text that names it.

    A row that is repeated as it is is one document: all its rows say kept.
    """
    signed = shared_table(sign_documents(docs, text_col), "signatures")
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    rows = nodes.select("digest", F.explode(F.array_distinct("bands")).alias("band"))
    # what hot keys meet is written first: then Spark can split the keys' partitions of the join
    buckets = shared_table(rows.groupBy("band").agg(F.min("digest").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = shared_table(rows.join(buckets.withColumnRenamed("band", "_band"), F.col("band") == F.col("_band")).select("band", "digest", "pivot", "n"), "members")
    done = shared_table(members.where("digest <> pivot").select(F.col("pivot").alias("a"), F.col("digest").alias("b")).distinct(), "pairs")
    links = shared_table(verify(done, docs, text_col, least), "links")
    found = components(links, merge=False)
    more = shared_table(_rest(members, found, signed, docs, text_col, least), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more), merge=False)
    found = shared_table(found, "roots")
    roots = nodes.join(found, F.col("digest") == F.col("node"), "left").select("digest", "rep", "copies", F.coalesce("root", "digest").alias("root"), F.col("root").isNotNull().alias("linked"))
    named = roots.where("linked or copies > 1")
    first = F.struct("rep", "digest")  # null ids come first in order, but name no class
    names = shared_table(named.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("rep").isNotNull(), first)), F.min(first)).alias("first")), "names")
    of = named.join(names.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select(F.col("digest").alias("_digest"), F.col("first.rep").alias("class_id"), F.col("first.digest").alias("_keeper"))
    of = shared_table(of, "classes")
    out = signed.join(of, F.col("digest") == F.col("_digest"), "left")
    kept = (F.coalesce("_keeper", "digest") == F.col("digest")) & F.coalesce("class_id", "doc_id").eqNullSafe(F.col("doc_id"))
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), kept.alias("kept"), "digest")
    null = docs.where(docs[text_col].isNull()).select(docs["doc_id"].cast("long").alias("doc_id"))
    return out.unionByName(null.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), F.lit(None).cast("binary").alias("digest")))


def _rest(members: DataFrame, found: DataFrame, signed: DataFrame, docs: DataFrame, text_col: str, least: float) -> DataFrame:
    """Links (a, b) between components of a bucket's texts, as many as join them."""
    big = members.where("n > 2")  # a bucket of two has been compared
    placed = big.join(found, F.col("digest") == F.col("node"), "left").select("band", "digest", "n", F.coalesce("root", "digest").alias("root"))
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("k"), F.max("n").alias("m")).where("k < m")
    main = shared_table(main, "main")
    columns = ["band", "digest", "root", "main", "k", "m"]
    opened = shared_table(placed.join(main.withColumnRenamed("band", "_band"), F.col("band") == F.col("_band")).select(*columns), "open")
    signs = signed.groupBy("digest").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")).withColumnRenamed("digest", "_d2")
    opened = opened.join(signs, F.col("digest") == F.col("_d2"))
    blocks, out = F.ceil(F.col("m") / BLOCK).cast("long"), F.ceil((F.col("m") - F.col("k")) / BLOCK).cast("long")
    columns = ["band", "digest", "root", "sketch", "bands"]
    opened = opened.select(*columns, (F.col("root") != F.col("main")).alias("outside"), blocks.alias("blocks"), out.alias("out"), F.xxhash64("digest").alias("at"))
    # a text outside its bucket's main component meets every block; every text meets every block of such
    one = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.lit(True).alias("asks"), F.pmod("at", "out").alias("i"), j.alias("j"))))
    other = F.transform(F.sequence(F.lit(0).cast("long"), F.col("out") - 1), lambda i: F.struct(F.lit(False).alias("asks"), i.alias("i"), F.pmod("at", "blocks").alias("j")))
    dealt = opened.select(*columns, F.explode(F.concat(F.coalesce(one, F.array().cast("array<struct<asks:boolean,i:bigint,j:bigint>>")), other)).alias("b")).select(*columns, "b.*")
    dealt = shared_table(dealt, "dealt")

    def alike(table: pa.Table) -> pa.Table:
        """Rows of a block that are in a pair that may be similar: only their texts are fetched."""
        at = np.unique(_candidates(table)[1:])
        return table.select(["band", "i", "j", "asks", "digest"]).take(pa.array(at))

    keys = ["band", "i", "j", "asks", "digest"]
    wanted = shared_table(dealt.groupBy("band", "i", "j").applyInArrow(alike, "band long, i long, j long, asks boolean, digest binary"), "alike")
    texts = texts_of(wanted.select(F.col("digest").alias("_wanted")), docs, text_col).withColumnRenamed("digest", "_d1")
    chosen = dealt.join(wanted, keys).join(texts, F.col("digest") == F.col("_d1")).select(*columns, "asks", "i", "j", "t")

    def meet(table: pa.Table) -> pa.Table:
        digests = table.column("digest").to_pylist()
        pairs = _candidates(table)
        _, roots = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)
        owner, items, counts = shingles(table.column("t").to_pylist())
        bounds = np.searchsorted(owner, np.arange(len(digests) + 1))
        parent = list(range(int(roots.max()) + 1))

        def find(r: int) -> int:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        links = []
        for at in np.argsort(-pairs[0], kind="stable").tolist():
            x, y = int(pairs[1, at]), int(pairs[2, at])
            a, b = find(roots[x]), find(roots[y])
            if a == b:
                continue
            own = [(items[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]]) for i in (x, y)]
            if max(similarity(*own)) >= least:
                parent[b] = a
                links.append((digests[x], digests[y]))
        return pa.table({"a": pa.array([p[0] for p in links], pa.binary()), "b": pa.array([p[1] for p in links], pa.binary())})

    return chosen.groupBy("band", "i", "j").applyInArrow(meet, "a binary, b binary").distinct()


def _candidates(table: pa.Table) -> np.ndarray:
    """Pairs of a block's rows that may be similar and share no earlier band: how many registers agree, the row that asks, the other."""
    asks, band = table.column("asks").to_numpy(), table.column("band")[0].as_py()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, 2, REGISTERS)
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    _, roots = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)
    inside = np.flatnonzero(~asks)
    found = [np.zeros((3, 0), np.int64)]
    for x in np.flatnonzero(asks):
        rest = inside[roots[inside] != roots[x]]
        agree = (sketch[rest] == sketch[x]).sum(2).max(1)
        rest, agree = rest[agree >= AGREE], agree[agree >= AGREE]
        first = bands[x][(bands[rest] == bands[x]).argmax(1)] == band  # no earlier band in common
        found.append(np.stack([agree[first], np.full(first.sum(), x), rest[first]]))
    return np.concatenate(found, 1)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of the documents of which one stays for each class, each once.

    Few dropped rows go to the texts; many meet them by a shuffle.
    """
    found = shared_table(classes(docs).select("doc_id", "digest", "kept"), "found")
    held, names = aside(docs)
    rows = held.select("*", F.col(names["doc_id"]).cast("long").alias("_id"), _digest(F.col(names["text"]).cast("string")).alias("_digest"))
    key = [F.col("doc_id").alias("_i"), F.col("digest").alias("_d")]
    same = F.col("_id").eqNullSafe(F.col("_i")) & F.col("_digest").eqNullSafe(F.col("_d"))
    dropped = found.where("not kept").select(*key).distinct()
    kept = rows.join(broadcast_if_small(dropped, 500_000), same, "left_anti")
    repeated = found.where("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(*key)
    if not repeated.isEmpty():
        again = broadcast_if_small(repeated, 500_000)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["_id", "_digest"]))
    return restored(kept, names)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and kept of every document."""
    return classes(read(spark, sf_dir, "documents")).drop("digest")


QUERIES = {"op6_minhash": op6_minhash}
ORACLE: dict[str, str] = {}
