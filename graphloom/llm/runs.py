"""Periodic runs of words: every maximal stretch that repeats a shorter one.

A run is a stretch of consecutive words with smallest period q, at least 2 * q long, that can't be
made longer. A text's runs are found by its suffix automaton. Each state stands for the substrings
that end at the same places; the places of a state are the union of those of the states whose link
it is, and its own. Unions are made from the longest states to the shortest, the smaller set's
members going into the larger, ordered one. Where a new member's distance d to a neighbour isn't
above the state's length, the words of length d before both places are equal: a square, the seed of
a run. It is extended to both sides as far as words d apart agree. A run's first period occurs
nowhere between its first two places, so its distance always appears; of stretches that are found
with several distances the least is the period.

Before that, what can't be part of a run goes: in a run of 12 words or more every word lies in a
window of SEED words that occurs twice in the run. So stretches are cut at words that no window
repeated within the stretch covers, and each part again while that halves it; an automaton
then holds only what repeats. Parts are whole runs, however long: nothing is cut by length.

Null and empty texts have no words and no runs. Very long texts are worked on whole; one task holds
one text, its automaton and sets in some hundred bytes for each word that repeats. Repeated rows are
worked on one by one; an empty table gives an empty result. Other columns are ignored or kept,
whatever their names.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import GAP, SPACES, WORD, aside, read, small_batches

#: Least length of a run, in words, and words of the windows that tell what repeats; twice the window at most is the length.
LEAST, SEED = 12, 6
#: Members of a list in an ordered set before it is split.
FULL = 1024
WORDS = re.compile(WORD)


class Ends:
    """An ordered set of places in lists of bounded length."""

    def __init__(self, place: int):
        self.lists, self.lasts, self.size = [[place]], [place], 1

    def add(self, place: int) -> tuple[int, int]:
        """Adds a new place; returns its neighbours, -1 where there is none."""
        k = min(bisect_left(self.lasts, place), len(self.lists) - 1)
        own = self.lists[k]
        at = bisect_left(own, place)
        left = own[at - 1] if at else self.lasts[k - 1] if k else -1
        right = own[at] if at < len(own) else -1
        own.insert(at, place)
        self.lasts[k] = own[-1]
        self.size += 1
        if len(own) > FULL:
            half = len(own) // 2
            self.lists[k : k + 1] = [own[:half], own[half:]]
            self.lasts[k : k + 1] = [own[half - 1], own[-1]]
        return left, right

    def __iter__(self) -> Iterator[int]:
        for own in self.lists:
            yield from own


class Automaton:
    """The suffix automaton of a sequence of numbers.

    A state's first transition is kept in arrays, and only states with more have a dictionary.
    """

    def __init__(self, words: list[int]):
        self.length, self.link, self.end = array("i", [0]), array("i", [-1]), array("i", [-1])
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        last = 0
        for at, word in enumerate(words):
            last = self._extend(last, word, at)

    def _state(self, length: int, end: int) -> int:
        for part, value in ((self.length, length), (self.link, 0), (self.end, end), (self.word, -1), (self.to, -1)):
            part.append(value)
        return len(self.length) - 1

    def _next(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        return self.more[state].get(word, -1) if state in self.more else -1

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (word, -1):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _extend(self, last: int, word: int, at: int) -> int:
        new = self._state(self.length[last] + 1, at)
        state = last
        while state >= 0 and (to := self._next(state, word)) < 0:
            self._set(state, word, new)
            state = self.link[state]
        if state < 0:
            return new
        if self.length[to] == self.length[state] + 1:
            self.link[new] = to
            return new
        twin = self._state(self.length[state] + 1, -1)
        self.link[twin], self.word[twin], self.to[twin] = self.link[to], self.word[to], self.to[to]
        if to in self.more:
            self.more[twin] = dict(self.more[to])
        self.link[to] = self.link[new] = twin
        while state >= 0 and self._next(state, word) == to:
            self._set(state, word, twin)
            state = self.link[state]
        return new

    def squares(self) -> Iterator[tuple[int, int]]:
        """(place, distance): the words of that length up to the place equal those up to the place and distance."""
        sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in self.end]
        for state in np.argsort(-np.frombuffer(self.length, np.int32), kind="stable").tolist():
            parent = self.link[state]
            if parent <= 0:  # the empty word's places seed nothing
                sets[state] = None
                continue
            small, large, least = sets[state], sets[parent], self.length[parent]
            sets[state] = None
            if large is None:
                sets[parent] = small
                continue
            if small.size > large.size:
                small, large = large, small
            sets[parent] = large
            for place in small:
                left, right = large.add(place)
                if left >= 0 and place - left <= least:
                    yield left, place - left
                if right >= 0 and right - place <= least:
                    yield place, right - place


def _agreeing(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and from b agree, going up or down by one."""
    most = len(words) - b if step > 0 else a + 1
    done, look = 0, 16
    while done < most:
        n = min(look, most - done)
        lo = (a + done, b + done) if step > 0 else (a - done - n + 1, b - done - n + 1)
        same = words[lo[0] : lo[0] + n] == words[lo[1] : lo[1] + n]
        differing = np.flatnonzero(~(same if step > 0 else same[::-1]))
        if len(differing):
            return done + int(differing[0])
        done, look = done + n, look * 2
    return done


def _runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a stretch that are at least LEAST long."""
    known: dict[int, list[tuple[int, int]]] = {}  # by distance, in order: starts rise, and so do ends
    for place, d in Automaton(words.tolist()).squares():
        held = known.setdefault(d, [])
        k = bisect_left(held, (place - d + 2, -1)) - 1
        if k >= 0 and held[k][1] >= place + d:
            continue
        start = place + 1 - _agreeing(words, place, place + d, -1)
        end = place + d + _agreeing(words, place + 1, place + 1 + d, 1)
        insort(held, (start, end))
    least: dict[tuple[int, int], int] = {}
    for d, held in known.items():
        for stretch in held:
            least[stretch] = min(d, least.get(stretch, d))
    return [(start, end - start + 1, d) for (start, end), d in least.items() if end - start + 1 >= LEAST]


def _covered(words: np.ndarray) -> np.ndarray:
    """Whether a window of SEED words that occurs twice, by hash, covers a word."""
    n = len(words) - SEED + 1
    with np.errstate(over="ignore"):
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        keys = np.zeros(n, np.uint64)
        for i in range(SEED):
            keys = keys * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : i + n]
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(n + 1, bool)
    same[1:n] = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order] = same[:-1] | same[1:]
    change = np.zeros(len(words) + 1, np.int32)
    change[:n] += twice
    change[SEED : SEED + n] -= twice
    return change.cumsum()[:-1] > 0


def _parts(words: np.ndarray, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """The stretches that may hold runs."""
    todo = [(start, stop)]
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        inside = np.concatenate([[False], _covered(words[a:b]), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if 2 * (y - x) <= b - a:
                todo.append((a + x, a + y))
            elif y - x >= LEAST:
                yield a + x, a + y


def find_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of LEAST words or more, by start and then period."""
    if len(words) < LEAST:
        return []
    numbers: dict[str, int] = {}
    coded = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))
    if len(numbers) == len(words):
        return []
    found = [(a + start, length, period) for a, b in _parts(coded, 0, len(words)) for start, length, period in _runs_of(coded[a:b])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that stay: of each run the first period, less what another run drops."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(change.cumsum()[:-1] == 0).tolist()]


def detect(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The kept columns, runs (an array of start, length, period) and collapsed (the words that stay, one space apart)."""
    spark = docs.sparkSession
    small_batches(spark)
    held, names = aside(docs)
    kept = [names[c] for c in keep]
    chosen = held.select(*kept, F.col(names[text_col]).cast("string").alias("_text"))
    kinds = dict(chosen.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in kept] + ["runs array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed string"])
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for text in batch.column(len(kept)).to_pylist():
                words = WORDS.findall(text or "")
                own = find_runs(words)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                texts.append(" ".join(collapsed(words, own)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(runs, run_type), pa.array(texts, pa.string())], names=[*kept, "runs", "collapsed"])

    found = chosen.mapInArrow(run, schema)
    return found.select(*[F.col(names[c]).alias(c) for c in keep], "runs", "collapsed")


def repeating(text: Column, doc_id: Column) -> Column:
    """The text that the query looks at: of one document in ten, by crc32 of the id, words from a place on repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.split(F.btrim(text, F.lit(SPACES)), GAP)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # words before the place, its period, and the period again as often as it takes
    head, unit = F.slice(words, 1, a), F.slice(words, a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), 1, n - a)
    changed = F.array_join(F.concat(head, again), " ")
    return F.when((h % 10 == 0) & (F.length(F.translate(text, SPACES, "")) > 0), changed).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    docs = read(spark, sf_dir, "documents")
    found = detect(docs.select("doc_id", repeating(F.col("text"), F.col("doc_id")).alias("text")), "doc_id")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length, period = -F.col("_b.l"), F.col("_b.p")
    return found.select("doc_id", "n_runs", F.col("_b.s").alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * -_b.l) div _b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
#: Every period at every place is too slow in SQL over whole tables; the tests hold the query against a brute-force version.
ORACLE: dict[str, str] = {}
