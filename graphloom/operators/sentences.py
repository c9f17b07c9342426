"""Sentences by a splitter that learns from the texts themselves which periods end one (Kiss and Strunk 2006).

Learning is a few aggregations over all tokens. A word is an abbreviation if its period sticks to it
more than chance would have it, scaled down by its length and by each time it stands without. A
sentence starter is a word that stands after ends of sentences more often than chance; a collocation a pair around
the period of an abbreviation, initial or number that does. A word that stands in lower case
somewhere, but never in upper case within a sentence, marks a begin where it is capitalised.

A token that ends in ! or ? ends a sentence. One that ends in a period does, but for: an abbreviation (or
dots) unless a capitalised starter or a word that marks a begin follows; an initial or number that
makes a collocation with what follows, or before a lower-case word; and an initial before a capitalised word that is never in lower case, as names
are. Lines don't end sentences.

The model is whole. Up to LOCAL entries of each kind it is broadcast; a larger one stays tables, and what its periods are is decided by
joins, once for each two words around one. Null and empty texts have no sentences.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import once, words
from graphloom.storage import bound_batches, broadcast_if_small, shared_table

OPENERS, CLOSERS = "\"'(\\[{«„“‘", "\"')\\]}»”’,;:"
#: Least scores, as published: of abbreviations, of sentence starters and of collocations.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
NUMBER = "##"
#: Entries of a kind up to which a model is broadcast.
LOCAL = 100_000
_STRIP = re.compile(f"^[{OPENERS}]+|[{CLOSERS}]+$")
_TOKEN = re.compile(r"\S+")


@dataclass
class Splitter:
    abbreviations: frozenset[str] = field(default_factory=frozenset)
    starters: frozenset[str] = field(default_factory=frozenset)
    collocations: frozenset[tuple[str, str]] = field(default_factory=frozenset)
    begins: frozenset[str] = field(default_factory=frozenset)
    names: frozenset[str] = field(default_factory=frozenset)

    def ends(self, token: str, after: str) -> bool:
        """Whether a sentence ends between two tokens."""
        met = _met(token, after)
        if isinstance(met, bool):
            return met
        word, follows, dots, capital, low = met
        if dots or word in self.abbreviations:
            return capital and (follows in self.starters or follows in self.begins)
        initial = len(word) == 1 and word.isalpha()
        if initial or word == NUMBER:
            if (word, follows) in self.collocations or low:
                return False
            if initial and capital and follows in self.names:
                return False
        return True

    def sentences(self, text: str | None) -> list[str]:
        return _cut(text, lambda i, token, after: self.ends(token, after))


@dataclass
class TableSplitter:
    """The same model as tables (w), and (p, w) of collocations, for any number of entries."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    begins: DataFrame
    names: DataFrame

    def decided(self, met: DataFrame) -> DataFrame:
        """Rows (word, follows, dots, capital, low) with ``ends``, by the rules of ``Splitter``."""
        on = lambda table, at, flag: table.select(F.col("w").alias(at), F.lit(True).alias(flag)).distinct()
        out = met.join(on(self.abbreviations, "word", "_short"), "word", "left")
        out = out.join(on(self.starters.unionByName(self.begins), "follows", "_opens"), "follows", "left").join(on(self.names, "follows", "_named"), "follows", "left")
        tied = self.collocations.select(F.col("p").alias("word"), F.col("w").alias("follows"), F.lit(True).alias("_tied"))
        out = out.join(tied, ["word", "follows"], "left")
        has = lambda c: F.coalesce(c, F.lit(False))
        doubtful = F.col("initial") | (F.col("word") == NUMBER)
        ends = F.when(F.col("dots") | has("_short"), F.col("capital") & has("_opens"))
        ends = ends.when(doubtful & (has("_tied") | F.col("low")), False).when(F.col("initial") & F.col("capital") & has("_named"), False).otherwise(True)
        return out.select(*met.columns, ends.alias("ends"))


def _met(token: str, after: str) -> bool | tuple[str, str, bool, bool, bool]:
    """Whether a sentence ends between two tokens, or, after a period, what tells: both types, dots, and the case of what follows."""
    bare, next_ = _STRIP.sub("", token), _STRIP.sub("", after)
    if bare.endswith(("!", "?")):
        return True
    if not bare.endswith("."):
        return False
    return _type(bare), _type(next_), bare.endswith(".."), next_[:1].isupper(), next_[:1].islower()


def _cut(text: str | None, ends: Callable[[int, str, str], bool]) -> list[str]:
    """The sentences of a text; ``ends`` gets a token's place, the token and the one after it."""
    out, start, tokens = [], None, [*_TOKEN.finditer(text or "")]
    for i, m in enumerate(tokens):
        start = m.start() if start is None else start
        if i + 1 == len(tokens) or ends(i, m[0], tokens[i + 1][0]):
            out.append(text[start : m.end()])
            start = None
    return out


def _type(bare: str) -> str:
    word = re.sub(r"[.!?]+$", "", bare).lower()
    return NUMBER if re.fullmatch(r"[0-9][0-9.,-]*", word) else word


def _tokens(text: Column) -> Column:
    """An array of (w, dot, mark, up, low) of a text's tokens: type, whether it ends in one period, in ! or ?, and its first letter's case."""

    def parsed(bare: Column) -> Column:
        first = F.substring(bare, 1, 1)
        return F.struct(
            _typed(bare).alias("w"), _dotted(bare).alias("dot"),
            bare.rlike(r"[!?]$").alias("mark"), first.rlike(r"^\p{Lu}").alias("up"), first.rlike(r"^\p{Ll}").alias("low"),
        )

    return F.transform(words(F.coalesce(text, F.lit(""))), lambda raw: once(_bare(raw), parsed))


def _bare(raw: Column) -> Column:
    return F.regexp_replace(raw, f"^[{OPENERS}]+|[{CLOSERS}]+$", "")


def _typed(bare: Column) -> Column:
    word = F.lower(F.regexp_replace(bare, r"[.!?]+$", ""))
    return once(word, lambda w: F.when(w.rlike(r"^[0-9][0-9.,-]*$"), NUMBER).otherwise(w))


def _dotted(bare: Column) -> Column:
    return bare.endswith(".") & ~bare.endswith("..")


def type_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n, n_dot): ``word_counts`` without cases. Tokens are counted as they stand first, and only different ones are parsed."""
    tokens = docs.select(F.explode(words(docs[text_col].cast("string"))).alias("raw")).groupBy("raw").agg(F.count("*").alias("k"))
    typed = tokens.withColumn("bare", _bare(F.col("raw"))).select(_typed(F.col("bare")).alias("w"), _dotted(F.col("bare")).alias("dot"), "k").where("w <> ''")
    return typed.groupBy("w").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("dot"), F.col("k")).otherwise(F.lit(0))).alias("n_dot"))


def token_pairs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, dot, mark, up, low) of each token, and (before: the same) of the token before it, null at a text's begin; tokens of marks only have no type and are left out."""
    of = docs.select(_tokens(docs[text_col].cast("string")).alias("t"))
    of = of.select(F.filter("t", lambda x: x["w"] != "").alias("t"))
    pairs = of.select(F.explode(F.transform("t", lambda x, i: F.struct(x.alias("own"), F.get("t", i - 1).alias("before")))).alias("p"))
    return pairs.select("p.own.*", F.col("p.before").alias("before"))


def word_counts(pairs: DataFrame) -> DataFrame:
    """(w, n, n_dot, n_low, n_up): how often each type stands, with a period, in lower case, and capitalised within a sentence."""
    within = F.col("before").isNotNull() & ~F.col("before.dot") & ~F.col("before.mark")
    count = lambda c: F.count_if(c)
    return pairs.groupBy("w").agg(F.count("*").alias("n"), count(F.col("dot")).alias("n_dot"), count(F.col("low")).alias("n_low"), count(F.col("up") & within).alias("n_up"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """(w, n, n_dot, score) of the words that stand with a period somewhere."""
    totals = counts.agg(F.sum("n").alias("all_n"), F.sum("n_dot").alias("all_dots"))
    a, b, p = F.col("n_dot"), F.col("n") - F.col("n_dot"), F.col("all_dots") / F.col("all_n")
    likelihood = 2 * (a * (F.log(F.lit(0.99)) - F.log(p)) + F.when(b > 0, b * (F.log(F.lit(0.01)) - F.log(1 - p))).otherwise(F.lit(0.0)))
    length = F.length(F.replace("w", F.lit("."), F.lit("")))
    score = likelihood * F.exp(-length) * (F.length("w") - length + 1) * F.pow(length, -b)
    known = counts.join(F.broadcast(totals)).where((F.col("n_dot") > 0) & F.col("w").rlike(r"\p{L}"))  # one row of totals
    return known.select("w", "n", "n_dot", score.alias("score"))


def ratio(both: Column, first: Column, second: Column, every: Column) -> Column:
    """The log-likelihood ratio of two events that meet ``both`` times among ``every``."""
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    rest, other = every - first, every - second
    cells = [(both, first * second), (first - both, first * other), (second - both, rest * second), (every - first - second + both, rest * other)]
    return 2 * sum((cell(o, e / every) for o, e in cells), F.lit(0.0))


def learn(docs: DataFrame, text_col: str = "text", most: int | None = None, local: int = LOCAL) -> Splitter | TableSplitter:
    """The splitter that all texts teach: tables if a kind has more than ``local`` entries. Only a ``most`` that is given leaves entries out, all but those of the highest score or count."""
    first = lambda rows, *order: rows if most is None else rows.orderBy(*order).limit(most)
    pairs = token_pairs(docs, text_col)
    counts = shared_table(word_counts(pairs), "words")
    found = shared_table(first(abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION), F.desc("score"), "w").select("w"), "abbreviations")
    b = F.col("before")
    across = pairs.where(b["dot"] | b["mark"]).groupBy(b["w"].alias("p"), b["dot"].alias("dot"), "w").agg(F.count("*").alias("n"))
    across = across.join(broadcast_if_small(found.select(F.col("w").alias("p"), F.lit(True).alias("short")), LOCAL), "p", "left")
    across = shared_table(across, "across")
    short, alone = F.coalesce("short", F.lit(False)), F.col("p").rlike(r"^\p{L}$") | (F.col("p") == NUMBER)
    every = F.broadcast(counts.agg(F.sum("n").cast("double").alias("all_n")))  # one row
    own = counts.select("w", F.col("n").cast("double").alias("n_w"))
    after = across.where(~F.col("dot") | ~short).groupBy("w").agg(F.sum("n").cast("double").alias("n"))
    ends = F.broadcast(after.agg(F.sum("n").alias("all_ends")))  # one row
    tied = after.join(own, "w").join(every).join(ends).where(F.col("w").rlike(r"^\p{L}") & (F.col("n") / F.col("all_ends") > F.col("n_w") / F.col("all_n")))
    starters = first(tied.withColumn("g", ratio(F.col("n"), F.col("all_ends"), F.col("n_w"), F.col("all_n"))).where(F.col("g") >= STARTER), F.desc("g"), "w").select("w")
    tied = across.where(F.col("dot") & (short | alone)).select("p", "w", F.col("n").cast("double").alias("n")).join(own, "w").join(own.select(F.col("w").alias("p"), F.col("n_w").alias("n_p")), "p").join(every)
    tied = tied.where(F.col("n") / F.col("n_p") > F.col("n_w") / F.col("all_n")).withColumn("g", ratio(F.col("n"), F.col("n_p"), F.col("n_w"), F.col("all_n")))
    collocations = first(tied.where(F.col("g") >= COLLOCATION), F.desc("g"), "p", "w").select("p", "w")
    # of words that follow doubtful periods: which mark a begin, and which are names
    doubtful = across.where(F.col("dot") & (short | alone)).groupBy("w").agg(F.sum("n").alias("met")).join(counts, "w")
    pick = lambda c: first(doubtful.where(c), F.desc("met"), "w").select("w")
    begins, names = pick((F.col("n_low") > 0) & (F.col("n_up") == 0)), pick(F.col("n_low") == 0)
    tables = found, *(shared_table(t, n) for t, n in ((starters, "starters"), (collocations, "collocations"), (begins, "begins"), (names, "names")))
    if any(t.count() > local for t in tables):
        return TableSplitter(*tables)
    of = lambda rows: [tuple(r) if len(r) > 1 else r[0] for r in rows.collect()]  # noqa: E731  # local rows
    return Splitter(*(frozenset(of(t)) for t in tables))


def split(docs: DataFrame, splitter: Splitter | TableSplitter, *keep: str, text_col: str = "text") -> DataFrame:
    """The kept columns and the sentences of each text, in order."""
    bound_batches(docs.sparkSession)
    chosen = docs.select(*keep, docs[text_col].cast("string").alias("_text"))
    schema = ", ".join([f"`{c}` {t}" for c, t in chosen.dtypes if c != "_text"] + ["sentences array<string>"])
    if isinstance(splitter, TableSplitter):
        chosen, cut = _with_stops(chosen, splitter), lambda text, stops: _cut(text, _but_for(stops))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(splitter)  # 5 * LOCAL entries at most
        cut = lambda text: shared.value.sentences(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut(*row) for row in zip(*(c.to_pylist() for c in batch.columns[len(keep) :]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.string()))], names=[*keep, "sentences"])

    return chosen.mapInArrow(run, schema)


def _but_for(stops: list[int] | None) -> Callable[[int, str, str], bool]:
    """Ends as ``_cut`` asks for them: after each mark and period but for those at ``stops``."""
    none = set(stops or ())
    return lambda i, token, after: i not in none and _met(token, after) is not False


def _with_stops(chosen: DataFrame, splitter: TableSplitter) -> DataFrame:
    """The rows with the places of tokens whose period ends no sentence.

    What stands around periods is decided once for each two types and cases; places come back by the text's digest.
    """
    met = ["word", "follows", "dots", "capital", "low", "initial"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, rows = _TOKEN.findall(text), []
                for i, (token, after) in enumerate(zip(tokens, tokens[1:])):
                    if not isinstance(found := _met(token, after), bool):
                        rows.append((key, i, *found, len(found[0]) == 1 and found[0].isalpha()))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)

    kinds = pa.schema([("_key", pa.string()), ("at", pa.int32()), ("word", pa.string()), ("follows", pa.string()), *((c, pa.bool_()) for c in met[2:])])
    key = F.sha2("_text", 256)
    asked = chosen.where("_text is not null").select(key.alias("_key"), "_text").mapInArrow(ask, "_key string, at int, word string, follows string, dots boolean, capital boolean, low boolean, initial boolean")
    asked = shared_table(asked, "periods")
    stops = asked.join(splitter.decided(asked.select(*met).distinct()).where("not ends").drop("ends"), met, "left_semi")
    stops = stops.groupBy("_key").agg(F.collect_set("at").alias("_stops"))
    return chosen.withColumn("_key", key).join(stops, "_key", "left").select(*chosen.columns, "_stops")
