"""Conversations, sentences and chunks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import SENTENCE, strip, words
from graphloom.operators.sentences import Splitter, split

ROLES = ("user", "assistant")


def invalid_messages(messages: DataFrame) -> DataFrame:
    """Messages without a role or a text, or of an unknown role."""
    known = F.col("role").isin(*ROLES, "system")
    return messages.where(F.col("role").isNull() | F.col("text").isNull() | ~known)


def message_lines(messages: DataFrame) -> DataFrame:
    """User and assistant messages as "role: text"; other roles are dropped."""
    return messages.where(F.col("role").isin(*ROLES)).select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))


def flatten(messages: DataFrame) -> DataFrame:
    """(conv_id, text): each conversation's lines in order of turns."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda m: m["line"])
    return message_lines(messages).groupBy("conv_id").agg(F.array_join(lines, "\n").alias("text"))


def sentences(text: Column) -> Column:
    """Sentences by rule: runs up to their closing marks or the line's end, without outer white space."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip), lambda s: s != "")


def chunk(text: Column, size: int = 500, parts: Column | None = None) -> Column:
    """Chunks of about ``size`` characters: sentences packed one after another, too long ones by word.

    The sentences are ``parts``, or those of the rule.

    A word longer than the size is a chunk of its own, and an empty chunk goes before one that
    opens a long sentence. The rest of a long sentence doesn't share its chunk. Size 0: one chunk.
    """
    if not size:
        return F.array(text)
    full = lambda buffer, part: F.length(buffer) + F.length(part) + 1 > size
    flushed = lambda acc: F.when(F.length(acc["buf"]) > 0, F.array_append(acc["out"], strip(acc["buf"]))).otherwise(acc["out"])
    state = lambda out, buf: F.struct(out.alias("out"), buf.alias("buf"))
    start = state(F.array().cast("array<string>"), F.lit(""))

    def by_word(acc: Column, word: Column) -> Column:
        over = full(acc["buf"], word)
        return F.when(over, state(F.array_append(acc["out"], strip(acc["buf"])), F.concat(word, F.lit(" ")))).otherwise(state(acc["out"], F.concat(acc["buf"], word, F.lit(" "))))

    def by_sentence(acc: Column, s: Column) -> Column:
        packed = F.aggregate(words(s), state(F.array().cast("array<string>"), F.lit("")), by_word, flushed)
        long = state(F.concat(flushed(acc), packed), F.lit(""))
        fresh = state(flushed(acc), F.concat(s, F.lit(" ")))
        return F.when(~full(acc["buf"], s), state(acc["out"], F.concat(acc["buf"], s, F.lit(" ")))).when(F.length(s) > size, long).otherwise(fresh)

    return F.aggregate(sentences(text) if parts is None else parts, start, by_sentence, flushed)


def chunks(docs: DataFrame, size: int = 500, drop_empty: bool = False, splitter: Splitter | None = None) -> DataFrame:
    """(doc_id, chunk_id, text) of documents (doc_id, text); sentences are those of a learned splitter, if one is given."""
    parts = None
    if splitter is not None:
        docs, parts = split(docs.withColumn("_whole", F.col("text")), splitter, "doc_id", "_whole").withColumnRenamed("_whole", "text"), F.col("sentences")
    out = docs.select("doc_id", F.posexplode(chunk(F.col("text"), size, parts)).alias("chunk_id", "text"))
    return out.where("text <> ''") if drop_empty else out
