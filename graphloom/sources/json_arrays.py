"""JSON arrays of any size, split at their elements' borders, and written by many tasks.

A file is read as text whose records end at commas, so Spark splits it by byte ranges like any text.
Whether a comma lies in a string, and how deep in brackets, depends on all that stands before it.
So a first pass notes, for each split, how it changes depth and quotes, once for a begin outside
of a string and once for one inside; a row for each split goes through the driver (some 100 bytes
for each split of the file, 128 MB as Spark is set up) and gives each the state it
begins in. A second pass cuts the splits at the commas of depth one. Elements that cross borders of splits are
put together from their pieces by key; all others never leave their task.

Files without anything but white space hold no elements; a top level other than an array is an error. An element
is a string in a row, so it is bounded as rows are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.storage import broadcast_if_small, shared_table

#: Strings, to their end or that of the text, and what tells the depth.
TOKENS = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[\]{},]', re.DOTALL)
REST = re.compile(r'(?:[^"\\]|\\.)*("?)', re.DOTALL)
WHOLE, HEAD, MIDDLE, TAIL = "whole", "head", "middle", "tail"


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    """(file, begin of the split, text): the text of consecutive records, with their commas."""
    for batch in batches:
        files, begins, values = (batch.column(c).to_pylist() for c in ("file", "begin", "value"))
        at = 0
        while at < len(values):
            end = at
            while end < len(values) and (files[end], begins[end]) == (files[at], begins[at]):
                end += 1
            yield files[at], begins[at], ",".join(values[at:end]) + ","
            at = end


def walk(text: str, inside: bool) -> Iterator[tuple[str, int, bool]]:
    """(mark, place, whether the text ends inside a string) of the brackets and commas outside of strings; the last has no mark."""
    at = 0
    if inside:
        rest = REST.match(text)
        at, inside = rest.end(), not rest[1]
    for m in TOKENS.finditer(text, at):
        if m[0][0] == '"':
            inside = not m[1]
        else:
            yield m[0], m.start(), False
    yield "", len(text), inside


def _effect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: its first mark, and the change of depth and the end state by either begin."""
    found: dict[tuple[str, int], list] = {}
    for file, begin, text in _splits(batches):
        row = found.setdefault((file, begin), ["", [0, False], [0, True]])
        row[0] = row[0] or text.lstrip(" \t\r\n﻿")[:1]
        for state in row[1:]:
            for mark, _, inside in walk(text, state[1]):
                state[0] += (mark in "[{") - (mark in "]}") if mark else 0
                state[1] = inside if not mark else state[1]
    rows = [(f, b, r[0], *r[1], *r[2]) for (f, b), r in found.items()]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "begin", "first", "depth0", "inside0", "depth1", "inside1"])


def _begins(rows: list) -> dict[tuple[str, int], tuple[int, bool]]:
    """The depth and the quotes that each split begins in."""
    out, state, file = {}, (0, False), None
    for r in sorted(rows, key=lambda r: (r["file"], r["begin"])):
        if r["file"] != file:
            file, state, first = r["file"], (0, False), r["first"]
            if first not in ("", ",", "["):
                raise ValueError("the top level must be a list")
            if first == ",":  # the record of an empty file
                continue
        out[r["file"], r["begin"]] = state
        depth, inside = (r["depth1"], r["inside1"]) if state[1] else (r["depth0"], r["inside0"])
        state = (state[0] + depth, inside)
    return out


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(value, pos): the elements of files that each hold a JSON array, as JSON, and their numbers in their file from 0."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin")]
    pieces = spark.read.text(path, lineSep=",").select(*meta, "value")
    effects = pieces.mapInArrow(_effect, "file string, begin long, first string, depth0 long, inside0 boolean, depth1 long, inside1 boolean")
    states = spark.sparkContext.broadcast(_begins(effects.collect()))  # a row for each split

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, depth, inside, open_, number = None, [], 0, False, False, 0
        out: list[tuple] = []

        def close() -> None:
            if at is not None and held:
                out.append((*at, number, TAIL if open_ else MIDDLE, "".join(held)))

        def rows() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["file", "begin", "number", "kind", "value"])
            out.clear()
            return batch

        for file, begin, text in _splits(batches):
            if (file, begin) not in states.value:
                continue
            if (file, begin) != at:
                close()
                at, held, open_, number = (file, begin), [], False, 0
                depth, inside = states.value[at]
            start, opened = 0, 0
            for mark, place, ends in walk(text, inside):
                if not mark:
                    inside = ends
                    break
                before = depth
                depth += (mark in "[{") - (mark in "]}")
                if mark == "[" and before == 0:
                    start, open_, held = place + 1, True, []
                elif mark in ",]" and before == 1:  # an element ends, and after a comma the next begins
                    held.append(text[start:place])
                    out.append((*at, number, WHOLE if open_ else HEAD, "".join(held)))
                    number, held, start, open_ = number + 1, [], place + 1, mark == ","
            if depth > 0:
                held.append(text[start:])
            else:
                held = []
            if len(out) >= 1000:
                yield rows()
        close()
        yield rows()

    parts = shared_table(pieces.mapInArrow(cut, "file string, begin long, number long, kind string, value string"), "elements")
    crossing = parts.where(F.col("kind") != WHOLE)
    # pieces belong to the last tail at or before them in their file; keys only are ordered
    order = Window.partitionBy("file").orderBy("begin", "number")
    keys = crossing.select("file", "begin", "number", "kind").withColumn("owner", F.max(F.when(F.col("kind") == TAIL, F.col("begin"))).over(order))
    joined = crossing.join(keys.select("file", "begin", "number", "owner"), ["file", "begin", "number"]).groupBy("file", F.col("owner").alias("begin")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("begin").alias("b"), "number", "value"))), lambda p: p["value"]), "").alias("value"), F.max(F.when(F.col("kind") == TAIL, F.col("number"))).alias("number"))
    every = parts.where(F.col("kind") == WHOLE).select("file", "begin", "number", "value").unionByName(joined.select("file", "begin", "number", "value"))
    every = shared_table(every.select("file", "begin", "number", F.regexp_replace("value", r"^\s+|\s+$", "").alias("value")).where("value <> ''"), "elements")
    # an element counts where it begins
    counts = every.groupBy("file", "begin").agg(F.count("*").alias("n"), F.min("number").alias("least"))
    before = Window.partitionBy("file").orderBy("begin")
    offsets = counts.withColumn("offset", F.sum("n").over(before) - F.col("n") - F.col("least")).select(F.col("file").alias("_file"), F.col("begin").alias("_begin"), "offset")
    placed = every.join(broadcast_if_small(offsets), (F.col("file") == F.col("_file")) & (F.col("begin") == F.col("_begin")))
    return placed.select("value", (F.col("offset") + F.col("number")).alias("pos"))


def write_array(values: DataFrame, path: str) -> None:
    """Writes the JSON texts of the column value; each task's file is an array of its own, so the folder reads as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            if batch.num_rows:
                lines = [mark + v if i == 0 else "," + v for i, v in enumerate(batch.column("value").to_pylist())]
                mark = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"], pa.string())], names=["value"])

    values.select("value").where("value is not null").mapInArrow(run, "value string").write.mode("overwrite").text(path)
