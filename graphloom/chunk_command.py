"""Prints the chunks of a text: python -m graphloom.chunk_command [--input_file FILE] [--max_chunk_size N]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom.operators.chunks import chunks
from graphloom.sources.json_records import texts


def main(given: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(description="Chunks of a text, by sentences.")
    options.add_argument("--input_file", help="the text; the standard input if it isn't given")
    options.add_argument("--max_chunk_size", type=int, default=500, help="characters of a chunk, about")
    args = options.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    rows = chunks(texts(spark, args.input_file), args.max_chunk_size).orderBy("doc_id", "chunk_id")
    for number, row in enumerate(rows.toLocalIterator(), 1):
        print(f"--- Chunk {number} (length {len(row['text'])}): ---\n{row['text']}\n")


if __name__ == "__main__":
    main()
