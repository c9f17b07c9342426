"""Parsing what language models answer; nothing raises, what doesn't parse is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import answer_text, once, strip, strip_dashes

SEPARATORS = (" | ", "\t", " -> ")


def relation_line(line: Column) -> Column:
    """struct<s, p, o> of a line of three parts, by the first separator that gives three; else null."""
    triple = lambda parts: F.struct(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate("spo")])
    filled = lambda parts: once(F.transform(parts, strip), lambda x: F.when(F.forall(x, lambda y: y != ""), triple(x)))
    three = lambda parts: F.when(F.size(parts) == 3, filled(parts))
    split = lambda text, separator: once(F.split(text, r"\Q" + separator + r"\E"), three)
    return once(strip_dashes(line), lambda text: F.coalesce(*[split(text, x) for x in SEPARATORS]))


def entities(response: Column) -> Column:
    """Distinct non-blank strings of the answer's JSON array, in order."""
    items = F.try_variant_get(F.try_parse_json(answer_text(response)), "$", "array<variant>")
    texts = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string"))))
    return F.coalesce(F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def relations(response: Column) -> Column:
    """Distinct triples of three non-blank strings under "relations", or under "triple" if that key is absent."""
    value = F.try_parse_json(answer_text(response))
    keyed = F.schema_of_variant(value).rlike(r"^OBJECT<(?:.*[ ,<])?`?relations`?:")
    found = F.when(keyed, F.try_variant_get(value, "$.relations", "array<variant>")).otherwise(F.try_variant_get(value, "$.triple", "array<variant>"))
    return F.coalesce(F.array_distinct(_triples(found)), F.array().cast("array<array<string>>"))


def _triples(items: Column) -> Column:
    rows = F.transform(items, lambda v: F.try_variant_get(v, "$", "array<variant>"))
    rows = F.filter(rows, lambda r: r.isNotNull() & (F.size(r) == 3))
    texts = F.transform(rows, lambda r: F.transform(r, lambda v: F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string")))))
    return F.filter(texts, lambda r: F.forall(r, lambda x: x.isNotNull() & (x != "")))


def existing_triples(record: Column) -> Column:
    """Lists of three strings under "triple" of a JSON record, stripped; blanks and repeats stay."""
    rows = F.transform(F.try_variant_get(F.try_parse_json(record), "$.triple", "array<variant>"), lambda v: F.try_variant_get(v, "$", "array<variant>"))
    rows = F.filter(rows, lambda r: r.isNotNull() & (F.size(r) == 3) & F.forall(r, lambda v: F.schema_of_variant(v) == "STRING"))
    return F.coalesce(F.transform(rows, lambda r: F.transform(r, lambda v: strip(F.try_variant_get(v, "$", "string")))), F.array().cast("array<array<string>>"))


def record_text(raw_chunk: Column, text: Column) -> Column:
    """The first of both that isn't blank; else empty."""
    filled = lambda c: F.when(strip(c) != "", c)
    return F.coalesce(filled(raw_chunk), filled(text), F.lit(""))


def converted_triples(record: Column, key: str = "triple") -> Column:
    """Distinct lists of three parts under a key of a JSON record, every part as text and stripped.

    Parts that aren't strings are spelled as Python does: None, True, False. Lists with a blank
    part are left out; what isn't a list of lists gives none.
    """

    def spelled(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        plain = F.try_variant_get(v, "$", "string")
        return strip(F.when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain))

    rows = F.transform(F.try_variant_get(F.try_parse_json(record), f"$.{key}", "array<variant>"), lambda v: F.try_variant_get(v, "$", "array<variant>"))
    rows = F.filter(rows, lambda r: r.isNotNull() & (F.size(r) == 3))
    texts = F.filter(F.transform(rows, lambda r: F.transform(r, spelled)), lambda r: F.forall(r, lambda x: x.isNotNull() & (x != "")))
    return F.coalesce(F.array_distinct(texts), F.array().cast("array<array<string>>"))
