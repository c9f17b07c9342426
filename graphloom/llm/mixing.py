"""Mixing sources to target weights.

Every document gets a hash-random key: the md5 of a seed and its id. Within each source the
documents stand in key order, and distributed prefix sums of their words cut that order at the
source's exact budget; a budget beyond the source's size first takes whole epochs.

The order is dealt out in ranges of the key: a source has as many equal ranges as its rows need,
so that a hot source is spread over many tasks. A range's own sum (a combined aggregate) is
summed up over the source's ranges, then each range sums up its rows.

Targets: sources by code point, nulls last, weigh 5, 2, 1, repeating; targets share all words by
weight, but stop at three times their source's size, the excess going to the others by weight.
That is the level L at which the sum of min(cap, weight * L) is the total; it is found from the
sources sorted by cap over weight.

Null and empty texts have size 0 and take nothing. Null ids get the key of an empty id. Rows that
are repeated or share an id stand next to each other, in the order of their text's md5; equal rows
can't be told apart, so which of them is cut is all the same. Other columns pass through `mix`
untouched, but one that has the name of a result gives way to it; `mixed_rows` returns the
documents' own columns, whatever their names. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, aside, broadcast_if_small, read, restored, shared_table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows of a range of keys, about.
RANGE_ROWS = 2000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """_source, _size, _rows, _target (double), _budget (long) for a table of sources (_source, _size, _rows)."""
    everything = Window.partitionBy(F.lit(1))  # a row for each source
    by_name = everything.orderBy(F.col("_source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("_weight", F.get(F.array(*map(F.lit, weights)), place).cast("long")).withColumn("_cap", F.lit(max_epochs) * F.col("_size"))
    order = everything.orderBy((F.col("_cap").cast("double") / F.col("_weight")).asc(), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("_size").over(everything), F.sum("_weight").over(everything)
    ranked = ranked.withColumn("_left", total - F.coalesce(F.sum("_cap").over(before), F.lit(0))).withColumn("_open", weight - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    # a source is at its cap if, with all of smaller ratio at theirs, its share isn't below the cap
    ranked = ranked.withColumn("_full", F.col("_weight") * F.col("_left") >= F.col("_cap") * F.col("_open"))
    ranked = ranked.withColumn("_full", F.min("_full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_rest", F.coalesce(F.max(F.when(~F.col("_full"), F.col("_left"))).over(everything), F.lit(0)))
    ranked = ranked.withColumn("_share", F.max(F.when(~F.col("_full"), F.col("_open"))).over(everything))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise((F.col("_weight") * F.col("_rest")).cast("double") / F.col("_share"))
    return ranked.select("_source", "_size", "_rows", target.alias("_target")).withColumn("_budget", F.floor(F.col("_target") + 0.5).cast("long"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(docs: DataFrame, id_col: str, text_col: str, seed: str) -> tuple[Column, Column]:
    """A row's key and what orders rows of one key."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))).cast("binary"))
    return key.alias("_key"), F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")).alias("_tie")


def mix(docs: DataFrame, *keep: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", whole: bool = False, seed: str = "mix") -> DataFrame:
    """The kept columns with size, source_size, target, and what the mix takes of each document.

    copies: whole copies; taken: words. With ``whole`` the document at the cut is taken as a whole
    if the cut reaches its middle; otherwise as many of its words as the budget still holds.
    """
    columns = list(dict.fromkeys([id_col, source_col, *keep]))
    held, names = aside(docs.select(*[docs[f"`{c}`"] for c in dict.fromkeys([*columns, text_col])]))
    mixed = _mix(held, [names[c] for c in columns], names[id_col], names[source_col], names[text_col], whole, seed)
    results = ["size", "source_size", "target", "taken", "copies"]
    return mixed.select(*[F.col(names[c]).alias(c) for c in columns if c not in results], *results)


def _mix(docs: DataFrame, columns: list[str], id_col: str, source_col: str, text_col: str, whole: bool, seed: str) -> DataFrame:
    sized = docs.select(*columns, word_count(docs[text_col].cast("string")).alias("size"), *_place(docs, id_col, text_col, seed), docs[source_col].cast("string").alias("_source"))
    sized = shared_table(sized, "sizes")
    sources = targets(sized.groupBy("_source").agg(F.sum("size").alias("_size"), F.count("*").alias("_rows")))
    sources = sources.withColumn("_ranges", F.ceil(F.col("_rows") / RANGE_ROWS)).withColumnRenamed("_source", "_s")
    place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = sized.join(broadcast_if_small(sources), F.col("_source").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_range", F.floor(place * F.col("_ranges") / F.lit(float(1 << 32))).cast("long"))
    sums = rows.groupBy("_s", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_s").alias("_s2"), F.col("_range").alias("_range2"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_s", "_range").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_range") == F.col("_range2")))
    rows = rows.withColumn("_start", F.col("_offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.when(F.col("_size") > 0, F.floor(F.col("_budget") / F.col("_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("_epochs", epochs).withColumn("_cut", F.col("_budget") - F.col("_epochs") * F.col("_size") - F.col("_start"))
    if whole:
        more = F.when((F.col("size") > 0) & (2 * F.col("_cut") >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    else:
        more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_cut")))
    rows = rows.withColumn("taken", (F.col("_epochs") * F.col("size") + more).cast("long"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    return rows.select(*columns, "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), "taken", copies.alias("copies"), "_key", "_tie", "_source", "_epochs")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """The documents' rows, each as often as the mix takes it, whole.

    The rows that a source takes once more are those up to its cut in key order, so each row is
    judged by itself against its source's epochs and cut; no text is shuffled.
    """
    held, names = aside(docs)
    id_col, source_col, text_col = names[id_col], names[source_col], names[text_col]
    mixed = _mix(held, [id_col], id_col, source_col, text_col, True, seed)
    more = F.when(F.col("taken") > F.col("_epochs") * F.col("size"), F.struct("_key", "_tie"))
    cuts = mixed.groupBy("_source").agg(F.max("_epochs").alias("_epochs"), F.max(more).alias("_cut")).withColumnRenamed("_source", "_s")
    cuts = broadcast_if_small(shared_table(cuts, "cuts"))
    rows = held.select("*", *_place(held, id_col, text_col, seed), F.coalesce(held[text_col].cast("string").rlike(WORD), F.lit(False)).alias("_any"), held[source_col].cast("string").alias("_source"))
    rows = rows.where("_any").join(cuts, F.col("_source").eqNullSafe(F.col("_s")))
    times = (F.col("_epochs") + F.coalesce((F.struct("_key", "_tie") <= F.col("_cut")).cast("long"), F.lit(0))).cast("int")
    return restored(rows.where(times > 0).select(*names.values(), F.explode(F.sequence(F.lit(1), times))), names)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS sz FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS wt, {MAX_EPOCHS} * sz AS cap FROM s),
r AS (SELECT *, (sum(sz) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft,
  (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY cap::DOUBLE / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS opn FROM w),
f AS (SELECT *, bool_and(wt * lft >= cap * opn) OVER (ORDER BY cap::DOUBLE / wt, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS fl FROM r),
t AS (SELECT source, sz, CASE WHEN fl THEN cap::DOUBLE ELSE (wt * (max(CASE WHEN NOT fl THEN lft END) OVER ()))::DOUBLE / (max(CASE WHEN NOT fl THEN opn END) OVER ()) END AS target FROM f),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
x AS (SELECT doc_id, size, sz, target, budget, CASE WHEN sz > 0 THEN budget // sz ELSE 0 END AS ep,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, sz AS source_size, target, (ep * size + greatest(0, least(size, budget - ep * sz - st)))::BIGINT AS taken FROM x"""

QUERIES = {"op5_mixing": op5_mixing}
ORACLE = {"op5_mixing": _ORACLE}
