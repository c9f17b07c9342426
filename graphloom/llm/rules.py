"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each document gets five measures of its text. A measure rejects what lies above its cutoff. The
cutoff of a stratum (a language) is the strictest of a fixed grid for which labelled good
documents prove that at most ``alpha`` of the good ones are rejected: the exact binomial tail
P(Bin(n, alpha) <= rejected) must not exceed ``delta`` over the number of (stratum, measure)
tests, and all milder cutoffs of the grid must have passed before (fixed-sequence testing). So
with probability 1 - delta each measure rejects at most ``alpha`` of the good documents of every
stratum, and all of them together at most JOINT_ALPHA (the sum of their shares). Strata with too few labels to prove anything get no cutoff.

Null texts count as empty ones: no words, base_failed. A null language is a stratum of its own.
Repeated rows are judged one by one. A document with several label rows is good if all say so.
Labels with null ids or values take no part. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import GAP, SPACES, UPPER, aside, broadcast_if_small, read, restored, shared_table

SYMBOLS = "#*$%&|<>"
#: Grids of cutoffs, mild to strict, for each measure.
GRIDS: dict[str, list[float]] = {
    "symbols_per_word": [4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "repeat_share": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25],
    "chars_per_word": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0],
    "capital_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25],
}
#: The share of good documents that all measures together may reject, that of each, and the chance that this fails.
JOINT_ALPHA, DELTA = 0.05, 0.05
ALPHA = JOINT_ALPHA / len(GRIDS)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def measure(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The kept columns with each text's counts and measures.

    A window of three words repeats if it stands at two places at least. Windows are compared by
    64-bit hash. Sorting (hash, place) brings equal windows together, in one row's own array.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(*[docs[c] for c in keep], text.alias("_t"))
    base = base.select(*keep, "_t", F.split(F.btrim("_t", F.lit(SPACES)), GAP).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"))
    base = base.select(
        *keep,
        "_w",
        F.when(F.get("_w", F.lit(0)) == "", 0).otherwise(F.size("_w")).alias("_n"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", UPPER, ""))).cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_lines")).cast("long").alias("_distinct_lines"),
    )
    plain = [*keep, "_n", "word_chars", "n_symbols", "n_capitals", "n_lines", (F.col("n_lines") - F.col("_distinct_lines")).alias("n_dup_lines")]
    windows = F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    base = base.select(*plain, windows.alias("_h"))
    plain = [*keep, "_n", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines"]
    pairs = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.select(*plain, pairs.alias("_p"))
    same = lambda p, k: F.get("_p", k)["h"] == p["h"]
    places = F.sort_array(F.filter(F.transform("_p", lambda p, k: F.when(F.coalesce(F.when(k > 0, same(p, k - 1)), F.lit(False)) | F.coalesce(same(p, k + 1), F.lit(False)), p["i"])), lambda i: i.isNotNull()))
    base = base.select(*plain, places.alias("_s"))
    covered = F.aggregate(F.transform("_s", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_s", k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    base = base.select(*plain, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).withColumn("n_words", F.col("_n").cast("long")).drop("_n")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words, chars = F.col("n_words"), F.col("word_chars")
    return base.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        _ratio(F.col("n_symbols"), words).alias("symbols_per_word"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _ratio(F.col("n_repeat_words"), words).alias("repeat_share"),
        _ratio(chars, words).alias("chars_per_word"),
        _ratio(F.col("n_capitals"), chars).alias("capital_share"),
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms; 1 where k reaches the mean."""
    from math import log, log1p

    step = log(p) - log1p(-p)

    def add(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1).cast("double") / i) + step
        top = F.greatest(acc["s"], term)
        return F.struct(term.alias("t"), (top + F.log(F.exp(acc["s"] - top) + F.exp(term - top))).alias("s"))

    first = n * log1p(-p)
    summed = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), F.struct(first.alias("t"), first.alias("s")), add, lambda a: F.exp(a["s"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(summed)


def certify(measured: DataFrame, labels: DataFrame, id_col: str, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum that has cutoffs: the stratum and a cutoff (or null) for each measure."""
    good = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isNotNull()).groupBy(labels["doc_id"].alias("_id")).agg(F.min("quality").alias("_q"))
    held = measured.where(~F.col("base_failed")).join(good.where("_q = 1"), F.col(id_col) == F.col("_id"), "left_semi")
    counts = held.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_n"), *[F.count_if(F.col(m) > c).alias(f"_{m}_{i}") for m, grid in GRIDS.items() for i, c in enumerate(grid)])
    tests = F.lit(len(GRIDS)) * F.count("*").over(_everything())
    counts = counts.withColumn("_level", F.lit(delta) / tests)

    # the tests as an array of the grid's passes keeps each tail from being worked out again
    passes = counts.select("_stratum", *[F.array(*[binomial_tail(F.col("_n"), F.col(f"_{m}_{i}"), alpha) <= F.col("_level") for i in range(len(grid))]).alias(f"_ok_{m}") for m, grid in GRIDS.items()])
    cuts = [_strictest(f"_ok_{m}", grid).alias(f"_cut_{m}") for m, grid in GRIDS.items()]
    return passes.select("_stratum", *cuts)


def _strictest(passed: str, grid: list[float]) -> Column:
    """The cutoff before the first that fails."""
    failing = F.array_position(passed, F.lit(False)).cast("int")
    upto = F.when(failing == 0, F.lit(len(grid))).otherwise(failing - 1)
    return F.when(upto > 0, F.get(F.array(*map(F.lit, grid)), upto - 1))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # a row for each stratum


def _with_kept(measured: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    joined = measured.join(broadcast_if_small(cuts), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    above = F.lit(False)
    for m in GRIDS:
        above = above | F.coalesce(F.col(m) > F.col(f"_cut_{m}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~above)


def judge(docs: DataFrame, labels: DataFrame, *keep: str, id_col: str = "doc_id", stratum: str = "lang", text_col: str = "text") -> DataFrame:
    """The kept columns, the counts, base_failed and kept, for each document.

    The measures are written once; the cutoffs come from the labelled rows among them.
    """
    columns = list(dict.fromkeys([id_col, stratum, *keep]))
    measured = shared_table(measure(docs, *columns, text_col=text_col), "measures")
    judged = _with_kept(measured, certify(measured, labels, id_col, stratum), stratum)
    return judged.select(*columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of the documents that are kept, with their own columns.

    Rows are written with their measures, so that texts needn't be shuffled to their verdicts, and
    the filter doesn't work the measures out again.
    """
    held, names = aside(docs)
    measured = shared_table(measure(held, *names.values(), text_col=names[text_col]), "measured")
    judged = _with_kept(measured, certify(measured, labels, names[id_col], names[stratum]), names[stratum])
    return restored(judged.where("kept"), names)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document."""
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("lang")


def _oracle() -> str:
    w = "[^\\x20\\x09-\\x0D]+"
    tail = lambda k: f"CASE WHEN {k} >= n * {ALPHA} THEN 1.0 ELSE list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) END"
    counts = ", ".join(f"count(*) FILTER (WHERE {m} > {c}) AS {m}_{i}" for m, g in GRIDS.items() for i, c in enumerate(g))
    passes = ", ".join(f"[{', '.join(f'({tail(f"{m}_{i}")}) <= level' for i in range(len(g)))}] AS ok_{m}" for m, g in GRIDS.items())
    cuts = ", ".join(f"[{', '.join(map(str, g))}][coalesce(nullif(list_position(ok_{m}, false), 0), {len(g) + 1}) - 1] AS cut_{m}" for m, g in GRIDS.items())
    above = " OR ".join(f"coalesce({m} > cut_{m}, false)" for m in GRIDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, regexp_extract_all(t, '{w}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{w}')) AS lines FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n_rep FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
c AS (SELECT p.rid, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (length(t) - length(translate(t, '{UPPER}', '')))::BIGINT AS n_capitals,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words FROM p LEFT JOIN cov USING (rid)),
m AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbols_per_word, CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share,
  CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS chars_per_word,
  CASE WHEN word_chars > 0 THEN n_capitals::DOUBLE / word_chars ELSE 0 END AS capital_share FROM c),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
n AS (SELECT lang, count(*) AS n, {counts} FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY lang),
l AS (SELECT *, {DELTA} / ({len(GRIDS)} * count(*) OVER ()) AS level FROM n),
ok AS (SELECT lang, {passes} FROM l),
cut AS (SELECT lang, {cuts} FROM ok)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT ({above})) AS kept
FROM m LEFT JOIN cut ON m.lang IS NOT DISTINCT FROM cut.lang"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE = {"op10_quality_rules": _oracle()}
