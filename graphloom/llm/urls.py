"""URL filters: a list of rules, and association rules mined from labelled URLs.

The list: a rule (host, path) fits its host and all subdomains if the URL's path starts with the
rule's path; the longest fitting rule decides. URLs that no rule of the list fits are judged by
mined rules. Spark's FP-growth mines the labelled URLs' token sets; a rule is a set of tokens with
the label "block" as its consequent, kept at enough support, confidence and lift. An inverted
index, token to rules, finds the rules whose tokens a URL has; a URL is blocked if it has all the
tokens of one at least.

A URL's tokens are the labels of its host (with what stands right of them, so the place counts),
and its path segments without digits. A rule needs a share SUPPORT of all labelled URLs and LEAST
blocked ones, so no rule rests on a few URLs. Tokens of fewer blocked URLs than that can't be in a
rule and are left out of mining, which changes no rule; all others are mined, and rules of any
length count. The index holds each rule under its rarest token: only URLs with that token are
compared with the rule, so tokens that most URLs have open few lists. It is broadcast after its rows
have been counted, and joined by a shuffle if they are many.

Null and empty URLs and URLs without "://" have an empty host and path and no tokens, and are
allowed; an empty table gives an empty result, and without labels nothing is mined. Very long URLs
are judged whole. Of rules of one length that fit, the last by code point decides. Repeated rows are
judged one by one. Labels with null ids are left out; several labels of an id block if one says so.
Other columns pass through, but one named host, path, rule or verdict gives way to the result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, UPPER, aside, broadcast_if_small, read

#: The list of this query, as (verdict, rule).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
SUPPORT, CONFIDENCE, LIFT = 0.01, 0.8, 1.5
#: Blocked URLs that a rule rests on, at least.
LEAST = 10
BLOCK = "label:block"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    place = F.locate("://", url)
    return F.coalesce(F.when(place > 0, F.substring(url, place + 3, F.length(url))), F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: each suffix of the host, and each path segment without digits."""
    parts = F.split(host, r"\.")
    hosts = F.transform(parts, lambda x, i: F.concat(F.lit("host:"), F.array_join(F.slice(parts, i + 1, F.size(parts)), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "")))
    return F.array_distinct(F.concat(hosts, segments))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least: int = LEAST) -> DataFrame:
    """(tokens, confidence, token: the rarest of tokens) from rows (tokens, block boolean)."""
    spark = labelled.sparkSession
    rows = labelled.count()
    if rows < max(1, least):
        return spark.createDataFrame([], "tokens array<string>, confidence double, token string")
    share = max(support, least / rows)
    counts = labelled.select(F.explode(F.array_distinct("tokens")).alias("token"), "block").groupBy("token").agg(F.count("*").alias("n"), F.count_if("block").alias("blocked"))
    counts = counts.where(F.col("blocked") >= F.ceil(F.lit(share * rows) - 1e-9)).select("token", "n")  # 1 / share rows for each token of a URL, at most
    numbered = labelled.select(F.monotonically_increasing_id().alias("_row"), "block", F.array_distinct("tokens").alias("tokens"))  # a number for each row, before rows are taken apart
    held = numbered.select("_row", "block", F.explode_outer("tokens").alias("token")).join(broadcast_if_small(counts), "token", "left")
    items = held.groupBy("_row").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.col("token"))).alias("items"), F.first("block").alias("block"))
    baskets = items.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    rules = model.associationRules.where((F.get("consequent", F.lit(0)) == BLOCK) & (F.col("lift") >= lift)).select(F.sort_array("antecedent").alias("tokens"), "confidence")
    each = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(broadcast_if_small(counts), "token")
    return each.groupBy("tokens").agg(F.first("confidence").alias("confidence"), F.min_by("token", F.struct("n", "token")).alias("token"))


def blocked_sets(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct token sets (column tokens) that have all tokens of a rule."""
    sets = token_sets.select("tokens").distinct()
    index = broadcast_if_small(rules.select("token", F.col("tokens").alias("_all")))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    return hits.where(F.size(F.array_except("_all", "tokens")) == 0).select("tokens").distinct()


def judge(urls: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """The rows with host, path, rule, verdict; ``labelled`` has url and block."""
    held, names = aside(urls)
    url = F.col(names[url_col])
    at = held.select("*", host_of(url).alias("_host"), path_of(url).alias("_path"))
    rule, verdict = listed(F.col("_host"), F.col("_path"), rules)
    at = at.select("*", rule.alias("_rule"), verdict.alias("_listed"), tokens_of(F.col("_host"), F.col("_path")).alias("_tokens"))
    known = labelled.select(tokens_of(host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "block")
    bad = blocked_sets(at.where("_listed is null").select(F.col("_tokens").alias("tokens")), mine(known))
    key = F.xxhash64("_tokens")
    out = at.withColumn("_key", key).join(bad.select(F.col("tokens").alias("_bad"), F.xxhash64("tokens").alias("_bad_key")), (F.col("_key") == F.col("_bad_key")) & (F.col("_tokens") == F.col("_bad")), "left")
    verdict = F.coalesce("_listed", F.when(F.col("_bad").isNotNull(), "block").otherwise("allow"))
    own = [F.col(n).alias(c) for c, n in names.items() if c not in ("host", "path", "rule", "verdict")]
    return out.select(*own, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A page's label is that of the document its URL names by number: block if it is of low quality
    or toxic.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("block"))
    numbered = pages.select("url", F.expr("try_cast(regexp_extract(url, '/([0-9]+)[^/]*/?$', 1) as bigint)").alias("doc_id"))
    labelled = numbered.join(labels, "doc_id").select("url", "block")
    return judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_url_filters": op1_url_filters}
ORACLE: dict[str, str] = {}
