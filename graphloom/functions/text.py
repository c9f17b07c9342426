"""Scalar expressions on strings and vectors; all of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of errors that are worth another try.
RETRYABLE = (
    "serviceunavailableerror",
    "rate limit",
    "ratelimiterror",
    "apitimeouterror",
    "timeout",
    "apiconnectionerror",
    "connection error",
    "openai_error",
    "503",
    "502",
    "504",
)
#: The markers as a pattern, for names and messages of errors in any case.
RETRYABLE_PATTERN = "(?i)" + "|".join(map(re.escape, RETRYABLE))
SENTENCE = r"[^.!?\n]+[.!?]*"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip_dashes(x: Column) -> Column:
    return strip(F.regexp_replace(strip(x), r"^-+|-+$", ""))


def words(x: Column) -> Column:
    """Tokens between white space; none of a blank text."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def sentence(s: Column, p: Column, o: Column) -> Column:
    return F.concat(s, F.lit(" "), p, F.lit(" "), o, F.lit("."))


def relationship_type(p: Column) -> Column:
    return F.upper(F.translate(p, " -", "__"))


def answer_text(response: Column) -> Column:
    """What stands in the first answer tags, or all, without code fences."""
    inner = F.when(response.rlike(r"(?s)<answer>.*?</answer>"), F.regexp_extract(response, r"(?s)<answer>(.*?)</answer>", 1)).otherwise(response)
    return strip(F.regexp_replace(inner, "```json|```", ""))


def retryable(kind: Column, message: Column) -> Column:
    return F.concat(kind, F.lit(": "), message).rlike(RETRYABLE_PATTERN)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def with_color(rows: DataFrame, key: Column, name: str = "color") -> DataFrame:
    """The rows with a colour, #rrggbb, from the first three bytes of the key's SHA-1: hue, saturation
    0.55 to 0.85, lightness 0.45 to 0.70. Channels are cut off to whole numbers.

    Each step is a projection of its own, so what several use is worked out once and the code stays small.
    """
    own = rows.columns
    digest = rows.select("*", F.sha1(key.cast("binary")).alias("_d"))
    share = lambda at: F.conv(F.substring("_d", at, 2), 16, 10).cast("double") / 255.0
    parts = digest.select(*own, share(1).alias("_hue"), (F.lit(0.55) + share(3) * 0.3).alias("_full"), (F.lit(0.45) + share(5) * 0.25).alias("_light"))
    light, full = F.col("_light"), F.col("_full")
    ends = parts.select(*own, "_hue", "_light", F.when(light <= 0.5, light * (full + 1.0)).otherwise(light + full - light * full).alias("_high"))
    ends = ends.select(*own, "_hue", "_high", (F.col("_light") * 2.0 - F.col("_high")).alias("_low"))
    shifts = (1 / 3, 0.0, -1 / 3)
    turned = ends.select(*own, "_high", "_low", *[(F.col("_hue") + t).alias(f"_t{i}") for i, t in enumerate(shifts)])
    turned = turned.select(*own, "_high", "_low", *[(F.col(f"_t{i}") - F.floor(f"_t{i}").cast("double")).alias(f"_h{i}") for i in range(3)])

    def channel(i: int) -> Column:
        h, low, high = F.col(f"_h{i}"), F.col("_low"), F.col("_high")
        value = F.when(h < 1 / 6, low + (high - low) * h * 6.0).when(h < 0.5, high).when(h < 2 / 3, low + (high - low) * (F.lit(2 / 3) - h) * 6.0).otherwise(low)
        return F.lpad(F.lower(F.hex(F.floor(value * 255.0).cast("long"))), 2, "0")

    return turned.select(*own, F.concat(F.lit("#"), *map(channel, range(3))).alias(name))
