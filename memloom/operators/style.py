"""Writing style by author, as aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
EMOJI = "[\\x{1f1e6}-\\x{1f1ff}\\x{1f300}-\\x{1faff}\\x{2600}-\\x{27bf}]"
TERMINAL = "[。！？!?…~～]$"
RATIOS = ("short_ratio", "question_ratio", "exclamation_ratio", "emoji_ratio", "multiline_ratio", "terminal_ratio")


def profile(messages: DataFrame, keys: list[str], text: Column, least: int = 20, short: int = 12) -> DataFrame:
    """Style of each author with at least ``least`` messages: counts, mean and exact median length, six ratios."""
    said = messages.select(*keys, text.alias("t")).where("t is not null and t != ''").withColumn("len", F.length(F.regexp_replace("t", r"(?U)\s+", "")))
    ratio = lambda c, name: F.round(F.avg(c.cast("double")), 4).alias(name)
    return (
        said.groupBy(*keys)
        .agg(
            F.count("*").alias("messages"),
            F.sum("len").alias("characters"),
            F.round(F.avg("len"), 3).alias("mean_length"),
            F.median("len").alias("median_length"),
            ratio(F.col("len") <= short, "short_ratio"),
            ratio(F.col("t").rlike("[?？]"), "question_ratio"),
            ratio(F.col("t").rlike("[!！]"), "exclamation_ratio"),
            ratio(F.col("t").rlike(EMOJI), "emoji_ratio"),
            ratio(F.contains("t", F.lit("\n")), "multiline_ratio"),
            ratio(F.col("t").rlike(TERMINAL), "terminal_ratio"),
        )
        .where(F.col("messages") >= least)
    )


def similarity(a: str, b: str) -> Column:
    """Weighted likeness of two profiles with columns prefixed ``a`` and ``b``."""
    length = lambda c: 1 - F.least(F.lit(1.0), F.abs(F.col(b + c) - F.col(a + c)) / F.greatest(F.lit(8.0), F.col(a + c)))
    weights = {"short_ratio": 0.15, "question_ratio": 0.10, "exclamation_ratio": 0.10, "emoji_ratio": 0.10, "multiline_ratio": 0.10, "terminal_ratio": 0.15}
    total = 0.15 * F.round(length("mean_length"), 4) + 0.15 * F.round(length("median_length"), 4)
    for c, w in weights.items():
        total = total + w * F.round(1 - F.abs(F.col(b + c) - F.col(a + c)), 4)
    return F.round(total, 6)


def phrase_counts(messages: DataFrame, keys: list[str], text: Column, low: int = 2, high: int = 4) -> DataFrame:
    """In how many messages of each author every letter n-gram occurs."""
    segments = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    chars = lambda s: F.regexp_extract_all(s, F.lit("."), F.lit(0))

    def grams(s: Column) -> Column:
        one = chars(s)

        def of(n: int) -> Column:
            starts = F.slice(one, 1, F.greatest(F.size(one) - (n - 1), F.lit(0)))
            return F.transform(starts, lambda _, i: F.array_join(F.slice(one, i + 1, n), ""))

        return F.concat(*[of(n) for n in range(low, high + 1)])

    found = messages.select(*keys, F.array_distinct(F.flatten(F.transform(segments, grams))).alias("g"))
    return found.select(*keys, F.explode("g").alias("phrase")).groupBy(*keys, "phrase").agg(F.count("*").alias("df"))


def common_phrases(counts: DataFrame, sizes: DataFrame, keys: list[str], most: int = 8, least: int = 3, share: float = 0.1) -> DataFrame:
    """Up to ``most`` frequent phrases of each author, none within another one; greedy over those above the threshold.

    A phrase needs ``share`` of the author's messages, so an author has few of them.
    """
    frequent = counts.join(sizes.select(*keys, "messages"), keys).where(F.col("df") >= F.greatest(F.lit(least), F.ceil(F.col("messages") * share)))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        chosen: list[str] = []
        for p in sorted(zip(-group["df"], -group["phrase"].str.len(), group["phrase"])):
            if len(chosen) == most:
                break
            if not any(p[2] in c or c in p[2] for c in chosen):
                chosen.append(p[2])
        return pd.DataFrame({**{k: [group[k].iloc[0]] * len(chosen) for k in keys}, "position": range(1, len(chosen) + 1), "phrase": chosen})

    kinds = dict(frequent.dtypes)
    return frequent.groupBy(*keys).applyInPandas(pick, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", position int, phrase string")


def confidence(messages: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.sqrt(messages / 100)), 4)




def directives(profiles: DataFrame, keys: list[str], levels: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Guidance by feature: ``keys``, feature, priority, directive, confidence.

    ``levels``: of each ratio, up to where it is rare, from where it is frequent, and its priority. Lengths are a range around the median.
    """
    low = F.greatest(F.lit(1.0), F.round(F.col("median_length") * 0.6))
    high = F.greatest(low, F.least(F.lit(200.0), F.round(F.greatest("mean_length", "median_length") * 1.4)))
    length = F.concat(low.cast("long").cast("string"), F.lit("-"), high.cast("long").cast("string"))
    each = [F.struct(F.lit("message_length").alias("feature"), F.lit(100).cast("long").alias("priority"), length.alias("directive"))]
    for c, (rare, often, priority) in levels.items():
        word = F.when(F.col(c) >= often, "often").when(F.col(c) <= rare, "rarely").otherwise("naturally")
        each.append(F.struct(F.lit(c).alias("feature"), F.lit(priority).cast("long").alias("priority"), word.alias("directive")))
    return profiles.select(*keys, F.explode(F.array(*each)).alias("x"), confidence(F.col("messages")).alias("confidence")).select(*keys, "x.*", "confidence")
