"""Comparing vocabularies and merge lists, and measuring how well a text is compressed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocab_overlap(trained: DataFrame, reference: DataFrame) -> DataFrame:
    """shared, total, overlap: distinct tokens of reference, and how many of them trained has."""
    ref = reference.select("token").distinct().join(trained.select("token").distinct().withColumn("hit", F.lit(1)), "token", "left")
    return ref.agg(F.count("hit").alias("shared"), F.count("*").alias("total")).withColumn("overlap", F.round(F.col("shared") / F.nullif("total", F.lit(0)), 6))


def rank_overlap(trained: DataFrame, reference: DataFrame, first: int) -> DataFrame:
    """The same for the tokens with the `first` lowest ids of each."""
    return vocab_overlap(trained.filter(F.col("id") < first), reference.filter(F.col("id") < first))


def merge_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """rank, left_a, right_a, left_b, right_b: ranks at which two merge lists differ, or only one goes on."""
    x = a.select("rank", F.col("left").alias("left_a"), F.col("right").alias("right_a"))
    y = b.select("rank", F.col("left").alias("left_b"), F.col("right").alias("right_b"))
    same = F.equal_null("left_a", "left_b") & F.equal_null("right_a", "right_b")
    return x.join(y, "rank", "full_outer").filter(~same)


def merge_prefix(a: DataFrame, b: DataFrame) -> DataFrame:
    """prefix, fraction: equal merges at the beginning, and their share of the longer list."""
    first = merge_diff(a, b).agg(F.min("rank").alias("at"))
    longest = a.select("rank").unionByName(b.select("rank")).agg((F.coalesce(F.max("rank"), F.lit(-1)) + 1).alias("n"))
    prefix = F.coalesce("at", "n").cast("bigint")
    return first.crossJoin(longest).select(prefix.alias("prefix"), F.round(prefix / F.nullif(F.col("n"), F.lit(0)), 6).alias("fraction"))


def vocab_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, token_a, token_b where two vocabularies differ."""
    x, y = a.select("id", F.col("token").alias("token_a")), b.select("id", F.col("token").alias("token_b"))
    return x.join(y, "id", "full_outer").filter(~F.equal_null("token_a", "token_b"))


def fertility(encoded: DataFrame) -> DataFrame:
    """tokens, words, fertility of word, cnt, tokens rows."""
    return encoded.agg(F.sum(F.size("tokens") * F.col("cnt")).alias("n_tokens"), F.sum("cnt").alias("n_words")).withColumn("fertility", F.round(F.col("n_tokens") / F.nullif("n_words", F.lit(0)), 6))


def compression(encoded: DataFrame, *by: str) -> DataFrame:
    """by, n_chars, n_bytes, n_tokens, chars_per_token, bytes_per_token."""
    sums = encoded.groupBy(*by).agg(F.sum(F.char_length("word") * F.col("cnt")).alias("n_chars"), F.sum(F.octet_length("word") * F.col("cnt")).alias("n_bytes"), F.sum(F.size("tokens") * F.col("cnt")).alias("n_tokens"))
    per = lambda c: F.round(F.col(c) / F.nullif("n_tokens", F.lit(0)), 6)
    return sums.withColumns({"chars_per_token": per("n_chars"), "bytes_per_token": per("n_bytes")})


def equity(by_group: DataFrame, group: str = "lang") -> DataFrame:
    """best, worst (groups by characters a token, equals by name), spread (population deviation of it)."""
    v = "chars_per_token"
    return by_group.agg(F.max(F.struct(F.col(v), F.col(group)))[group].alias("best"), F.min(F.struct(F.col(v), F.col(group)))[group].alias("worst"), F.round(F.stddev_pop(v), 6).alias("spread"))


def run_statistics(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """by, n, median, spread (largest less smallest), mean, half_range of repeated measurements."""
    v = F.col(value)
    n = lambda c, name: F.round(c, 6).alias(name)
    wide = F.max(v) - F.min(v)
    return runs.groupBy(*by).agg(F.count(v).alias("n"), n(F.median(v), "median"), n(wide, "spread"), n(F.avg(v), "mean"), n(wide / 2, "half_range"))
