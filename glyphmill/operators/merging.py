"""Merging as DataFrame steps: words stay distributed, a step is one aggregation and a rewrite.

A word is a string in which SEP stands on both sides of every token, so that replacing
SEP a SEP SEP b SEP merges from left to right without overlaps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import settled
from . import counts, packs

SEP = "\x01"


def wrapped(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda s: F.concat(F.lit(SEP), s, F.lit(SEP))), "")


def unwrapped(word: Column) -> Column:
    """The tokens of a wrapped word."""
    inner = F.substring(word, F.lit(2), F.char_length(word) - 2)
    return F.when(F.char_length(word) > 2, F.split(inner, SEP + SEP)).otherwise(F.array().cast("array<string>"))


def merge(word: Column, left: str, right: str) -> Column:
    return F.replace(word, F.lit(f"{SEP}{left}{SEP}{SEP}{right}{SEP}"), F.lit(f"{SEP}{left}{right}{SEP}"))


def merge_all(word: Column, merges: Sequence[tuple[str, str]]) -> Column:
    for left, right in merges:
        word = merge(word, left, right)
    return word


def train_stepwise(words: DataFrame, steps: int, specials: Sequence[str] = (), limit: int | None = None, min_frequency: int = 0) -> tuple[list[tuple[str, str, int]], DataFrame]:
    """At most `steps` merges (left, right, count), and the wrapped words after them.

    A step brings one row to the driver. Every step reads the words as they were at the start, from
    reliable storage, and rewrites them by all merges so far, so nothing but that table is kept.
    """
    vocab = counts.vocabulary(counts.limited(counts.alphabet_counts(words), limit), specials).collect()
    ids = {r["token"]: r["id"] for r in vocab}
    spark = words.sparkSession
    base = settled(counts.symbols(words, spark.createDataFrame(vocab, "id long, token string")).select(wrapped(F.col("symbols")).alias("w"), "cnt").filter("w <> ''"))
    found: list[tuple[str, str, int]] = []
    while len(found) < steps:
        now = base.select(unwrapped(merge_all(F.col("w"), [(a, b) for a, b, _ in found])).alias("symbols"), "cnt")
        table = spark.createDataFrame([(i, t) for t, i in ids.items()], "id long, token string")
        top = counts.top_pairs(counts.pair_counts(now), F.broadcast(table), 1).collect()
        if not top or top[0]["cnt"] < max(1, min_frequency):
            break
        a, b, n = top[0]["left"], top[0]["right"], top[0]["cnt"]
        ids.setdefault(a + b, len(ids))
        found.append((a, b, n))
    return found, base.select(merge_all(F.col("w"), [(a, b) for a, b, _ in found]).alias("w"), "cnt")


def encode(words: DataFrame, merges: Sequence[tuple[str, str]], alphabet: DataFrame | None = None) -> DataFrame:
    """word, cnt, tokens (array): each distinct word cut by the merges in their order."""
    if alphabet is None:
        chars = counts.T.characters(F.col("word"))
        rows = words.select("word", "cnt", chars.alias("symbols"))
    else:
        rows = counts.symbols(words, alphabet)
    return rows.select("word", "cnt", unwrapped(merge_all(wrapped(F.col("symbols")), merges)).alias("tokens"))


def cut(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The tokens of a word by any number of merges, each applied once in its order as merge_all does."""
    now, last = list(word), -1
    while len(now) > 1:
        rank = min((r for p in zip(now, now[1:]) if (r := ranks.get(p, -1)) > last), default=None)
        if rank is None:
            break
        out, i = [], 0
        while i < len(now):
            hit = i + 1 < len(now) and ranks.get((now[i], now[i + 1])) == rank
            out.append(now[i] + now[i + 1] if hit else now[i])
            i += 1 + hit
        now, last = out, rank
    return now


def cut_all(word: Column, merges: Sequence[tuple[str, str]]) -> Column:
    """tokens (array) of each word as cut makes them, a batch of words at once; for merge lists that are too long for an expression."""
    tokens = list(dict.fromkeys(t for a, b in merges for t in (a, b, a + b)))
    ids = {t: i for i, t in enumerate(tokens)}
    todo = packs.Merges([(ids[a], ids[b], ids[a + b]) for a, b in merges])
    single = sorted((ord(t), i) for t, i in ids.items() if len(t) == 1)
    points, known = (np.array([x[k] for x in single], np.int64) for k in (0, 1))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            held = words.to_pylist()
            symbols = packs.points(held).astype(np.int64)
            # a character that no merge has is its code point beyond all tokens
            at = np.minimum(np.searchsorted(points, symbols), len(points) - 1)
            symbols = np.where(points[at] == symbols, known[at], len(tokens) + symbols) if len(points) else len(tokens) + symbols
            symbols, sizes = todo.follow(symbols, np.fromiter(map(len, held), np.int64, len(held)))
            distinct, which = np.unique(symbols, return_inverse=True)
            shown = pa.array([tokens[i] if i < len(tokens) else chr(i - len(tokens)) for i in distinct.tolist()], pa.string())
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), shown.take(pa.array(which)))

    return F.arrow_udf(run, "array<string>")(word)
