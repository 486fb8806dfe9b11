"""Word counts and what is derived from them: alphabets, symbols, pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

MODES = ("whitespace", "bytelevel")


def pretokens(docs: DataFrame, mode: str = "whitespace", text: str = "text") -> DataFrame:
    """word: an occurrence a row; byte-level pieces are still raw."""
    if mode not in MODES:
        raise ValueError(f"unknown pretokenizer {mode!r}: expected one of {', '.join(MODES)}")
    if mode == "whitespace":
        return docs.select(F.explode(T.words(F.col(text))).alias("word"))
    return docs.select(F.explode(T.lines(F.col(text))).alias("line")).select(F.explode(T.pieces(F.col("line"))).alias("word"))


def word_counts(docs: DataFrame, mode: str = "whitespace", text: str = "text") -> DataFrame:
    """word, cnt. The byte map is one to one, so it is applied to distinct pieces only."""
    n = pretokens(docs, mode, text).groupBy("word").agg(F.count("*").alias("cnt"))
    return n if mode == "whitespace" else n.withColumn("word", T.show_bytes(F.col("word")))


def line_counts(lines: DataFrame, mode: str = "whitespace") -> DataFrame:
    """word, cnt of lines (line with its terminator, weight)."""
    if mode not in MODES:
        raise ValueError(f"unknown pretokenizer {mode!r}: expected one of {', '.join(MODES)}")
    cut = T.words(F.col("line")) if mode == "whitespace" else T.pieces(F.col("line"))
    n = lines.select(F.explode(cut).alias("word"), "weight").groupBy("word").agg(F.sum("weight").alias("cnt")).filter("cnt <> 0")
    return n if mode == "whitespace" else n.withColumn("word", T.show_bytes(F.col("word")))


def alphabet_counts(words: DataFrame) -> DataFrame:
    """ch, cnt: occurrences of every character, weighted by the words' counts."""
    return words.select(F.explode(T.characters(F.col("word"))).alias("ch"), "cnt").groupBy("ch").agg(F.sum("cnt").alias("cnt"))


def limited(alphabet: DataFrame, limit: int | None, initial: Sequence[str] = ()) -> DataFrame:
    """The `limit` most frequent characters (of equals the greater code point stays); initial ones count as most frequent."""
    if initial:
        forced = alphabet.sparkSession.createDataFrame([(c, (1 << 63) - 1) for c in dict.fromkeys(initial)], "ch string, cnt long")
        alphabet = alphabet.unionByName(forced).groupBy("ch").agg(F.max("cnt").alias("cnt"))
    return alphabet if limit is None else alphabet.orderBy(F.desc("cnt"), F.desc("ch")).limit(limit)


def vocabulary(alphabet: DataFrame, specials: Sequence[str] = ()) -> DataFrame:
    """id (from 0), token: distinct specials in their order, then the other characters by code point."""
    first = list(dict.fromkeys(specials))
    listed = alphabet.sparkSession.createDataFrame(list(enumerate(first)), "id long, token string")
    rest = alphabet.filter(~F.col("ch").isin(first)) if first else alphabet
    order = (F.row_number().over(W.orderBy("ch")) + F.lit(len(first) - 1)).cast("bigint")
    return listed.unionByName(rest.select(order.alias("id"), F.col("ch").alias("token")))


def decorated(chars: Column, prefix: str | None, suffix: str | None) -> Column:
    """Characters with the prefix on all but the first and the suffix on the last."""
    return F.transform(chars, lambda c, i: F.concat(F.when(i > 0, F.lit(prefix or "")).otherwise(""), c, F.when(i == F.size(chars) - 1, F.lit(suffix or "")).otherwise("")))


def symbols(words: DataFrame, vocab: DataFrame, prefix: str | None = None, suffix: str | None = None) -> DataFrame:
    """word, cnt, symbols: the decorated characters in vocab's tokens; others are dropped, but count for the places of decoration."""
    known = vocab.agg(F.collect_set("token").alias("known"))  # one row, of the alphabet's size
    chars = T.characters(F.col("word"))
    pairs = F.arrays_zip(chars.alias("plain"), decorated(chars, prefix, suffix).alias("shown"))
    kept = F.transform(F.filter(pairs, lambda p: F.array_contains(F.col("known"), p["plain"])), lambda p: p["shown"])
    return words.crossJoin(F.broadcast(known)).select("word", "cnt", kept.alias("symbols"))


def adjacent(rows: DataFrame) -> DataFrame:
    """left, right and all other columns, a row for each two neighbours in symbols; overlaps count."""
    at = F.explode(F.sequence(F.lit(1), F.size("symbols") - 1))
    each = rows.filter(F.size("symbols") > 1).withColumn("_i", at)
    return each.select("*", F.element_at("symbols", F.col("_i")).alias("left"), F.element_at("symbols", F.col("_i") + 1).alias("right")).drop("_i", "symbols")


def pair_counts(rows: DataFrame) -> DataFrame:
    return adjacent(rows).groupBy("left", "right").agg(F.sum("cnt").alias("cnt"))


def pair_postings(rows: DataFrame) -> DataFrame:
    """left, right, n_words: in how many distinct words two symbols are neighbours."""
    return adjacent(rows).select("left", "right", "word").distinct().groupBy("left", "right").agg(F.count("*").alias("n_words"))


def ranked_pairs(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """left, right, cnt, left_id, right_id of pairs of vocab's tokens."""
    a, b = vocab.select(F.col("token").alias("left"), F.col("id").alias("left_id")), vocab.select(F.col("token").alias("right"), F.col("id").alias("right_id"))
    return pairs.join(a, "left").join(b, "right").select("left", "right", "cnt", "left_id", "right_id")


def top_pairs(pairs: DataFrame, vocab: DataFrame, k: int = 1) -> DataFrame:
    """The k most frequent pairs; equals by the left id, then by the right one."""
    return ranked_pairs(pairs, vocab).orderBy(F.desc("cnt"), "left_id", "right_id").limit(k)
