"""Mixing sources to target weights: temperature, and budgeted block permutations.

A source with the share p of all tokens gets the weight p^a / sum p^a. The exponent a in [0, 1] is
bisected until the weights reach a target entropy, or until no source repeats more often than a
limit allows. A source's weight is a budget of tokens. It is met by whole passes over the source
and one part of a pass. A source's documents are dealt by hash to blocks of about ``block_tokens``,
LEAST_BLOCKS of them at least. Every pass reads the blocks in the order of a permutation of its
own and the documents of a block in the order of a hash; the part of a pass ends inside one
block, at the last document in that order that fits. Only that one block of a source is ever sorted.

The permutation sends block b to (a b + c) mod n, with c and the prime a > n drawn by source and
pass; so a block's place is an expression and no table of blocks is joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, positional, unit_hash

NONE = "\x00none"
STEPS, BROADCAST_SOURCES, LEAST_BLOCKS = 60, 100_000, 16
#: Above 2^31, so that none divides a number of blocks.
PRIMES = (2147483659, 2147483693, 2147483713, 2147483743, 2147483777, 2147483783, 2147483813, 2147483857)


def tempered(shares: list[float], exponent: float) -> list[float]:
    raised = [p**exponent if p > 0 else 0.0 for p in shares]
    total = math.fsum(raised)
    return [x / total for x in raised] if total else raised


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def repeats(shares: list[float], weights: list[float], keep_all: bool) -> list[float]:
    """Passes over each source. With keep_all the budget is such that every source is passed once at least, else it equals the corpus."""
    rates = [w / p if p > 0 else 0.0 for p, w in zip(shares, weights)]
    low = min((r for r in rates if r > 0), default=1.0)
    return [r / low for r in rates] if keep_all else rates


def exponent_for(shares: list[float], target_entropy: float | None = None, max_repeats: float | None = None, keep_all: bool = True) -> float:
    """The largest exponent in [0, 1] whose entropy reaches the target, or the smallest with no source repeated above the limit; a limit that nothing meets gives 1, a target beyond reach 0."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")

    def flat_enough(a: float) -> bool:
        w = tempered(shares, a)
        if target_entropy is not None:
            return entropy(w) >= target_entropy
        return max(repeats(shares, w, keep_all), default=0.0) > max_repeats

    # both conditions hold for small exponents and stop holding once
    if flat_enough(1.0) or not flat_enough(0.0):
        return 1.0 if flat_enough(1.0) else 0.0
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if flat_enough(mid) else (lo, mid)
    return lo if target_entropy is not None else hi


@dataclass(frozen=True)
class Plan:
    source: str
    passes: int
    rest: int
    blocks: int
    rate: float


def plan(totals: dict[str, int], target_entropy: float | None, max_repeats: float | None, keep_all: bool, block_tokens: int) -> list[Plan]:
    """Whole passes and the tokens of the part of a pass, by source. Sources without tokens are passed once."""
    names = sorted(totals)
    total = sum(totals.values())
    shares = [totals[n] / total if total else 0.0 for n in names]
    a = exponent_for(shares, target_entropy, max_repeats, keep_all) if total else 1.0
    out = []
    for name, rate in zip(names, repeats(shares, tempered(shares, a), keep_all)):
        n = totals[name]
        rate = rate if n else 1.0
        passes = math.floor(rate + 1e-9)
        rest = max(0, math.floor((rate - passes) * n + 1e-6)) if n else 0
        size = max(1, min(block_tokens, -(-n // LEAST_BLOCKS)))
        out.append(Plan(name, passes, rest, max(1, -(-n // size)), rate))
    return out


def tokens_of(text: Column) -> Column:
    """Tokens of a text: its UTF-8 bytes. A null text has none."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long")


def place_of(block: Column, blocks: Column, source: Column, turn: Column, seed: int) -> Column:
    """The place of a block in the permutation of a pass over its source."""
    drawn = F.xxhash64(F.lit(seed), source, turn)
    a = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(drawn, F.lit(len(PRIMES))) + 1).cast("int"))
    return F.pmod(block * F.pmod(a, blocks) + F.pmod(F.shiftright(drawn, 8), blocks), blocks)


def _keyed(docs: DataFrame, seed: int) -> tuple[DataFrame, list[str]]:
    flat, where = positional(docs)
    key = F.xxhash64(F.lit(seed), F.col(where["doc_id"]), F.col(where["text"]))
    return flat.withColumns({"_source": F.coalesce(F.col(where["source"]).cast("string"), F.lit(NONE)), "_tokens": tokens_of(F.col(where["text"])), "_key": key}), flat.columns


def mixed(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, keep_all: bool = True, block_tokens: int = 1 << 25, seed: int = 17) -> DataFrame:
    """Columns c0..cn of docs in their order and _source, _tokens, pass, position: a row for each time a document is read."""
    spark = docs.sparkSession
    keyed, columns = _keyed(docs, seed)
    sizes = checkpoint(keyed.select("_source", "_tokens", "_key"))
    totals = {r["_source"]: r["n"] for r in sizes.groupBy("_source").agg(F.sum("_tokens").alias("n")).collect()}
    plans = plan(totals, target_entropy, max_repeats, keep_all, block_tokens)
    if not plans:
        return keyed.withColumns({"pass": F.lit(0), "position": F.lit(0.0)}).drop("_key")
    per_source = spark.createDataFrame([(p.source, p.passes, p.rest, p.blocks, p.rate) for p in plans], "_source string, _passes int, _rest long, _blocks long, _rate double")
    block = F.pmod(F.col("_key"), F.col("_blocks"))
    block_rank = place_of(F.col("_block"), F.col("_blocks"), F.col("_source"), F.col("_passes"), seed)
    in_block = unit_hash(F.col("_key"), F.col("_passes"), seed=seed + 1)
    # the block of each source in which its budget ends, and what is left for it
    blocks = sizes.join(per_source.filter("_rest > 0"), "_source").withColumn("_block", block).groupBy("_source", "_block", "_blocks", "_passes", "_rest").agg(F.sum("_tokens").alias("n")).withColumn("_u", block_rank)
    run = W.partitionBy("_source").orderBy("_u", "_block").rowsBetween(W.unboundedPreceding, 0)
    ends = blocks.withColumn("end", F.sum("n").over(run)).filter("end > _rest").groupBy("_source").agg(F.min(F.struct("_u", "_block", F.col("end").alias("end"), "n")).alias("b"))
    last = [(r["_source"], r["b"]["_u"], r["b"]["_block"], r["b"]["end"] - r["b"]["n"]) for r in ends.collect()]
    rest = {p.source: p.rest for p in plans}
    last = [(s, u, b, rest[s] - before) for s, u, b, before in last]
    ended = spark.createDataFrame(last, "_source string, _end_u long, _end_block long, _left long")
    params = per_source.join(ended, "_source", "left")
    if len(plans) <= BROADCAST_SOURCES:  # a row a source; a shuffle on the source would put a hot one into one task
        params = F.broadcast(params)
    # documents of a final block: first ones in the order of its permutation that fit what is left
    placed = keyed.join(params, "_source").withColumn("_block", block).withColumn("_u", block_rank)
    whole = (F.col("_rest") > 0) & (F.col("_u") < F.col("_end_u"))
    passes = F.sequence(F.lit(0), F.col("_passes") - 1 + whole.cast("int"))
    full = placed.filter((F.col("_passes") > 0) | whole).withColumn("pass", F.explode(passes))
    order = W.partitionBy("_source").orderBy(F.col("_order"), F.col("_key")).rowsBetween(W.unboundedPreceding, 0)
    final = placed.filter((F.col("_rest") > 0) & (F.col("_block") == F.col("_end_block")) & (F.col("_left") > 0))
    final = final.withColumn("_order", in_block).withColumn("_sum", F.sum("_tokens").over(order)).filter("_sum <= _left").drop("_order", "_sum").withColumn("pass", F.col("_passes"))
    at = place_of(F.col("_block"), F.col("_blocks"), F.col("_source"), F.col("pass"), seed) + unit_hash(F.col("_key"), F.col("pass"), seed=seed + 1)
    spread = (F.col("pass") + at / F.col("_blocks")) / F.col("_rate")
    return full.select(*final.columns).unionByName(final).withColumn("position", spread).select(*columns, "_source", "_tokens", "pass", "position")


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, keep_all: bool = True, block_tokens: int = 1 << 25, seed: int = 17) -> DataFrame:
    """doc_id, source, tokens, pass (from 0) and position: the schedule, a row for each reading.

    Within a source position follows the pass, the block's place in that pass's permutation and the
    document's place in the block; sorting by it interleaves the sources evenly.

    keep_all=True: every document is read once at least and small sources repeat; otherwise the
    budget is the corpus's size and large sources lose documents. A null source is one of its own.
    Null and empty texts have no tokens and cost nothing. Repeated rows are scheduled alike. Ties of
    the permutations go by hash of doc_id and text. An empty table gives an empty schedule.
    """
    rows = mixed(docs, target_entropy, max_repeats, keep_all, block_tokens, seed)
    _, where = positional(docs)
    return rows.select(F.col(where["doc_id"]).alias("doc_id"), F.col(where["source"]).alias("source"), F.col("_tokens").alias("tokens"), "pass", F.round("position", 9).alias("position"))


def remix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns as they were, as often as the schedule reads them."""
    rows = mixed(docs, **how)
    return rows.select(*rows.columns[: len(docs.columns)]).toDF(*docs.columns)
