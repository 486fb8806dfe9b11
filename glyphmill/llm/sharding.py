"""Sharding by sampled splitters.

Keys are drawn with probability in proportion to a record's size; equal quantiles of the drawn
keys are the splitters, and a record belongs to the range between two of them. At most about SAMPLE
keys are drawn, so with many shards a range is made for several of them. The ranges are then
measured exactly, and one that is overfull (for several shards, for a hot key, or by bad luck) is
subdivided: into ceil(size / target) parts by hash of doc_id and text, which also divides the rows
of a single key.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, positional, unit_hash
from .mixing import tokens_of

NONE = ""
#: Drawn keys, shards at least, and tasks that write shards at most.
SAMPLE, LEAST_SHARDS, MOST_TASKS = 1 << 18, 16, 100_000


def splitters(drawn: list[str], shards: int) -> list[str]:
    """Keys at equal quantiles, without repeats; a range holds the keys above its lower and up to its upper splitter."""
    drawn = sorted(drawn)
    if not drawn:
        return []
    at = [drawn[min(len(drawn) - 1, len(drawn) * i // shards)] for i in range(1, shards)]
    out: list[str] = []
    for k in at:
        # a hot key gets a range of its own: both it and the greatest key below it split
        below = bisect.bisect_left(drawn, k)
        for s in ([drawn[below - 1]] if below and at.count(k) > 1 else []) + [k]:
            if not out or s > out[-1]:
                out.append(s)
    return out


def range_of(spark: SparkSession, bounds: list[str]):
    """A column function key -> number of splitters below it, by bisection of the distinct keys of a batch."""
    handle = spark.sparkContext.broadcast(np.array(bounds, dtype=object))

    @F.pandas_udf("int")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            codes, distinct = pd.factorize(keys)
            yield pd.Series(np.searchsorted(handle.value, np.asarray(distinct, dtype=object))[codes].astype(np.int32))

    return find if bounds else lambda key: F.lit(0)


def shard(docs: DataFrame, key: str = "source", target_tokens: int = 1 << 25, per_shard: int = 64, slack: float = 1.2, seed: int = 31) -> DataFrame:
    """All rows and columns of docs and shard (0, 1, .. in order of the keys), a partition for each shard (for several neighbours where there are more than MOST_TASKS), sorted by key and doc_id within.

    A small table is cut into LEAST_SHARDS shards or so, whatever target_tokens says.

    No shard but that of a single record exceeds slack * target_tokens by more than the unevenness
    of a hash. Keys compare as strings; a null key is the empty string. A text's size is its UTF-8
    bytes and one more, so null and empty texts count too. Repeated rows share a shard. Another
    column named shard in any spelling stays; the new one is then called shard_, shard__ and so on.
    An empty table gives no rows.
    """
    flat, where = positional(docs)
    cols, name = flat.columns, "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    text, doc_id = F.col(where["text"]), F.col(where["doc_id"])
    keyed = flat.withColumns({"_key": F.coalesce(F.col(where[key]).cast("string"), F.lit(NONE)), "_hash": F.xxhash64(F.lit(seed), doc_id, text), "_size": tokens_of(text) + 1})
    sizes = checkpoint(keyed.select("_key", "_hash", "_size"))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    target_tokens = max(1, min(target_tokens, -(-total // LEAST_SHARDS)))
    shards = max(1, -(-total // target_tokens))
    ranges_wanted = min(shards, max(1, SAMPLE // per_shard))
    wanted = ranges_wanted * per_shard
    # Poisson draws in proportion to size: about `wanted` keys in all, per_shard for each range
    drawn = sizes.filter(unit_hash(F.col("_hash"), seed=seed) * total < F.col("_size") * wanted).select("_key").collect() if shards > 1 else []
    bounds = splitters([r["_key"] for r in drawn], ranges_wanted)
    find = range_of(docs.sparkSession, bounds)
    placed = sizes.withColumn("_range", find(F.col("_key")))
    measured = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.sum("_size").alias("n")).collect()}
    parts = {r: -(-n // target_tokens) if n > slack * target_tokens else 1 for r, n in measured.items()}
    first, begin = 0, {}
    for r in sorted(parts):
        begin[r] = first
        first += parts[r]
    # two numbers a range, 2 SAMPLE / per_shard ranges at most
    ranges = docs.sparkSession.createDataFrame([(r, begin[r], parts[r]) for r in sorted(parts)], "_range int, _begin int, _parts int")
    out = keyed.withColumn("_range", find(F.col("_key"))).join(F.broadcast(ranges), "_range")
    number = (F.col("_begin") + F.pmod(F.col("_hash"), F.col("_parts").cast("long"))).cast("int")
    out = out.select(*cols, number.alias("_shard"), "_key", doc_id.alias("_id"))
    tasks = max(1, min(first, MOST_TASKS))
    task = F.floor(F.col("_shard").cast("long") * tasks / max(1, first)).cast("int")
    out = out.repartitionById(tasks, task).sortWithinPartitions("_shard", "_key", "_id")
    return out.select(*cols, "_shard").toDF(*docs.columns, name)
