"""Packing documents into windows of fixed length by best-fit decreasing.

A document longer than the window is first cut into full windows; its rest and all shorter
documents go, longest first, each into the open window with the least room that suffices. Open
windows are held by a segment tree indexed by remaining room. Documents are dealt by hash to
shards of about ``shard_tokens``, each packed on its own, so a window is short only where its
shard ends; the number of shards grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, positional
from .mixing import tokens_of


class Rooms:
    """Open windows by remaining room: tree[i] says whether the leaves below i hold a window."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        i = self.size + room
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least need, as (room, window); it is closed."""
        i = self.size + need
        while not self.tree[i]:
            while i & 1:  # nothing to the right below this parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        window = self.windows[room].pop()
        if not self.windows[room]:
            self.tree[i] = 0
            i >>= 1
            while i and not (self.tree[2 * i] or self.tree[2 * i + 1]):
                self.tree[i] = 0
                i >>= 1
        return room, window


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (item, start, length, window, place) of items in the given order of ties; every token is in one row."""
    lengths = np.asarray(lengths, np.int64)
    full = lengths // capacity
    item = np.repeat(np.arange(len(lengths)), full)
    number = np.arange(len(item)) - np.repeat(np.cumsum(full) - full, full)
    rows = [np.stack([item, number * capacity, np.full(len(item), capacity), np.arange(len(item)), np.zeros(len(item), np.int64)], 1)]
    opened = len(item)
    rest = lengths - full * capacity
    rooms, filled, out = Rooms(capacity), {}, []
    for i in np.argsort(-rest, kind="stable").tolist():
        n = int(rest[i])
        if not n:
            break
        found = rooms.take(n)
        room, window = found or (capacity, opened)
        opened += found is None
        out.append((i, int(full[i]) * capacity, n, window, filled.get(window, 0)))
        filled[window] = filled.get(window, 0) + 1
        if room > n:
            rooms.put(room - n, window)
    return np.concatenate([rows[0], np.array(out, np.int64).reshape(-1, 5)])


def pack(docs: DataFrame, capacity: int = 8192, shard_tokens: int = 1 << 26, seed: int = 23) -> DataFrame:
    """shard, window, place, doc_id, start, length, room: which tokens [start, start + length) of which document lie where; (shard, window) names a window, room is what it has left.

    A text's tokens are its UTF-8 bytes. Null and empty texts give no row. Repeated rows are packed
    each; documents of equal length are taken in order of doc_id, null first. Extra columns are
    ignored. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    flat, where = positional(docs)
    sizes = checkpoint(flat.select(F.col(where["doc_id"]).cast("long").alias("doc_id"), tokens_of(F.col(where["text"])).alias("tokens"), F.xxhash64(F.lit(seed), F.col(where["doc_id"]), F.col(where["text"])).alias("key")).filter("tokens > 0"))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "key", "tokens"], kind="stable", na_position="first")
        rows = best_fit(pdf["tokens"].to_numpy(), capacity)
        used = np.bincount(rows[:, 3], weights=rows[:, 2]).astype(np.int64)
        ids = pdf["doc_id"].array[rows[:, 0]]
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "window": rows[:, 3], "place": rows[:, 4], "doc_id": ids, "start": rows[:, 1], "length": rows[:, 2], "room": capacity - used[rows[:, 3]]})

    dealt = sizes.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(one, "shard long, window long, place long, doc_id long, start long, length long, room long")
