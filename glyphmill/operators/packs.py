"""Words in packs: a row holds many words as bytes, so that numpy reads them without a step for each.

symbols: int32 ids (at first code points) of all words, one after another; sizes: int32, how many each
word has; counts: int64, how often each occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "symbols binary, sizes binary, counts binary"
#: Distinct keys that a task sums up before it passes them on.
HELD = 1 << 20

Pack = tuple[np.ndarray, np.ndarray, np.ndarray]


def batch(symbols: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    rows = [pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in ((symbols, np.int32), (sizes, np.int32), (counts, np.int64))]
    return pa.RecordBatch.from_arrays(rows, names=["symbols", "sizes", "counts"])


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Pack]:
    for b in batches:
        for i in range(b.num_rows):
            raw = [b.column(k)[i].as_buffer() for k in range(3)]
            yield np.frombuffer(raw[0], np.int32).astype(np.int64), np.frombuffer(raw[1], np.int32).astype(np.int64), np.frombuffer(raw[2], np.int64)


def points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


def packed(words: DataFrame) -> DataFrame:
    """Packs of code points, from word, cnt; the words are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(0).to_pylist()
            yield batch(points(held), np.fromiter(map(len, held), np.int64, len(held)), b.column(1).to_numpy(zero_copy_only=False))

    return words.select("word", F.col("cnt").cast("long").alias("cnt")).mapInArrow(run, SCHEMA)


def mapped(packs: DataFrame, change: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Packs with their symbols and sizes changed; words of a single symbol or none are dropped, as they have no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, sizes, counts in read(batches):
            symbols, sizes = change(symbols, sizes)
            more = sizes > 1
            if more.any():
                yield batch(symbols[np.repeat(more, sizes)], sizes[more], counts[more])

    return packs.mapInArrow(run, SCHEMA)


def edges(sizes: np.ndarray) -> np.ndarray:
    """Of each symbol: 1 if it begins its word, plus 2 if it ends it."""
    out = np.zeros(int(sizes.sum()), np.int64)
    ends = np.cumsum(sizes)[sizes > 0]
    out[ends - sizes[sizes > 0]] += 1
    out[ends - 1] += 2
    return out


def spelled(symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, ids: np.ndarray, edged: bool) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by sorted keys (code point * 4 + edge); those without a key are dropped."""
    key = symbols * 4 + (edges(sizes) if edged else 0)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1) if len(keys) else np.zeros(len(key), np.int64)
    known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
    left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
    return ids[at[known]], left


def linked(sizes: np.ndarray) -> np.ndarray:
    """Whether each symbol is followed by one of the same word."""
    out = np.ones(int(sizes.sum()), bool)
    out[np.cumsum(sizes)[sizes > 0] - 1] = False
    return out


def every_other(at: np.ndarray) -> np.ndarray:
    """Of places that overlap in a chain the first, the third and so on."""
    begins = np.r_[True, at[1:] != at[:-1] + 1] if len(at) else np.empty(0, bool)
    since = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    return at[since % 2 == 0]


class Merges:
    """Merges (left id, right id, new id) that are followed in their order, each once; of a repeated pair the last one counts."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        rank = {a << 32 | b: i for i, (a, b, _) in enumerate(merges)}
        self.keys = np.array(sorted(rank), np.int64)
        self.ranks = np.array([rank[k] for k in self.keys.tolist()], np.int64)
        self.new = np.array([n for _, _, n in merges], np.int64)

    def follow(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words at once: each makes its next merge in every turn, and rests when it has none left."""
        if not len(self.keys) or not len(sizes):
            return symbols, sizes
        none = len(self.new)
        which, last = np.arange(len(sizes)), np.full(len(sizes), -1, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(symbols[:0], sizes[sizes == 0], which[sizes == 0])]
        sizes, which, last = sizes[sizes > 0], which[sizes > 0], last[sizes > 0]
        while len(sizes):
            key = np.r_[symbols[:-1] << 32 | symbols[1:], -1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & linked(sizes), self.ranks[at], none)
            rank[rank <= np.repeat(last, sizes)] = none
            best = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            goes = best < none
            of = np.repeat(goes, sizes)
            if not goes.all():
                done.append((symbols[~of], sizes[~goes], which[~goes]))
                symbols, rank, sizes, which, best = symbols[of], rank[of], sizes[goes], which[goes], best[goes]
            if not len(sizes):
                break
            hit = every_other(np.flatnonzero(rank == np.repeat(best, sizes)))
            symbols = symbols.copy()
            symbols[hit] = self.new[rank[hit]]
            stays = np.ones(len(symbols), bool)
            stays[hit + 1] = False
            sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes))
            symbols, last = symbols[stays], best
        symbols, sizes, which = (np.concatenate(x) for x in zip(*done))
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(which)
        sizes = sizes[order]
        spots = np.repeat(begins[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(symbols))
        return symbols[spots], sizes


def summed(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct values of the first column and sums of the others."""
    order = np.argsort(rows[0], kind="stable")
    key = rows[0][order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return [key[begin], *(np.add.reduceat(r[order], begin) if len(key) else r for r in rows[1:])]


def sums(packs: DataFrame, find: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """Sums by key (names[0]) of what find makes of each pack: the key's column and those to add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for pack in read(batches):
            parts.append(summed(find(*pack)))
            n += len(parts[-1][0])
            if n >= HELD:
                parts = [summed([np.concatenate(c) for c in zip(*parts)])]
                n = len(parts[0][0])
                if n >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in parts[0]], names=names)
                    parts, n = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in summed([np.concatenate(c) for c in zip(*parts)])], names=names)

    rows = packs.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return rows.groupBy(names[0]).agg(*[F.sum(n).alias(n) for n in names[1:]])


def points_of(packs: DataFrame, edged: bool) -> DataFrame:
    """key (code point * 4 + edge), weight, n (symbols in distinct words), below (of counts below zero)."""

    def find(symbols, sizes, counts):
        weight = np.repeat(counts, sizes)
        return [symbols * 4 + (edges(sizes) if edged else 0), weight, np.ones(len(symbols), np.int64), (weight < 0).astype(np.int64)]

    return sums(packs, find, ["key", "weight", "n", "below"])


def pairs_of(packs: DataFrame, counted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """pair (left << 32 | right), n (occurrences), places (in distinct words) of the pairs that count."""

    def find(symbols, sizes, counts):
        at = np.flatnonzero(linked(sizes))
        left, right, weight = symbols[at], symbols[at + 1], np.repeat(counts, sizes)[at]
        fits = counted(left, right)
        return [(left << 32 | right)[fits], weight[fits], np.ones(int(fits.sum()), np.int64)]

    return sums(packs, find, ["pair", "n", "places"])


def runs_of(packs: DataFrame, alive: np.ndarray) -> DataFrame:
    """run (int32 ids), cnt: what is left of words that are cut wherever a pair isn't in the sorted list, alike ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["run", "cnt"])
        for symbols, sizes, counts in read(batches):
            key = np.r_[symbols[:-1] << 32 | symbols[1:], -1]
            at = np.minimum(np.searchsorted(alive, key), len(alive) - 1)
            on = linked(sizes) & (alive[at] == key)
            back = np.r_[False, on[:-1]]
            begin, end = np.flatnonzero(on & ~back), np.flatnonzero(back & ~on) + 1
            raw = symbols.astype(np.int32).tobytes()
            for i, j, n in zip((begin * 4).tolist(), (end * 4).tolist(), np.repeat(counts, sizes)[begin].tolist()):
                part = raw[i:j]
                held[part] = held.get(part, 0) + n
            if len(held) > HELD // 4:
                yield give()
                held.clear()
        if held:
            yield give()

    return packs.mapInArrow(run, "run binary, cnt long").groupBy("run").agg(F.sum("cnt").alias("cnt"))
