"""Incremental training that follows the merges exactly.

The symbols of words lie in one array, linked to their neighbours. A merge looks at the words
that its pair was last seen in, finds all its places at once and updates the counts of the pairs
around them; a heap orders pairs by (count, ids), and an entry whose count is outdated goes back
with the right one.

One task does this, but of many words it holds only what the next merges can touch. Words stay
distributed (packs.py) and are trained in rounds, each down to a least count: pairs that occur less
often at its beginning can't be merged in it, nor can a pair across them, as it occurs no more often
than they do. So words are cut at such pairs, what is left is often alike, and each kind is held
once. That reasoning needs each token to come of one pair only. Where a merge makes a token that
words already have, one task holds all words from the start.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import remove, shared_folder, written
from . import packs

UNSIGNED = (1 << 64) - 1


@dataclass(frozen=True)
class Config:
    """vocab_size may be exceeded by specials and alphabet; max_token_length bounds (strictly) the length of newly possible pairs."""

    vocab_size: int = 30000
    min_frequency: int = 0
    special_tokens: Sequence[str] = field(default_factory=tuple)
    limit_alphabet: int | None = None
    initial_alphabet: Sequence[str] = field(default_factory=tuple)
    max_token_length: int | None = None
    continuing_subword_prefix: str | None = None
    end_of_word_suffix: str | None = None

    def __post_init__(self):
        for name in ("vocab_size", "min_frequency"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")


@dataclass
class Trained:
    """vocab: tokens by id; merges: (left id, right id, new id) as they happened."""

    vocab: list[str]
    merges: list[tuple[int, int, int]]

    def serialized(self) -> list[tuple[str, str]]:
        """Merges as tokens: of a repeated pair the last one counts."""
        last = {(a, b): rank for rank, (a, b, _) in enumerate(self.merges)}
        return [(self.vocab[a], self.vocab[b]) for (a, b), _ in sorted(last.items(), key=lambda x: x[1])]


def first_tokens(seen: dict[str, int], spelled: list[tuple[str, int]], cfg: Config) -> tuple[list[str], dict[str, int], list[int]]:
    """The vocabulary before any merge, ids, and the id of each spelling (character; 1 if it begins a word, plus 2 if it ends it) or -1."""
    seen = seen | dict.fromkeys(cfg.initial_alphabet, UNSIGNED)
    kept = sorted(seen)
    if cfg.limit_alphabet is not None and len(kept) > cfg.limit_alphabet:
        kept = sorted(sorted(kept, key=lambda c: (seen[c], c))[len(kept) - cfg.limit_alphabet :])
    vocab = list(dict.fromkeys([*cfg.special_tokens, *kept]))
    ids = {t: i for i, t in enumerate(vocab)}
    prefix, suffix = cfg.continuing_subword_prefix or "", cfg.end_of_word_suffix or ""
    live = [c in ids for c, _ in spelled]
    tokens = [c for c, _ in spelled]
    if prefix or suffix:
        tokens = [(c if k & 1 else prefix + c) + (suffix if k & 2 else "") for c, k in spelled]
        for t in sorted({t for t, on in zip(tokens, live) if on} - ids.keys()):
            ids[t] = len(vocab)
            vocab.append(t)
    return vocab, ids, [ids[t] if on else -1 for t, on in zip(tokens, live)]


def start(words: Sequence[str], counts: np.ndarray, cfg: Config) -> tuple[list[str], dict[str, int], np.ndarray, np.ndarray]:
    """The vocabulary before any merge, ids, the symbols of all words and the word of each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = packs.points(words).astype(np.int64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    # a symbol's spelling depends on its character and on whether it begins or ends its word
    edged = bool(cfg.continuing_subword_prefix or cfg.end_of_word_suffix)
    keys, which = np.unique(points * 4 + (packs.edges(sizes) if edged else 0), return_inverse=True)
    weight = np.zeros(len(keys), np.int64)
    np.add.at(weight, which, counts[owner])
    vocab, ids, known = first_tokens(*spellings(keys.tolist(), weight.tolist()), cfg)
    sym = np.array(known, np.int64)[which]
    return vocab, ids, sym[sym >= 0], owner[sym >= 0]


def spellings(keys: list[int], weights: list[int]) -> tuple[dict[str, int], list[tuple[str, int]]]:
    """How often each character occurs, and each key as (character, edge)."""
    seen: dict[str, int] = {}
    for k, n in zip(keys, weights):
        seen[chr(k >> 2)] = seen.get(chr(k >> 2), 0) + n
    return seen, [(chr(k >> 2), k & 3) for k in keys]


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the keys, where each distinct one begins in it, and the distinct keys."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return order, begin, key[begin]


def first_pairs(symbols: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """Counts of neighbours (by left << 32 | right) and the words they stand in."""
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    order, begin, key = grouped(symbols[inside] << 32 | symbols[inside + 1])
    if not len(key):
        return {}, {}
    held = owner[inside][order]
    total = np.add.reduceat(counts[held], begin)
    return dict(zip(key.tolist(), total.tolist())), dict(zip(key.tolist(), np.split(held, begin[1:])))


def train(words: Sequence[tuple[str, int]], cfg: Config) -> Trained:
    return train_words([w for w, _ in words], np.array([n for _, n in words], np.int64), cfg)


def train_words(words: Sequence[str], counts: np.ndarray, cfg: Config) -> Trained:
    vocab, ids, sym, owner = start(words, counts, cfg)
    merges, _ = follow(vocab, ids, sym, owner, counts, cfg)
    return Trained(vocab, merges)


def joined(left: str, right: str, prefix: str | None) -> str:
    return left + (right[len(prefix) :] if prefix and right.startswith(prefix) else right)


def follow(vocab: list[str], ids: dict[str, int], sym: np.ndarray, owner: np.ndarray, counts: np.ndarray, cfg: Config, lengths: np.ndarray | None = None, floor: int = 0, live: set[int] | None = None) -> tuple[list[tuple[int, int, int]], bool]:
    """Merges of words (the symbols and the word of each, words' counts), which vocab and ids grow by.

    lengths: characters by id, where symbols aren't single ones. floor: stop at a lower count. live:
    the tokens that words have; stop, and say so, before a merge that makes one of them again.
    """
    pair_n, where = first_pairs(sym, owner, counts)
    n = len(sym)
    same = owner[1:] == owner[:-1]
    at = np.arange(n, dtype=np.int64)
    after, before = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    after[:-1][same], before[1:][same] = at[1:][same], at[:-1][same]
    sizes = np.bincount(owner, minlength=len(counts)) if n else np.zeros(len(counts), np.int64)
    begins = np.cumsum(sizes) - sizes
    most = cfg.max_token_length
    length = np.ones(n, np.int64) if lengths is None else lengths[sym]
    heap = [(-c, k >> 32, k & 0xFFFFFFFF, i) for i, (k, c) in enumerate(pair_n.items()) if c > 0]
    places: dict[int, np.ndarray] = {i: where[a << 32 | b] for _, a, b, i in heap}
    where.clear()
    heapq.heapify(heap)
    ticket, merges = len(pair_n), []
    prefix = cfg.continuing_subword_prefix
    while len(vocab) < cfg.vocab_size and heap:
        negative, a, b, i = heapq.heappop(heap)
        current = pair_n[a << 32 | b] & UNSIGNED
        if -negative != current:
            heapq.heappush(heap, (-current, a, b, i))
            continue
        if current < 1 or current < cfg.min_frequency or current < floor:
            break
        token = joined(vocab[a], vocab[b], prefix)
        new = ids.get(token)
        if live is not None:
            if new in live:
                return merges, True
            live.add(len(vocab) if new is None else new)
        if new is None:
            new = ids[token] = len(vocab)
            vocab.append(token)
        merges.append((a, b, new))
        held = np.unique(places.pop(i))
        span = sizes[held]
        spots = np.repeat(begins[held] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        left = spots[sym[spots] == a]
        right = after[left]
        hit = (right >= 0) & (sym[right] == b)
        left, right = left[hit], right[hit]
        if a == b and len(left):  # of a chain of overlapping places every other one
            chain = np.r_[True, left[1:] != right[:-1]]
            start_at = np.maximum.accumulate(np.where(chain, np.arange(len(left)), 0))
            every_other = (np.arange(len(left)) - start_at) % 2 == 0
            left, right = left[every_other], right[every_other]
        if not len(left):
            continue
        weight = counts[owner[left]]
        size = length[left] + length[right]
        p, q = before[left], after[right]
        has_p, has_q = p >= 0, q >= 0
        # a left neighbour that ends the place before is merged already, a right one isn't yet
        merged = np.r_[False, p[1:] == right[:-1]]
        p_sym = np.where(merged, new, sym[p])
        p_size = np.where(merged, np.r_[0, size[:-1]], length[p])
        fits_p = has_p if most is None else has_p & (p_size + size < most)
        fits_q = has_q if most is None else has_q & (size + length[q] < most)
        q_sym = sym[q]
        grown = np.concatenate([p_sym[fits_p] << 32 | new, new << 32 | q_sym[fits_q]])
        shrunk = np.concatenate([p_sym[has_p] << 32 | a, b << 32 | q_sym[has_q]])
        key = np.concatenate([grown, shrunk])
        if len(key):
            change = np.concatenate([weight[fits_p], weight[fits_q], -weight[has_p], -weight[has_q]])
            order, begin, distinct = grouped(key)
            for k, c in zip(distinct.tolist(), np.add.reduceat(change[order], begin).tolist()):
                pair_n[k] = pair_n.get(k, 0) + c
        sym[left], sym[right] = new, -1
        length[left] = size
        after[left] = q
        before[q[has_q]] = left[has_q]
        if len(grown):
            held = np.concatenate([owner[left[fits_p]], owner[left[fits_q]]])
            order, begin, distinct = grouped(grown)
            for k, w in zip(distinct.tolist(), np.split(held[order], begin[1:])):
                if pair_n[k] > 0:
                    places[ticket] = w
                    heapq.heappush(heap, (-pair_n[k], k >> 32, k & 0xFFFFFFFF, ticket))
                    ticket += 1
    return merges, False


SCHEMA = "kind string, id long, token string, left string, right string"
#: Symbols that one task trains on. FEW: pairs that may be merged in the first round, GROWS: times as many in the next where words are alike.
MOST, FEW, GROWS = 5_000_000, 100, 16


def train_table(words: DataFrame, cfg: Config, most: int = MOST) -> DataFrame:
    """kind 'vocab' (id, token) and 'merge' (id: serialized rank; token, left, right), from word, cnt.

    Trains when it is called; words are read once, and their order doesn't matter for the result.
    """
    done = train_packs(words, cfg, most)
    merges = done.serialized()
    n, m = len(done.vocab), len(merges)
    token = done.vocab + [joined(a, b, cfg.continuing_subword_prefix) for a, b in merges]
    columns = {"kind": ["vocab"] * n + ["merge"] * m, "id": [*range(n), *range(m)], "token": token}
    columns |= {"left": [None] * n + [a for a, _ in merges], "right": [None] * n + [b for _, b in merges]}
    types = {"kind": pa.string(), "id": pa.int64(), "token": pa.string(), "left": pa.string(), "right": pa.string()}
    return words.sparkSession.createDataFrame(pa.table({c: pa.array(v, types[c]) for c, v in columns.items()}), SCHEMA)


def train_packs(words: DataFrame, cfg: Config, most: int = MOST) -> Trained:
    spark = words.sparkSession
    folder = shared_folder(spark, "training")
    try:
        points = written(packs.packed(words), f"{folder}/points")
        edged = bool(cfg.continuing_subword_prefix or cfg.end_of_word_suffix)
        found = packs.points_of(points, edged).orderBy("key").collect()  # a row for each character and place in words
        vocab, ids, known = first_tokens(*spellings([r["key"] for r in found], [r["weight"] for r in found]), cfg)
        on = [(r["key"], i) for r, i in zip(found, known) if i >= 0]
        keys, symbols = (np.array(x, np.int64) for x in (zip(*on) if on else ((), ())))
        spell = lambda s, n: packs.spelled(s, n, keys, symbols, edged)
        trained = None
        if sum(r["n"] for r in found) > most and not any(r["below"] for r in found):
            state = written(packs.mapped(points, spell), f"{folder}/words-0")
            trained = in_rounds(state, Trained([*vocab], []), {**ids}, set(symbols.tolist()), cfg, most, folder)
        if trained is None:
            merges, _ = one_task(packs.mapped(points, spell), vocab, ids, cfg)
            trained = Trained(vocab, [])
            extend(trained, ids, merges, cfg)
        return trained
    finally:
        remove(spark, folder)


def extend(trained: Trained, ids: dict[str, int], merges: list[tuple[int, int, int]], cfg: Config) -> None:
    for a, b, new in merges:
        if new == len(trained.vocab):
            token = joined(trained.vocab[a], trained.vocab[b], cfg.continuing_subword_prefix)
            ids[token] = new
            trained.vocab.append(token)
        trained.merges.append((a, b, new))


def one_task(rows: DataFrame, vocab: list[str], ids: dict[str, int], cfg: Config, **how) -> tuple[list[tuple[int, int, int]], bool]:
    """follow on packs, or on runs, in one task."""
    runs = "run" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[packs.Pack] = []
        if runs:
            for b in batches:
                held = b.column(0).to_pylist()
                parts.append((np.frombuffer(b"".join(held), np.int32), np.fromiter(map(len, held), np.int64, len(held)) // 4, b.column(1).to_numpy(zero_copy_only=False)))
        else:
            parts += packs.read(batches)
        if not parts:
            return
        sym, sizes, counts = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        merges, again = follow([*vocab], {**ids}, sym.astype(np.int64), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), counts, cfg, **how)
        table = np.array([*merges, (-1, -1, -1)] if again else merges, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(3)], names=["left", "right", "new"])

    got = [tuple(r) for r in rows.coalesce(1).mapInArrow(run, "left long, right long, new long").collect()]
    return [m for m in got if m[0] >= 0], any(m[0] < 0 for m in got)


def in_rounds(state: DataFrame, trained: Trained, ids: dict[str, int], live: set[int], cfg: Config, most: int, folder: str) -> Trained | None:
    """Training in rounds from packs; None if a merge makes a token that words already have."""
    spark, least = state.sparkSession, max(1, cfg.min_frequency)
    lengths, longest = [1] * len(trained.vocab), cfg.max_token_length
    kinds, share, turn, names = FEW, 0.0, 0, [f"{folder}/words-0"]
    while len(trained.vocab) < cfg.vocab_size:
        chars = np.array(lengths, np.int64)

        def counted(left: np.ndarray, right: np.ndarray, chars: np.ndarray = chars) -> np.ndarray:
            size = chars[left] + chars[right]
            return (size == 2) | (size < longest) if longest is not None else np.ones(len(left), bool)

        pairs = written(packs.pairs_of(state, counted).filter(F.col("n") >= least), f"{folder}/pairs-{turn}")
        by_count = pairs.groupBy(F.floor(F.log2("n") * 8).alias("b"))
        shares = by_count.agg(F.min("n").alias("least"), F.max("n").alias("top"), F.count("*").alias("kinds"), F.sum("places").alias("places")).orderBy(F.desc("b")).collect()  # 8 rows for each doubling of counts
        if not shares:
            break
        places = most / share if share else float("inf")
        while True:
            floor, held, used = int(shares[0]["top"]), 0, 0
            for r in shares:
                if used + r["kinds"] > kinds or held + r["places"] > places:
                    break
                floor, held, used = int(r["least"]), held + r["places"], used + r["kinds"]
            alive = np.sort(pairs.filter(F.col("n") >= floor).select("pair").toArrow().column(0).to_numpy())
            runs = written(packs.runs_of(state, alive), f"{folder}/runs-{turn}")
            size = (runs.agg(F.sum(F.octet_length("run"))).first()[0] or 0) // 4
            turn += 1
            if size <= most or not used:
                break
            kinds, places = used * most // (2 * size), held * most / (2 * size)
        merges, again = one_task(runs, trained.vocab, ids, cfg, lengths=chars, floor=int(floor), live=live)
        if again:
            return None
        for a, b, new in merges:
            both = lengths[a] + lengths[b]
            lengths += [both] * (new == len(lengths))
            lengths[new] = both
        live |= {new for _, _, new in merges}
        extend(trained, ids, merges, cfg)
        if len(trained.vocab) >= cfg.vocab_size or floor <= least:
            break
        # symbols of runs, as a share of all places: it grows towards 1 as words have less in common
        share = min(1.0, 2 * size / max(1, held))
        kinds = len(alive) * max(2, min(GROWS, most // max(1, size)))
        kinds = max(kinds, len(alive) + 8) if share < 1 else 1 << 62
        names.append(f"{folder}/words-{turn}")
        state = written(packs.mapped(state, packs.Merges(merges).follow), names[-1])
        remove(spark, names[-2])
    return trained


def collected(table: DataFrame) -> tuple[list[str], list[tuple[str, str]]]:
    """Tokens by id and merges by rank, on the driver."""
    rows = table.collect()
    vocab = [r["token"] for r in sorted((r for r in rows if r["kind"] == "vocab"), key=lambda r: r["id"])]
    return vocab, [(r["left"], r["right"]) for r in sorted((r for r in rows if r["kind"] == "merge"), key=lambda r: r["id"])]
