"""N-gram Jaccard join by prefixes.

Two documents join when the Jaccard similarity of their sets of word n-grams is at least
``threshold``. The search is exact over the hashed n-grams: the members of each set are ordered,
rare ones first; two sets that reach the threshold share one of the first (1 - threshold) |set| + 1
members, the prefix, so each of these is a signature. The first member that they share leaves
enough members behind it in both sets for the overlap that their sizes ask for; runs of equal
signatures are searched for pairs of which this holds. Any order of the members gives the same
result. It is taken from counts of all sets by hash buckets, which only rounds it; a second count,
of the prefixes, tells signatures that no other set has, which aren't sent, and the length of runs.

Documents of equal sets form a class first, by an aggregation that combines before it shuffles; one
set stands for the class from there on. Signatures are made and sorted in several passes, each over
a share of the members, so that the files of one pass are gone before the next. With a signature
goes a sketch of the members from there on (a parity bit for each bucket of the domain), which bounds
their symmetric difference from below; what two sets hold before the first member that they share
differs entirely, so what the threshold allows is less by that. Sets that no chain of possible pairs
connects part ways, and the smallest class of each chain leads it. So the shuffle carries a row a signature and a row a membership, never
a pair, and unrelated sets that share a signature go no further. Last, the sets of a leader are
compared exactly. Runs and leaders with many members are divided into pairs of blocks, each a task
of its own.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grouping
from .common import checkpoint, dropping_shuffles, folder, mix64, pick, positional, remove, written
from .grouping import blocks_of, by_group, classes_of, group_lengths, one_row_each, spanning

WORD = re.compile(r"\w+")
#: Hash buckets in which members are counted, and those of a part of the table.
BUCKETS, PART = 1 << 22, 1 << 16
#: Members of a run that are compared with as many others in one task.
RUN = 32768
#: What a set may miss of the threshold by rounding, as a share of its size.
SLACK = 1e-6
#: Bytes of signatures of a task of the shuffle in one pass.
PASS_BYTES = 8_000_000
#: Bits of sketches of signatures that are drawn at a time.
DRAWN = 1 << 26
#: Members up to which all pairs of a run are made; those of longer ones are sought by size.
LONG = 32


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(text: str | None, n: int) -> set[str]:
    """The n-grams of lower-case words; a text of fewer words than n is one shorter n-gram."""
    w = words_of(text) if text else []
    if n == 1 or not w:
        return set(w)
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def hash_shingles(grams: list[str]) -> np.ndarray:
    """uint32 hashes that don't depend on the process."""
    if not grams:
        return np.empty(0, np.uint32)
    h = pd.util.hash_array(np.array(grams, dtype=object), categorize=False)
    return (h ^ (h >> np.uint64(32))).astype(np.uint32)


def buckets(feats: np.ndarray) -> np.ndarray:
    return (mix64(feats.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def prefixes(sets: list[np.ndarray], threshold: float, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, index of the set, members of the set from there on) of all prefixes. A set holds no repeats; an empty one gives none.

    levels: of each bucket, how frequent its members are; without, the order is that of the hashes.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.size or not sizes.max():
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    feats = np.concatenate(sets).astype(np.uint64)
    rank = (np.zeros(len(feats), np.uint64) if levels is None else levels[buckets(feats)].astype(np.uint64)) << np.uint64(32)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint64), sizes) << np.uint64(40)
    feats = np.sort(owner | rank | feats).astype(np.uint32)
    who = np.repeat(np.arange(len(sets)), sizes)
    place = np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    live = place <= np.floor((1 - threshold + SLACK) * sizes + 1e-9).astype(np.int64)[who]
    return feats[live], who[live], (sizes[who] - place)[live]


def of_share(feats: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Which members belong to share (i, m): one in m."""
    return mix64(feats.astype(np.uint64)) % np.uint64(share[1]) == share[0]


def signatures(sets: list[np.ndarray], threshold: float, share: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of all sets, in the order of the hashes, of a share of the members."""
    feats, who, _ = prefixes(sets, threshold)
    mine = of_share(feats, share)
    return feats[mine], who[mine]


def widths(sizes: np.ndarray, rest: np.ndarray, threshold: float) -> np.ndarray:
    """Bits of the sketch at a signature, a power of 2, that tell unrelated sets apart: where d members may differ from there on, 2 d bits at least, and more the fewer they are, as chance matters more."""
    differing = 2 / (1 + threshold) * np.maximum(0, (1 - threshold) * rest - threshold * (sizes - rest))
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, 2.15 * differing + 13 * np.sqrt(differing)))).astype(np.int64))


def sketch_buckets(feats: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(feats.astype(np.uint64) + np.uint64(0x5BF03635)) & np.uint64(bits - 1)).astype(np.int64)


def sketches_of(sets: list[np.ndarray], bits: np.ndarray | None = None) -> list[bytes]:
    """For each set a parity bit for each of 2^b buckets of the domain, 1.5 buckets a member at least where their number isn't given.

    Two sets differ in a member at least for each bit in which their sketches do. Half a sketch
    xor the other half is the sketch of half as many buckets.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    if bits is None:
        bits = np.maximum(64, 1 << np.ceil(np.log2(1.5 * np.maximum(1, sizes))).astype(np.int64))
    out: list[bytes] = [b""] * len(sets)
    for n in np.unique(bits).tolist():
        who = np.flatnonzero(bits == n)
        step = max(1, (1 << 21) // n)
        for lo in range(0, len(who), step):
            some = who[lo : lo + step]
            bucket = sketch_buckets(np.concatenate([sets[i] for i in some]), n)
            odd = np.bincount(np.repeat(np.arange(len(some)), sizes[some]) * n + bucket, minlength=len(some) * n).astype(np.uint8) & 1
            drawn = np.packbits(odd, bitorder="little").tobytes()
            for k, i in enumerate(some.tolist()):
                out[i] = drawn[k * n // 8 : (k + 1) * n // 8]
    return out


def sketch(feats: np.ndarray) -> np.ndarray:
    """The sketch of one set in uint64 words."""
    return np.frombuffer(sketches_of([feats])[0], np.uint64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches (row, word) with fewer words."""
    while x.shape[1] > words:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def tails(sets: list[np.ndarray], feats: np.ndarray, who: np.ndarray, rest: np.ndarray, mine: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, sketches (row, word)) of those places of the prefixes (feats, who, rest) that are mine: each is the sketch of the members from there on."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bits, narrow = widths(sizes, sizes, threshold), widths(sizes[who], rest, threshold)
    for n in np.unique(bits[who[mine]]).tolist():
        own = np.flatnonzero(bits == n)
        whole = np.frombuffer(b"".join(sketches_of([sets[i] for i in own], bits[own])), np.uint64).reshape(-1, n // 64)
        nth = np.zeros(len(sets), np.int64)
        nth[own] = np.arange(len(own))
        rows = np.flatnonzero(bits[who] == n)
        step = max(1, DRAWN // n)
        before, last, begin = np.zeros(n // 64, np.uint64), -1, np.zeros(n // 64, np.uint64)
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            seen = np.zeros((len(some) + 1, n // 64), np.uint64)
            seen[0] = before
            bucket = sketch_buckets(feats[some], n)
            seen[np.arange(1, len(some) + 1), bucket >> 6] = np.uint64(1) << (bucket & 63).astype(np.uint64)
            np.bitwise_xor.accumulate(seen, axis=0, out=seen)
            # the members before a place in its own set are all before it but those before the set
            new = np.r_[who[some[0]] != last, who[some[1:]] != who[some[:-1]]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(some)), -1))
            for v in np.unique(narrow[some[mine[some]]]).tolist():
                take = np.flatnonzero(mine[some] & (narrow[some] == v))
                start = np.where((first[take] >= 0)[:, None], seen[first[take]], begin)
                yield some[take], np.ascontiguousarray(folded(whole[nth[who[some[take]]]] ^ seen[take] ^ start, v // 64))
            begin = seen[first[-1]].copy() if first[-1] >= 0 else begin
            before, last = seen[-1].copy(), who[some[-1]]


def following(after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each position and as many next ones as given, some hundred thousand at a time."""
    done = np.cumsum(after)
    lo = 0
    while lo < len(after):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + 400_000, side="right")))
        n = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi


def neighbours(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of positions in the same one of consecutive runs of the given lengths."""
    ends = np.cumsum(lengths)
    yield from following(np.repeat(ends, lengths) - np.arange(lengths.sum()) - 1)


def fitting(need: np.ndarray, most: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in the same one of consecutive runs, of which most of either is at least what the other needs."""
    long = np.repeat(lengths > LONG, lengths)
    where = np.flatnonzero(~long)
    for i, j in neighbours(lengths[lengths <= LONG]):
        i, j = where[i], where[j]
        ok = (most[i] >= need[j]) & (most[j] >= need[i])
        yield i[ok], j[ok]
    if long.any():
        run = np.repeat(np.arange(len(lengths)), lengths)
        where = np.flatnonzero(long)
        where = where[np.lexsort((need[where], run[where]))]
        begin = run[where] * (1 + need.max() + most.max())
        after = np.searchsorted(begin + need[where], begin + most[where], side="right") - np.arange(len(where)) - 1
        for i, j in following(np.maximum(0, after)):
            i, j = where[i], where[j]
            ok = most[j] >= need[i]
            yield i[ok], j[ok]


def possible(sketches: np.ndarray, words: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, threshold: float, rest: np.ndarray | None = None, tail: bool = False) -> np.ndarray:
    """For each member of consecutive runs the first one of its run that a chain of possible pairs connects it with.

    A pair is possible if neither its sizes nor rest, the members from the signature on, are too
    small for the overlap and the sketches don't show more differences than the threshold allows.
    sketches: all of them, one after the other; words: how many words each has; tail: whether they
    are those of the members from the signature on, of which it is the first that both sets hold.
    """
    label = np.arange(len(sizes))
    part, rate = threshold / (1 + threshold) - SLACK, (1 - threshold) / (1 + threshold)
    begin = np.cumsum(words) - words
    room = rate * sizes + 5e-4 - (sizes - rest if tail else 0)
    drawn = {}

    def narrowed(w: int) -> tuple[np.ndarray, np.ndarray]:
        """Sketches of w words (word, row) of the sets that may be compared in so many, and where each is."""
        if w not in drawn:
            at = np.flatnonzero((words >= w) & (tail | (words <= 4 * w)))  # sizes differ by a factor of 2 at most
            x, own = np.empty((w, len(at)), np.uint64), words[at]
            for v in np.unique(own).tolist():
                rows = np.flatnonzero(own == v)
                x[:, rows] = folded(sketches[begin[at[rows]][:, None] + np.arange(v)], w).T
            place = np.zeros(len(sizes), np.int64)
            place[at] = np.arange(len(at))
            drawn[w] = x, place
        return drawn[w]

    a, b = [], []
    for i, j in fitting(part * sizes, (sizes if rest is None else rest) - part * sizes + 1e-3, lengths):
        fewest = np.minimum(words[i], words[j])
        for w in np.unique(fewest).tolist():
            mine = fewest == w
            p, q = i[mine], j[mine]
            x, place = narrowed(w)
            left, right = place[p], place[q]
            apart = np.zeros(len(p), np.int32)
            for word in x:
                apart += np.bitwise_count(word[left] ^ word[right])
            ok = apart <= room[p] + room[q]
            a.append(p[ok])
            b.append(q[ok])
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
    return label


def similar_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs i < j of distinct sets with Jaccard >= threshold, and the similarity, by counting shared members."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float32)
    order = np.argsort(sizes, kind="stable")
    owner = np.repeat(np.arange(m), sizes[order].astype(np.int64))
    _, code = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    seen = np.bincount(code)
    dense = np.cumsum(seen > 1) - 1
    live = seen[code] > 1
    owner, code = owner[live], dense[code[live]]
    by_code = np.argsort(code, kind="stable")
    owner_c, code_c = owner[by_code], code[by_code]
    width = int(code_c[-1]) + 1 if len(code_c) else 0
    ordered = sizes[order]
    out_a, out_b, out_j = [], [], []
    block = max(1, min(m, 8_000_000 // max(1, m)))
    for lo in range(0, m, block):
        hi = min(m, lo + block)
        top = int(np.searchsorted(ordered, math.floor(ordered[hi - 1] / threshold + 1e-6), side="right"))
        shared = np.zeros((hi - lo, top - lo), np.float32)
        for c in range(0, width, 2048):
            s, e = np.searchsorted(code_c, [c, c + 2048])
            o, k = owner_c[s:e], code_c[s:e] - c
            inside = (o >= lo) & (o < top)
            block_x = np.zeros((top - lo, 2048), np.float32)
            block_x[o[inside] - lo, k[inside]] = 1
            used = np.flatnonzero(block_x[: hi - lo].any(0))
            if len(used):
                block_x = block_x[:, used]
                shared += block_x[: hi - lo] @ block_x.T
        jac = shared / (ordered[lo:hi, None] + ordered[None, lo:top] - shared)
        i, j = np.nonzero(jac >= threshold - 1e-6)
        late = j > i
        i, j = i[late], j[late]
        out_a.append(order[i + lo])
        out_b.append(order[j + lo])
        out_j.append(jac[i, j].astype(np.float64))
    a, b, j = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_j)
    return np.minimum(a, b), np.maximum(a, b), j


def feature_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, feats (sorted distinct hashes of the n-grams); rows without id or n-grams give none."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(texts), 500):
                grams = [list(shingles(t, n)) for t in texts.slice(lo, 500).to_pylist()]
                sizes = np.array([len(g) for g in grams])
                h = hash_shingles([g for doc in grams for g in doc])
                row = np.repeat(np.arange(len(grams), dtype=np.uint64), sizes)
                keys = np.unique((row << np.uint64(32)) | h)
                row, h = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32).view(np.int32)
                n_of = np.bincount(row, minlength=len(grams))
                ends = np.concatenate([[0], np.cumsum(n_of)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 500), pa.ListArray.from_arrays(pa.array(ends), pa.array(h))], ["doc_id", "feats"])

    base = pick(docs, "doc_id", "text").filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return base.mapInArrow(extract, "doc_id long, feats array<int>").filter(F.size("feats") > 0)


def lists_of(column: pa.Array) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint32)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def tally(classes: DataFrame, members: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """For each bucket the level of how often it is among the members that are given of all sets: 8 times the binary logarithm, 0 where it is once or never."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                total += np.bincount(buckets(members(lists_of(batch.column(0).slice(lo, 2000)))), minlength=BUCKETS).astype(np.uint32)
        for part in range(BUCKETS // PART):
            at = np.flatnonzero(total[part * PART : (part + 1) * PART])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([total[part * PART + at].tobytes()], pa.binary())], ["part", "place", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, place, n in zip(*(c.to_pylist() for c in batch.columns)):
                totals.setdefault(part, np.zeros(PART, np.int64))[np.frombuffer(place, np.uint16)] += np.frombuffer(n, np.uint32)
        for part, total in totals.items():
            level = np.minimum(255, np.round(8 * np.log2(np.maximum(1, total)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "level"])

    parts = classes.select("feats").mapInArrow(count, "part int, place binary, n binary")
    out = np.zeros(BUCKETS, np.uint8)
    for part, level in parts.repartition("part").mapInArrow(add, "part int, level binary").collect():
        out[part * PART : (part + 1) * PART] = np.frombuffer(level, np.uint8)
    return out


def passes_for(threshold: float, features: int, tasks: int) -> int:
    """Passes over the signatures, so that those of one take about 5 bytes a feature; fewer where a task of the shuffle would get less than PASS_BYTES."""
    by_size = math.ceil(100 * (1 - threshold) * features / (PASS_BYTES * tasks))
    return max(1, min(by_size, math.ceil(20 * (1 - threshold) - 1e-9)))


def candidates(classes: DataFrame, threshold: float, path: str) -> DataFrame:
    """leader, member: classes that are compared with each other, the leaders themselves included."""
    spark = classes.sparkSession
    levels = spark.sparkContext.broadcast(tally(classes, np.concatenate))
    shared = spark.sparkContext.broadcast(tally(classes, lambda sets: prefixes(sets, threshold, levels.value)[0]))

    def sign_share(share: tuple[int, int]):
        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 500):
                    part = batch.slice(lo, 500)
                    sets, cls = lists_of(part.column(1)), part.column(0).to_numpy()
                    sizes = np.array([len(s) for s in sets], np.int32)
                    feats, who, rest = prefixes(sets, threshold, levels.value)
                    level = shared.value[buckets(feats)]
                    mine = (level > 0) & of_share(feats, share)
                    for at, drawn in tails(sets, feats, who, rest, mine, threshold):
                        # a run of more than RUN members is divided into pairs of blocks
                        many = np.ceil(2 ** (level[at] / 8) / RUN).astype(np.int64)
                        own = (mix64(cls[who[at]].astype(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
                        each = np.repeat(np.arange(len(at)), many)
                        other = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                        own, at = own[each], at[each]
                        columns = [feats[at].astype(np.int64), np.minimum(own, other).astype(np.int32), np.maximum(own, other).astype(np.int32), cls[who[at]], sizes[who[at]], rest[at].astype(np.int32)]
                        ends = np.arange(len(drawn) + 1, dtype=np.int32) * np.int32(8 * drawn.shape[1])
                        sketches = pa.Array.from_buffers(pa.binary(), len(drawn), [None, pa.py_buffer(ends), pa.py_buffer(drawn)])
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), sketches.take(pa.array(each))], ["grp", "i", "j", "cls", "size", "rest", "sketch"])

        return sign

    def connect(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cls, sizes, rest = batch.column(3).to_numpy(), batch.column(4).to_numpy().astype(np.int64), batch.column(5).to_numpy().astype(np.int64)
        _, ends, data = batch.column(6).buffers()
        ends = np.frombuffer(ends, np.int32)[batch.column(6).offset :][: len(cls) + 1]
        sketches = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64)
        label = possible(sketches, np.diff(ends) // 8, sizes, group_lengths(batch), threshold, rest, tail=True)
        # the smallest class of a chain leads
        lead = np.full(len(cls), np.iinfo(np.int64).max)
        np.minimum.at(lead, label, cls)
        lead = lead[label]
        some = lead != cls
        pair = pd.DataFrame({"leader": lead[some], "member": cls[some]}).drop_duplicates()
        yield pa.RecordBatch.from_pandas(pair, preserve_index=False)

    total = classes.agg(F.sum(F.size("feats"))).first()[0] or 0
    times, found = passes_for(threshold, total, int(spark.conf.get("spark.sql.shuffle.partitions"))), []
    for i in range(times):
        rows = classes.select("cls", "feats").mapInArrow(sign_share((i, times)), "grp long, i int, j int, cls long, size int, rest int, sketch binary")
        found.append(written(by_group(rows, connect, "leader long, member long").distinct(), f"{path}/star-{i}"))
    star = functools.reduce(DataFrame.unionByName, found).distinct()
    star = written(star, f"{path}/star")
    levels.destroy()
    shared.destroy()
    return star.unionByName(star.select("leader", F.col("leader").alias("member")).distinct())


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose first column is among ids (one column, of monotonically_increasing_id), without a shuffle of rows: a bit for each row is broadcast."""
    spark, schema = rows.sparkSession, rows.schema

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            x = batch.column(0).to_numpy()
            for part in np.unique(x >> 33).tolist():
                held.setdefault(part, []).append(x[x >> 33 == part] & ((1 << 33) - 1))
        for part, places in held.items():
            bits = np.zeros(max(int(p.max()) for p in places) + 1, bool)
            for p in places:
                bits[p] = True
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

    one = ids.select(F.col(ids.columns[0]).alias("id"))
    drawn = one.repartition(F.shiftright("id", 33)).mapInArrow(draw, "part int, bits binary").collect()
    known = spark.sparkContext.broadcast({r.part: bytes(r.bits) for r in drawn})

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            found = np.zeros(len(x), bool)
            for part in np.unique(x >> 33).tolist():
                bits = np.frombuffer(known.value.get(part, b""), np.uint8)
                at = np.flatnonzero((x >> 33 == part) & ((x & ((1 << 33) - 1)) < 8 * len(bits)))
                place = x[at] & ((1 << 33) - 1)
                found[at] = bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1
            yield batch.filter(pa.array(found))

    return rows.mapInArrow(select, schema)


def compared(classes: DataFrame, threshold: float, path: str) -> DataFrame:
    """a, b, links: for a class with partners (b null) the documents of other classes that it joins with, in parts that add up; and (a, b) that hold each connected group together."""
    star = candidates(classes, threshold, path)
    sized = star.join(star.groupBy("leader").agg(F.count("*").alias("many")), "leader")
    led = sized.groupBy("member").agg(F.array_sort(F.collect_set(F.struct("leader", "many"))).alias("led"))
    led = led.join(among(classes.select(F.col("cls").alias("member"), "n", "feats"), star.select("member")), "member")
    each = led.select("member", "n", "feats", F.col("led.leader").alias("leaders"), F.explode("led").alias("l"))
    each = each.select("member", "n", "feats", "leaders", F.explode(blocks_of(F.col("l.leader"), F.col("member"), F.col("l.many"))).alias("g"), grouping.own_block(F.col("member"), F.col("l.many")).alias("block"))
    rows = each.select("g.grp", "g.i", "g.j", "member", "n", "feats", "leaders", "block")

    def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        member, weight, block = (batch.column(c).to_numpy() for c in (3, 4, 7))
        grp, bi, bj = (batch.column(c).to_numpy() for c in (0, 1, 2))
        feats = lists_of(batch.column(5))
        known = batch.column(6).to_pylist()
        at, a, b, n = 0, [], [], []
        for m in group_lengths(batch).tolist():
            if m > 1:
                x, y, _ = similar_pairs(feats[at : at + m], threshold)
                if bi[at] != bj[at]:
                    across = block[at + x] != block[at + y]
                    x, y = x[across], y[across]
                # two classes may share several leaders: they count under the first one
                several = np.fromiter((len(k) > 1 for k in known[at : at + m]), bool, m)
                mine = ~(several[x] & several[y])
                for e in np.flatnonzero(~mine).tolist():
                    mine[e] = min(set(known[at + x[e]]) & set(known[at + y[e]])) == grp[at]
                x, y = x[mine], y[mine]
                links = np.bincount(x, weight[at + y], m) + np.bincount(y, weight[at + x], m)
                some = np.flatnonzero(links)
                a += member[at + some].tolist()
                b += [None] * len(some)
                n += links[some].astype(np.int64).tolist()
                p, q = spanning(m, x, y)
                a += member[at + p].tolist()
                b += member[at + q].tolist()
                n += [None] * len(p)
            at += m
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "links"])

    return written(by_group(rows, verify, "a long, b long, links long"), f"{path}/found")


#: Over documents, for n = 1.
JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS g FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, list(g ORDER BY g) AS k FROM w GROUP BY doc_id, text)),
c AS (SELECT k, min(doc_id) AS rep, count(*) AS n FROM s GROUP BY k),
x AS (SELECT rep, n, len(k) AS size, unnest(k) AS g FROM c),
half AS (SELECT a.rep AS a, b.rep AS b, a.n AS n_a, b.n AS n_b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n, a.size, b.size HAVING count(*) >= (0.85 - 1e-6) * (a.size + b.size - count(*))),
edges AS (SELECT a, b, n_b AS n FROM half UNION ALL SELECT b, a, n_a FROM half),
reached AS (SELECT rep, rep AS other FROM c UNION SELECT r.rep, e.b FROM reached r JOIN edges e ON e.a = r.other),
least AS (SELECT rep, min(other) AS class_id FROM reached GROUP BY rep),
linked AS (SELECT a AS rep, sum(n) AS links FROM edges GROUP BY a)
SELECT s.doc_id, class_id, (n - 1)::BIGINT AS n_copies, (n - 1 + coalesce(links, 0))::BIGINT AS n_links FROM s JOIN c USING (k) JOIN least USING (rep) LEFT JOIN linked USING (rep)
"""


def jaccard_join(docs: DataFrame, threshold: float = 0.85, n: int = 1) -> DataFrame:
    """doc_id, class_id, n_copies, n_links: a row for each document.

    n_links counts all other documents whose n-gram sets reach the threshold, of which n_copies
    have the very same set. class_id is the smallest doc_id of those that links connect with it,
    directly or through others; its own where there is no link.

    Null ids, null texts and texts without words give no row. Rows that repeat a doc_id with the
    same set count once; one doc_id with two sets counts as two documents, with a row each. Ties at
    the threshold join. Extra columns are ignored. An empty table gives no rows.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must lie in [0.5, 1]")
    spark = docs.sparkSession
    path, kept = folder(spark, "join"), folder(spark, "joined")
    keys = [F.xxhash64("feats").alias("k1"), F.xxhash64(F.lit(1), "feats").alias("k2")]
    with dropping_shuffles(spark):
        members, classes = classes_of(feature_sets(docs, n).select("doc_id", *keys, "feats"), path)
        found = compared(classes, threshold, path)
        rows = written(one_row_each(members, classes, found, path), kept)
        remove(spark, path)
    return rows


def keep_one(docs: DataFrame, threshold: float = 0.85, n: int = 1) -> DataFrame:
    """The rows of docs but those of documents with a smaller doc_id in their group, all columns as they were.

    Rows that repeat a doc_id and its text become one; rows without doc_id, text or words stay. Of
    one doc_id with two texts both stay or go.
    """
    flat, where = positional(docs)
    doc_id, text = F.col(where["doc_id"]), F.col(where["text"])
    gone = jaccard_join(docs, threshold, n).filter("doc_id <> class_id").select(F.col("doc_id").alias("_id")).distinct()
    repeated = checkpoint(flat.filter(doc_id.isNotNull()).groupBy(doc_id.cast("long").alias("_id")).count().filter("count > 1").select("_id"))
    kept = flat.join(gone, doc_id.cast("long") == F.col("_id"), "left_anti")
    if not repeated.isEmpty():
        again = doc_id.cast("long") == F.col("_id")
        once = kept.join(repeated, again, "left_semi")
        once = once.filter(text.isNull()).unionByName(once.filter(text.isNotNull()).dropDuplicates([where["doc_id"], where["text"]]))
        kept = kept.join(repeated, again, "left_anti").unionByName(once)
    return kept.toDF(*docs.columns)
