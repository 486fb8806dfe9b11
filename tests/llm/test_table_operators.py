import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import chat, embedding_dedup, grouping, jaccard_join, mixing, packing, sharding


def brute_pack(lengths, capacity):
    rows, rooms = 0, []
    rest = []
    for n in lengths:
        rows += n // capacity
        rooms += [0] * (n // capacity)
        rest.append(n % capacity)
    for n in sorted((n for n in rest if n), reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60))
    lengths = rng.integers(0, 150, rng.integers(0, 80))
    rows = packing.best_fit(lengths, capacity)
    used = np.bincount(rows[:, 3], weights=rows[:, 2]).astype(int) if len(rows) else np.array([], int)
    assert sorted((capacity - used).tolist()) == brute_pack(lengths.tolist(), capacity)
    for i, n in enumerate(lengths):
        mine = sorted(rows[rows[:, 0] == i][:, 1:3].tolist())
        assert sum(b for _, b in mine) == n and all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:]))


def test_pack(awkward):
    rows = packing.pack(awkward, capacity=1000, shard_tokens=100_000).collect()
    by = {}
    for r in rows:
        by.setdefault((r.shard, r.window), []).append(r)
    assert all(sum(x.length for x in w) + w[0].room == 1000 and sorted(x.place for x in w) == [*range(len(w))] for w in by.values())
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * 22 and sum(r.length for r in rows if r.doc_id == 4) == 120_000
    assert not {r.doc_id for r in rows} & {2, 3} and sum(r.length for r in rows if r.doc_id is None) == 20
    assert packing.pack(awkward.limit(0)).count() == 0


def test_exponent():
    shares = [0.7, 0.2, 0.1]
    a = mixing.exponent_for(shares, target_entropy=1.0)
    assert mixing.entropy(mixing.tempered(shares, a)) == pytest.approx(1.0, abs=1e-9)
    b = mixing.exponent_for(shares, max_repeats=1.5)
    assert max(mixing.repeats(shares, mixing.tempered(shares, b), True)) == pytest.approx(1.5, abs=1e-9)
    assert mixing.exponent_for(shares, target_entropy=5) == 0 and mixing.exponent_for(shares, target_entropy=0.1) == 1
    assert mixing.exponent_for(shares, max_repeats=0.5) == 1 and mixing.exponent_for(shares, max_repeats=100) == 0
    with pytest.raises(ValueError):
        mixing.exponent_for(shares)


@pytest.mark.parametrize("keep_all", [True, False])
def test_mix_meets_budgets(spark, tables, keep_all):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 4 > 0, "big").otherwise(F.col("source")))
    rows = mixing.mix(docs, max_repeats=1.4, keep_all=keep_all, block_tokens=20_000).collect()
    sizes, given, largest = {}, {}, {}
    for r in docs.select("source", F.octet_length("text").alias("n")).collect():
        sizes[r.source] = sizes.get(r.source, 0) + r.n
        largest[r.source] = max(largest.get(r.source, 0), r.n)
    for r in rows:
        given[r.source] = given.get(r.source, 0) + r.tokens
    plans = mixing.plan(sizes, None, 1.4, keep_all, 20_000)
    for p in plans:
        want = p.passes * sizes[p.source] + p.rest
        assert want - largest[p.source] < given.get(p.source, 0) <= want
    seen = {(r.doc_id, r["pass"]) for r in rows}
    assert len(seen) == len(rows)
    if keep_all:
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_mix_by_brute_force(spark, monkeypatch):
    """Budgets from shares and exponent anew; passes read block by block, the last one a beginning of its order."""
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 5)
    rows = [(i, f"text {i} " * (1 + i % 7), "abc"[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = mixing.mixed(docs, max_repeats=2.6, seed=3)
    got = placed.select(F.col("c0").alias("doc_id"), "_source", "_tokens", "pass", "position").collect()
    size = {i: len(t.encode()) for i, t, _ in rows}
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in "abc"}
    share = {s: n / sum(total.values()) for s, n in total.items()}
    lo, hi = 0.0, 1.0
    for _ in range(80):  # the rate of the smallest source against the largest is (p_large / p_small) ^ (1 - a)
        a = (lo + hi) / 2
        lo, hi = (a, hi) if (share["a"] / share["c"]) ** (1 - a) > 2.6 else (lo, a)
    keys = {r["c0"]: r for r in mixing._keyed(docs, 3)[0].select("c0", "_key").collect()}
    for s in "abc":
        rate = (share["a"] / share[s]) ** (1 - hi)
        mine = [r for r in got if r._source == s]
        budget = int(rate * total[s] + 1e-6)
        given = sum(r._tokens for r in mine)
        assert budget - max(size.values()) < given <= budget
        block = lambda r: keys[r.doc_id]["_key"] % 5  # noqa: E731, B023
        orders = []
        for turn in range(int(rate + 1e-9) + 1):
            read = sorted((r for r in mine if r["pass"] == turn), key=lambda r: r.position)
            if turn < int(rate + 1e-9):
                assert sorted(r.doc_id for r in read) == sorted(i for i, _, x in rows if x == s)
            seen = list(dict.fromkeys(map(block, read)))
            assert len(seen) == 1 + sum(block(p) != block(q) for p, q in zip(read, read[1:])) if read else not seen
            assert all(turn <= r.position * rate < turn + 1 for r in read)
            orders.append(seen)
            if read and turn == int(rate + 1e-9):  # whole blocks, but for the last one
                for b in seen[:-1]:
                    assert {r.doc_id for r in read if block(r) == b} == {i for i, _, x in rows if x == s and keys[i]["_key"] % 5 == b}
        assert sorted(orders[0]) == [*range(5)]


def test_mix_of_awkward_rows(awkward):
    rows = mixing.mix(awkward, max_repeats=3, block_tokens=1000).collect()
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    again = mixing.remix(awkward, max_repeats=3, block_tokens=1000)
    assert again.columns == awkward.columns and again.count() == len(rows)
    assert mixing.remix(awkward.limit(0), max_repeats=2).count() == 0 and mixing.mix(awkward.limit(0), target_entropy=1.0).count() == 0


def test_splitters():
    assert sharding.splitters([], 4) == [] and sharding.splitters(list("aabbccdd"), 1) == []
    bounds = sharding.splitters(["a"] + ["hot"] * 50 + ["z"], 8)
    assert bounds == ["a", "hot"]


def test_shard(spark, tables):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 > 0, "src7").otherwise(F.col("source")))
    target = 100_000
    out = sharding.shard(docs, target_tokens=target)
    rows = out.select("doc_id", "source", "shard", F.octet_length("text").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect()) and out.columns == [*docs.columns, "shard"]
    sizes, keys = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n + 1
        keys.setdefault(r.source, set()).add(r.shard)
    assert sorted(sizes) == [*range(max(sizes) + 1)] and max(sizes.values()) < 1.2 * target + 60_000 and len(keys["src7"]) >= 10
    order = sorted(keys)
    assert all(max(keys[a]) <= max(keys[b]) and min(keys[a]) <= min(keys[b]) for a, b in zip(order, order[1:]))
    assert len({(r.shard, r.p) for r in rows}) == len(sizes)


def test_few_ranges_for_many_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLE", 256)
    monkeypatch.setattr(sharding, "MOST_TASKS", 7)
    rows = [(i, f"k{i % 97:02}", "x" * (50 + i % 40)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sharding.shard(docs, target_tokens=4000).select("doc_id", "source", "shard", F.octet_length("text").alias("n"), F.spark_partition_id().alias("p")).collect()
    sizes, low, high = {}, {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n + 1
        low[r.source], high[r.source] = min(low.get(r.source, r.shard), r.shard), max(high.get(r.source, r.shard), r.shard)
    assert sorted(r.doc_id for r in got) == [*range(3000)] and sorted(sizes) == [*range(len(sizes))] and len(sizes) >= 50
    assert max(sizes.values()) < 2 * 4000 and len({r.p for r in got}) <= 7
    # keys of one range share its shards, and ranges follow each other
    order = sorted(low)
    assert all(low[a] <= high[b] for i, a in enumerate(order) for b in order[i:]) and high[order[0]] < low[order[-1]]
    of = {r.shard: r.p for r in got}
    assert all(of[a] <= of[a + 1] for a in range(len(of) - 1)) and len({(r.shard, r.p) for r in got}) == len(of)


def test_ranges_by_brute_force(spark):
    bounds = ["b", "d", "é", "中"]
    keys = ["", "a", "b", "c", "d", "da", "e", "z", "é", "éa", "中", "中文", "🙂"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", sharding.range_of(spark, bounds)(F.col("k")).alias("r")).collect()
    assert {r.k: r.r for r in got} == {k: sum(b.encode() < k.encode() for b in bounds) for k in keys}


def test_shard_of_awkward_rows(awkward):
    out = sharding.shard(awkward, target_tokens=50_000)
    assert out.count() == 10 and out.columns == [*awkward.columns, "shard_"]
    assert sharding.shard(awkward.limit(0)).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_join(rows, threshold, n):
    """doc_id, class_id, n_copies, n_links by comparing every document with every other."""
    docs = sorted({(i, frozenset(jaccard_join.shingles(t, n))) for i, t in rows if i is not None and jaccard_join.shingles(t, n)}, key=lambda d: d[0])
    links = [[y for y, (_, t) in enumerate(docs) if y != x and jaccard(s, t) >= threshold - 1e-9] for x, (_, s) in enumerate(docs)]
    least = list(range(len(docs)))
    while True:
        now = [min([least[x], *(least[y] for y in links[x])]) for x in range(len(docs))]
        if now == least:
            break
        least = now
    return sorted((i, docs[least[x]][0], sum(docs[y][1] == s for y in links[x]), len(links[x])) for x, (i, s) in enumerate(docs))


@pytest.mark.parametrize("threshold,n,block", [(0.85, 1, 2048), (0.6, 2, 4), (0.5, 1, 2048), (0.7, 1, 3), (1.0, 1, 2048)])
def test_join_is_exact(spark, monkeypatch, threshold, n, block):
    monkeypatch.setattr(grouping, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LONG", 3 if n == 1 else 32)
    rng = np.random.default_rng(int(threshold * 100) + n)
    rows, base = [], []
    for i in range(160):
        if i % 8 == 0 or not base:
            base = [f"w{k}" for k in rng.integers(0, 400, rng.integers(1, 60))]
        words = [w if rng.random() > 0.05 else f"v{rng.integers(9)}" for w in base]
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 60, 3)] + [(3, rows[20][1]), (3, rows[3][1]), (7, rows[6][1])]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), threshold, n)
    assert sorted(tuple(r) for r in got.collect()) == brute_join(rows, threshold, n)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 1.0])
def test_signatures_and_sketches_lose_no_pair(threshold):
    rng = np.random.default_rng(11)
    sets, pairs = [], []
    for _ in range(300):
        a = rng.choice(1 << 32, int(rng.integers(1, 120)), replace=False).astype(np.uint32)
        drop = int(rng.integers(0, len(a) + 1) * rng.random() ** 3)
        b = np.unique(np.r_[a[drop:], rng.integers(0, 1 << 32, int(rng.integers(0, 30) * rng.random() ** 2)).astype(np.uint32)])
        sets += [np.unique(a), b]
    where = {}
    for i in range(3):
        sig, who = jaccard_join.signatures(sets, threshold, (i, 3))
        for s, w in zip(sig.tolist(), who.tolist()):
            where.setdefault(w, set()).add(s)
    whole = {}
    for s, w in zip(*(x.tolist() for x in jaccard_join.signatures(sets, threshold))):
        whole.setdefault(w, set()).add(s)
    assert whole == where
    for x in range(0, len(sets), 2):
        if len(sets[x + 1]) and jaccard(set(sets[x].tolist()), set(sets[x + 1].tolist())) >= threshold:
            pairs.append(x)
            sk = [jaccard_join.sketch(s) for s in sets[x : x + 2]]
            label = jaccard_join.possible(np.concatenate(sk), np.array([len(s) for s in sk]), np.array([len(s) for s in sets[x : x + 2]]), np.array([2]), threshold)
            assert where[x] & where[x + 1] and label.tolist() == [0, 0]
    assert len(pairs) > 20


def zipf_texts(n, size, seed):
    """Unrelated texts over one vocabulary of 3,000 words, some of them in nearly all texts."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, 3001) ** 0.8
    return [sorted(rng.choice(3000, size, replace=False, p=share / share.sum()).tolist()) for _ in range(n)]


def test_unrelated_sets_hardly_meet():
    """A signature for each member of the prefix at most, and fewer than half of the pairs in the runs of signatures."""
    sets = [jaccard_join.hash_shingles([f"w{k}" for k in t]) for t in zipf_texts(400, 100, 5)]
    sig, who = jaccard_join.signatures(sets, 0.7)
    assert len(sig) <= 31 * len(sets) and set(who.tolist()) == set(range(400))
    levels = np.zeros(jaccard_join.BUCKETS, np.uint8)
    at, n = np.unique(jaccard_join.buckets(np.concatenate(sets)), return_counts=True)
    levels[at] = np.round(8 * np.log2(n))
    feats, who, rest = jaccard_join.prefixes(sets, 0.7, levels)
    order = np.argsort(feats, kind="stable")
    lengths = np.unique(feats, return_counts=True)[1]
    part = 0.7 / 1.7
    pairs = sum(len(i) for i, _ in jaccard_join.fitting(np.full(len(feats), part * 100), rest[order] - part * 100, lengths))
    assert pairs < 0.5 * (lengths * (lengths - 1) // 2).sum()


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_first_shared_member_fits(threshold):
    """Whatever the order of the members, two similar sets fit each other in the run of the first one that they share."""
    rng = np.random.default_rng(23)
    levels, tried = rng.integers(0, 4, jaccard_join.BUCKETS).astype(np.uint8), 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 32, int(rng.integers(1, 90)), dtype=np.uint64)).astype(np.uint32)
        b = np.unique(np.r_[a[int(rng.integers(0, len(a) + 1) * rng.random() ** 3) :], rng.integers(0, 1 << 32, int(rng.integers(1, 30) * rng.random() ** 2), dtype=np.uint64).astype(np.uint32)])
        if not len(b) or jaccard(set(a.tolist()), set(b.tolist())) < threshold:
            continue
        tried += 1
        feats, who, rest = jaccard_join.prefixes([a, b], threshold, levels)
        common = sorted(set(feats[who == 0].tolist()) & set(feats[who == 1].tolist()))
        size, sk = np.array([len(a), len(b)]), [jaccard_join.sketch(a), jaccard_join.sketch(b)]
        found = [jaccard_join.possible(np.concatenate(sk), np.array([len(x) for x in sk]), size, np.array([2]), threshold, np.array([rest[(who == w) & (feats == c)][0] for w in (0, 1)])).tolist() for c in common]
        assert [0, 0] in found
    assert tried > 20


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 1.0])
@pytest.mark.parametrize("drawn", [1 << 8, 1 << 13, 1 << 26])
def test_tails_by_brute_force(monkeypatch, threshold, drawn):
    """Each sketch is that of the members from the signature on, however many are drawn at a time."""
    monkeypatch.setattr(jaccard_join, "DRAWN", drawn)
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32)) for n in (1, 2, 40, 41, 300, 2000, 5, 299)]
    levels = rng.integers(0, 3, jaccard_join.BUCKETS).astype(np.uint8)
    feats, who, rest = jaccard_join.prefixes(sets, threshold, levels)
    mine, seen = rng.random(len(feats)) < 0.6, []
    for at, rows in jaccard_join.tails(sets, feats, who, rest, mine, threshold):
        for p, row in zip(at.tolist(), rows):
            s = sets[who[p]]
            tail = s[np.lexsort((s, levels[jaccard_join.buckets(s)]))][len(s) - rest[p] :]
            assert tail[0] == feats[p] and jaccard_join.sketches_of([tail], np.array([64 * len(row)]))[0] == row.tobytes()
            seen.append(p)
    assert sorted(seen) == np.flatnonzero(mine).tolist()


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85])
def test_tails_lose_no_pair(threshold):
    """Sets at the threshold meet at the first member that both hold; few unrelated ones do."""
    rng = np.random.default_rng(int(100 * threshold))
    levels, near, far = rng.integers(0, 4, jaccard_join.BUCKETS).astype(np.uint8), 0, []
    for trial in range(300):
        size, away = int(rng.integers(3, 600)), trial % 3 == 2
        base = np.unique(rng.integers(0, 1 << 32, 2 * size, dtype=np.uint32))
        share = 0.3 if away else rng.uniform(threshold, 1)
        k = math.ceil(size * 2 * share / (1 + share))
        a = base[rng.permutation(len(base))[:size]]
        other = np.setdiff1d(base, a)
        b = np.concatenate([rng.permutation(a)[:k], other[: size - k]])
        both = len(np.intersect1d(a, b))
        jac = both / (len(a) + len(b) - both)
        feats, who, rest = jaccard_join.prefixes([a, b], threshold, levels)
        drawn, common = {}, set(feats[who == 0].tolist()) & set(feats[who == 1].tolist())
        for at, rows in jaccard_join.tails([a, b], feats, who, rest, np.ones(len(feats), bool), threshold):
            drawn |= dict(zip(at.tolist(), rows))
        met = False
        for c in common:
            x, y = (int(np.flatnonzero((who == w) & (feats == c))[0]) for w in (0, 1))
            sk = [drawn[x], drawn[y]]
            met |= jaccard_join.possible(np.concatenate(sk), np.array([len(v) for v in sk]), np.array([len(a), len(b)]), np.array([2]), threshold, rest[[x, y]], tail=True).tolist() == [0, 0]
        if jac >= threshold:
            near += 1
            assert met
        elif away and size > 100:
            far.append(met)
    assert near > 150 and (threshold < 0.7 or np.mean(far) < 0.05)


@pytest.mark.parametrize("threshold, most", [(0.7, 56), (0.85, 28)])
def test_signatures_carry_few_bytes(spark, monkeypatch, threshold, most):
    """Sets of about 400 words sent 128 bytes with each signature when it had a sketch of the whole set."""
    rng, sent, sorting = np.random.default_rng(5), [], jaccard_join.by_group

    def by_group(rows, work, schema):
        if "sketch" in rows.columns:
            sent.append(rows.agg(F.sum(F.length("sketch")), F.count("*")).first())
        return sorting(rows, work, schema)

    monkeypatch.setattr(jaccard_join, "by_group", by_group)
    rows = [(i, " ".join(f"w{k}" for k in rng.choice(2000, 400, replace=False))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(9)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), threshold, 1)
    assert sorted(tuple(r) for r in got.collect()) == brute_join(rows, threshold, 1)
    assert sum(b for b, _ in sent) / sum(n for _, n in sent) < most


def test_among(spark):
    rows = spark.range(1000, numPartitions=7).select(F.monotonically_increasing_id().alias("cls"), F.col("id").alias("x")).localCheckpoint()
    some = rows.filter("x % 3 = 0 and (x < 400 or x > 700)").select(F.col("cls").alias("member"))
    assert sorted(r.x for r in jaccard_join.among(rows, some.union(some)).collect()) == [x for x in range(0, 1000, 3) if x < 400 or x > 700]
    assert jaccard_join.among(rows, some.limit(0)).count() == 0


def test_long_runs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RUN", 3)
    monkeypatch.setattr(jaccard_join, "PASS_BYTES", 100)
    texts = zipf_texts(60, 12, 9)
    rows = [(i, " ".join(f"w{k}" for k in t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(f"w{k}" for k in [*t[:-1], 5000])) for i, t in enumerate(texts)]
    rows += [(300 + i, f"once upon a time there was a {i}") for i in range(20)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 0.7, 1)
    assert sorted(tuple(r) for r in got.collect()) == brute_join(rows, 0.7, 1)


def test_neighbours():
    for lengths in ([1], [3, 1, 4], [2, 2, 900]):
        runs = np.repeat(np.arange(len(lengths)), lengths)
        want = {(i, j) for i in range(len(runs)) for j in range(i + 1, len(runs)) if runs[i] == runs[j]}
        parts = list(jaccard_join.neighbours(np.array(lengths)))
        got = [(i, j) for a, b in parts for i, j in zip(a.tolist(), b.tolist())]
        assert len(got) == len(want) and set(got) == want


def test_keep_one_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = {i for i, least, *_ in brute_join([(r.doc_id, r.text) for r in docs.collect()], 0.85, 1) if i == least}
    kept = jaccard_join.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns


def test_join_of_awkward_rows(awkward):
    assert {tuple(r) for r in jaccard_join.jaccard_join(awkward, 0.85).collect()} == {(1, 1, 1, 1), (6, 1, 1, 1), (4, 4, 1, 1), (5, 4, 1, 1), (8, 8, 0, 0)}
    kept = jaccard_join.keep_one(awkward)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8] and kept.columns == awkward.columns
    assert jaccard_join.jaccard_join(awkward.limit(0)).count() == 0 and jaccard_join.keep_one(awkward.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.jaccard_join(awkward, 0.4)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101)]
    edges = spark.createDataFrame([(b, a) for a, b in chain], "doc_a long, doc_b long")
    got = {r.doc_id: r.group_id for r in grouping.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_near(rows, threshold):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold - 1e-7
    np.fill_diagonal(near, False)
    return ids, near


@pytest.mark.parametrize("dim,block", [(64, 2048), (48, 40)])
def test_planted_embeddings(spark, monkeypatch, dim, block):
    """Near copies in random directions, and displaced towards other vectors, which other lists are likelier to hold."""
    monkeypatch.setattr(grouping, "BLOCK", block)
    rng = np.random.default_rng(dim)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((1500, dim)))
    angle = np.arccos(0.952) * rng.random(900)[:, None] ** 0.3
    noise, towards = unit(rng.standard_normal((450, dim))), unit(base[rng.integers(0, 1500, 450)] + base[rng.integers(0, 1500, 450)])
    way = np.r_[noise, towards]
    own = base[:900]
    way = unit(way - (way * own).sum(1, keepdims=True) * own + 1e-9)
    near = own * np.cos(angle) + way * np.sin(angle)
    crowd = unit(base[1000] + 0.02 * rng.standard_normal((120, dim)))
    rows = [(i, v.tolist()) for i, v in enumerate(np.r_[base, near, crowd, 3 * base[1200:1220]])]
    ids, real = brute_near(rows, 0.95)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(r.vec_id for r in got) == ids
    links = np.zeros(len(ids), int)
    links[[r.vec_id for r in got]] = [r.n_links for r in got]
    want = real.sum(1)
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum()
    plain = [i for i in range(900) if want[i]]
    assert len(plain) > 850 and np.mean([links[i] > 0 for i in plain]) >= 0.95
    same = {r.vec_id: r.class_id for r in got}
    assert np.mean([same[i] == same[1500 + i] for i in plain]) >= 0.95 and len({same[i] for i in range(2400, 2520)}) == 1
    assert all(same[i] in np.flatnonzero(real[i]) or same[i] == i or want[i] > 1 for i in ids)
    assert all(r.n_copies == 1 for r in got if r.vec_id >= 2520)


def test_awkward_embeddings(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (1, v, 0), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, None, 0), (5, [], 0), (6, [0.0] * 3, 0), (7, [math.nan, 1.0, 1.0], 0), (8, [None, 1.0, 1.0], 0), (None, v, 0), (9, [1.0, 2.0], 0), (10, [-1.0, -2.0, -3.0], 0), (11, [1.0, 2.0, 3.01], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, VEC_A int")
    got = {tuple(r) for r in embedding_dedup.near_duplicates(df, 0.95).collect()}
    assert got == {(1, 1, 2, 3), (2, 1, 2, 3), (3, 1, 2, 3), (11, 1, 0, 3), (10, 10, 0, 0), (9, 9, 0, 0)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_codes_bound_distances():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((50, 10)).astype("f4"), rng.standard_normal((5, 10)).astype("f4")
    words = [x[:16, s] for s in embedding_dedup.parts(10)]
    codes, missed = embedding_dedup.encode(x, words)
    tables = embedding_dedup.lookups(q, words)
    d = np.sqrt(np.maximum(0, sum(t[:, codes[:, i]] for i, t in enumerate(tables))))
    real = np.linalg.norm(q[:, None] - x[None], axis=2)
    assert (np.abs(d - real) <= missed[None] + 1e-3).all()


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "first"), (3, 0, "user", "alone"), (None, 0, "assistant", "x"), (4, None, None, "?"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")]
    got = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "turn", "n_context").collect()
    assert [(r.conv_id, r.turn, r.n_context) for r in got] == [(1, 1, 1), (1, 3, 3), (2, 0, 0), (4, 1, 1), (4, 1, 2)]
    assert got[1].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\n<|end|>\n<|assistant|>\n" and got[1].target == "<|end|>\n"
    assert all((r.prompt + r.target)[r.train_start : r.train_end] == r.target for r in got)
    assert chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_jaccard_join", "mixing", "packing"]
    rows = corpus_pipeline.run(spark, tables).collect()
    kept = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.keep_known_languages(spark, corpus_pipeline.drop_toxic(spark, docs, tables), tables), tables)
    sizes = {r.doc_id: r.n for r in kept.select("doc_id", F.octet_length("text").alias("n")).collect()}
    packed = {}
    for r in rows:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed.keys() == sizes.keys() and all(packed[i] % n == 0 and 1 <= packed[i] // n <= 2 for i, n in sizes.items())


def test_pipeline_drops_copies_with_an_added_line(spark):
    import corpus_pipeline

    text = [f"w{i}" for i in range(40)]
    edited = ["here", "is", "one", "more", "line", "first", *text[:20], "changed", *text[21:]]
    other = [f"w{i}" for i in range(20)] + [f"v{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(edited)), (3, " ".join(other))], "doc_id long, text string")
    assert 0.8 < jaccard(set(text), set(edited)) < 0.85
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
