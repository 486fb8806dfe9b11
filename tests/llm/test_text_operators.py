import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import fingerprints, language_id, quality, toxicity

WORDS = "loser idiot pathetic scum worthless moron clown trash".split()


@pytest.fixture(scope="module")
def net():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(w, k=60)) for w in (["the", "of", "thing"], ["der", "und", "ißt"]) for _ in range(20)]
    return language_id.train(texts, ["en"] * 20 + ["de"] * 20, steps=250)


def test_language_gradient():
    net = language_id.fresh(3, ["a", "b"], 1)
    for k, p in zip(("table", "recur", "bias", "out", "out_bias"), net.params()):
        setattr(net, k, p.astype(np.float64))
    rng = np.random.default_rng(2)
    x, y = rng.integers(97, 101, (7, 4)), np.array([0, 1, 0, 1])
    w = np.ones((7, 4))
    _, grads = language_id.gradients(net, x, y, w)
    for p, g in zip(net.params(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = p[i], []
        for e in (1e-3, -1e-3):
            p[i] = old + e
            losses.append(language_id.gradients(net, x, y, w)[0])
        p[i] = old
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[i], rel=0.05, abs=1e-4)


def test_language(spark, awkward, net):
    assert net.languages == ["de", "en"]
    got = [r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, "the thing of " * 10), (2, "und der ißt " * 10)], "doc_id long, text string"), net).orderBy("doc_id").collect()]
    assert got == ["en", "de"]
    rows = language_id.identify(awkward, net).collect()
    assert len(rows) == 10 and {r.doc_id for r in rows if r.lang_pred is None} == {2, 3}
    assert all(sum(r.votes) == r.n_bytes for r in rows)
    assert {r.doc_id for r in language_id.filter_by_language(awkward, 0.0, net).collect()} == {1, None, 4, 5, 6, 7, 8}
    assert language_id.filter_by_language(awkward, 0.0, net).columns == awkward.columns
    assert language_id.identify(awkward.limit(0), net).count() == 0
    assert language_id.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred is not null").count() == 0
    spans = language_id.label_positions(awkward, net).filter("doc_id = 4").orderBy("start").collect()
    assert spans[0].start == 0 and spans[-1].end == 120000 and all(a.end == b.start for a, b in zip(spans, spans[1:]))


def plain_labels(net, text):
    """Probabilities of every byte by a loop over windows, directions and bytes."""
    raw, out = list(text.encode()), []
    for core in range(0, len(raw), language_id.CORE):
        symbols = [raw[i] if 0 <= i < len(raw) else language_id.EDGE for i in range(core - language_id.CONTEXT, core + language_id.CORE + language_id.CONTEXT)]
        both, n = [], net.hidden
        for d in range(2):
            h, states = np.zeros(n), []
            for c in symbols if d == 0 else symbols[::-1]:
                gin, rec = net.table[d][:, c].astype(float), net.recur[d].astype(float) @ h
                z, r = (1 / (1 + np.exp(-2 * (gin + rec)[i * n : (i + 1) * n])) for i in range(2))
                h = z * h + (1 - z) * np.tanh(gin[2 * n :] + r * (rec[2 * n :] + net.bias[d][:, 0]))
                states.append(h)
            both.append(states if d == 0 else states[::-1])
        for i in range(language_id.CONTEXT, language_id.CONTEXT + min(language_id.CORE, len(raw) - core)):
            logit = net.out.astype(float) @ np.r_[both[0][i], both[1][i]] + net.out_bias[:, 0]
            e = np.exp(logit - logit.max())
            out.append(e / e.sum())
    return np.array(out)


def test_labels_by_brute_force(net):
    texts = ["the thing of " * 25, None, "", "und der ißt " * 3 + "the thing of " * 12, "x", "of the"]
    pooled, votes, sizes, labels = language_id.label_batch(net, texts)
    for i, t in enumerate(texts):
        if not t:
            assert sizes[i] == 0 and not pooled[i].any() and not len(labels[i])
            continue
        p = plain_labels(net, t)
        sure = np.abs(p[:, 0] - p[:, 1]) > 1e-4
        assert len(p) == sizes[i] == len(labels[i]) and (labels[i] == p.argmax(1))[sure].all()
        assert np.allclose(pooled[i], p.mean(0), atol=1e-5) and abs(votes[i] - np.bincount(p.argmax(1), minlength=2)).max() <= (~sure).sum()


def test_windows_do_not_change_labels(net, monkeypatch):
    """The same text alone, among others, and with blocks of few windows."""
    text, others = "the thing of und der " * 40, ["of", "der ißt " * 90, None, "thing " * 33]
    alone = language_id.label_batch(net, [text])
    among = language_id.label_batch(net, [*others, text, *others])
    monkeypatch.setattr(language_id, "BLOCK", 3)
    small = language_id.label_batch(net, [*others[::-1], text])
    for got in ([x[4] for x in among], [x[4] for x in small]):
        assert np.allclose(got[0], alone[0][0], atol=1e-5) and got[1].tolist() == alone[1][0].tolist() and (got[3] == alone[3][0]).all()


def test_spans_are_returned(spark, net):
    rows = language_id.identify(spark.createDataFrame([(1, "und der ißt " * 30 + "the thing of " * 30), (2, None)], "doc_id long, text string"), net).orderBy("doc_id").collect()
    assert rows[0].span_ends[-1] == rows[0].n_bytes and len(rows[0].span_ends) == len(rows[0].span_langs) == rows[0].n_spans and set(rows[0].span_langs) == {"de", "en"}
    assert rows[1].span_ends == [] and rows[1].n_spans == 0


def test_held_out_language(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    net = language_id.fit(docs.filter("doc_id % 2 = 0"), steps=150)
    got = language_id.identify(docs.filter("doc_id % 2 = 1"), net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.93


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    base = "the cat sat on mat and then went home with other animals after dinner".split()
    toxic, clean = [], []
    for i in range(240):
        own = ["".join(rng.choices("aeiou" "bdfgkmnprstv", k=9)) for _ in range(12)]
        words = rng.choices(base, k=30) + own
        clean.append(" ".join(words))
        toxic.append(" ".join([*words, rng.choice(WORDS), rng.choice(WORDS)]))
    counts = np.zeros((64, 64, 64))
    for t in toxic:
        k = [0, 0, *(toxicity.CLASS.get(c, 0) for c in t), 0]
        for a, b, c in zip(k, k[1:], k[2:]):
            counts[a, b, c] += 1
    return toxicity.Model(toxicity.learn(toxic, clean), toxicity.log_probabilities(counts))


def test_rules_are_the_words(model):
    assert {r.rstrip("$") for r in model.rules} == {toxicity.squeeze(w) for w in WORDS}


def test_disguises(model):
    back = {}
    for c, letters in toxicity.LOOKALIKES.items():
        for x in letters:
            back.setdefault(x, []).append(c)
    rng = random.Random(9)
    ways = [
        lambda w: "".join(rng.choice(back[c]) if c in back and rng.random() < 0.5 else c for c in w),
        lambda w: "".join(c * rng.choice([1, 2, 4]) for c in w),
        lambda w: rng.choice([" ", ".", "-", "_", "*"]).join(w),
        lambda w: rng.choice(list("|!+$@")).join(w),
        lambda w: " ".join(c * rng.choice([1, 2, 3]) for c in w),
        lambda w: "-".join(rng.choice(back[c]) if c in back and rng.random() < 0.3 else c * rng.choice([1, 2]) for c in w),
        str.upper,
    ]
    tries = [(w, way(w)) for way in ways for w in WORDS for _ in range(4)]
    hit = [any(x == toxicity.squeeze(w) for x, _ in toxicity.score_batch(model, [f"the cat {shown}, on the mat"])[0]) for w, shown in tries]
    assert np.mean(hit) >= 0.95
    harmless = ["the cat sat on the mat", "call 555-1234 or a@b.example.com", "a b c d e f", "x = $5 + 3!", "clowns loserly", None, ""]
    assert toxicity.score_batch(model, harmless) == [[]] * len(harmless)


@pytest.mark.parametrize("shown", ["l|o|s|e|r", "l+o+s+e+r", "l!o!s!e!r", "l$o$s$e$r", "l@o@s@e@r", "lo!ser", "l oo s e r", "lo ser", "mo ron", "scu m", "mo, ron"])
def test_separators(model, shown):
    word = toxicity.squeeze("".join(c for c in shown if c.isalpha()))
    assert word in {w for w, _ in toxicity.score_batch(model, [f"the cat {shown} sat"])[0]}


def test_filter_loses_nothing(model):
    """With and without it, of random tokens of the rules' letters, look-alikes and separators."""
    rng = random.Random(4)
    found = 0
    for _ in range(400):
        w = rng.choice(WORDS)
        token = "".join(rng.choice("|!+$@.-_*01x" + w) * rng.choice([0, 0, 1, 1, 2]) + c for c in w)
        rules = {model.at[k] for _, bits in model.follow(token)[1] for k in model.at if bits >> k & 1}
        for r in model.rules:
            if toxicity.decode(token, model.lm, r.rstrip("$"))[1] > -np.inf:
                assert r in rules
                found += 1
    assert found > 50


def test_huge_token(model):
    rng = random.Random(8)
    token = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    began = time.time()
    plain = model.restored(token)
    assert "loser" not in plain and time.time() - began < 60
    hidden = token[:500_000] + ".l-0-$-3-r." + token[500_000:]
    assert "loser" in model.restored(hidden) and time.time() - began < 120


def test_decoder_prefers_the_likelier_word(model):
    assert toxicity.decode("cl0wn", model.lm)[0] == "clown" and toxicity.decode("m0r0n", model.lm)[0] == "moron"


def brute(lm, text):
    import itertools
    import re

    runs = [(m.group(0)[0], len(m.group(0))) for m in re.finditer(r"(.)\1*", text)]
    best = None
    for way in itertools.product(*(toxicity.arcs(c, n) for c, n in runs)):
        s = "".join(h for h, _ in way)
        k = [0, 0, *(toxicity.CLASS.get(c, 0) for c in s), 0]
        score = sum(lm[a, b, c] for a, b, c in zip(k, k[1:], k[2:])) - sum(c for _, c in way)
        best = max(best or (score, s), (score, s))
    return best


@pytest.mark.parametrize("text", ["5tt1ll", "i.d!0t", "a11!", "$$cc|_m"])
def test_decoder_is_exact(model, text):
    score, s = brute(model.lm, text)
    assert toxicity.decode(text, model.lm)[1] == pytest.approx(score)


def test_toxicity_of_awkward_rows(spark, awkward, labels, model):
    rows = toxicity.score_toxicity(awkward, labels, model=model).collect()
    assert len(rows) == 10 and not any(r.toxic for r in rows)
    bad = spark.createDataFrame([(11, "you L O S E R", None, None, None, None, None)], awkward.schema)
    both = awkward.unionByName(bad, allowMissingColumns=False) if len(set(c.lower() for c in awkward.columns)) == len(awkward.columns) else awkward.union(bad)
    kept = toxicity.drop_toxic(both, labels, model=model)
    assert kept.count() == 10 and kept.columns == awkward.columns
    assert toxicity.score_toxicity(awkward, labels).filter("toxic").count() == 0
    assert toxicity.score_toxicity(awkward.limit(0), labels.limit(0)).count() == 0


def test_corpus_counts_are_whole(spark, awkward):
    assert toxicity.trigram_counts(awkward).sum() > 2 * 120_000


def test_quality_held_out(spark, tables):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality.classify(docs, labels, model=model).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("keep", labels.quality).collect()
    assert np.mean([r.keep == (r.quality == 1) for r in rows]) > 0.95 and model.pairs


def test_quality_tables_add_up():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 11)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.train(x, y)
    assert ((m.log_odds(x) > 0) == (y > 0)).mean() > 0.9 and (0, 1) in {(i, j) for i, j, *_ in m.pairs}
    slow = [m.bias + sum(t[np.searchsorted(c, v, side="right")] for c, t, v in zip(m.cuts, m.tables, r)) + sum(t[np.searchsorted(a, r[i], side="right"), np.searchsorted(b, r[j], side="right")] for i, j, a, b, t in m.pairs) for r in x[:20]]
    assert np.allclose(slow, m.log_odds(x[:20]))


def test_quality_of_awkward_rows(awkward, labels):
    rows = quality.classify(awkward, labels).collect()
    assert len(rows) == 10 and all(r.quality == 0 and not r.keep for r in rows if r.doc_id in (2, 3))
    assert quality.classify(awkward, labels.limit(0)).count() == 10 and quality.classify(awkward.limit(0), labels).count() == 0


def test_fingerprint_estimates_generalised_jaccard():
    rng = random.Random(4)
    for _ in range(4):
        a, b = (Counter(rng.choices("abcdefghijklmnop", k=60)) for _ in range(2))
        real = sum((a & b).values()) / sum((a | b).values())
        s = fingerprints.sign([a, b], 3000)
        assert fingerprints.estimate(s[0], s[1]) == pytest.approx(real, abs=0.05)


def test_fingerprint_by_brute_force():
    sets = [Counter("the cat the dog a".split()), Counter(), Counter("dog cat dog".split())]
    got = fingerprints.sign(sets, 8)
    for i, s in enumerate(sets):
        for j in range(8):
            if not s:
                assert got[i, j] == 0
                continue
            best = None
            for w, n in s.items():
                h = fingerprints.term_hash([w])
                r, c, b = (float(x[0]) for x in fingerprints.draws(h, j))
                t = np.floor(np.float32(np.log(np.float32(n))) / np.float32(r) + np.float32(b))
                best = min(best or (np.inf, ""), (c - r * (t - b) - r, w))
            assert got[i, j] == fingerprints.sign([Counter({best[1]: s[best[1]]})], 8)[0, j]


def test_fingerprints_of_awkward_rows(awkward):
    rows = fingerprints.fingerprint(awkward, 16).collect()
    sig = {r.doc_id: r.signature for r in rows}
    assert len(rows) == 10 and sig[4] == sig[5] and sig[2] is None and sig[3] is None and sig[7] is None
    assert sig[1] == sig[6] or sum(a == b for a, b in zip(sig[1], sig[6])) == 16
    assert fingerprints.fingerprint(awkward.limit(0)).count() == 0
