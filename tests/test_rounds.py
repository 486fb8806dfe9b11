"""Training in rounds and cutting in batches against their plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import slow_trainer
from glyphmill.operators import merging, packs, trainer
from glyphmill.operators.trainer import Config


def some_words(seed, letters, n):
    rng = random.Random(seed)
    parts = ["".join(rng.choices(letters, k=rng.randint(1, 3))) for _ in range(40)]
    return {"".join(rng.choices(parts, k=rng.randint(1, 6))): rng.randint(1, 99) for _ in range(n)}


CASES = {
    "plain": (0, "abcdefghijkl", dict(vocab_size=150)),
    "prefix": (1, "abcdefghijkl", dict(vocab_size=120, continuing_subword_prefix="##", special_tokens=["[UNK]"])),
    "length": (2, "abcdefghijkl", dict(vocab_size=150, max_token_length=4)),
    "least": (3, "abcdefghijkl", dict(min_frequency=900, special_tokens=["ab", "a"])),
    "alphabet": (4, "abcdefghijkl", dict(vocab_size=60, limit_alphabet=6, initial_alphabet=["z"], end_of_word_suffix="</w>")),
    "made_again": (5, "aab", dict(vocab_size=60, continuing_subword_prefix="a")),
}


@pytest.mark.parametrize("case", CASES)
def test_rounds_make_the_same_merges(spark, monkeypatch, case):
    seed, letters, how = CASES[case]
    words, cfg, most = some_words(seed, letters, 400), Config(**how), 1500
    assert sum(map(len, words)) > most
    seen, follow, ways = [], trainer.one_task, []
    monkeypatch.setattr(trainer, "FEW", 3)

    def watched(rows, *args, **more):
        size = rows.agg(F.sum(F.octet_length(rows.columns[0])) / 4).first()[0]
        (seen if "run" in rows.columns else ways).append(size)
        return follow(rows, *args, **more)

    monkeypatch.setattr(trainer, "one_task", watched)
    table = trainer.train_table(spark.createDataFrame([*words.items()], "word string, cnt long"), cfg, most)
    want = slow_trainer.train([*words.items()], cfg)
    assert trainer.collected(table) == (want.vocab, want.serialized())
    # no task holds more than it may, unless a merge makes a token again
    assert seen and max(seen) <= most
    assert bool(ways) == (case == "made_again")
    if not ways:
        assert len(seen) > 1


@pytest.mark.parametrize("seed", range(20))
def test_batches_are_cut_like_words(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(50)]
    merges = [(a, b) for a, b in (("".join(rng.choices("abc", k=rng.randint(1, 2))), "".join(rng.choices("abc", k=rng.randint(1, 2)))) for _ in range(40))]
    tokens = list(dict.fromkeys([*"abc", *(t for a, b in merges for t in (a, b, a + b))]))
    ids = {t: i for i, t in enumerate(tokens)}
    symbols = np.array([ids[c] for w in words for c in w], np.int64)
    got, sizes = packs.Merges([(ids[a], ids[b], ids[a + b]) for a, b in merges]).follow(symbols, np.array([*map(len, words)]))
    ranks = {p: i for i, p in enumerate(merges)}
    want = [merging.cut(w, ranks) for w in words]
    assert sizes.tolist() == [*map(len, want)] and [tokens[i] for i in got.tolist()] == [t for w in want for t in w]


def test_words_are_cut_in_batches(spark, monkeypatch):
    monkeypatch.setattr(merging, "cut", None)  # a word at a time took most of the time on large tables
    words = spark.createDataFrame([("lower",), ("",), ("loß😀low",)], "word string")
    rows = words.select("word", merging.cut_all(F.col("word"), [("l", "o"), ("lo", "w"), ("e", "r")]).alias("t")).collect()
    assert {r.word: list(r.t) for r in rows} == {"lower": ["low", "er"], "": [], "loß😀low": ["lo", "ß", "😀", "low"]}
    assert [r.t for r in words.select(merging.cut_all(F.col("word"), []).alias("t")).collect()] == [[*"lower"], [], [*"loß😀low"]]
