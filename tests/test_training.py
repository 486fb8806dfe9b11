import json
import random

import pytest

import slow_trainer
from glyphmill import api
from glyphmill.__main__ import main
from glyphmill.operators import counts, merging, metrics, serialize, trainer
from glyphmill.operators.trainer import Config


def train(words, **how):
    done = trainer.train([*words.items()], Config(**how))
    return done.vocab, [f"{a} {b}" for a, b in done.serialized()], done


def of(text):
    out = {}
    for w in text.split():
        out[w] = out.get(w, 0) + 1
    return out


LOW = {"low": 5, "lower": 2, "newest": 6, "widest": 3}


def test_goldens():
    words = {w: 1 for w in "roses red voilets blue BERT big and so GPT-2".split()} | {"are": 2, "is": 2}
    vocab, _, done = train(words, min_frequency=2)
    assert vocab == "- 2 B E G P R T a b d e g i l n o r s t u v re are is".split()
    assert done.merges == [(17, 11, 22), (8, 22, 23), (13, 18, 24)]
    assert train({"aaaa": 4}, max_token_length=2)[0] == ["a", "aa"]
    assert train({"ba": 3, "dc": 3}, vocab_size=5)[2].merges == [(1, 0, 4)]
    assert train({"ba": 3, "dc": 3}, vocab_size=2)[0] == ["a", "b", "c", "d"]
    assert train(LOW, vocab_size=20)[1] == ["e s", "es t", "l o", "lo w", "e w", "n ew", "new est", "d est", "i dest", "w idest"]
    assert len(train(LOW, vocab_size=30, min_frequency=4)[1]) == 7
    assert train(LOW, vocab_size=30, max_token_length=4)[1] == ["e s", "es t", "l o", "lo w", "e w", "n ew", "i d", "w id", "e r"]
    assert train(of("aac aac aac b"), limit_alphabet=1, special_tokens=["c"])[0] == ["c", "a", "ac", "aac"]
    assert train(of("aab aab b cc c"), limit_alphabet=2)[0] == ["a", "c", "aa", "cc"]
    assert train(of("aaaa aaa aa"))[1] == ["a a", "aa a", "aa aa"]
    assert train(of("the then th th e"), special_tokens=["th", "e", "<eos>"])[0] == ["th", "e", "<eos>", "h", "n", "t", "the", "then"]
    assert train({})[0] == []


def test_decoration():
    text = "##c ##cac# #ab c# #### accc#a#a#b a cb"
    how = dict(vocab_size=244, max_token_length=4, continuing_subword_prefix="##", special_tokens=["a", "<unk>"])
    merges = train(of(text), **how)[1]
    assert len(merges) == 15 and merges[11] == "##c ##a"
    vocab, merges, _ = train({"bccaa": 1}, continuing_subword_prefix="##")
    assert vocab.index("##a") < vocab.index("##c") and merges[:2] == ["b ##c", "##a ##a"]
    assert Config(continuing_subword_prefix="# #").continuing_subword_prefix == "# #"


@pytest.mark.parametrize("seed", range(150))
def test_same_as_loops(seed):
    rng = random.Random(seed)
    letters = "abcde"[: rng.choice([1, 1, 2, 3, 5])]
    words = {"".join(rng.choices(letters, k=rng.randint(1, 16))): rng.randint(1, 30) for _ in range(rng.randint(1, 14))}
    how = dict(vocab_size=rng.randint(5, 80), max_token_length=rng.choice([None, None, 2, 3, 4, 6]), min_frequency=rng.choice([0, 0, 3, 20]))
    how |= dict(continuing_subword_prefix=rng.choice([None, "##", "a"]), end_of_word_suffix=rng.choice([None, None, "</w>"]))
    how |= dict(special_tokens=rng.choice([(), ("ab", "e", "<s>")]), limit_alphabet=rng.choice([None, None, 2]), initial_alphabet=rng.choice([(), ("z", "a")]))
    fast, slow = trainer.train([*words.items()], Config(**how)), slow_trainer.train([*words.items()], Config(**how))
    assert fast.vocab == slow.vocab and fast.merges == slow.merges


def stepwise(words, steps):
    """Recounting after every merge."""
    ids = {c: i for i, c in enumerate(sorted({c for w in words for c in w}))}
    now, found = {w: list(w) for w in words}, []
    while len(found) < steps:
        n = {}
        for w, s in now.items():
            for p in zip(s, s[1:]):
                n[p] = n.get(p, 0) + words[w]
        if not n:
            break
        a, b = min(n, key=lambda p: (-n[p], ids[p[0]], ids[p[1]]))
        ids.setdefault(a + b, len(ids))
        found.append((a, b))
        for w, s in now.items():
            out, i = [], 0
            while i < len(s):
                hit = s[i : i + 2] == [a, b]
                out.append(a + b if hit else s[i])
                i += 1 + hit
            now[w] = out
    return found


@pytest.mark.parametrize("seed", range(60))
def test_incremental_equals_recount(seed):
    rng = random.Random(seed)
    letters = "abcde"[: rng.choice([1, 2, 3, 4])]
    words = {"".join(rng.choices(letters, k=rng.randint(1, 16))): rng.randint(1, 30) for _ in range(rng.randint(3, 12))}
    done = trainer.train([*words.items()], Config(vocab_size=60))
    ours = done.serialized()
    assert ours == stepwise(words, len(ours))


def test_order_of_words_does_not_matter():
    shuffled = dict(random.Random(1).sample([*LOW.items()], len(LOW)))
    assert train(LOW)[:2] == train(shuffled)[:2]


def test_same_as_another_trainer(spark):
    tk = pytest.importorskip("tokenizers")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = counts.word_counts(docs, "bytelevel")
    vocab, merges = trainer.collected(trainer.train_table(words, Config(vocab_size=600)))
    other = tk.Tokenizer(tk.models.BPE())
    other.pre_tokenizer = tk.pre_tokenizers.ByteLevel(add_prefix_space=False)
    lines = [line for r in docs.collect() for line in r.text.splitlines(keepends=True)]
    other.train_from_iterator(lines, tk.trainers.BpeTrainer(vocab_size=600, show_progress=False))
    model = json.loads(other.to_str())["model"]
    assert [list(m) for m in merges] == [list(m) for m in model["merges"]]
    assert {t: i for i, t in enumerate(vocab)} == model["vocab"]


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {str(api.train_from_counts(counts.word_counts(docs.repartition(n)), Config(vocab_size=200))) for n in (1, 3, 7)}
    assert len(found) == 1


def test_steps_and_encoding(spark):
    words = spark.createDataFrame([*LOW.items(), ("zz", 1), ("x", 1)], "word string, cnt long")
    found, _ = merging.train_stepwise(words, 10)
    assert [(a, b) for a, b, _ in found][:4] == [("e", "s"), ("es", "t"), ("l", "o"), ("lo", "w")]
    coded = {r.word: list(r.tokens) for r in merging.encode(words, [(a, b) for a, b, _ in found]).collect()}
    assert coded["lower"] == ["low", "e", "r"] and all("".join(t) == w for w, t in coded.items())
    assert metrics.fertility(merging.encode(words, [])).first().n_words == 18


def test_diffs(spark):
    a = spark.createDataFrame([(0, "a", "b"), (1, "c", "d")], "rank long, left string, right string")
    b = spark.createDataFrame([(0, "a", "b"), (1, "c", "e"), (2, "x", "y")], "rank long, left string, right string")
    assert metrics.merge_prefix(a, b).first().prefix == 1 and metrics.merge_diff(a, b).count() == 2
    assert metrics.merge_prefix(a, a).first().fraction == 1.0
    assert metrics.merge_prefix(a.limit(0), a.limit(0)).first().prefix == 0


def test_document(spark):
    tk = pytest.importorskip("tokenizers")
    cfg = Config(vocab_size=40, special_tokens=["<s>", "<s>"])
    done = trainer.train([("Ġlow", 3), ("lower", 2)], cfg)
    text = serialize.tokenizer_json(done.vocab, done.serialized(), cfg, "bytelevel")
    assert tk.Tokenizer.from_str(text).encode(" lower").tokens and len(json.loads(text)["added_tokens"]) == 1


def test_files_and_command_line(spark, tmp_path, capsys):
    f = tmp_path / "t.txt"
    f.write_bytes(b"x y\r\nx y\r\nx y\r\n")
    vocab, merges = api.train_bpe([str(f)], 12, pretokenizer="bytelevel")
    assert list(vocab) == ["x", "y", "Ċ", "č", "Ġ", "čĊ", "Ġy"] and merges == [("č", "Ċ"), ("Ġ", "y")]
    with pytest.raises(ValueError):
        api.train_bpe([str(tmp_path / "none")], 12)
    with pytest.raises(ValueError):
        api.train_bpe([str(f)], 12, threads=5000)
    tsv = tmp_path / "w.tsv"
    tsv.write_text("".join(f"{w}\t{n}\n" for w, n in LOW.items()))
    assert main(["--vocab-size", "13", "--words-tsv", "--vocab-out", str(tmp_path / "v.json"), str(tsv)]) == 0
    assert capsys.readouterr().out == "e s\nes t\nl o\n" and len(json.loads((tmp_path / "v.json").read_text())) == 13
    for bad in (["--wordpiece", "--continuing-subword-prefix", "##"], ["--end-of-word-suffix", "a b"], ["--threads", "4097"]):
        with pytest.raises(SystemExit) as e:
            main(["--vocab-size", "9", *bad, str(tsv)])
        assert e.value.code == 2
    assert main(["pretok", str(f)]) == 0 and capsys.readouterr().out.split() == ["x", "Ġy", "čĊ"] * 3


def test_train_tokenizer(spark, tmp_path):
    tk = pytest.importorskip("tokenizers")
    f, out = tmp_path / "t.txt", tmp_path / "tokenizer.json"
    f.write_text("low lower lowest\nnewer newest low\n" * 5)
    for mode in ("whitespace", "bytelevel"):
        api.train_tokenizer([str(f)], 40, str(out), pretokenizer=mode, special_tokens=["<s>"])
        vocab, merges = api.train_bpe([str(f)], 40, pretokenizer=mode, special_tokens=["<s>"])
        told = json.loads(out.read_text())
        assert told["model"]["vocab"] == vocab and [tuple(m) for m in told["model"]["merges"]] == merges and told["added_tokens"][0]["content"] == "<s>"
        assert "".join(tk.Tokenizer.from_file(str(out)).encode("lower newest").tokens).replace("Ġ", "") == "lowernewest"


DEGENERATE = {
    "dna_fasta": "\n".join("ACGT"[i % 4] * 3 + "GATTACA" * 9 for i in range(200)),
    "dna_oneline": "ACGTTGCAAC" * 3000,
    "json_oneline": "{" + ",".join(f'"k{i}": [{i}, null]' for i in range(900)) + "}",
    "cr_only": "one two\rthree four\r" * 700,
    "cjk_dense": "".join(chr(0x4E00 + i * 7 % 512) for i in range(9000)),
    "minified_js": "function(a,b){return a+b};" * 600 + "\n",
    "base64": "\n".join("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=" for _ in range(300)),
    "logs": "".join(f"2024-01-01T00:00:{i % 60:02} INFO worker-{i % 7} took {i} ms\r\n" for i in range(500)),
    "giant_word": "supercalifragilistic" * 2000,
    "blank_runs": "a  b\n\n \t \n   c" * 50,
    "mark_first": "\ufeffword one\nword two",
    "mark_only": "\ufeff",
    "empty": "",
    "line_feeds": "\n\n\n",
}


@pytest.mark.parametrize("shape", DEGENERATE)
def test_files_in_splits(spark, tmp_path, shape):
    """Counts of a file that many tasks read are those of its whole text."""
    f = tmp_path / "f.txt"
    f.write_bytes(DEGENERATE[shape].encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for mode in ("whitespace", "bytelevel"):
            whole = counts.word_counts(spark.createDataFrame([(DEGENERATE[shape],)], "text string"), mode)
            got = api.count_words([str(f), str(f)], mode, spark)
            assert {r.word: r.cnt for r in got.collect()} == {r.word: 2 * r.cnt for r in whole.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bad_bytes(spark, tmp_path):
    f = tmp_path / "f.txt"
    for raw in (b"fine\nnot \xff\nfine\n", b"fine\ncut \xc3", b"\xed\xa0\x80\n"):
        f.write_bytes(raw)
        with pytest.raises(ValueError, match="UTF-8"):
            api.train_bpe([str(f)], 20)
        with pytest.raises(SystemExit):
            main(["--vocab-size", "9", str(f)])


def test_training_tables_of_little(spark):
    for rows, vocab in (([], []), ([("a", 1)], ["a"])):
        table = trainer.train_table(spark.createDataFrame(rows, "word string, cnt long"), Config(vocab_size=10))
        assert trainer.collected(table) == (vocab, [])


@pytest.mark.parametrize("seed", range(20))
def test_cut_follows_every_merge_in_order(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 16))): rng.randint(1, 30) for _ in range(rng.randint(3, 12))}
    merges = list(dict.fromkeys(stepwise(words, 60)))
    ranks = {p: i for i, p in enumerate(merges)}
    for w in words:
        now = "".join(f"<{c}>" for c in w)
        for a, b in merges:
            now = now.replace(f"<{a}><{b}>", f"<{a}{b}>")
        assert merging.cut(w, ranks) == now[1:-1].split("><")


def test_production_queries_follow_all_merges(spark, tmp_path):
    from glyphmill.plans import registry

    rng = random.Random(7)
    texts = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(12)), "en" if i % 2 else "de") for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    words, english = of(" ".join(t for _, t, _ in texts)), of(" ".join(t for _, t, lang in texts if lang == "en"))
    want, other = stepwise(words, 30000), stepwise(english, 30000)
    assert len(set(want)) == len(want) > registry.STEPS and len(set(other)) == len(other)
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path))
    assert [(r.left_token, r.right_token) for r in run("bpe_train_ws_30k").orderBy("rank").collect()] == want
    assert {r.word: r.n_tokens for r in run("encode_words_30k").collect()} == dict.fromkeys(words, 1)
    assert run("fertility_30k").first().fertility == 1.0
    differ = {i for i in range(max(len(want), len(other))) if want[i : i + 1] != other[i : i + 1]}
    assert {r["rank"] for r in run("merge_diff_30k").collect()} == differ and max(differ) > registry.FEW
    assert run("merge_prefix_30k").first().prefix == min(differ)
    assert {r.lang for r in run("lang_compression_30k").collect()} == {"de", "en"}
    tokens = lambda found, w: {a + b for a, b in found} | {c for x in w for c in x}
    got = run("vocab_overlap_30k").first()
    assert (got.shared, got.total) == (len(tokens(want, words) & tokens(other, english)), len(tokens(other, english)))
