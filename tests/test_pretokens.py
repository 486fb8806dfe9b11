import re

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import charclass as C
from glyphmill.functions import text as T
from glyphmill.operators import counts
from glyphmill.sources import corpus

PIECES = {
    "Hello world": ["Hello", "Ġworld"],
    "don't stop": ["don", "'t", "Ġstop"],
    "a  b": ["a", "Ġ", "Ġb"],
    "x   ": ["x", "ĠĠĠ"],
    "  lead": ["Ġ", "Ġlead"],
    "123abc": ["123", "abc"],
    "a1b2": ["a", "1", "b", "2"],
    "end.  ": ["end", ".", "ĠĠ"],
    "café": ["cafÃ©"],
    "中文 text": ["ä¸Ńæĸĩ", "Ġtext"],
    "Ⅷ roman": ["âħ§", "Ġroman"],
    "aͅb": ["a", "Íħ", "b"],
    "x\r\n": ["x", "čĊ"],
}


def test_pieces(spark):
    df = spark.createDataFrame([(t,) for t in PIECES], "line string")
    got = {r[0]: list(r[1]) for r in df.select("line", F.transform(T.pieces(F.col("line")), T.show_bytes)).collect()}
    assert got == PIECES


def test_bytes_round_trip(spark):
    every = "".join(map(chr, [*range(0x180), 0x4E2D, 0x1F600]))
    df = spark.createDataFrame([(every,)], "s string")
    shown, back = df.select(T.show_bytes("s"), T.read_bytes(T.show_bytes("s"))).first()
    assert back == every and len(shown) == len(every.encode()) and len(set(C.SHOWN.values())) == 256


def test_white_space_is_unicode(spark):
    text = "a\x1cb c　d​e"
    assert [r.word for r in counts.pretokens(spark.createDataFrame([(text,), (None,), ("",)], "text string")).collect()] == ["a\x1cb", "c", "d​e"]
    with pytest.raises(ValueError):
        counts.pretokens(spark.createDataFrame([("a",)], "text string"), "none")


def test_lines_keep_terminators(spark):
    rows = corpus.split_lines(spark.createDataFrame([(1, "a\r\nb\n\nc"), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.line_no, r.line) for r in rows] == [(1, 0, "a\r\n"), (1, 1, "b\n"), (1, 2, "\n"), (1, 3, "c")]


def test_same_pieces_as_another_tokenizer(spark):
    tk = pytest.importorskip("tokenizers")
    pre = tk.pre_tokenizers.ByteLevel(add_prefix_space=False)
    texts = ["I'll  go, we've gone!\t\tx", "   tab\t x", "ä ö ü 12½ Ⅷ²", "''s 's", "a‍b 👍🏽 é́"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.transform(T.pieces(F.col("t")), T.show_bytes)).collect()
    assert [list(r[0]) for r in got] == [[p for p, _ in pre.pre_tokenize_str(t)] for t in texts]


def test_counts_from_lines(spark):
    df = spark.createDataFrame([("a\t2",), ("",), ("a\t3",), ("b\tc\t1",)], "value string")
    assert {r.word: r.cnt for r in corpus.parse_counts(df).collect()} == {"a": 5, "b\tc": 1}
    for bad in ("a b\t1", "a", "a\tx", "a\t99999999999999999999"):
        with pytest.raises(Exception):
            corpus.parse_counts(spark.createDataFrame([(bad,)], "value string")).collect()


def test_json_escape(spark):
    s = spark.createDataFrame([('a"b\\c\nd\te\x01f',)], "s string").select(T.json_escaped(F.col("s"))).first()[0]
    assert s == 'a\\"b\\\\c\\nd\\te\\u0001f'


def test_files(spark, tmp_path):
    good, bad = tmp_path / "a.txt", tmp_path / "b.txt"
    good.write_bytes(b"x y\r\nz")
    bad.write_bytes(b"\xff\xfe")
    assert sorted((r.line, r.weight) for r in corpus.read_lines(spark, [str(good)]).collect()) == [("x y\r\n", 1), ("z", 1), ("z\n", -1), ("z\n", 1)]
    with pytest.raises(Exception, match="valid UTF-8"):
        corpus.read_lines(spark, [str(bad)]).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.n_lines, r.bad_lines) for r in corpus.utf8_guard(spark, [str(good), str(bad)]).collect()} == {"a.txt": (2, 0), "b.txt": (1, 1)}


def test_pattern_of_the_oracle_marks_only_backed_off_blanks():
    assert re.search(r"10FFFF", C.SQL_PIECE)


def test_slice_and_round_robin(spark):
    docs = spark.createDataFrame([(i, "x" * 8, "ab"[i % 3 == 0]) for i in range(10)] + [(10, None, "a")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus.corpus_slice(docs, 25, buckets=3).collect()) == [0, 1, 2]
    order = [r.doc_id for r in corpus.round_robin(docs).orderBy("position").collect()]
    assert order[:4] == [1, 0, 2, 3] and len(order) == 11
