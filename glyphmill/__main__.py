"""python -m glyphmill: train on files and print the merges, or (pretok) print pretokens."""

from __future__ import annotations

import argparse
import resource
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from . import api
from .functions import text as T
from .operators import serialize
from .operators.trainer import Config
from .sources import corpus

WORDPIECE = "##"
#: Bytes of lines that pretok holds at once.
CHUNK = 16_000_000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphmill")
    p.add_argument("--vocab-size", type=int, required=True)
    p.add_argument("--min-frequency", type=int, default=0)
    p.add_argument("--special", action="append", default=[])
    p.add_argument("--max-token-length", type=int)
    p.add_argument("--limit-alphabet", type=int)
    p.add_argument("--threads", type=int)
    p.add_argument("--pretokenizer", choices=["whitespace", "bytelevel"], default="whitespace")
    p.add_argument("--continuing-subword-prefix")
    p.add_argument("--end-of-word-suffix")
    p.add_argument("--wordpiece", action="store_true")
    p.add_argument("--words-tsv", action="store_true")
    p.add_argument("--vocab-out")
    p.add_argument("files", nargs="+")
    return p


def pretok(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="glyphmill pretok")
    p.add_argument("--lines", action="store_true")
    p.add_argument("file")
    a = p.parse_args(args)
    spark = api.session()
    shown = F.array_join(F.transform(T.pieces(F.col("line")), T.show_bytes), "\t" if a.lines else "\n")
    # what is printed passes the driver in the file's order anyway; so many bytes at a time
    with open(a.file, "rb") as f:
        while lines := f.readlines(CHUNK):
            try:
                rows = spark.createDataFrame([(i, x.decode()) for i, x in enumerate(lines)], "i long, line string")
            except UnicodeDecodeError:
                p.error(corpus.NOT_UTF8)
            for r in rows.select("i", shown.alias("out")).orderBy("i").toLocalIterator():
                print(r["out"])
    return 0


def main(args: list[str]) -> int:
    if args[:1] == ["pretok"]:
        return pretok(args[1:])
    p = parser()
    a = p.parse_args(args)
    if a.wordpiece and a.continuing_subword_prefix is not None:
        p.error("--wordpiece sets the prefix itself; --continuing-subword-prefix can't be given with it")
    for decoration in (a.continuing_subword_prefix, a.end_of_word_suffix):
        if decoration and " " in decoration:
            p.error("a prefix or suffix must not contain a space, which divides the tokens of a printed merge")
    if a.threads is not None and not 0 <= a.threads <= api.MOST_THREADS:
        p.error(f"--threads must lie in 0..{api.MOST_THREADS}")
    prefix = WORDPIECE if a.wordpiece else a.continuing_subword_prefix
    try:
        cfg = Config(a.vocab_size, a.min_frequency, tuple(a.special), a.limit_alphabet, (), a.max_token_length, prefix, a.end_of_word_suffix)
    except ValueError as e:
        p.error(str(e))
    if a.words_tsv and len(a.files) != 1:
        p.error("--words-tsv takes one file")
    times = [time.time()]
    try:
        words = corpus.read_counts(api.session(), a.files[0]) if a.words_tsv else api.count_words(a.files, a.pretokenizer)
        words = words.persist()
        distinct, total = words.agg(F.count("*"), F.sum("cnt")).first()
        times.append(time.time())
        ids, merges = api.train_from_counts(words, cfg)
        times.append(time.time())
        words.unpersist()
    except ValueError as e:
        p.error(str(e))
    except Exception as e:
        if corpus.NOT_UTF8 not in str(e):
            raise
        p.error(corpus.NOT_UTF8)
    sys.stdout.write(serialize.merge_lines(merges))
    if a.vocab_out:
        Path(a.vocab_out).write_text(serialize.vocab_json(list(ids)), encoding="utf-8")
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    print(f"words {total or 0}, distinct {distinct}, vocab {len(ids)}, merges {len(merges)}, counting {times[1] - times[0]:.1f} s, merging {times[2] - times[1]:.1f} s, driver {peak:.0f} MB", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
