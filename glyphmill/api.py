"""Training from files: the Python functions behind the command line."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import counts, serialize, trainer
from .operators.trainer import Config
from .sources import corpus

MOST_THREADS = 4096


def session() -> SparkSession:
    return SparkSession.builder.appName("glyphmill").getOrCreate()


def train_from_counts(words: DataFrame, cfg: Config) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Token ids and merges, from word, cnt."""
    vocab, merges = trainer.collected(trainer.train_table(words, cfg))
    return {t: i for i, t in enumerate(vocab)}, merges


def count_words(files: Sequence[str], pretokenizer: str = "whitespace", spark: SparkSession | None = None) -> DataFrame:
    missing = [f for f in files if "://" not in f and not Path(f).is_file()]
    if missing:
        raise ValueError(f"not a regular file: {missing[0]}")
    return counts.line_counts(corpus.read_lines(spark or session(), files), pretokenizer)


def train_bpe(files: Sequence[str], vocab_size: int, *, special_tokens: Sequence[str] = (), min_frequency: int = 0, max_token_length: int | None = None, limit_alphabet: int | None = None, pretokenizer: str = "whitespace", threads: int | None = None, continuing_subword_prefix: str | None = None, end_of_word_suffix: str | None = None) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Token ids and merges. threads is checked and otherwise left to Spark; errors are ValueErrors."""
    if threads is not None and not 0 <= threads <= MOST_THREADS:
        raise ValueError(f"threads must lie in 0..{MOST_THREADS}")
    cfg = Config(vocab_size, min_frequency, tuple(special_tokens), limit_alphabet, (), max_token_length, continuing_subword_prefix, end_of_word_suffix)
    try:
        return train_from_counts(count_words(files, pretokenizer), cfg)
    except Exception as e:
        if "valid UTF-8" in str(e):
            raise ValueError("stream did not contain valid UTF-8") from e
        raise


def train_tokenizer(files: Sequence[str], vocab_size: int, output: str, *, pretokenizer: str = "whitespace", **options) -> None:
    """Write tokenizer.json; the options are those of train_bpe."""
    ids, merges = train_bpe(files, vocab_size, pretokenizer=pretokenizer, **options)
    cfg = Config(vocab_size, special_tokens=tuple(options.get("special_tokens", ())), continuing_subword_prefix=options.get("continuing_subword_prefix"), end_of_word_suffix=options.get("end_of_word_suffix"))
    Path(output).write_text(serialize.tokenizer_json(list(ids), merges, cfg, pretokenizer), encoding="utf-8")
