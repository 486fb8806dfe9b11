"""Writing trained vocabularies: merge lines, vocabulary JSON and tokenizer.json."""

from __future__ import annotations

import json
from collections.abc import Sequence

from .trainer import Config


def merge_lines(merges: Sequence[tuple[str, str]]) -> str:
    return "".join(f"{a} {b}\n" for a, b in merges)


def vocab_json(vocab: Sequence[str]) -> str:
    """A JSON array in order of ids; everything but controls, quotes and backslashes stands as it is."""
    return json.dumps(list(vocab), ensure_ascii=False, separators=(",", ":"))


def tokenizer_json(vocab: Sequence[str], merges: Sequence[tuple[str, str]], cfg: Config, mode: str) -> str:
    """The document that the tokenizers library reads."""
    ids = {t: i for i, t in enumerate(vocab)}
    added = [{"id": ids[t]} | {"content": t} | dict.fromkeys(("single_word", "lstrip", "rstrip", "normalized"), False) | {"special": True} for t in dict.fromkeys(cfg.special_tokens)]
    level = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    bytelevel = mode == "bytelevel"
    model = {"type": "BPE"}
    model |= dict.fromkeys(("dropout", "unk_token"))
    model |= {"continuing_subword_prefix": cfg.continuing_subword_prefix, "end_of_word_suffix": cfg.end_of_word_suffix}
    model |= dict.fromkeys(("fuse_unk", "byte_fallback", "ignore_merges"), False)
    model |= {"vocab": ids, "merges": [list(m) for m in merges]}
    whole = {"version": "1.0"} | dict.fromkeys(("truncation", "padding")) | {"added_tokens": added, "normalizer": None}
    whole |= {"pre_tokenizer": level | {"add_prefix_space": False} if bytelevel else {"type": "WhitespaceSplit"}}
    whole |= dict.fromkeys(("post_processor", "decoder"), level if bytelevel else None)
    return json.dumps(whole | {"model": model}, ensure_ascii=False, indent=2)
