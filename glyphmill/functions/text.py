"""Column expressions: lines, words, byte-level pieces and the visible form of bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charclass as C

HIDDEN = "".join(map(chr, C.OTHER))
VISIBLE = "".join(C.SHOWN[b] for b in C.OTHER)


def lines(text: Column) -> Column:
    """Lines with their terminating line feed; a carriage return belongs to its line."""
    return F.regexp_extract_all(text, F.lit(C.LINE), F.lit(0))


def words(text: Column) -> Column:
    """Runs of anything but the 25 white-space code points."""
    return F.regexp_extract_all(text, F.lit(C.WORD), F.lit(0))


def pieces(line: Column) -> Column:
    """Byte-level pieces of one line: contractions, letters, numbers, signs (each with one space before it) and blanks."""
    return F.regexp_extract_all(line, F.lit(C.PIECE), F.lit(0))


def words_and_signs(text: Column) -> Column:
    """Runs of word characters (letters, marks, numbers, connectors), and runs of anything else but blanks."""
    return F.regexp_extract_all(text, F.lit(C.WORD_OR_SIGNS), F.lit(0))


def show_bytes(raw: Column) -> Column:
    """Every byte of the UTF-8 form as one visible character."""
    return F.translate(F.decode(F.encode(raw, "UTF-8"), "ISO-8859-1"), HIDDEN, VISIBLE)


def read_bytes(shown: Column) -> Column:
    """What show_bytes made of it, undone."""
    some = F.translate(shown, VISIBLE[1:], HIDDEN[1:])  # translate would delete what becomes NUL
    return F.decode(F.encode(F.replace(some, F.lit(VISIBLE[0]), F.lit("\0")), "ISO-8859-1"), "UTF-8")


def characters(word: Column) -> Column:
    """The code points of a word."""
    return F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))


def json_escaped(s: Column) -> Column:
    """Inside of a JSON string: two-character escapes, other controls as \\u00xx, everything else as it is."""
    s = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    for c in range(0x20):
        s = F.replace(s, F.lit(chr(c)), F.lit("\\" + short[c] if c in short else f"\\u{c:04x}"))
    return s
