"""Character classes and pretoken patterns, the same on the JVM and in DuckDB.

Letters and numbers are those of Unicode 16. Either engine's own tables are older, so the code
points that it lacks are added to its class as ranges.
"""

from __future__ import annotations

#: The 25 code points with the property White_Space, as the inside of a class.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

JVM_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 "
    "A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 "
    "105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 "
    "11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF "
    "11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE "
    "16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A "
    "1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE "
    "2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF "
)
JVM_NUMBERS = (
    "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 "
    "1E4F0-1E4F9 1E5F1-1E5FA "
)
SQL_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E "
    "11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0 "
    "2EBF0-2EE5D "
)
SQL_NUMBERS = (
    "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA "
)


def ranges(listed: str) -> str:
    """Listed code points as the inside of a class."""
    return "".join("-".join(rf"\x{{{p}}}" for p in item.split("-")) for item in listed.split())


L, N = r"\p{L}" + ranges(JVM_LETTERS), r"\p{N}" + ranges(JVM_NUMBERS)
SQL_L, SQL_N = r"\p{L}" + ranges(SQL_LETTERS), r"\p{N}" + ranges(SQL_NUMBERS)

WORD = f"[^{WS}]+"
LINE = r"[^\n]*\n|[^\n]+"
CONTRACTION = "'(?:[stmd]|re|ve|ll)"
PIECE = f"{CONTRACTION}| ?[{L}]+| ?[{N}]+| ?[^{WS}{L}{N}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
#: Runs of word characters, or of neither these nor blanks.
WORD_OR_SIGNS = f"[{L}{N}\\p{{M}}\\p{{Pc}}]+|[^{WS}{L}{N}\\p{{M}}\\p{{Pc}}]+"
SQL_WORD_OR_SIGNS = f"[{SQL_L}{SQL_N}\\p{{M}}\\p{{Pc}}]+|[^{WS}{SQL_L}{SQL_N}\\p{{M}}\\p{{Pc}}]+"
#: DuckDB has no lookahead: MARK stands before the last blank of a run that a word follows, and ends the run there.
MARK = 0x10FFFF
SQL_PIECE = f"{CONTRACTION}| ?[{SQL_L}]+| ?[{SQL_N}]+| ?[^{WS}{SQL_L}{SQL_N}\\x{{{MARK:X}}}]+|[{WS}]+"

#: Bytes that a byte-level token shows as themselves; the other 68 become U+0100 and up, in order.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
OTHER = [b for b in range(256) if b not in set(PLAIN)]
SHOWN = {b: chr(b) for b in PLAIN} | {b: chr(0x100 + i) for i, b in enumerate(OTHER)}
