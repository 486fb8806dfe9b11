"""Texts of degenerate shape, and degenerate versions of given texts.

A generated text joins what an expression makes of every number below its length. The expressions
are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HAN = "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BASE = "substr('ACGT', CAST((i * 7919 + i * i % 13) % 4 AS INT) + 1, 1)"
_LF, _CR = "chr(10)", "chr(13)"

SHAPES = {
    "dna_fasta": f"CASE WHEN i % 70 = 69 THEN {_LF} ELSE {_BASE} END",
    "dna_oneline": _BASE,
    "json_oneline": "'{\"id\": ' || CAST(i AS VARCHAR(9)) || ', \"tags\": [null, true]},'",
    "cr_only": f"'line ' || CAST(i % 97 AS VARCHAR(9)) || ' of many' || {_CR}",
    "cjk_dense": f"substr('{HAN}', CAST(i * 31 % {len(HAN)} AS INT) + 1, 1)",
    "minified_js": "'function f' || CAST(i % 50 AS VARCHAR(9)) || '(a,b){return a+b!==0&&b};'",
    "base64": f"CASE WHEN i % 77 = 76 THEN {_LF} ELSE substr('{BASE64}', CAST((i * 37 + i * i % 29) % 64 AS INT) + 1, 1) END",
    "logs": f"'2024-01-01T00:00:' || CAST(i % 60 AS VARCHAR(9)) || ' INFO worker-' || CAST(i % 7 AS VARCHAR(9)) || ' took ' || CAST(i * 13 % 997 AS VARCHAR(9)) || ' ms' || {_LF}",
    "giant_word": "substr('supercalifragilistic', CAST(i % 20 AS INT) + 1, 1)",
}


def generated(spark: SparkSession, length: int) -> DataFrame:
    """shape, text: each shape with so many elements."""
    numbers = f"sequence(CAST(0 AS BIGINT), CAST({length} - 1 AS BIGINT))"
    rows = [spark.range(1).select(F.lit(name).alias("shape"), F.expr(f"array_join(transform({numbers}, i -> {e}), '')").alias("text")) for name, e in SHAPES.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def generated_sql(length: int) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS shape, array_to_string(list_transform(range({length}), lambda i: {e}), '') AS text" for name, e in SHAPES.items())


def one_line(text: Column) -> Column:
    """Without line ends."""
    return F.replace(F.replace(text, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))


def genome(text: Column) -> Column:
    """ASCII letters in upper case, without N and line ends, as sequences are cleaned."""
    return F.replace(F.translate(one_line(text), string.ascii_lowercase, string.ascii_uppercase), F.lit("N"), F.lit(""))


def carriage_returns(text: Column) -> Column:
    """Carriage returns where line feeds were."""
    return F.replace(text, F.lit("\n"), F.lit("\r"))
