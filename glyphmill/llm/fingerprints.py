"""Document fingerprints by consistent weighted sampling.

A document is the weighted set of its lower-case words (weight: number of occurrences). For every
word and sample j the generator seeded by both gives r ~ Gamma(2, 1), c ~ Gamma(2, 1) and
b ~ U(0, 1); with t = floor(ln w / r + b) and y = exp(r (t - b)) the sample of the document is the
(word, t) that minimises c / (y e^r). Two documents agree in a sample with a probability that
equals their generalised Jaccard similarity, sum of minima over sum of maxima of the weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pick

WORD = re.compile(r"\w+")
STEP = 0x9E3779B97F4A7C15


def weighted(text: str | None) -> Counter[str]:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def term_hash(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)


def draws(h: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of every term for one sample; a Gamma(2, 1) number is minus the log of the product of two uniform ones."""
    with np.errstate(over="ignore"):
        one = mix64(h + np.uint64(2 * sample + 1) * np.uint64(STEP))
        two = mix64(h + np.uint64(2 * sample + 2) * np.uint64(STEP))
    bits = lambda x, shift, n: ((x >> np.uint64(shift) & np.uint64((1 << n) - 1)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-n)
    r = -np.log(bits(one, 0, 24) * bits(one, 24, 24))
    c = -np.log(bits(two, 0, 22) * bits(two, 22, 22))
    return r, np.log(c), bits(two, 44, 20)


def sign(sets: list[Counter[str]], samples: int) -> np.ndarray:
    """(document, sample) 64-bit signature; zeros for documents without words."""
    out = np.zeros((len(sets), samples), np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    live = np.flatnonzero(sizes)
    if not len(live):
        return out
    index: dict[str, int] = {}
    code = np.fromiter((index.setdefault(w, len(index)) for i in live for w in sets[i]), np.int32)
    weight = np.log(np.fromiter((n for i in live for n in sets[i].values()), np.float32, len(code)))
    h = term_hash(list(index))
    start = np.cumsum(sizes[live]) - sizes[live]
    doc = np.repeat(np.arange(len(live), dtype=np.int32), sizes[live])
    for j in range(samples):
        r, ln_c, b = draws(h, j)
        fixed = ln_c + r * (b - 1)
        rj = r[code]
        t = np.floor(weight / rj + b[code])
        a = fixed[code] - rj * t
        least = np.minimum.reduceat(a, start)
        at = np.flatnonzero(a == least[doc])
        # ties (equal float32 values) go to the smallest hash, so the order of words doesn't matter
        order = np.lexsort((h[code[at]], doc[at]))
        at = at[order]
        at = at[np.r_[True, doc[at][1:] != doc[at][:-1]]]
        with np.errstate(over="ignore"):
            out[live, j] = mix64(h[code[at]] ^ mix64(t[at].astype(np.int64).view(np.uint64) + np.uint64(j + 1) * np.uint64(STEP))).view(np.int64)
    return out


def fingerprint(docs: DataFrame, samples: int = 32) -> DataFrame:
    """doc_id, n_terms (distinct words), signature (array of `samples` numbers), one row for each row.

    A null or empty text, or one without words, has no terms and a null signature. Equal texts have
    equal signatures, whatever else stands in the row. Texts are read whole; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1500):
                part = batch.slice(lo, 1500)
                sets = [weighted(t) for t in part.column(1).to_pylist()]
                sig = sign(sets, samples)
                n = np.array([len(s) for s in sets], np.int32)
                ends = np.arange(0, samples * len(sets) + 1, samples, dtype=np.int32)
                array = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), array], ["doc_id", "n_terms", "signature"])

    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return base.mapInArrow(run, "doc_id long, n_terms int, signature array<long>")


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The share of samples in which two signatures agree."""
    return float(np.mean(np.asarray(a) == np.asarray(b)))
