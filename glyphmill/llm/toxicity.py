"""Toxicity of texts whose words may be disguised, by noisy-channel deobfuscation.

The channel writes letters as look-alike digits and signs, puts separators or spaces between them
and repeats them. What may have been written so becomes a character lattice, and Viterbi decoding
under a character trigram model of the whole corpus restores it. The restored text is scored by
rules, words and word beginnings, learnt from a bounded sample of labelled rows. Only one text of
each group of near copies is learnt from, so that what is merely copied along with toxic words
doesn't become a rule.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, pick, unit_hash

LOOKALIKES = {"0": "o", "1": "il", "!": "il", "|": "il", "3": "e", "€": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z"}
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100)])) + "œ"
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
SIZE = 64
REPEAT = re.compile(r"(.)\1+", re.S)
LONG_REPEAT = re.compile(r"(.)\1\1", re.S)
NOT_LETTER = re.compile(r"[\W\d_]+")
EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…|*_-~#%&$/\\=+^`@"
SHORTEST, LONGEST = 3, 6
MARGIN = 10.0
#: Signs up to which a text is restored as a whole, and signs around a place in a longer one.
WHOLE, AROUND = 512, 32


def squeeze(word: str) -> str:
    """Runs of one letter count as one letter."""
    return REPEAT.sub(r"\1", word)


def class_table() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for c, k in CLASS.items():
        table[ord(c)] = k
        if len(c.upper()) == 1 and ord(c.upper()) < len(table):
            table[ord(c.upper())] = k
    return table


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams (everything else is a boundary) over all texts; SIZE^3 of them at most reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = class_table(), np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                joined = "\n\n".join(t for t in batch.column(0).slice(lo, 500).to_pylist() if t)
                points = np.frombuffer(f"\n\n{joined}\n".encode("utf-32-le", "replace"), np.uint32)
                k = table[np.minimum(points, len(table) - 1)]
                total += np.bincount((k[:-2] * SIZE + k[1:-1]) * SIZE + k[2:], minlength=SIZE**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    rows = pick(docs, "text").filter("text is not null").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(SIZE**3)
    for r in rows:
        total[r["gram"]] = r["n"]
    return total.reshape(SIZE, SIZE, SIZE)


def log_probabilities(counts: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """log P(c | a, b), each order smoothed by the next lower one."""
    one = counts.sum((0, 1)) + 0.5
    one /= one.sum()
    pair = counts.sum(0)
    two = (pair + strength * one) / (pair.sum(1, keepdims=True) + strength)
    three = (counts + strength * two) / (counts.sum(2, keepdims=True) + strength)
    return np.log(three)


def arcs(sign: str, run: int, parts: bool = False) -> list[tuple[str, float]]:
    """What a run of one sign may stand for, with the channel's cost. parts: blanks are more likely what they look like."""
    if sign in LOOKALIKES:
        out = [(h, 0.7) for h in LOOKALIKES[sign]] + [("", 5.0 if sign.isdigit() else 1.5)]
    elif sign.isalpha():
        out = [(sign, 0.0)]
    elif sign.isspace():
        return [("", 5.0), (" ", 0.0)] if parts else [("", 0.5), (" ", 1.0)]
    else:
        return [("", 0.3), (" ", 1.0)]
    return out + [(h + h, cost + 0.5) for h, cost in out if h] * (run > 1)


def decode(text: str, lm: np.ndarray, wanted: str = "", parts: bool = False) -> tuple[str, float]:
    """The likeliest restoration and its log probability; with wanted, a rule, the likeliest that has a word (squeezed) that meets it."""
    whole, wanted = wanted.endswith("$"), wanted.rstrip("$")
    full = len(wanted)
    runs = [(m.group(0)[0], len(m.group(0))) for m in re.finditer(r"(.)\1*", text, re.S)]
    table = CLASS
    # state: last two classes, squeezed letters matched of wanted (all of them once found, one more if a whole word is wanted and has ended), last letter; each keeps the way back to where it came from
    states: dict[tuple, tuple[float, tuple | None]] = {(0, 0, 0, ""): (0.0, None)}
    for sign, run in runs:
        after: dict[tuple, tuple[float, tuple | None]] = {}
        for (a, b, m, last), (score, back) in states.items():
            for hidden, cost in arcs(sign, run, parts):
                x, y, s, mm, ll = a, b, score - cost, m, last
                for c in hidden:
                    k = table.get(c, 0)
                    s += lm[x, y, k]
                    x, y = y, k
                    if wanted and mm == full and whole and c != ll:
                        mm = 0 if c.isalpha() else full + 1
                    elif wanted and mm < full and c != ll:
                        mm = mm + 1 if c == wanted[mm] else (1 if c == wanted[0] and (ll == "" or ll == " ") else 0)
                        if mm == 1 and ll not in ("", " "):
                            mm = 0
                    ll = c
                key = (x, y, mm, ll if wanted else "")
                if key not in after or after[key][0] < s:
                    after[key] = (s, (hidden, back) if hidden else back)
        states = after
    ends = [(s + lm[key[0], key[1], 0], i) for i, (key, (s, _)) in enumerate(states.items()) if not wanted or key[2] >= full]
    if not ends:
        return "", -math.inf
    score, i = max(ends)
    back, out = list(states.values())[i][1], []
    while back:
        out.append(back[0])
        back = back[1]
    return "".join(reversed(out)), score


@dataclass
class Model:
    """rules: squeezed word ("loser$") or beginning ("loser") -> probability that a document with it is toxic; lm: log trigram probabilities.

    What may meet a rule is found by an automaton that follows all rules at once, a bit for each of
    their letters: a sign moves a bit on if it may stand for the next letter; anything that isn't a
    letter may stand for nothing, and a letter may repeat. Every path through the lattice that
    meets a rule is such a way, so only where there is none is nothing decoded.
    """

    rules: dict[str, float]
    lm: np.ndarray

    def __post_init__(self):
        self.lengths = sorted({len(r) for r in self.rules if r[-1] != "$"})
        self.starts = {r[:2] for r in self.rules} | {r[0] * 2 for r in self.rules if r}
        self.heads = {r.rstrip("$")[:n] for r in self.rules for n in range(1, len(r.rstrip("$")))}
        self.first = self.last = bits = 0
        self.at: dict[int, str] = {}
        self.letter: dict[str, int] = {}
        for r in sorted(self.rules):
            core = r.rstrip("$")
            self.first |= 1 << bits
            for c in core:
                self.letter[c] = self.letter.get(c, 0) | 1 << bits
                bits += 1
            self.last |= 1 << (bits - 1)
            self.at[bits - 1] = r
        self.accepts = dict(self.letter)
        for sign, letters in LOOKALIKES.items():
            for c in letters:
                self.accepts[sign] = self.accepts.get(sign, 0) | self.letter.get(c, 0)

    def match(self, word: str) -> str | None:
        """The surest rule that a squeezed word meets."""
        found = [r for r in (word + "$", *(word[:n] for n in self.lengths if len(word) >= n)) if r in self.rules]
        return max(found, key=lambda r: (self.rules[r], r)) if found else None

    def follow(self, text: str, state: int = 0, begin: bool = True) -> tuple[int, list[tuple[int, int]]]:
        """The automaton's bits after the text, and (place, bits) where last letters of rules were read. begin: rules may begin at any sign that no letter stands before."""
        ends, free = [], begin
        first, last = self.first, self.last
        for place, c in enumerate(text):
            may, letter = self.accepts.get(c, 0), c.isalpha()
            stay = state & self.letter.get(c, 0) if letter else state
            state = (state << 1) & ~first & may | stay
            if free:
                state |= first & may
            if state & last & may:
                ends.append((place, state & last & may))
            free = begin and not letter
        return state, ends

    def window(self, text: str, end: int, rule: str) -> int:
        """Where the shortest way that ends there begins."""
        core, k = rule.rstrip("$"), len(rule.rstrip("$")) - 1
        for place in range(end, -1, -1):
            c = text[place]
            if k >= 0 and (c == core[k] or core[k] in LOOKALIKES.get(c, "")):
                k -= 1
                if k < 0:
                    return place
        return 0

    def restored(self, text: str) -> list[str]:
        """Squeezed words of the restorations of a text that are within MARGIN of the likeliest one.

        Of a text of more than WHOLE signs the surroundings of each place that may meet a rule are restored.
        """
        _, ends = self.follow(text)
        met = [(place, self.at[k]) for place, bits in ends for k in self.at if bits >> k & 1]
        spans: list[list[int]] = []
        if met and len(text) > WHOLE:
            for place, r in met:
                lo = max(0, self.window(text, place, r) - AROUND)
                while lo and text[lo - 1].isalpha() and text[lo].isalpha():
                    lo -= 1
                if spans and lo <= spans[-1][1]:
                    spans[-1] = [min(lo, spans[-1][0]), place + 1 + AROUND]
                else:
                    spans.append([lo, place + 1 + AROUND])
        elif met:
            spans = [[0, len(text)]]
        words: list[str] = []
        for lo, hi in spans:
            part = text[lo:hi]
            best, top = decode(part, self.lm)
            own = [squeeze(w) for w in NOT_LETTER.split(best) if w]
            for r in sorted({r for place, r in met if lo <= place < hi}):
                if not any(self.match(w) == r for w in own):
                    other, score = decode(part, self.lm, r)
                    if score >= top - MARGIN:
                        own += [squeeze(w) for w in NOT_LETTER.split(other) if w]
            words += own
        return words

    def hits(self, token: str) -> list[tuple[str, str]]:
        """(restored word, rule) of a token without white space, in lower case."""
        core = token.strip(EDGES)
        if core.isalpha() and len(core) == len(token):
            if core[:2] not in self.starts:
                return []
            if not LONG_REPEAT.search(core):
                word = squeeze(core)
                rule = self.match(word)
                return [(word, rule)] if rule else []
        words = dict.fromkeys([squeeze(w) for w in NOT_LETTER.split(token) if w] + self.restored(token))
        return [(w, r) for w in words if (r := self.match(w))]

    def opening(self, token: str) -> int:
        """The automaton's bits after a token that may be the first part of a divided word, else 0."""
        if token.isalpha():
            return self.follow(token, 0)[0] if squeeze(token) in self.heads else 0
        return self.follow(token, 0)[0]

    def divided(self, tokens: list[str], opening: dict[str, int]) -> list[tuple[str, str]]:
        """(restored word, rule) of words that blanks divide into parts of which one is longer than a letter.

        Blanks between such parts mostly are what they look like, so only what the likeliest
        restoration, with the tokens before and after, joins counts.
        """
        out = []
        for i in [i for i, t in enumerate(tokens) if t in opening]:
            state, j, ends = opening[tokens[i]], i + 1, 0
            while state and j < len(tokens):
                state, more = self.follow(tokens[j], state, False)
                j += 1
                if more:
                    ends = j
            if ends and any(not single(t) for t in tokens[i:ends]):
                best, _ = decode(" ".join(tokens[max(0, i - 1) : ends + 1]), self.lm, parts=True)
                out += [(w, r) for w in map(squeeze, filter(None, NOT_LETTER.split(best))) if (r := self.match(w))]
        return out


def single(token: str) -> bool:
    """One sign, repeated or not."""
    return token.count(token[0]) == len(token)


def spaced_runs(tokens: list[str]) -> list[str]:
    """Three or more single signs in a row, with what stands before and after if it is one sign within others."""
    ones = [i for i, t in enumerate(tokens) if single(t)]
    if len(ones) < 2:
        return []
    out, start = [], 0
    for e in range(1, len(ones) + 1):
        if e == len(ones) or ones[e] != ones[e - 1] + 1:
            lo, hi = ones[start], ones[e - 1] + 1
            if lo and len(tokens[lo - 1].strip(EDGES)) == 1:
                lo -= 1
            if hi < len(tokens) and len(tokens[hi].strip(EDGES)) == 1:
                hi += 1
            if hi - lo >= 3:
                out.append(" ".join(tokens[lo:hi]))
            start = e
    return out


def score_batch(model: Model, texts: list[str | None]) -> list[list[tuple[str, str]]]:
    """(restored word, rule) of each text, without repeats, in order of the words."""
    if not model.rules:
        return [[] for _ in texts]
    split = [t.lower().split() if t else [] for t in texts]
    own = [set(s) for s in split]
    every: set[str] = set().union(*own) if own else set()
    found = {t: h for t in every if (h := model.hits(t))}
    opening = {t: state for t in every if (state := model.opening(t))}
    names, out = set(found), []
    for tokens, distinct in zip(split, own):
        hits = {h for t in names & distinct for h in found[t]}
        for run in spaced_runs(tokens):
            hits |= {(w, r) for w in model.restored(run) if (r := model.match(w))}
        hits |= set(model.divided(tokens, opening))
        out.append(sorted(hits))
    return out


def probability(model: Model, hits: Iterable[tuple[str, str]]) -> float:
    """That one of the rules is right, were they independent."""
    return 1 - math.prod(1 - model.rules[r] for r in {r for _, r in hits})


def features(text: str) -> set[str]:
    """Squeezed whole words ("word$") and beginnings of a text's words."""
    out: set[str] = set()
    for w in set(NOT_LETTER.split(text.lower())):
        w = squeeze(w)
        if len(w) >= SHORTEST:
            out.add(w + "$")
            out.update(w[:n] for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return out


def representatives(texts: list[str], bands: int = 10, rows: int = 3) -> list[str]:
    """One text of each group of near copies, by minima of hashes of the longer words; copies would make their every word look toxic."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 1 << 31, (2, bands * rows, 1)).astype(np.uint64)
    seen: set[tuple[int, bytes]] = set()
    out = []
    for t in texts:
        words = set(NOT_LETTER.split(t.lower()))
        words = {w for w in words if len(w) > 6} or words
        h = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
        low = ((a * h + b) % np.uint64((1 << 61) - 1)).min(1).reshape(bands, rows)
        keys = {(i, x.tobytes()) for i, x in enumerate(low)}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


def learn(toxic: list[str], clean: list[str], impurity: float = 0.01, chance: float = 0.01) -> dict[str, float]:
    """The rules: words or beginnings whose rate among clean texts is at most impurity times that among toxic ones.

    The likelihood ratio against their being toxic by chance must hold for all candidates together.
    Of rules that begin alike the one with most toxic texts stays, of equals the longest.
    """
    toxic, n_clean = representatives(toxic), max(1, len(clean))
    if not toxic:
        return {}
    seen: Counter[str] = Counter()
    for t in toxic:
        seen.update(features(t))
    base = len(toxic) / (len(toxic) + n_clean)
    least = math.log(max(1, len(seen)) / chance)
    often = {f for f, n in seen.items() if n >= 3 and n * math.log(1 / base) >= least}
    against: Counter[str] = Counter()
    for t in clean:
        against.update(features(t) & often)
    general = set()  # beginnings that a longer rule replaces without loss, or more purely
    for f in often:
        for p in {f.rstrip("$")[:n] for n in range(SHORTEST, LONGEST + 1)} & often - {f}:
            if seen[f] >= seen[p] or (against[f] < against[p] and seen[f] >= 0.9 * seen[p]):
                general.add(p)
    rules: dict[str, float] = {}
    for f in sorted(often - general, key=lambda f: (-seen[f], -len(f), f)):
        n, c = seen[f], against[f]
        if c * len(toxic) > impurity * n * n_clean or any(f.startswith(r) for r in rules):
            continue
        if n * math.log(n / (n + c) / base) + (c * math.log(c / (n + c) / (1 - base)) if c else 0) < least:
            continue
        t, q = n / len(toxic), c / n_clean
        rules[f] = (t + 1e-4) / (t + q + 2e-4)
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, seed: int = 5) -> tuple[list[str], list[str]]:
    """At most per_class toxic and as many clean texts: those with the smallest hashes of doc_id. A doc_id with several labels is toxic if one says so."""
    own = pick(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    if not counts:
        return [], []
    share = F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.2 * (per_class + 20) / c)))])
    chosen = own.withColumn("u", unit_hash(F.col("doc_id"), seed=seed)).filter(F.col("u") < share[F.col("toxic")])
    # at most about 2.4 per_class ids, whatever the size of labels
    rows = pick(docs, "doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]).toPandas()
    rows = rows.sort_values(["u", "text"], kind="stable").groupby("toxic").head(per_class)
    return rows["text"][rows["toxic"] != 0].tolist(), rows["text"][rows["toxic"] == 0].tolist()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model:
    """Rules from at most per_class labelled rows of either class; the character model from every text of docs."""
    return Model(learn(*training_rows(docs, labels, per_class)), log_probabilities(trigram_counts(docs)))


RESULT = "score double, hits array<string>"


def scorer(docs: DataFrame, model: Model):
    """A column function text -> struct of RESULT."""
    handle = docs.sparkSession.sparkContext.broadcast((model.rules, model.lm))

    @F.pandas_udf(RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*handle.value)
        for texts in batches:
            hits = []
            for lo in range(0, len(texts), 200):
                hits += score_batch(own, [t if isinstance(t, str) else None for t in texts.iloc[lo : lo + 200]])
            yield pd.DataFrame({"score": [round(probability(own, h), 6) for h in hits], "hits": [sorted({w for w, _ in h}) for h in hits]})

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """doc_id, score, hits (restored words that met a rule, sorted), toxic (score >= threshold), one row for each row.

    A null or empty text scores 0 without hits. Repeated rows score alike, whatever their copies
    are labelled. Without toxic labels there are no rules and nothing is toxic. Extra columns are
    ignored; texts are read whole.
    """
    model = model or fit(docs, labels)
    scored = pick(docs, "doc_id", "text").withColumn("r", scorer(docs, model)(F.col("text").cast("string")))
    return scored.select("doc_id", "r.score", "r.hits", (F.col("r.score") >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """The rows that aren't toxic, all columns as they were; null and empty texts stay."""
    score = scorer(docs, model or fit(docs, labels))

    def clean(text: Column) -> Column:
        return score(text.cast("string"))["score"] < threshold

    return keep_rows(docs, ["text"], clean)
