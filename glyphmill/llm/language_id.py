"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of CORE bytes with CONTEXT more on either side
(beyond a text's ends a boundary symbol), labels every byte of the core, and the document's
probabilities are the mean of those of its bytes. It is trained in numpy by backpropagation
through time on windows of a bounded, hashed sample of the rows that carry a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, pick, unit_hash

CORE, CONTEXT, BLOCK, EDGE = 128, 16, 1024, 256


@dataclass
class Network:
    """table: input weights by byte (2, 3H, 257); recur (2, 3H, H); bias of the candidate (2, H, 1); out (L, 2H); out_bias (L, 1). Gate rows: update, reset (both halved, for sigmoid by tanh), candidate."""

    table: np.ndarray
    recur: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    languages: list[str]

    @property
    def hidden(self) -> int:
        return self.recur.shape[2]

    def params(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.bias, self.out, self.out_bias]


def fresh(hidden: int, languages: list[str], seed: int) -> Network:
    rng = np.random.default_rng(seed)
    f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    n = len(languages)
    return Network(f(2, 3 * hidden, 257, s=0.3), f(2, 3 * hidden, hidden, s=hidden**-0.5), np.zeros((2, hidden, 1), np.float32), f(n, 2 * hidden, s=hidden**-0.5), np.zeros((n, 1), np.float32), languages)


def forward(net: Network, x: np.ndarray, trace: bool = False):
    """x: (T, B) symbols. Hidden states (T, 2, H, B) in reading order of each direction; the intermediates with trace."""
    steps, b = x.shape
    h_n = net.hidden
    states = np.empty((steps, 2, h_n, b), np.float32)
    h = np.zeros((2, h_n, b), np.float32)
    gin = np.empty((2, 3 * h_n, b), np.float32)
    rec = np.empty((2, 3 * h_n, b), np.float32)
    kept = []
    for t in range(steps):
        np.take(net.table[0], x[t], axis=1, out=gin[0], mode="clip")
        np.take(net.table[1], x[steps - 1 - t], axis=1, out=gin[1], mode="clip")
        np.matmul(net.recur, h, out=rec)
        gates = gin[:, : 2 * h_n]
        gates += rec[:, : 2 * h_n]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        inner = rec[:, 2 * h_n :]
        inner += net.bias
        cand = gin[:, 2 * h_n :]
        pre = gates[:, h_n:] * inner
        cand += pre
        np.tanh(cand, out=cand)
        if trace:
            kept.append((h.copy(), gates.copy(), inner.copy(), cand.copy()))
        np.subtract(h, cand, out=pre)
        pre *= gates[:, :h_n]
        np.add(pre, cand, out=states[t])
        h = states[t]
    return (states, kept) if trace else states


def position_probabilities(net: Network, states: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """(hi - lo, L, B) for positions lo to hi of the window."""
    h_n = net.hidden
    logits = np.matmul(net.out[:, :h_n], states[lo:hi, 0]) + np.matmul(net.out[:, h_n:], states[::-1][lo:hi, 1])
    logits += net.out_bias
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the weighted positions of (T, B) windows with labels y (B,), and its gradient by backpropagation through time."""
    steps, b = x.shape
    h_n = net.hidden
    states, kept = forward(net, x, trace=True)
    p = position_probabilities(net, states, 0, steps)
    at = weight / weight.sum()
    loss = float(-(np.log(np.take_along_axis(p, y[None, None, :], 1)[:, 0] + 1e-12) * at).sum())
    d_logits = p
    np.put_along_axis(d_logits, np.broadcast_to(y[None, None, :], (steps, 1, b)), np.take_along_axis(p, y[None, None, :], 1) - 1, 1)
    d_logits *= at[:, None, :]
    mirrored = states[::-1][:, 1]
    d_out = np.concatenate([np.einsum("tlb,thb->lh", d_logits, states[:, 0], optimize=True), np.einsum("tlb,thb->lh", d_logits, mirrored, optimize=True)], 1)
    d_out_bias = d_logits.sum((0, 2))[:, None]
    d_states = np.stack([np.matmul(net.out[:, :h_n].T, d_logits), np.matmul(net.out[:, h_n:].T, d_logits)[::-1]], 1)
    d_recur, d_bias = np.zeros_like(net.recur), np.zeros_like(net.bias)
    d_gin = np.empty((steps, 2, 3 * h_n, b), np.float32)
    back = np.zeros((2, h_n, b), np.float32)
    for t in range(steps - 1, -1, -1):
        before, gates, inner, cand = kept[t]
        z, r = gates[:, :h_n], gates[:, h_n:]
        dh = d_states[t] + back
        d_cand = dh * (1 - z) * (1 - cand * cand)
        d_z = dh * (before - cand) * z * (1 - z) * 2  # the gate's input is halved
        d_inner = d_cand * r
        d_r = d_cand * inner * r * (1 - r) * 2
        d_rec = np.concatenate([d_z, d_r, d_inner], 1)
        d_gin[t] = np.concatenate([d_z, d_r, d_cand], 1)
        d_recur += np.matmul(d_rec, before.transpose(0, 2, 1))
        d_bias += d_inner.sum(2, keepdims=True)
        back = dh * z + np.matmul(net.recur.transpose(0, 2, 1), d_rec)
    d_table = np.zeros_like(net.table)
    for d, symbols in enumerate((x, x[::-1])):
        flat = d_gin[:, d].transpose(0, 2, 1).reshape(steps * b, 3 * h_n)
        order = np.argsort(symbols.ravel(), kind="stable")
        which, first = np.unique(symbols.ravel()[order], return_index=True)
        d_table[d][:, which] = np.add.reduceat(flat[order], first, axis=0).T
    return loss, [d_table, d_recur, d_bias, d_out, d_out_bias]


def train(texts: list[str], labels: list[str], hidden: int = 8, steps: int = 300, batch: int = 192, seed: int = 7) -> Network:
    """Adam on random windows; a window's every real byte carries its text's language."""
    languages = sorted(set(labels))
    net = fresh(hidden, languages, seed)
    rng = np.random.default_rng(seed)
    raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    by = [[i for i, lang in enumerate(labels) if lang == k and len(raw[i])] for k in languages]
    by = [b or [] for b in by]
    usable = [k for k, b in enumerate(by) if b]
    if not usable:
        return net
    length = 64
    first, second = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for step in range(1, steps + 1):
        x = np.full((length, batch), EDGE, np.int64)
        y = np.array([usable[i % len(usable)] for i in range(batch)])
        for i in range(batch):
            doc = raw[by[y[i]][rng.integers(len(by[y[i]]))]]
            start = int(rng.integers(-CONTEXT, max(1, len(doc) - length // 2)))
            cut = doc[max(0, start) : start + length]
            x[max(0, -start) : max(0, -start) + len(cut), i] = cut
        weight = (x != EDGE).astype(np.float32)
        _, grads = gradients(net, x, y, weight)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, step / 20) * (0.1 ** max(0.0, (step - steps * 0.5) / (steps * 0.5)))
        for p, g, m, v in zip(net.params(), grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (CORE + 2 CONTEXT, N), the document of each window, and its number of real core bytes. Documents without bytes have none."""
    lengths = np.array([len(r) for r in raw], np.int64)
    count = -(-lengths // CORE)
    doc = np.repeat(np.arange(len(raw)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    joined = np.frombuffer(b"".join(raw), np.uint8).astype(np.int16)  # EDGE is no byte
    begin = np.cumsum(lengths) - lengths
    at = number[None, :] * CORE + np.arange(-CONTEXT, CORE + CONTEXT)[:, None]
    inside = (at >= 0) & (at < lengths[doc][None, :])
    if not len(joined):
        return np.full(at.shape, EDGE, np.int16), doc, np.zeros(len(doc), np.int64)
    x = np.where(inside, joined[np.where(inside, begin[doc][None, :] + at, 0)], np.int16(EDGE))
    return x, doc, np.minimum(CORE, lengths[doc] - number * CORE)


def label_batch(net: Network, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each text: mean probabilities (N, L), bytes labelled with each language (N, L), number of bytes, and the label of every byte."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n, n_lang = len(raw), len(net.languages)
    pooled, votes = np.zeros((n, n_lang)), np.zeros((n, n_lang), np.int64)
    sizes = np.array([len(r) for r in raw], np.int64)
    if not n_lang:
        return pooled, votes, sizes, [np.empty(0, np.int8)] * n
    x, doc, real = windows(raw)
    labels = []
    for s in range(0, x.shape[1], BLOCK):
        part = x[:, s : s + BLOCK]
        p = position_probabilities(net, forward(net, part), CONTEXT, CONTEXT + CORE)
        live = np.arange(CORE)[:, None] < real[None, s : s + BLOCK]
        best = p.argmax(1).astype(np.int8)
        p *= live[:, None, :]
        d = doc[s : s + BLOCK]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        pooled[d[first]] += np.add.reduceat(p.sum(0, dtype=np.float64), first, axis=1).T
        for k in range(n_lang):
            votes[d[first], k] += np.add.reduceat(((best == k) & live).sum(0), first)
        labels.append(best.T[live.T])
    flat = np.concatenate(labels) if labels else np.empty(0, np.int8)
    return pooled / np.maximum(sizes, 1)[:, None], votes, sizes, np.split(flat, np.cumsum(sizes)[:-1]) if n else []


def runs_of(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of equal labels."""
    if not len(labels):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    return starts, np.r_[starts[1:], len(labels)]


def training_rows(docs: DataFrame, per_language: int, seed: int = 11) -> tuple[list[str], list[str]]:
    """At most per_language texts of each language, those with the smallest hash of id, language and text (rows without doc_id are drawn like others; only equal rows go together)."""
    base = pick(docs, "doc_id", "text", "lang").filter("lang is not null and text is not null and text <> ''")
    counts = {r["lang"]: r["count"] for r in base.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    u = unit_hash(F.col("doc_id"), F.col("lang"), F.col("text"), seed=seed)
    share = F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.3 * (per_language + 20) / c)))])
    rows = base.withColumn("u", u).filter(F.col("u") < share[F.col("lang")]).select("lang", "text", "u").toPandas()
    rows = rows.sort_values(["u", "text"], kind="stable").groupby("lang", sort=True).head(per_language)
    return rows["text"].tolist(), rows["lang"].tolist()


def fit(docs: DataFrame, per_language: int = 400, hidden: int = 8, steps: int = 300) -> Network:
    """Train on at most per_language labelled rows of each language."""
    texts, langs = training_rows(docs, per_language)
    return train(texts, langs, hidden, steps)


POOLED = "lang_pred string, confidence double"
RESULT = POOLED + ", n_bytes long, n_spans long, votes array<long>, probabilities array<double>, span_ends array<long>, span_langs array<string>"


def labeller(docs: DataFrame, net: Network, schema: str = RESULT):
    """A column function text -> struct of the schema, RESULT or POOLED."""
    handle = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf(schema)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = handle.value
        for texts in batches:
            parts = []
            for lo in range(0, len(texts), 400):
                cut = texts.iloc[lo : lo + 400].tolist()
                pooled, votes, sizes, labels = label_batch(own, [t if isinstance(t, str) else None for t in cut])
                some = (sizes > 0) & bool(own.languages)
                top = pooled.argmax(1) if own.languages else np.zeros(len(cut), int)
                out = {
                    "lang_pred": [own.languages[k] if ok else None for k, ok in zip(top, some)],
                    "confidence": np.where(some, pooled.max(1) if own.languages else 0.0, 0.0).round(6),
                }
                if schema == RESULT:
                    spans = [(ends, x[starts]) for x in labels for starts, ends in [runs_of(x)]]
                    out |= {"n_bytes": sizes, "n_spans": [len(e) for e, _ in spans], "votes": votes.tolist(), "probabilities": pooled.round(6).tolist()}
                    out |= {"span_ends": [e for e, _ in spans], "span_langs": [[own.languages[k] for k in x] for _, x in spans]}
                parts.append(pd.DataFrame(out))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return label


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, lang_pred, confidence, n_bytes, n_spans, votes and probabilities (both by language in alphabetical order), span_ends and span_langs, one row for each row.

    The spans are the maximal runs of bytes with one label; each begins where the last one ends.

    A null or empty text has no language (null), confidence 0 and no bytes. Repeated rows are
    labelled alike; equal probabilities go to the first language of the alphabet. Without any
    labelled row every text stays without language. Texts are read whole, whatever their length.
    """
    net = net or fit(docs)
    return pick(docs, "doc_id", "text").withColumn("r", labeller(docs, net)(F.col("text").cast("string"))).select("doc_id", "r.*")


def label_positions(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, start, end, lang: the maximal runs of bytes with one label, end exclusive; none for null or empty texts."""
    handle = docs.sparkSession.sparkContext.broadcast(net)

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = handle.value
        for pdf in batches:
            for lo in range(0, len(pdf), 400):
                cut = pdf.iloc[lo : lo + 400]
                labels = label_batch(own, [t if isinstance(t, str) else None for t in cut["text"]])[3]
                for i, x in zip(cut["doc_id"], labels):
                    s, e = runs_of(x)
                    yield pd.DataFrame({"doc_id": np.full(len(s), i), "start": s, "end": e, "lang": np.array([own.languages[k] for k in x[s]], dtype=object)})

    return pick(docs, "doc_id", "text").filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(spans, "doc_id long, start long, end long, lang string")


def accepted(result: Column, min_confidence: float) -> Column:
    """Whether the pooled label is surer than min_confidence."""
    return result["lang_pred"].isNotNull() & (result["confidence"] >= min_confidence)


def filter_by_language(docs: DataFrame, min_confidence: float = 0.4, net: Network | None = None) -> DataFrame:
    """The rows whose text has a language with at least min_confidence, all columns as they were; null and empty texts go."""
    net = net or fit(docs)
    label = labeller(docs, net, POOLED)
    return keep_rows(docs, ["text"], lambda text: accepted(label(text.cast("string")), min_confidence))
