"""The trainer as loops over words and symbols, to hold the vectorised one against."""

import heapq

from glyphmill.operators.trainer import UNSIGNED, Trained


def start(words, cfg):
    """The vocabulary before any merge, ids, and the words' symbols and counts."""
    seen = {}
    for w, n in words:
        for c in w:
            seen[c] = seen.get(c, 0) + n
    for c in cfg.initial_alphabet:
        seen[c] = UNSIGNED
    kept = sorted(seen)
    if cfg.limit_alphabet is not None and len(kept) > cfg.limit_alphabet:
        kept = sorted(sorted(kept, key=lambda c: (seen[c], c))[len(kept) - cfg.limit_alphabet :])
    vocab = list(dict.fromkeys([*cfg.special_tokens, *kept]))
    ids = {t: i for i, t in enumerate(vocab)}
    prefix, suffix = cfg.continuing_subword_prefix or "", cfg.end_of_word_suffix or ""
    spelled = [[((prefix if i else "") + c + (suffix if i == len(w) - 1 else "")) for i, c in enumerate(w) if c in ids] for w, _ in words] if prefix or suffix else None
    if spelled is not None:
        for t in sorted({t for s in spelled for t in s} - ids.keys()):
            ids[t] = len(vocab)
            vocab.append(t)
        symbols = [[ids[t] for t in s] for s in spelled]
    else:
        symbols = [[ids[c] for c in w if c in ids] for w, _ in words]
    return vocab, ids, symbols, [n for _, n in words]


def train(words, cfg):
    vocab, ids, symbols, counts = start(words, cfg)
    pair_n, places = {}, {}
    for w, s in enumerate(symbols):
        for pair in zip(s, s[1:]):
            pair_n[pair] = pair_n.get(pair, 0) + counts[w]
            places.setdefault(pair, set()).add(w)
    lengths = [[1] * len(s) for s in symbols] if cfg.max_token_length is not None else None
    heap = [(-n, a, b, i) for i, ((a, b), n) in enumerate(pair_n.items()) if n > 0]
    places = {i: places[a, b] for _, a, b, i in heap}
    heapq.heapify(heap)
    ticket, merges = len(pair_n), []
    prefix = cfg.continuing_subword_prefix
    while len(vocab) < cfg.vocab_size and heap:
        negative, a, b, i = heapq.heappop(heap)
        current = pair_n[a, b] & UNSIGNED
        if -negative != current:
            heapq.heappush(heap, (-current, a, b, i))
            continue
        if current < 1 or current < cfg.min_frequency:
            break
        tail = vocab[b][len(prefix) :] if prefix and vocab[b].startswith(prefix) else vocab[b]
        token = vocab[a] + tail
        new = ids.get(token)
        if new is None:
            new = ids[token] = len(vocab)
            vocab.append(token)
        merges.append((a, b, new))
        fresh = {}
        at = places.pop(i)
        for w in at:
            old, n = symbols[w], counts[w]
            if a not in old:
                continue
            sizes = lengths[w] if lengths is not None else None
            out, out_sizes, k, end = [], [], 0, len(old)
            while k < end:
                if k + 1 < end and old[k] == a and old[k + 1] == b:
                    size = sizes[k] + sizes[k + 1] if sizes is not None else 0
                    if out:
                        p = out[-1]
                        pair_n[p, a] = pair_n.get((p, a), 0) - n
                        if sizes is None or out_sizes[-1] + size < cfg.max_token_length:
                            pair_n[p, new] = pair_n.get((p, new), 0) + n
                            fresh.setdefault((p, new), set()).add(w)
                    if k + 2 < end:
                        q = old[k + 2]
                        pair_n[b, q] = pair_n.get((b, q), 0) - n
                        if sizes is None or size + sizes[k + 2] < cfg.max_token_length:
                            pair_n[new, q] = pair_n.get((new, q), 0) + n
                            fresh.setdefault((new, q), set()).add(w)
                    out.append(new)
                    out_sizes.append(size)
                    k += 2
                else:
                    out.append(old[k])
                    if sizes is not None:
                        out_sizes.append(sizes[k])
                    k += 1
            symbols[w] = out
            if lengths is not None:
                lengths[w] = out_sizes
        for pair, at in fresh.items():
            if pair_n[pair] > 0:
                places[ticket] = at
                heapq.heappush(heap, (-pair_n[pair], *pair, ticket))
                ticket += 1
    return Trained(vocab, merges)
