"""Brute-force versions of the corpus operators."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def removed(rows, window=20):
    """n_words, n_removed and digest of the kept words, by doc_id."""
    first, split = {}, {}
    for d, t in sorted(rows):
        split[d] = words(t)
        for s in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][s : s + window]), (d, s))
    out = {}
    for d, w in split.items():
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (d, s):
                keep[s : s + window] = [False] * window
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out[d] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def shingles(text, size, lower=True):
    w = words(text, lower)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}


def components(rows, size=3, percent=90):
    """n_shingles and component_id, by doc_id."""
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def leaks(docs, items, threshold=0.8, size=5):
    """(doc_id, item_id) pairs with an item-sized window at or above the threshold."""

    def bag(w):
        return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)] if w else [])

    out = set()
    for d, t in docs:
        w = words(t, True)
        for i, x in items:
            item = words(x, True)
            if not item or not w:
                continue
            n, b = min(len(item), len(w)), bag(item)
            for s in range(len(w) - n + 1):
                a = bag(w[s : s + n])
                low = sum((a & b).values())
                if low and low >= threshold * sum((a | b).values()):
                    out.add((d, i))
                    break
    return out


def repeat_words(w, size=8):
    at = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    hit = set()
    for i in range(len(w) - size + 1):
        if at[tuple(w[i : i + size])] > 1:
            hit.update(range(i, i + size))
    return len(hit)


def log_sum(values):
    values = [v for v in values if v > -math.inf]
    if not values:
        return -math.inf
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def segmentations(marked, ids, spelled):
    """All lists of pieces that spell a string; ``spelled`` gives those of a character that is no piece."""
    if not marked:
        yield []
        return
    if marked[0] not in ids:
        for rest in segmentations(marked[1:], ids, spelled):
            yield [*spelled(marked[0]), *rest]
    for e in range(1, len(marked) + 1):
        if marked[:e] in ids:
            for rest in segmentations(marked[e:], ids, spelled):
                yield [ids[marked[:e]], *rest]


def lattice_scores(rows, held, logp, ids, spelled, rounds=2, prior=0.01, tau=2000.0):
    """Natural log probability of each text (one latent class), from (id, text) rows."""
    texts = [(held(d), [w.decode() for w in words(t, True)]) for d, t in rows]
    count = Counter(w for h, ws in texts if not h for w in ws)
    docs = sum(not h for h, _ in texts)
    paths = {w: list(segmentations("▁" + w, ids, spelled)) for _, ws in texts for w in ws}
    for _ in range(rounds):
        weight = [prior if x > -math.inf else 0.0 for x in logp]
        for w in count:
            each = [math.exp(sum(logp[i] for i in p)) for p in paths[w]]
            for p, x in zip(paths[w], each, strict=True):
                for i in p:
                    weight[i] += x / sum(each)
        total = sum(weight)
        logp = [math.log(x / total) if x else -math.inf for x in weight]
    n, v = sum(count.values()) + docs, len(count) + 1
    once, twice = (max(sum(c == k for c in count.values()), k == 1) for k in (1, 2))
    d = min(max(once / (once + 2 * twice), 0.1), 0.9)
    pieces = {w: math.exp(log_sum([sum(logp[i] for i in p) for p in paths[w]])) for w in paths}
    arc = {w: max(count[w] - d, 0) for w in paths}
    common = {w: arc[w] / n + d * v / n * pieces[w] for w in paths}
    below = {w: 0.1 * arc[w] / (n - d * v) + 0.9 * pieces[w] for w in paths}
    own = {w: arc[w] / n + d * v / n * below[w] for w in paths}
    ends = (docs - d) / n, (docs - d) / n + d * v / n * 0.1 * (docs - d) / (n - d * v)
    out = []
    for _, ws in texts:
        kinds = []
        for share, end, p in zip((1, docs + 1), ends, (common, own), strict=True):
            seen, value = Counter(), math.log(share / (docs + 2)) + math.log(tau * end / (tau + len(ws)))
            for t, w in enumerate(ws):
                value += math.log((tau * p[w] + seen[w]) / (tau + t))
                seen[w] += 1
            kinds.append(value)
        out.append(log_sum(kinds))
    return out
