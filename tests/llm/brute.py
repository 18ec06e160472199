"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def fingerprint(text, k=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    total = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            total[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * total[b] > len(shingles))


def shingles(text, k):
    words = WORD.findall((text or "").lower())
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def groups(ids, fps, distance=4):
    """The smallest id that chains of close fingerprints reach."""
    fps = np.array(fps, dtype=np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1:
            root[find(i)] = find(int(j))
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def said(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def entropy(s, window):
    best = -1.0
    for i in range(len(s) - window + 1):
        n = Counter(s[i : i + window])
        best = max(best, -sum(c / window * math.log2(c / window) for c in n.values()))
    return best


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """sizes: source -> words. The sharing as the contract tells it, step by step."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = most * sizes[s]


def backoff_scores(texts, alpha=0.4):
    docs = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    one, two = Counter(), Counter()
    for d in docs:
        one.update(d)
        two.update(zip(d, d[1:]))
    out, total = [], sum(one.values())
    for d in docs:
        own1, own2, score = Counter(d), Counter(zip(d, d[1:])), 0.0
        for i, w in enumerate(d):
            low = math.log(one[w] - own1[w] + 1) - math.log(total - len(d) + len(one) + 1)
            if i:
                c = two[d[i - 1], w] - own2[d[i - 1], w]
                low = math.log(c) - math.log(one[d[i - 1]] - own1[d[i - 1]]) if c else math.log(alpha) + low
            score += low
        out.append(score)
    return out


def all_spans(text, patterns, classes, allowed):
    """Base spans and, clear of them, the candidates whose best window's entropy reaches their class's threshold."""
    text = text or ""
    kinds = [p.kind for p in patterns]
    base = [(a, kinds.index(k), k, b) for a, _, k, b in base_spans(text)] if patterns else []
    more = []
    for rank, c in enumerate(classes, len(patterns)):
        for m in re.finditer(c.regex, text):
            s = m[0]
            if all(re.search(n, s) for n in c.needs) and not any(re.search(f, s) for f in allowed):
                s = s.lower() if c.alphabet == c.alphabet.lower() else s
                if entropy(s, c.window) >= c.threshold:
                    more.append((m.start(), rank, c.kind, m.end()))
    return sorted(base + [x for x in more if not any(a < x[3] and x[0] < b for a, _, _, b in base)])
