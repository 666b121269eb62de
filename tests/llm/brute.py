"""The operators once more, in plain Python over all rows and pairs, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter

import xxhash


def brute_prediction(model, text):
    """Language, score and rejection by dictionaries of n-grams and plain sums."""
    clean = re.sub(r"\s+", " ", f" {''.join(c if c.isalpha() else ' ' for c in (text or '').lower())} ")
    if not clean.strip():
        return "und", 0.0, True
    low = lambda x: x & 0xFFFFFFFF
    counts = Counter()
    for n in (1, 2, 3):
        for k in range(len(clean) - n + 1):
            c = [ord(x) for x in clean[k : k + n]]
            h = low(c[0] * 2654435761)
            if n > 1:
                h = low((h ^ low(c[1] * 2246822519)) * 3266489917)
            if n > 2:
                h = low((h ^ low(c[2] * 668265263)) * 374761393)
            counts[h >> 20] += 1
    weights = {d: math.log1p(n) * float(model.idf[d]) for d, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    scores = [sum(w * float(c[d]) for d, w in weights.items()) / norm for c in model.centroids]
    best = max(range(len(scores)), key=scores.__getitem__)
    middle, at = math.log2(len(counts)) - 0.5, model.limits[best]
    k = min(max(int(math.floor(middle)), 0), len(at) - 1)
    limit = at[0] if middle <= 0 else at[k] + (at[min(k + 1, len(at) - 1)] - at[k]) * (middle - k)
    return model.langs[best], scores[best], scores[best] < limit


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    counts = Counter(k for p in parts for h in [xxhash.xxh64_intdigest(p.encode(), seed=42)] for k in range(64) if h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(parts))


def brute_components(values):
    parent = {v: v for v in values}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def brute_queue(rows, packet, max_epochs=3):
    """Targets, words taken by row, and the (row, epoch) pairs served, from one heap of the sources' next packets, served
    until the budget is spent."""
    by_source = {}
    for k, (i, source, text) in enumerate(rows):
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        key = hashlib.md5(f"{'' if i is None else i}|{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        by_source.setdefault(source, []).append((key, k, size))
    targets = brute_targets({s: sum(x[2] for x in q) for s, q in by_source.items()})

    def packets(source):
        done = 0
        for epoch in range(max_epochs):
            for _, k, size in sorted(by_source[source]):
                for at in range(0, size, packet):
                    words = min(packet, size - at)
                    done += words
                    yield done / targets[source], source is None, source or "", done, k, words, epoch

    lines = {s: packets(s) for s, q in by_source.items() if sum(x[2] for x in q)}
    heap = [next(line) for line in lines.values()]
    heapq.heapify(heap)
    budget, taken, copies = sum(x[2] for q in by_source.values() for x in q), Counter(), set()
    while budget and heap:
        _, null, source, _, k, words, epoch = heap[0]
        taken[k] += min(words, budget)
        copies.add((k, epoch))
        budget -= min(words, budget)
        following = next(lines[None if null else source], None)
        heapq.heapreplace(heap, following) if following else heapq.heappop(heap)
    return targets, taken, copies


def _chunks_of(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn, role or "", text or ""))
    turn_id = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{len(r[2].encode())}:{r[2]}".encode()).hexdigest()[:32] + str(len(r[2]))
    return {c: [r[1:] for r in sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, turn_id(r)))] for c, turns in by.items()}


def brute_trie(rows, shared):
    """Nodes by their whole sequences, from dictionaries of members."""
    own = _chunks_of(rows)
    built = own
    if shared:
        built = {}
        for c, turns in own.items():
            h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
            built[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [v for v in members if v[: len(node)] == node]
        has_child = {v[:-1] for v in members if v}
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        out.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                sum(v[:-1] == node for v in members if v),
                sum(v not in has_child for v in below),
                sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def brute_spelling(rows, one_in=199, ratio=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w in n:
        about = [v for v in n if near(w, v)]
        best = min(about, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = n[w], len(about), n[best] if form[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), *out[w]) for w in n)
