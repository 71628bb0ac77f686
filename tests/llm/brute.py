"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANK = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(BLANK, text or "", re.ASCII)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def remove_repeats(docs, width):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, b in data:
        for p in range(len(b) - width + 1):
            seen[b[p : p + width]] += 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def remove_passages(docs, width):
    least = defaultdict(lambda: None)
    data = [(i, words(t)) for i, t in docs]
    for i, w in data:
        for p in range(len(w) - width + 1):
            if i is not None:
                k = tuple(w[p : p + width])
                least[k] = i if least[k] is None else min(i, least[k])
    out = []
    for i, w in data:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            if i is not None and least[k] < i:
                gone[p : p + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, n=3):
    import xxhash

    w = words(lowered(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(docs, radius=3):
    prints = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                group[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        ids[top(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, f"{prints[i]:016x}", least[top(i)]) for i, (d, _) in enumerate(docs)), key=str)


def passages(docs, items, n=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for item, text in items:
        w = re.findall(pattern, lowered(text))
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[p : p + k])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = re.findall(pattern, lowered(text))
        hit, found = set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if (key := tuple(w[p : p + k])) in windows:
                    hit |= set(range(p, p + k))
                    found |= windows[key]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


def secrets(docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = [("assign", assign, 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]
    out = []
    for i, text in docs:
        spans = []
        counts = []
        for n, (kind, pattern, group, least) in enumerate(kinds):
            own = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
            counts.append(len(own))
            spans += own
        out.append((i, *counts, sha(",".join(s for _, _, s in sorted(spans)))))
    return sorted(out, key=str)


def surface(docs):
    out = []
    for i, text in docs:
        w = words(text)
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        rep = {q for p in range(len(w) - 4) if grams[tuple(w[p : p + 5])] > 1 for q in range(p, p + 5)}
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), symbols, dup, len(rep), failed))
    return sorted(out, key=str)
