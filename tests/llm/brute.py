"""Plain Python versions of what the operators compute, for small inputs."""

import hashlib
import re

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_sets(texts, k):
    out = {}
    for i, t in texts.items():
        w = [x for x in WHITE.split(lower(t)) if x]
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def linked(nodes, pairs):
    """Smallest member of each node's component."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ngram_components(texts, k, percent):
    sets = shingle_sets(texts, k)
    ids = sorted(sets)
    pairs = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return sets, linked(ids, pairs)


def repeats(texts, span=100):
    """id: (bytes, removed, runs, digest of the rest)"""
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        cut = bytearray(len(data))
        for at in range(len(data) - span + 1):
            w = data[at : at + span]
            if w in seen:
                cut[at : at + span] = b"\1" * span
            seen.add(w)
        rest = bytes(b for b, c in zip(data, cut) if not c)
        out[i] = (len(data), sum(cut), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(rest).hexdigest(), rest)
    return out


def exact(texts):
    """id: (keep_id, group size)"""
    groups = {}
    for i, t in texts.items():
        groups.setdefault(WHITE.sub("", t or ""), []).append(i)
    return {i: (min(g, key=lambda j: (-len(texts[j] or ""), j)), len(g)) for g in groups.values() for i in g}
